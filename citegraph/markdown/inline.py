"""Inline structure: code spans, emphasis, links, images, raw HTML, breaks, escapes and character references.

The subject is the text of one block with, for every character, its offset in the source document.
"""

from __future__ import annotations

import re
import unicodedata
from html.entities import html5

ESCAPABLE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SPECIAL = re.compile(r"[\n`\[\]\\!<&*_]")
_TICKS = re.compile(r"`+")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]{1,31}));")
_AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9.+-]{1,31}:[^<>\x00-\x20]*>")
_EMAIL = re.compile(
    r"<[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*>"
)
_ATTRIBUTE = r"(?:\s+[a-zA-Z_:][a-zA-Z0-9:._-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
HTML_TAG = re.compile(
    rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>|<!-->|<!--->|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>"
)
_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\[\s\S]){0,999})\]")
_BLANKS = " \t\n"


class Node:
    """An inline node; ``starts`` has the source offset of each character of a text's value."""

    __slots__ = ("type", "value", "starts", "begin", "end", "children", "prev", "next")

    def __init__(self, type_: str, value: str = "", starts: list[int] | None = None, begin: int = 0, end: int = 0) -> None:
        self.type, self.value, self.starts, self.begin, self.end = type_, value, starts or [], begin, end
        self.children: list[Node] = []
        self.prev: Node | None = None
        self.next: Node | None = None


class _Delimiter:
    __slots__ = ("node", "char", "count", "original", "opens", "closes", "prev", "next")

    def __init__(self, node, char, count, opens, closes) -> None:
        self.node, self.char, self.count, self.original, self.opens, self.closes = node, char, count, count, opens, closes
        self.prev = self.next = None


class _Bracket:
    __slots__ = ("node", "image", "active", "at", "delimiter", "followed")

    def __init__(self, node, image, at, delimiter) -> None:
        self.node, self.image, self.at, self.delimiter = node, image, at, delimiter
        self.active, self.followed = True, False


def decode_reference(match: re.Match) -> str | None:
    """The characters of a character reference; None for an unknown name."""
    hexadecimal, decimal, name = match.groups()
    if name:
        return html5.get(name + ";")
    code = int(hexadecimal, 16) if hexadecimal else int(decimal)
    invalid = (
        code < 9
        or code == 11
        or 13 < code < 32
        or 126 < code < 160
        or 0xD7FF < code < 0xE000
        or 0xFDCF < code < 0xFDF0
        or code & 0xFFFF in (0xFFFE, 0xFFFF)
        or code > 0x10FFFF
    )
    return "�" if invalid else chr(code)


def normalize_label(label: str) -> str:
    return re.sub(r"[ \t\r\n]+", " ", label.strip(" \t\r\n")).casefold().upper().casefold()


def _is_punctuation(char: str) -> bool:
    return char in ESCAPABLE or unicodedata.category(char)[0] in "PS"


class InlineParser:
    def __init__(self, subject: str, starts: list[int], labels: set[str]) -> None:
        self.subject, self.starts, self.labels = subject, starts, labels
        self.at = 0
        self.head = Node("root")
        self.tail = self.head
        self.delimiters: _Delimiter | None = None
        self.brackets: list[_Bracket] = []
        self.missing_ticks: set[int] = set()
        self.ticks_from: dict[int, list[int]] | None = None

    # -- the list of nodes at this level ---------------------------------

    def _append(self, node: Node) -> Node:
        node.prev, node.next = self.tail, None
        self.tail.next = node
        self.tail = node
        return node

    def _insert_after(self, place: Node, node: Node) -> None:
        node.prev, node.next = place, place.next
        if place.next:
            place.next.prev = node
        else:
            self.tail = node
        place.next = node

    def _unlink(self, node: Node) -> None:
        node.prev.next = node.next
        if node.next:
            node.next.prev = node.prev
        else:
            self.tail = node.prev
        node.prev = node.next = None

    def _text(self, begin: int, end: int) -> Node:
        return self._append(Node("text", self.subject[begin:end], self.starts[begin:end], self._source(begin), self._source_end(end)))

    def _source(self, i: int) -> int:
        return self.starts[i] if i < len(self.starts) else self._source_end(i)

    def _source_end(self, i: int) -> int:
        """Source offset just behind subject[i - 1]."""
        return self.starts[i - 1] + 1 if i else (self.starts[0] if self.starts else 0)

    # -- parsing ----------------------------------------------------------

    def parse(self) -> list[Node]:
        subject, size = self.subject, len(self.subject)
        while self.at < size:
            found = _SPECIAL.search(subject, self.at)
            stop = found.start() if found else size
            if stop > self.at:
                self._text(self.at, stop)
                self.at = stop
                continue
            char = subject[self.at]
            if char == "\n":
                self._newline()
            elif char == "\\":
                self._backslash()
            elif char == "`":
                self._code()
            elif char in "*_":
                self._delimiter_run(char)
            elif char == "[":
                self._open_bracket(False)
            elif char == "!":
                if subject.startswith("![", self.at):
                    self._open_bracket(True)
                else:
                    self._one()
            elif char == "]":
                self._close_bracket()
            elif char == "<":
                self._angle()
            else:
                self._ampersand()
        self._emphasis(None)
        return _merged(_listed(self.head.next))

    def _one(self, length: int = 1) -> None:
        self._text(self.at, self.at + length)
        self.at += length

    def _newline(self) -> None:
        """A soft break stays in the text; two blanks before it make a hard one."""
        last = self.tail
        at = self.at
        hard = False
        if last.type == "text" and last.value.endswith(" ") and last.starts and last.starts[-1] == self.starts[at - 1]:
            stripped = last.value.rstrip(" ")
            hard = len(last.value) - len(stripped) >= 2
            last.starts = last.starts[: len(stripped)]
            last.value = stripped
            last.end = last.starts[-1] + 1 if last.starts else last.begin
        if hard:
            self._append(Node("break", begin=self._source(at), end=self._source_end(at + 1)))
        else:
            self._text(at, at + 1)
        self.at += 1
        while self.at < len(self.subject) and self.subject[self.at] == " ":
            self.at += 1

    def _backslash(self) -> None:
        following = self.subject[self.at + 1 : self.at + 2]
        if following == "\n":
            self._append(Node("break", begin=self._source(self.at), end=self._source_end(self.at + 2)))
            self.at += 2
            while self.at < len(self.subject) and self.subject[self.at] == " ":
                self.at += 1
        elif following in ESCAPABLE and following:
            self._append(Node("text", following, [self._source(self.at)], self._source(self.at), self._source_end(self.at + 2)))
            self.at += 2
        else:
            self._one()

    def _code(self) -> None:
        run = _TICKS.match(self.subject, self.at)
        length = len(run[0])
        if self.ticks_from is None:  # where the runs of each length are, found once
            self.ticks_from = {}
            for tick in _TICKS.finditer(self.subject):
                self.ticks_from.setdefault(len(tick[0]), []).append(tick.start())
        places = self.ticks_from[length]
        lo, hi = 0, len(places)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if places[mid] < run.end() else (lo, mid)
        if lo == len(places):
            self._one(length)
            return
        close = places[lo]
        begin, end = run.end(), close
        value = self.subject[begin:end].replace("\n", " ")
        if len(value) >= 2 and value[0] == value[-1] == " " and value.strip(" "):
            begin, end, value = begin + 1, end - 1, value[1:-1]
        self._append(Node("inlineCode", value, self.starts[begin:end], self._source(self.at), self._source_end(close + length)))
        self.at = close + length

    def _ampersand(self) -> None:
        found = _ENTITY.match(self.subject, self.at)
        value = decode_reference(found) if found else None
        if value is None:
            self._one()
            return
        begin = self._source(self.at)
        self._append(Node("text", value, [begin] * len(value), begin, self._source_end(found.end())))
        self.at = found.end()

    def _angle(self) -> None:
        for pattern in (_AUTOLINK, _EMAIL):
            found = pattern.match(self.subject, self.at)
            if found:
                a, b = self.at + 1, found.end() - 1
                link = Node("link", begin=self._source(self.at), end=self._source_end(found.end()))
                link.children = [Node("text", self.subject[a:b], self.starts[a:b], self._source(a), self._source_end(b))]
                self._append(link)
                self.at = found.end()
                return
        found = HTML_TAG.match(self.subject, self.at)
        if found:
            self._append(Node("html", found[0], self.starts[self.at : found.end()], self._source(self.at), self._source_end(found.end())))
            self.at = found.end()
        else:
            self._one()

    def _delimiter_run(self, char: str) -> None:
        begin, size = self.at, len(self.subject)
        end = begin
        while end < size and self.subject[end] == char:
            end += 1
        before = self.subject[begin - 1] if begin else "\n"
        after = self.subject[end] if end < size else "\n"
        blank_b, blank_a = before.isspace(), after.isspace()
        sign_b, sign_a = _is_punctuation(before), _is_punctuation(after)
        left = not blank_a and (not sign_a or blank_b or sign_b)
        right = not blank_b and (not sign_b or blank_a or sign_a)
        if char == "_":
            opens, closes = left and (not right or sign_b), right and (not left or sign_a)
        else:
            opens, closes = left, right
        node = self._text(begin, end)
        self.at = end
        if opens or closes:
            self._push(_Delimiter(node, char, end - begin, opens, closes))

    def _push(self, delimiter: _Delimiter) -> None:
        delimiter.prev = self.delimiters
        if self.delimiters:
            self.delimiters.next = delimiter
        self.delimiters = delimiter

    def _drop(self, delimiter: _Delimiter) -> None:
        if delimiter.prev:
            delimiter.prev.next = delimiter.next
        if delimiter.next:
            delimiter.next.prev = delimiter.prev
        else:
            self.delimiters = delimiter.prev

    def _emphasis(self, bottom: _Delimiter | None) -> None:
        openers_bottom: dict[tuple, _Delimiter | None] = {}
        closer = self.delimiters
        while closer and closer.prev is not bottom:
            closer = closer.prev
        while closer:
            if not closer.closes:
                closer = closer.next
                continue
            key = (closer.char, closer.opens, closer.original % 3)
            floor = openers_bottom.get(key, bottom)
            opener = closer.prev
            found = False
            while opener and opener is not bottom and opener is not floor:
                odd = (closer.opens or opener.closes) and closer.original % 3 != 0 and (opener.original + closer.original) % 3 == 0
                if opener.char == closer.char and opener.opens and not odd:
                    found = True
                    break
                opener = opener.prev
            old = closer
            if not found:
                openers_bottom[key] = old.prev
                closer = closer.next
                if not old.opens:
                    self._drop(old)
                continue
            use = 2 if closer.count >= 2 and opener.count >= 2 else 1
            left, right = opener.node, closer.node
            wrap = Node("strong" if use == 2 else "emphasis", begin=left.end - use, end=right.begin + use)
            inner, run = left.next, []
            while inner is not right:
                following = inner.next
                run.append(inner)
                inner = following
            # The nodes between move under the new one in one step.
            left.next, right.prev = right, left
            for child in run:
                child.prev = child.next = None
            wrap.children = run
            self._insert_after(left, wrap)
            for node, delimiter, at_end in ((left, opener, True), (right, closer, False)):
                delimiter.count -= use
                if at_end:
                    node.value, node.starts, node.end = node.value[:-use], node.starts[:-use], node.end - use
                else:
                    node.value, node.starts, node.begin = node.value[use:], node.starts[use:], node.begin + use
            opener.next, closer.prev = closer, opener  # delimiters between them are done with
            if not opener.count:
                self._unlink(left)
                self._drop(opener)
            if not closer.count:
                self._unlink(right)
                following = closer.next
                self._drop(closer)
                closer = following
        while self.delimiters and self.delimiters is not bottom:
            self._drop(self.delimiters)

    # -- links ------------------------------------------------------------

    def _open_bracket(self, image: bool) -> None:
        if self.brackets:
            self.brackets[-1].followed = True
        node = self._text(self.at, self.at + 1 + image)
        self.at += 1 + image
        self.brackets.append(_Bracket(node, image, self.at, self.delimiters))

    def _close_bracket(self) -> None:
        close = self.at
        if not self.brackets:
            self._one()
            return
        opener = self.brackets[-1]
        if not opener.active:
            self.brackets.pop()
            self._one()
            return
        kind, end = self._resource(close + 1)
        if not kind:
            label = _LABEL.match(self.subject, close + 1)
            if label and label[1].strip(_BLANKS):
                if normalize_label(label[1]) in self.labels:
                    kind, end = "Reference", label.end()
            elif not opener.followed or label:
                text = self.subject[opener.at : close]
                if len(text) <= 999 and text.strip(_BLANKS) and normalize_label(text) in self.labels and not opener.followed:
                    kind, end = "Reference", label.end() if label else close + 1
            if not kind and label and label[1].strip(_BLANKS):
                text = None  # a full reference to nothing is no shortcut either
        if not kind:
            self.brackets.pop()
            self._one()
            return
        link = Node(("image" if opener.image else "link") + (kind if kind == "Reference" else ""), begin=opener.node.begin, end=self._source_end(end))
        self._emphasis(opener.delimiter)
        children, node = [], opener.node.next
        while node:
            following = node.next
            node.prev = node.next = None
            children.append(node)
            node = following
        opener.node.next, self.tail = None, opener.node
        link.children = children
        self._unlink(opener.node)
        if opener.image:
            link.value = plain_text(link.children)
            link.children = []
        self._append(link)
        self.brackets.pop()
        if not opener.image:
            for other in reversed(self.brackets):
                if not other.image:
                    if not other.active:
                        break
                    other.active = False
        self.at = end

    def _resource(self, at: int) -> tuple[str, int]:
        """'(destination "title")' from ``at``: its kind and end, or no kind."""
        subject = self.subject
        if not subject.startswith("(", at):
            return "", at
        at = skip_blanks(subject, at + 1)
        if subject.startswith(")", at):
            return "Resource", at + 1
        end = destination_end(subject, at)
        if end is None:
            return "", at
        at = skip_blanks(subject, end)
        if at > end:
            title = title_end(subject, at)
            if title is not None:
                at = skip_blanks(subject, title)
        return ("Resource", at + 1) if subject.startswith(")", at) else ("", at)


def skip_blanks(text: str, at: int) -> int:
    while at < len(text) and text[at] in _BLANKS:
        at += 1
    return at


def destination_end(text: str, at: int) -> int | None:
    if text.startswith("<", at):
        found = re.compile(r"<(?:[^<>\n\\]|\\.)*>").match(text, at)
        return found.end() if found else None
    depth, begin = 0, at
    while at < len(text):
        char = text[at]
        if char == "\\" and text[at + 1 : at + 2] in ESCAPABLE and at + 1 < len(text):
            at += 2
            continue
        if char == "(":
            depth += 1
            if depth > 32:
                return None
        elif char == ")":
            if not depth:
                break
            depth -= 1
        elif char <= " " or char == "\x7f":
            break
        at += 1
    return at if not depth and (at > begin or text.startswith(")", at)) else None


def title_end(text: str, at: int) -> int | None:
    close = {'"': '"', "'": "'", "(": ")"}.get(text[at : at + 1])
    if close is None:
        return None
    opening = text[at]
    at += 1
    while at < len(text):
        char = text[at]
        if char == "\\":
            at += 2
            continue
        if char == close:
            return at + 1
        if opening == "(" and char == "(":
            return None
        at += 1
    return None


def _listed(node: Node | None) -> list[Node]:
    nodes = []
    while node:
        nodes.append(node)
        node = node.next
    return nodes


def _merged(nodes: list[Node]) -> list[Node]:
    """Neighbouring texts become one, at every depth; empty ones go."""
    top: list[Node] = []
    work = [(nodes, top)]
    while work:
        source, target = work.pop()
        run: list[Node] = []
        for node in [*source, None]:
            if node is not None and node.type == "text":
                if node.value:
                    run.append(node)
                continue
            if run:
                starts = [offset for text in run for offset in text.starts]
                target.append(run[0] if len(run) == 1 else Node("text", "".join(text.value for text in run), starts, run[0].begin, run[-1].end))
                run = []
            if node is not None:
                if node.children:
                    children, node.children = node.children, []
                    work.append((children, node.children))
                target.append(node)
    return top


def plain_text(nodes: list[Node]) -> str:
    """A node's value, else an image's alternative text, else its children's text."""
    parts, stack = [], list(reversed(nodes))
    while stack:
        node = stack.pop()
        if node.value:
            parts.append(node.value)
        else:
            stack.extend(reversed(node.children))
    return "".join(parts)


def parse_inlines(subject: str, starts: list[int], labels: set[str]) -> list[Node]:
    begin, end = 0, len(subject)
    while begin < end and subject[begin] in " \t\n":
        begin += 1
    while end > begin and subject[end - 1] in " \t\n":
        end -= 1
    return InlineParser(subject[begin:end], starts[begin:end], labels).parse()
