"""Block structure: containers, leaves and link definitions, line by line, with an explicit stack of open blocks."""

from __future__ import annotations

import re
from bisect import bisect_right

from citegraph.markdown.inline import HTML_TAG, _LABEL, destination_end, normalize_label, skip_blanks, title_end

_LINE = re.compile(r"\r\n|\n|\r")
_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_ATX_CLOSE = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_FENCE = re.compile(r"`{3,}(?=[^`]*$)|~{3,}")
_FENCE_CLOSE = re.compile(r"(`{3,}|~{3,})[ \t]*$")
_BREAK = re.compile(r"(?:\*[ \t]*){3,}$|(?:_[ \t]*){3,}$|(?:-[ \t]*){3,}$")
_MARKER = re.compile(r"([*+-])|([0-9]{1,9})([.)])")
_HTML_TAGS = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|"
    "frameset|h[123456]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|"
    "tfoot|th|thead|title|tr|track|ul"
)
_HTML_OPEN = (
    re.compile(r"<(?:script|pre|textarea|style)(?:\s|>|$)", re.I),
    re.compile(r"<!--"),
    re.compile(r"<[?]"),
    re.compile(r"<![A-Za-z]"),
    re.compile(r"<!\[CDATA\["),
    re.compile(rf"</?(?:{_HTML_TAGS})(?:\s|/?>|$)", re.I),
    re.compile(rf"(?:{HTML_TAG.pattern.split('|<!-->')[0]})\s*$", re.I),
)
_HTML_CLOSE = (re.compile(r"</(?:script|pre|textarea|style)>", re.I), re.compile(r"-->"), re.compile(r"\?>"), re.compile(r">"), re.compile(r"\]\]>"))
_LEAVES = {"paragraph", "heading", "code", "html", "thematicBreak"}


class Block:
    __slots__ = ("type", "children", "parent", "begin", "end", "depth", "text", "starts", "lines", "data")

    def __init__(self, type_: str, begin: int, parent: Block | None) -> None:
        self.type, self.begin, self.end, self.parent = type_, begin, begin, parent
        self.children: list[Block] = []
        self.depth = 0
        self.text, self.starts = "", []  # inline content and the source offset of each character
        self.lines: list[tuple[int, str]] = []
        self.data: dict = {}


class Lines:
    """Markdown lines of a text: LF, CRLF and a lone CR all end one."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.starts, self.texts = [0], []
        last = 0
        for found in _LINE.finditer(source):
            self.texts.append(source[last : found.start()])
            last = found.end()
            self.starts.append(last)
        self.texts.append(source[last:])

    def line_of(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1

    def position(self, offset: int) -> tuple[int, int]:
        """Zero-based line and character, in UTF-16 code units."""
        line = self.line_of(offset)
        part = self.source[self.starts[line] : offset]
        return line, len(part) + sum(c > "￿" for c in part)

    def starts_search_line(self, line: int) -> bool:
        start = self.starts[line]
        return start == 0 or self.source[start - 1] == "\n"


class BlockParser:
    def __init__(self, source: str) -> None:
        self.lines = Lines(source)
        self.root = Block("root", 0, None)
        self.open: list[Block] = [self.root]
        self.labels: set[str] = set()

    # -- the current line ---------------------------------------------------

    def _advance(self, count: int, columns: bool = False) -> None:
        line = self.line
        while count > 0 and self.offset < len(line):
            if line[self.offset] == "\t":
                width = 4 - self.column % 4
                if columns:
                    self.partial = width > count
                    step = min(count, width)
                    self.column += step
                    self.offset += not self.partial
                    count -= step
                else:
                    self.partial = False
                    self.column += width
                    self.offset += 1
                    count -= 1
            else:
                self.partial = False
                self.offset += 1
                self.column += 1
                count -= 1

    def _look(self) -> None:
        """Find the next character that is no blank; once for each run of blanks, however many containers look."""
        if self.offset <= self.next:
            self.indent = self.next_column - self.column
            return
        line, at, column = self.line, self.offset, self.column
        while at < len(line) and line[at] in " \t":
            column += 4 - column % 4 if line[at] == "\t" else 1
            at += 1
        self.next, self.next_column = at, column
        self.blank = at == len(line)
        self.indent = column - self.column

    def _skip_indent(self) -> None:
        self.offset, self.column, self.partial = self.next, self.next_column, False

    # -- parsing --------------------------------------------------------------

    def parse(self) -> Block:
        source = self.lines.source
        texts = self.lines.texts
        count = len(texts) - (texts[-1] == "")
        for number in range(count):
            self.line = texts[number]
            self.start = self.lines.starts[number]
            self.offset = self.column = 0
            self.next = -1
            self.partial = False
            if number == 0 and source.startswith("﻿"):
                self.offset = 1  # a byte order mark is no content
            self._line()
        self.line, self.start, self.offset = "", len(source), 0
        while len(self.open) > 1:
            self._close()
        return self.root

    def _close(self) -> Block:
        block = self.open.pop()
        if block.type == "paragraph":
            self._content(block)
            self._definitions(block)
            if not block.text:
                block.parent.children.remove(block)
        return block

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self._close()

    def _add(self, type_: str, begin: int) -> Block:
        while self.open[-1].type in _LEAVES or (self.open[-1].type == "list") != (type_ == "item"):
            self._close()
        block = Block(type_, self.start + begin, self.open[-1])
        self.open[-1].children.append(block)
        self.open.append(block)
        return block

    def _line(self) -> None:
        depth = 1
        while depth < len(self.open):
            block = self.open[depth]
            self._look()
            going = self._continues(block)
            if going is None:
                return  # the line was used up, as a closing fence is
            if not going:
                break
            depth += 1
        matched = depth
        last = self.open[matched - 1]
        self.closed_to = None
        starting = last.type not in ("code", "html")
        started = False
        while starting:
            self._look()
            if self.indent < 4 and not self.blank and self.line[self.next] not in "#`~*+_=<>-0123456789":
                break
            kind = self._start(matched, started)
            if kind == "leaf":
                return
            if kind is None:
                break
            started = True
            matched = len(self.open)
            if self.open[-1].type in ("code", "html"):
                break
        self._look()
        tip = self.open[-1]
        if matched < len(self.open) and not started and not self.blank and tip.type == "paragraph":
            self._add_line(tip)  # lazy continuation
            return
        self._close_to(matched)
        tip = self.open[-1]
        if tip.type in ("code", "html"):
            if tip.type == "html":
                self._add_raw(tip)
                kind = tip.data["kind"]
                if kind < 5 and _HTML_CLOSE[kind].search(self.line, self.offset):
                    self._close()
            else:
                tip.end = self.start + len(self.line)
            return
        if self.blank:
            for block in self.open:
                block.data["blank"] = True
            if tip.type == "paragraph":
                self._close()
            return
        if tip.type == "paragraph":
            self._add_line(tip)
        else:
            self._skip_indent()
            self._add_line(self._add("paragraph", self.offset))

    def _continues(self, block: Block) -> bool | None:
        kind = block.type
        if kind == "blockquote":
            if self.indent < 4 and not self.blank and self.line[self.next] == ">":
                self._skip_indent()
                self._advance(1)
                if self.offset < len(self.line) and self.line[self.offset] in " \t":
                    self._advance(1, columns=True)
                return True
            return False
        if kind == "list":
            return True
        if kind == "item":
            if self.blank:
                if not block.children:
                    return False
                self._skip_indent()
                return True
            need = block.data["indent"] + block.data["padding"]
            if self.indent >= need:
                self._advance(need, columns=True)
                return True
            return False
        if kind == "code":
            if block.data["fence"]:
                if self.indent < 4 and not self.blank:
                    found = _FENCE_CLOSE.match(self.line, self.next)
                    if found and found[1][0] == block.data["fence"][0] and len(found[1]) >= len(block.data["fence"]):
                        depth = self.open.index(block)
                        self._close_to(depth)
                        return None
                self._advance(min(self.indent, block.data["indent"]), columns=True)
                return True
            if self.indent >= 4:
                self._advance(4, columns=True)
                return True
            if self.blank:
                self._skip_indent()
                return True
            return False
        if kind == "html":
            return not (self.blank and block.data["kind"] >= 5)
        if kind == "paragraph":
            return not self.blank
        return False

    def _start(self, matched: int, started: bool) -> str | None:
        """Open a block that begins here; 'leaf' if it takes the whole line, 'container' if more may follow."""
        paragraph = self.open[-1].type == "paragraph" and (matched == len(self.open))
        holder = self.open[matched - 1]
        if self.indent >= 4:
            if self.open[-1].type != "paragraph" and not self.blank:
                self._advance(4, columns=True)
                self._close_to(matched)
                self._add("code", self.offset).data = {"fence": "", "indent": 0}
                return "leaf"
            return None
        if self.blank:
            return None
        line, at = self.line, self.next
        char = line[at]
        if char == ">":
            self._skip_indent()
            begin = self.offset
            self._advance(1)
            if self.offset < len(line) and line[self.offset] in " \t":
                self._advance(1, columns=True)
            self._close_to(matched)
            self._add("blockquote", begin)
            return "container"
        if char == "#" and (found := _ATX.match(line, at)):
            self._close_to(matched)
            heading = self._add("heading", at)
            heading.depth = len(found[1])
            body = line[found.end() :]
            close = _ATX_CLOSE.search(body)
            if close:
                body = body[: close.start()]
            heading.text = body
            first = self.start + found.end()
            heading.starts = list(range(first, first + len(body)))
            heading.end = self.start + len(line.rstrip(" \t"))
            self.open.pop()
            return "leaf"
        if char in "`~" and (found := _FENCE.match(line, at)):
            self._close_to(matched)
            code = self._add("code", at)
            code.data = {"fence": found[0], "indent": self.indent}
            return "leaf"
        if char == "<":
            for kind, pattern in enumerate(_HTML_OPEN):
                if pattern.match(line, at) and (kind < 6 or self.open[-1].type != "paragraph"):
                    self._close_to(matched)
                    html = self._add("html", at)
                    html.data = {"kind": kind}
                    self._add_raw(html)
                    if kind < 5 and _HTML_CLOSE[kind].search(line, at + (4 if kind == 1 else 2)):
                        self._close()
                    return "leaf"
        if paragraph and (found := _SETEXT.match(line, at)):
            block = self.open[-1]
            self._content(block)
            self._definitions(block)
            if block.text:
                block.type, block.depth = "heading", 1 if found[1][0] == "=" else 2
                block.end = self.start + len(line.rstrip(" \t"))
                self.open.pop()
                return "leaf"
            block.lines = []
            block.parent.children.remove(block)
            self.open.pop()
            matched -= 1
        if _BREAK.match(line, at):
            self._close_to(matched)
            self._add("thematicBreak", at)
            self.open.pop()
            return "leaf"
        return self._start_item(matched, holder)

    def _start_item(self, matched: int, holder: Block) -> str | None:
        line, at = self.line, self.next
        found = _MARKER.match(line, at)
        if not found:
            return None
        after = line[found.end() : found.end() + 1]
        if after and after not in " \t":
            return None
        if self.open[-1].type == "paragraph" and matched == len(self.open):
            if not line[found.end() :].strip(" \t") or (found[2] and int(found[2]) != 1):
                return None
        indent = self.indent
        self._skip_indent()
        begin = self.offset
        self._advance(len(found[0]))
        width, column, offset = len(found[0]), self.column, self.offset
        self._look()
        spaces = self.indent
        if self.blank or spaces >= 5:
            padding = width + 1
            if offset < len(line) and line[offset] in " \t":
                self._advance(1, columns=True)
        else:
            padding = width + spaces
            self._advance(max(1, spaces), columns=True)
        self._close_to(matched)
        mark = found[1] or found[3]
        while self.open[-1].type in _LEAVES:
            self._close()
        if self.open[-1].type != "list" or self.open[-1].data["mark"] != mark:
            if self.open[-1].type == "list":
                self._close()
            self._add("list", begin).data = {"mark": mark}
        self._add("item", begin).data = {"indent": indent, "padding": padding}
        return "container"

    # -- leaves ---------------------------------------------------------------

    def _add_line(self, paragraph: Block) -> None:
        self._skip_indent()
        paragraph.lines.append((self.start + self.offset, self.line[self.offset :]))
        paragraph.end = self.start + len(self.line)

    def _add_raw(self, block: Block) -> None:
        block.end = self.start + len(self.line)

    def _content(self, block: Block) -> None:
        """Join a paragraph's lines; a line feed stands where a line ended."""
        starts: list[int] = []
        for i, (offset, text) in enumerate(block.lines):
            if i:
                before, line = block.lines[i - 1]
                starts.append(before + len(line))
            starts.extend(range(offset, offset + len(text)))
        block.text, block.starts = "\n".join(text for _, text in block.lines), starts

    def _definitions(self, block: Block) -> None:
        """Take link reference definitions off the paragraph's beginning."""
        text, at = block.text, 0
        while text.startswith("[", at):
            end = self._definition(text, at)
            if end is None:
                break
            at = end
        if at:
            block.text, block.starts = text[at:], block.starts[at:]
            if not block.text.strip(" \t\n"):
                block.text, block.starts = "", []
            elif block.starts:
                block.begin = block.starts[0]

    def _definition(self, text: str, at: int) -> int | None:
        label = _LABEL.match(text, at)
        if not label or not label[1].strip(" \t\n") or not text.startswith(":", label.end()):
            return None
        begin = skip_blanks(text, label.end() + 1)
        end = destination_end(text, begin)
        if end is None or end == begin:
            return None
        done = None
        line = re.compile(r"[ \t]*(?:\n|$)").match(text, end)
        if line:
            done = line.end()
        title = skip_blanks(text, end)
        if title > end and (close := title_end(text, title)) is not None:
            rest = re.compile(r"[ \t]*(?:\n|$)").match(text, close)
            if rest:
                done = rest.end()
        if done is not None:
            self.labels.add(normalize_label(label[1]))
        return done


def parse_blocks(source: str) -> tuple[Block, Lines, set[str]]:
    parser = BlockParser(source)
    root = parser.parse()
    return root, parser.lines, parser.labels
