"""What the rules need to know of one document: headings, References entries, citations.

Everything that depends on the parse or on exact source positions is settled here, per document; dispositions, joins and
reports are relational and live elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from citegraph.functions import grammar as g
from citegraph.markdown.block import Block, Lines, parse_blocks
from citegraph.markdown.inline import Node, parse_inlines

REFERENCES = "References"
_BR = re.compile(r"<br(?=[\s/>])", re.I)
_KEYWORD = re.compile("[Ss]ee|[Pp]er")
_ENTRY_LINE = re.compile(rf"[{re.escape(g.JS_WS_CHARS)}]*(?:[-*+]|[0-9]+[.)])[{re.escape(g.JS_WS_CHARS)}]*\[?")
_TERMINATORS = set(",;:)]}\"'!?")
_ALNUM = re.compile("[0-9A-Za-z]")
_INLINE = re.compile(r"[`\[\]\\!<&*_]")
#: Keyword, gap, candidate.
CITED = re.compile(f"(see|See|per|Per)([{re.escape(g.JS_WS_CHARS)}]+)([0-9][0-9.#]*)")
_MARKUP = str.maketrans("", "", "*_`\\")


class TooComplex(ValueError):
    """A document beyond the stage's budget: it is reported as unparsable."""


@dataclass
class Segment:
    kind: str  # text, code, break or other
    text: str
    starts: list[int]  # source offset of each character, where known
    begin: int
    end: int
    wrappers: tuple[str, ...] = ()


@dataclass
class Facts:
    headings: list[dict] = field(default_factory=list)
    references: dict | None = None
    entries: list[dict] = field(default_factory=list)
    runs: list[dict] = field(default_factory=list)
    citations: list[dict] = field(default_factory=list)


def quiet(text: str) -> bool:
    """Whether a paragraph holds no citation for sure: without its markup, no keyword stands before a number.

    Of emphasis, code and escapes the visible text only loses characters that are dropped here, too.
    """
    if _INLINE.search(text) is None:
        return CITED.search(text) is None
    if "<" in text or "&" in text or "[" in text:
        return False
    return CITED.search(text.translate(_MARKUP)) is None


def node_segments(nodes: list[Node]) -> list[Segment]:
    """A node's value, else an image's alternative text, else its children: the literal pieces of an entry or a heading."""
    found, stack = [], list(reversed(nodes))
    while stack:
        node = stack.pop()
        if node.type in ("text", "inlineCode", "html"):
            kind = {"text": "text", "inlineCode": "code"}.get(node.type, "other")
            found.append(Segment(kind, node.value, node.starts, node.begin, node.end))
        elif node.value:
            found.append(Segment("other", node.value, [], node.begin, node.end))
        else:
            stack.extend(reversed(node.children))
    return found


def run_segments(nodes: list[Node]) -> list[Segment]:
    """A paragraph's visible text: hard breaks, <br> and images are blanks, other inline HTML is nothing."""
    found: list[Segment] = []
    stack = [(node, ()) for node in reversed(nodes)]
    while stack:
        node, wrappers = stack.pop()
        if node.type == "text":
            found.append(Segment("text", node.value, node.starts, node.begin, node.end, wrappers))
        elif node.type == "inlineCode":
            found.append(Segment("code", node.value, node.starts, node.begin, node.end, wrappers))
        elif node.type == "html":
            if _BR.match(node.value.strip(g.JS_WS_CHARS)):
                found.append(Segment("break", " ", [], node.begin, node.end, wrappers))
        elif node.type in ("break", "image", "imageReference"):
            found.append(Segment("break", " ", [], node.begin, node.end, wrappers))
        else:
            inner = (*wrappers, node.type)
            stack.extend((child, inner) for child in reversed(node.children))
    return found


class Document:
    def __init__(self, source: str) -> None:
        self.source = source
        self.root, self.lines, self.labels = parse_blocks(source)

    def range(self, begin: int, end: int) -> dict:
        (a, b), (c, d) = self.lines.position(begin), self.lines.position(end)
        return {"start_line": a, "start_character": b, "end_line": c, "end_character": d}

    def inlines(self, block: Block) -> list[Node]:
        return parse_inlines(block.text, block.starts, self.labels)

    def walk(self):
        stack = [self.root]
        while stack:
            block = stack.pop()
            yield block
            stack.extend(reversed(block.children))

    # -- headings -------------------------------------------------------------

    def heading_obstruction(self, offset: int, depth: int, identifier: str) -> str | None:
        number = self.lines.line_of(offset)
        line = self.lines.texts[number]
        if number == 0 and line.startswith("﻿"):
            return "byte-order-mark" if _heading_line(line[1:], depth, identifier) else "form"
        if not _heading_line(line, depth, identifier):
            return "form"
        return None if self.lines.starts_search_line(number) else "lone-carriage-return"

    # -- References -------------------------------------------------------------

    def references_section(self):
        """The first References heading of any depth of nesting (level 2), its list, and whether either is out of place."""
        frames = [(self.root, self.root.children, 0)]
        while frames:
            parent, siblings, at = frames.pop()
            if at == len(siblings):
                continue
            frames.append((parent, siblings, at + 1))
            child = siblings[at]
            if child.type == "heading" and child.depth == 2 and child.data.get("text") == REFERENCES:
                beside = siblings[at + 1] if at + 1 < len(siblings) else None
                found = beside
                while found is not None and found.type not in ("heading", "list"):
                    found = found.children[0] if found.children else None
                if found is not None and found.type == "heading":
                    found = None
                nested = parent is not self.root or (found is not None and found is not beside)
                return child, found, nested
            frames.append((child, child.children, 0))
        return None

    def entry_segments(self, item: Block) -> list[Segment]:
        found, stack = [], [item]
        while stack:
            block = stack.pop()
            if block.type in ("paragraph", "heading"):
                found += node_segments(self.inlines(block))
            elif block.type in ("code", "html"):
                found.append(Segment("other", self.raw(block), [], block.begin, block.end))
            stack.extend(reversed(block.children))
        return found

    def raw(self, block: Block) -> str:
        return self.source[block.begin : block.end]

    def entry_obstruction(self, begin: int, text: str, segments: list[Segment], entry: g.Entry) -> str | None:
        number = self.lines.line_of(begin)
        line = self.lines.texts[number]
        prefix = _ENTRY_LINE.match(line)
        rest = line[prefix.end() :] if prefix else ""
        after = rest[len(entry.target) :]
        if not prefix or not rest.startswith(entry.target) or not after or after[0] in "0123456789.#" or not self._label_opens(number, text, segments, entry):
            return "form"
        return None if self.lines.starts_search_line(number) else "lone-carriage-return"

    def _label_opens(self, number: int, text: str, segments: list[Segment], entry: g.Entry) -> bool:
        """The '(' and the whole label come from one text or code, literally, on the entry's first line."""
        label, start = f"({entry.direction}", 0
        for segment in segments:
            end = start + len(segment.text)
            if entry.open < end:
                if segment.kind == "other" or entry.open + len(label) > end:
                    return False
                at = segment.starts[entry.open - start]
                return self.source.startswith(label, at) and at < self.lines.starts[number] + len(self.lines.texts[number])
            start = end
        return False

    # -- citations ----------------------------------------------------------------

    def citations(self, segments: list[Segment]):
        visible = "".join(s.text for s in segments)
        owners = [i for i, s in enumerate(segments) for _ in s.text]
        starts = [0]
        for s in segments:
            starts.append(starts[-1] + len(s.text))
        is_text = lambda i: segments[owners[i]].kind == "text"
        for found in _KEYWORD.finditer(visible):
            at = found.start()
            if not all(is_text(i) for i in range(at, at + 3)) or (at and g.word_character(visible[at - 1])):
                continue
            here = at + 3
            while here < len(visible) and visible[here] in g.JS_WS_CHARS:
                here += 1
            gap = visible[at + 3 : here]
            if not gap or here == len(visible) or visible[here] not in "0123456789" or not is_text(here):
                continue
            begin = here
            while here < len(visible) and visible[here] in "0123456789.#":
                here += 1
            candidate = visible[begin:here]
            target = candidate[:-1] if candidate.endswith(".") else candidate
            ended = here == len(visible) or visible[here] in g.JS_WS_CHARS or visible[here] in _TERMINATORS
            conforms = ended and (g.parse_doc_id(target) or g.parse_section_id(target) is not None)
            owner = segments[owners[at]]
            splitter = None
            literal = False
            if conforms:
                last = owners[begin + len(target) - 1]
                if last != owners[at]:
                    splitter = _splitter(segments[owners[at] : last + 1])
                else:
                    literal = gap == " " and self._literal(owner, at - starts[owners[at]], found[0], target)
            yield {
                "keyword": found[0],
                "kind": found[0].lower(),
                "candidate": candidate,
                "target": target,
                "conforms": conforms,
                "splitter": splitter,
                "literal": literal,
                "range": self.range(owner.begin, owner.end),
            }

    def _literal(self, segment: Segment, at: int, keyword: str, target: str) -> bool:
        """The source has the citation in just these characters, bounded so that a text search finds it."""
        begin = segment.starts[at]
        text = f"{keyword} {target}"
        if not self.source.startswith(text, begin):
            return False
        before = self.source[begin - 1] if begin else ""
        if before and before != "_" and g.word_character(before):
            return False
        end = begin + len(text)
        after = self.source[end : end + 1]
        if not after or after in "\r\n":
            return True
        if _ALNUM.match(after) or after == "#":
            return False
        if after != "." or "#" in target:
            return True
        beyond = self.source[end + 1 : end + 2]
        return not beyond or not (_ALNUM.match(beyond) or beyond in ".#")


def _heading_line(line: str, depth: int, identifier: str) -> bool:
    prefix = f"{'#' * depth} {identifier}"
    rest = line[len(prefix) : len(prefix) + 1]
    if not line.startswith(prefix):
        return False
    return bool(rest) and rest not in "0123456789.#" if depth == 1 else not rest or rest not in "0123456789"


_WRAPPERS = ("strong", "emphasis", "delete", "link", "linkReference")


def _splitter(spanned: list[Segment]) -> str:
    """What parts keyword and identifier: the first wrapper not shared by all, else code or a break, else inline HTML."""
    shared = list(spanned[0].wrappers)
    for segment in spanned:
        shared = [w for i, w in enumerate(shared) if i < len(segment.wrappers) and segment.wrappers[i] == w]
    for segment in spanned:
        if len(segment.wrappers) > len(shared) and segment.wrappers[len(shared)] in _WRAPPERS:
            return segment.wrappers[len(shared)]
    obstacle = next((s.kind for s in spanned if s.kind != "text"), None)
    return {"code": "inline code", "break": "a line break"}.get(obstacle, "inline HTML")


def hierarchy(headings: list[dict], doc_id: str) -> None:
    """The fold over a document's sub-headings: sets issue, section_id, title and parent_id of each.

    A heading stops at its first failed check. One that fails behind the identifier still stands on the stack of
    its ancestors, so a good child may name a parent that is no section.
    """
    stack: list[tuple[str, int]] = [(doc_id, 1)]
    seen = {doc_id}
    for h in headings:
        if h["depth"] == 1 or h["references"]:
            continue
        if not g.separated(h["text"]):
            h["issue"] = "separator" if re.match(rf"[{re.escape(g.JS_WS_CHARS)}]*[0-9]", h["text"]) else "unnumbered"
            continue
        candidate, title = g.candidate_and_title(h["text"])
        parsed = g.parse_section_id(candidate)
        if parsed is None:
            h["issue"] = "section-id"
            continue
        depth, (own_doc, path) = h["depth"], parsed
        h["section_id"] = candidate
        parent = next((i for i, d in reversed(stack) if d == depth - 1), None)
        segments = path.split(".")
        over = g.parse_section_id(parent) if parent in seen else None
        if own_doc != doc_id:
            h["issue"] = "foreign"
        elif len(segments) != depth - 1:
            h["issue"] = "path-length"
        elif candidate in seen:
            h["issue"] = "duplicate"
        elif depth > stack[-1][1] + 1:
            h["issue"] = "skipped-level"
        elif over and ".".join(segments[:-1]) != over[1]:
            h["issue"] = "misplaced"
            h["expected_id"] = f"{doc_id}#{over[1]}.{segments[-1]}"
        else:
            seen.add(candidate)
            h["title"], h["parent_id"], h["extracted"] = title, parent, True
        while stack and stack[-1][1] >= depth:
            stack.pop()
        stack.append((candidate, depth))


def extract(source: str, most_characters: int | None = None) -> Facts:
    """All facts of a document."""
    if most_characters is not None and len(source) > most_characters:
        raise TooComplex(f"{len(source)} characters")
    document = Document(source)
    facts = Facts()
    context: str | None = None
    paragraphs: list[tuple[Block, str | None]] = []
    for block in document.walk():
        if block.type == "heading":
            text = "".join(s.text for s in node_segments(document.inlines(block)))
            block.data["text"] = text
            parsed = g.parse_section_heading(text) if block.depth > 1 else None
            identifier = None
            if block.depth == 1:
                identifier = (g.parse_heading(text) or (None,))[0] if g.separated(text) else None
            elif g.separated(text):
                candidate = g.candidate_and_title(text)[0]
                identifier = candidate if g.parse_section_id(candidate) else None
            facts.headings.append(
                {
                    "depth": block.depth,
                    "text": text,
                    "range": document.range(block.begin, block.end),
                    "references": block.depth == 2 and text == REFERENCES,
                    "obstruction": document.heading_obstruction(block.begin, block.depth, identifier) if identifier else None,
                    "issue": None,
                    "section_id": None,
                    "title": None,
                    "parent_id": None,
                    "expected_id": None,
                    "extracted": False,
                }
            )
            if parsed:
                context = parsed[0]
        elif block.type == "paragraph":
            paragraphs.append((block, context))
    roots = [h for h in facts.headings if h["depth"] == 1]
    identity = g.parse_heading(roots[0]["text"]) if len(roots) == 1 and g.separated(roots[0]["text"]) else None
    if identity:
        hierarchy(facts.headings, identity[0])
    found = document.references_section()
    if found:
        heading, list_, nested = found
        number = document.lines.line_of(heading.begin)
        obstruction = None
        if document.lines.texts[number] != "## References":
            obstruction = "form"
        elif not document.lines.starts_search_line(number):
            obstruction = "lone-carriage-return"
        facts.references = {"nested": nested, "obstruction": None if nested else obstruction, "range": document.range(heading.begin, heading.end)}
        for item in list_.children if list_ else ():
            segments = document.entry_segments(item)
            text = "".join(s.text for s in segments)
            entry = g.parse_entry(text)
            good = isinstance(entry, g.Entry)
            facts.entries.append(
                {
                    "text": text,
                    "range": document.range(item.begin, max([item.begin, *(s.end for s in segments)])),
                    "problem": None if good else entry,
                    "target": entry.target if good else None,
                    "title": entry.title if good else None,
                    "direction": entry.direction if good else None,
                    "explanation": entry.explanation if good else None,
                    "obstruction": document.entry_obstruction(item.begin, text, segments, entry) if good and not nested else None,
                }
            )
    if identity:
        for block, where in paragraphs:
            if quiet(block.text):
                continue
            segments = run_segments(document.inlines(block))
            for citation in document.citations(segments):
                facts.citations.append(citation | {"context": where or identity[0]})
    return facts
