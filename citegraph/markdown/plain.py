"""The facts of a document as rows, in one pass over its lines where it is plainly built; else from the whole parser.

Plain documents have headings, paragraphs and flat lists of one line for each item, all from the first column on. Their
blocks are what the lines say, so no block tree is needed; a block with inline markup still goes through the inline
parser. Anything else gives up at once, and ``extract`` reads the document from its beginning. Both give the same rows.
"""

from __future__ import annotations

import re
from operator import itemgetter

from citegraph.functions import grammar as g
from citegraph.markdown.block import Block, Lines, _MARKER
from citegraph.markdown.facts import _INLINE, _TERMINATORS, CITED, REFERENCES, Document, Facts, TooComplex, _heading_line, extract, hierarchy, node_segments, quiet, run_segments

HEADING = ("depth", "text", "range", "references", "obstruction", "issue", "section_id", "title", "parent_id", "expected_id", "extracted")
ENTRY = ("text", "range", "problem", "target", "title", "direction", "explanation", "obstruction")
CITATION = ("keyword", "kind", "candidate", "target", "conforms", "splitter", "literal", "range", "context")
RANGE = ("start_line", "start_character", "end_line", "end_character")
#: What a parse is asked for. Level-1 headings always come; the References heading comes with entries.
FACTS = ("headings", "entries", "citations")

_WS = "[" + re.escape(g.JS_WS_CHARS) + "]"
_NOT_WS = "[^" + re.escape(g.JS_WS_CHARS) + "]"
_PATH = "[0-9]+(?:\\.[0-9]+)*"
#: No document that holds one of these is plain, nor one that begins or ends with a blank.
_ODD = ("\r", "\t", "\x00", "\ufeff", " \n", "\n ")
_ATX = re.compile("(#{1,6}) ([^ #](?:.*[^ #])?)", re.S)
#: A heading's text as most are: identifier, ' - ', title. All other forms are left to the grammar's own functions.
_SECTION = re.compile(f"({_PATH})#({_PATH}) - ({_NOT_WS}[^\n\r\u2028\u2029]*)")
_TARGET = re.compile(f"{_PATH}(?:#{_PATH})?\\Z")
_OPENS = "#`~*+_=<>-["
_SAFE = r"\n`\[\]\\!<&*_"
#: The most frequent blocks, each in one match: a numbered heading with a paragraph of one line, and a regular entry.
_BLOCK = re.compile(f"(#{{1,6}}) (({_PATH})#({_PATH}) - ((?!{_WS})[^{_SAFE}\r\u2028\u2029]+))(?<!#)\n\n([A-Za-z][^{_SAFE}]*)\n\n")
_ITEM = re.compile(f"- (({_PATH}) - ([^{_SAFE}()]+)(?<!{_WS}) \\(([a-z]+) - ([^{_SAFE}()]*(?:\\([^{_SAFE}()]*\\)[^{_SAFE}()]*)*)\\))(?:\n|\\Z)")


def plain_citations(text: str, line: int, column: int, wide) -> list[tuple]:
    """Citations of a paragraph without markup, whose text is the source's, all but the context."""
    found, size, range_ = [], len(text), None
    for match in CITED.finditer(text):
        at = match.start()
        if at and text[at - 1] != " " and g.word_character(text[at - 1]):
            continue
        keyword, gap, candidate = match.groups()
        kind = keyword.lower()
        target = candidate[:-1] if candidate[-1] == "." else candidate
        here = match.end()
        ended = here == size or text[here] in g.JS_WS_CHARS or text[here] in _TERMINATORS
        conforms = ended and _TARGET.match(target) is not None
        literal = False
        if conforms and gap == " ":
            end = match.start(3) + len(target)
            after = text[end] if end < size else "\n"
            if after == "." and "#" not in target:
                beyond = text[end + 1] if end + 1 < size else "\n"
                literal = not ("0" <= beyond <= "9" or "a" <= beyond <= "z" or "A" <= beyond <= "Z" or beyond in ".#")
            else:
                literal = after == "\n" or not ("0" <= after <= "9" or "a" <= after <= "z" or "A" <= after <= "Z" or after == "#")
        if range_ is None:
            lines = text.count("\n")
            last = text[text.rfind("\n") + 1 :]
            range_ = (line, column, line + lines, wide(last) + (0 if lines else column))
        found.append((keyword, kind, candidate, target, conforms, None, literal, range_))
    return found


def _obstruction(text: str, depth: int) -> str | None:
    """That of a level-1 heading in plain source, whose line is just marks, blank and text."""
    identifier = (g.parse_heading(text) or (None,))[0] if g.separated(text) else None
    return "form" if identifier and not _heading_line(f"{'#' * depth} {text}", depth, identifier) else None


class _Plain:
    def __init__(self, source: str, wanted) -> None:
        self.source, self.wanted = source, wanted
        self.document: Document | None = None
        self.wide = len if source.isascii() else lambda s: len(s) + sum(c > "\uffff" for c in s)
        self.starts: list[int] = []

    def full(self) -> Document:
        """The parser's own view of the source, for blocks with markup."""
        if self.document is None:
            self.document = Document.__new__(Document)
            self.document.source, self.document.root, self.document.lines, self.document.labels = self.source, None, Lines(self.source), set()
        return self.document

    def block(self, line: int, skip: int, text: str) -> Block:
        begin = self.full().lines.starts[line] + skip
        block = Block("paragraph", begin, None)
        block.text, block.starts = text, list(range(begin, begin + len(text)))
        return block

    def rows(self):
        """Headings, References, entries and citations as tuples, or None for a document that is not plain."""
        source, wide = self.source, self.wide
        if any(odd in source for odd in _ODD) or source[:1] == " " or source[-1:] == " ":
            return None
        want_headings, want_entries, want_citations = (f in self.wanted for f in FACTS)
        headings: list[list] = []
        sections: list[tuple | None] = []
        paragraphs: list[tuple] = []  # line, skip, text, context, whether it is known to be plain and to cite
        references, items, entries = None, 0, []
        state, context, gathering = "", None, False  # state: the block that the line before belongs to
        at, size, number = 0, len(source), -1
        while at < size:
            number += 1
            char = source[at]
            if char == "#" and (block := _BLOCK.match(source, at)):
                marks, text, own, path, title, body = block.groups()
                depth = len(marks)
                context = text[: len(own) + 1 + len(path)]
                if want_headings or depth == 1:
                    headings.append([depth, text, (number, 0, number, depth + 1 + wide(text)), False, None if depth > 1 else _obstruction(text, depth), None, None, None, None, None, False])
                    sections.append((own, path, title, context))
                if want_citations and CITED.search(body):
                    paragraphs.append((number + 2, 0, body, context, True))
                gathering, state = False, ""
                at, number = block.end(), number + 3
                continue
            if char == "-" and gathering and state != "paragraph" and (state[:4] == "list" or not items) and (item := _ITEM.match(source, at)):
                text, target, title, direction, explanation = item.groups()
                items += 1
                if want_entries:
                    entries.append((text, (number, 0, number, 2 + wide(text)), None, target, title, direction, explanation, None))
                if want_citations and CITED.search(text):
                    paragraphs.append((number, 2, text, context, True))
                at, state = item.end(), "list"
                continue
            end = source.find("\n", at)
            if end < 0:
                end = size
            line = source[at:end]
            at = end + 1
            if not line:
                state = "list-blank" if state[:4] == "list" else ""
                continue
            first = line[0]
            if first == "#":
                found = _ATX.fullmatch(line)
                if found is None:
                    return None
                marks, text = found.groups()
                depth = len(marks)
                if _INLINE.search(text):
                    text = "".join(s.text for s in node_segments(self.full().inlines(self.block(number, depth + 1, text))))
                named = obstruction = None
                if depth == 1:
                    identifier = (g.parse_heading(text) or (None,))[0] if g.separated(text) else None
                else:
                    named = _SECTION.fullmatch(text)
                    if named is not None:
                        context = identifier = f"{named[1]}#{named[2]}"
                        named = (*named.groups(), context)
                    else:
                        parsed = g.parse_section_heading(text)
                        if parsed:
                            context = parsed[0]
                        candidate = g.candidate_and_title(text)[0] if g.separated(text) else ""
                        identifier = candidate if candidate and g.parse_section_id(candidate) else None
                if identifier and not _heading_line(line, depth, identifier):
                    obstruction = "form"
                is_references = depth == 2 and text == REFERENCES
                gathering = is_references and references is None
                range_ = (number, 0, number, wide(line))
                if gathering:
                    references = (False, None if line == "## References" else "form", range_)
                headings.append([depth, text, range_, is_references, obstruction, None, None, None, None, None, False])
                sections.append(named)
                state = ""
            elif first == "-":
                text = line[2:]
                if line[1:2] != " " or not text or text[0] == " " or text[0] in _OPENS:
                    return None
                if "0" <= text[0] <= "9" and (mark := _MARKER.match(text)) and text[mark.end() : mark.end() + 1] in ("", " "):
                    return None
                if gathering and state != "paragraph" and (state[:4] == "list" or not items):
                    items += 1
                    if want_entries:
                        entries.append(self.entry(number, text))
                else:
                    gathering = False
                if want_citations:
                    paragraphs.append((number, 2, text, context, False))
                state = "list"
            else:
                if state == "list" or first == "[":
                    return None  # a lazy continuation, or perhaps a definition
                if first in "`~*+_=<>":
                    return None
                if "0" <= first <= "9" and (mark := _MARKER.match(line)) and line[mark.end() : mark.end() + 1] in ("", " "):
                    return None
                gathering = False
                if state == "paragraph":
                    if want_citations:
                        number_, skip, text, where, _ = paragraphs[-1]
                        paragraphs[-1] = (number_, skip, f"{text}\n{line}", where, False)
                else:
                    if want_citations:
                        paragraphs.append((number, 0, line, context, False))
                    state = "paragraph"
        roots = [h for h in headings if h[0] == 1]
        identity = g.parse_heading(roots[0][1]) if len(roots) == 1 and g.separated(roots[0][1]) else None
        if identity and want_headings:
            _hierarchy(headings, sections, identity[0])
        citations = self.citations(paragraphs, identity[0]) if identity and want_citations else []
        return headings if want_headings else roots, references if want_entries else None, entries, citations

    def entry(self, number: int, text: str) -> tuple:
        if "0" <= text[0] <= "9" and _INLINE.search(text) is None:
            entry = g.parse_entry(text)
            range_ = (number, 0, number, 2 + self.wide(text))
            if not isinstance(entry, g.Entry):
                return (text, range_, entry, None, None, None, None, None)
            after = text[len(entry.target) : len(entry.target) + 1]
            obstruction = "form" if not entry.target or not after or after in "0123456789.#" else None
            return (text, range_, None, entry.target, entry.title, entry.direction, entry.explanation, obstruction)
        document, block = self.full(), self.block(number, 2, text)
        segments = node_segments(document.inlines(block))
        begin = document.lines.starts[number]
        shown = "".join(s.text for s in segments)
        entry = g.parse_entry(shown)
        range_ = _range(document.range(begin, max([begin, *(s.end for s in segments)])))
        if not isinstance(entry, g.Entry):
            return (shown, range_, entry, None, None, None, None, None)
        return (shown, range_, None, entry.target, entry.title, entry.direction, entry.explanation, document.entry_obstruction(begin, shown, segments, entry))

    def citations(self, paragraphs: list[tuple], doc_id: str) -> list[tuple]:
        found = []
        for number, skip, text, context, cites in paragraphs:
            if not cites and quiet(text):
                continue
            if cites or _INLINE.search(text) is None:
                where = (context or doc_id,)
                found += [c + where for c in plain_citations(text, number, skip, self.wide)]
            else:
                document = self.full()
                for c in document.citations(run_segments(document.inlines(self.block(number, skip, text)))):
                    found.append(_citation(c | {"context": context or doc_id}))
        return found


def _hierarchy(headings: list[list], sections: list[tuple | None], doc_id: str) -> None:
    """``facts.hierarchy`` over rows. The checks come in the same order; regular headings come with their parts."""
    if None in sections and any(named is None and h[0] > 1 and not h[3] for h, named in zip(headings, sections)):
        whole = [dict(zip(HEADING, h)) for h in headings]
        hierarchy(whole, doc_id)
        for h, w in zip(headings, whole):
            h[:] = _VALUES["headings"](w)
        return
    stack: list[tuple[str, int]] = [(doc_id, 1)]
    paths = {doc_id: None}
    for h, named in zip(headings, sections):
        depth = h[0]
        if depth == 1 or h[3]:
            continue
        own, path, title, candidate = named
        h[6] = candidate
        top, deepest = stack[-1]
        if deepest == depth - 1:
            parent = top
        else:
            parent = next((i for i, d in reversed(stack) if d == depth - 1), None)
        over = paths.get(parent) if parent is not None else None
        if own != doc_id:
            h[5] = "foreign"
        elif path.count(".") + 1 != depth - 1:
            h[5] = "path-length"
        elif candidate in paths:
            h[5] = "duplicate"
        elif depth > deepest + 1:
            h[5] = "skipped-level"
        elif over and path.rpartition(".")[0] != over:
            h[5] = "misplaced"
            h[9] = f"{doc_id}#{over}.{path.rpartition('.')[2]}"
        else:
            paths[candidate] = path
            h[7], h[8], h[10] = title, parent, True
        while stack and stack[-1][1] >= depth:
            stack.pop()
        stack.append((candidate, depth))


_range = itemgetter(*RANGE)
_VALUES = {"headings": itemgetter(*HEADING), "entries": itemgetter(*ENTRY), "citations": itemgetter(*CITATION)}


def _row(kind: str, value: dict) -> tuple:
    return _VALUES[kind](value | {"range": _range(value["range"])})


def _citation(value: dict) -> tuple:
    return _row("citations", value)


def rows_of(facts: Facts, wanted) -> tuple:
    """The whole parser's facts as rows."""
    headings = facts.headings if "headings" in wanted else [h for h in facts.headings if h["depth"] == 1]
    refs = facts.references if "entries" in wanted else None
    return (
        [_row("headings", h) for h in headings],
        (refs["nested"], refs["obstruction"], _range(refs["range"])) if refs else None,
        [_row("entries", e) for e in facts.entries] if "entries" in wanted else [],
        [_row("citations", c) for c in facts.citations] if "citations" in wanted else [],
    )


def extract_rows(source: str, most_characters: int | None = None, wanted=FACTS) -> tuple:
    """(headings, References or None, entries, citations) of a document, as tuples in the order of the fields."""
    if most_characters is not None and len(source) > most_characters:
        raise TooComplex(f"{len(source)} characters")
    rows = _Plain(source, wanted).rows()
    return rows if rows is not None else rows_of(extract(source), wanted)
