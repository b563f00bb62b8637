"""Identifier grammar as column expressions, and the same rules for the parsing stage.

DocID: digits, then dot and digits, any number of times. SectionID: DocID, '#', section path. Digits are ASCII.
White space is what ECMAScript's ``\\s`` matches; Java's and Python's differ, so the class is spelled out.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: White space inside and outside of a character class, for Java regexes.
JS_WS = f"[{_WS}]"
JS_NOT_WS = f"[^{_WS}]"
JS_WS_CHARS = "\t\n\x0b\f\r   " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
_PATH = "[0-9]+(?:\\.[0-9]+)*"
_DASH = "[-–—]"
#: A word character before a keyword forbids a citation: letters, marks, digits, connectors, joiners.
NOT_WORD = "[^\\p{IsAlphabetic}\\p{M}\\p{Nd}\\p{Pc}\\p{IsJoin_Control}]"

DIRECTIONS = ("authority", "dependency", "constraint", "contract")


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"\\A{JS_WS}+|{JS_WS}+\\z", "")


def is_doc_id(text: Column) -> Column:
    return F.coalesce(text.rlike(f"\\A{_PATH}\\z"), F.lit(False))


def is_section_id(text: Column) -> Column:
    return F.coalesce(text.rlike(f"\\A{_PATH}#{_PATH}\\z"), F.lit(False))


def section_doc(text: Column) -> Column:
    """DocID part of a SectionID; null for anything else."""
    return F.when(is_section_id(text), F.substring_index(text, "#", 1))


def section_path(text: Column) -> Column:
    return F.when(is_section_id(text), F.substring_index(text, "#", -1))


def extends_doc(section_id: Column, doc_id: Column) -> Column:
    return F.coalesce(section_doc(section_id) == doc_id, F.lit(False))


def segment_count(path: Column) -> Column:
    return F.when(path == "", F.lit(0)).otherwise(F.size(F.split(path, "\\.")))


def section_path_length(text: Column) -> Column:
    return F.when(is_section_id(text), segment_count(section_path(text))).otherwise(F.lit(0))


def expected_path_length(depth: Column) -> Column:
    return depth - 1


def _heading_part(text: Column, identifier: str, group: int) -> Column:
    pattern = f"\\A({identifier}){JS_WS}*{_DASH}{JS_WS}*([^\\n\\r\\u2028\\u2029]+)\\z"
    trimmed = js_trim(text)
    part = F.regexp_extract(trimmed, pattern, group)
    title = js_trim(F.regexp_extract(trimmed, pattern, 2))
    return F.when(trimmed.rlike(pattern) & (title != ""), part)


def heading_doc_id(text: Column) -> Column:
    """DocID of a level-1 heading text; null where the heading has no such form."""
    return _heading_part(text, _PATH, 1)


def heading_title(text: Column) -> Column:
    return _heading_part(text, _PATH, 2)


def section_heading_id(text: Column) -> Column:
    return _heading_part(text, f"{_PATH}#{_PATH}", 1)


def section_heading_title(text: Column) -> Column:
    return _heading_part(text, f"{_PATH}#{_PATH}", 2)


def has_separator(text: Column) -> Column:
    return text.rlike(f"[0-9]{JS_WS}*{_DASH}{JS_WS}*{JS_NOT_WS}")


def section_candidate(text: Column) -> Column:
    """What stands before the first dash; the whole text without one."""
    return js_trim(F.element_at(F.split(text, _DASH, 2), 1))


def title_after_dash(text: Column) -> Column:
    parts = F.split(text, f"{JS_WS}*{_DASH}{JS_WS}*", 2)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))


def target_doc(identifier: Column) -> Column:
    return F.substring_index(identifier, "#", 1)


def starts_with_digit(text: Column) -> Column:
    return text.rlike(f"\\A{JS_WS}*[0-9]")


def relationship_parenthesis(entry: Column) -> Column:
    """Offset (from 0) of the '(' that the final ')' closes; -1 without a final ')', -2 if unbalanced."""
    length = F.length(entry)
    start = F.struct(F.lit(0).alias("depth"), F.lit(-2).alias("open"))
    # From right to left: a struct of the depth so far and the place found.
    walk = F.aggregate(
        F.sequence(length, F.lit(1), F.lit(-1)),
        start,
        lambda state, i: F.when(state["open"] >= 0, state).otherwise(
            F.struct(
                (state["depth"] + F.when(F.substr(entry, i, F.lit(1)) == ")", 1).when(F.substr(entry, i, F.lit(1)) == "(", -1).otherwise(0)).alias("depth"),
                F.when((F.substr(entry, i, F.lit(1)) == "(") & (state["depth"] == 1), i - 1).otherwise(F.lit(-2)).alias("open"),
            )
        ),
        lambda state: state["open"],
    )
    return F.when(~F.endswith(entry, F.lit(")")), F.lit(-1)).otherwise(walk)


def entry_fields(text: Column) -> Column:
    """Struct of a References entry's target, title, direction, explanation (values untrimmed); null if it has no such form."""
    entry = F.regexp_replace(text, f"{JS_WS}+\\z", "")
    open_ = relationship_parenthesis(entry)
    gap = F.substring(entry, F.lit(1), open_)
    inside = F.substring(entry, open_ + 2, F.length(entry) - open_ - 2)
    prefix = F.regexp_replace(gap, f"{JS_WS}+\\z", "")
    cut = f" {_DASH} "
    inner, outer = F.split(inside, cut, 2), F.split(prefix, cut, 2)
    fine = (open_ >= 0) & gap.rlike(f"{JS_WS}\\z") & (F.size(inner) == 2) & (F.size(outer) == 2)
    return F.when(
        fine,
        F.struct(F.element_at(outer, 1).alias("target"), F.element_at(outer, -1).alias("title"), F.element_at(inner, 1).alias("direction"), F.element_at(inner, -1).alias("explanation")),
    )


def citation_pattern(identifier: str = "[0-9][0-9.#]*") -> str:
    """Java regex: group 1 keyword, group 2 identifier, behind a word boundary."""
    return f"(?<!{NOT_WORD.replace('^', '', 1)})([Ss]ee|[Pp]er){JS_WS}+({identifier})"


# -- the same grammar for the parsing stage ---------------------------------

_PY_WS = "[" + re.escape(JS_WS_CHARS) + "]"
_RE_DOC = re.compile(rf"{_PATH}\Z")
_RE_SECTION = re.compile(rf"({_PATH})#({_PATH})\Z")
_RE_HEADING = re.compile(rf"({_PATH}){_PY_WS}*{_DASH}{_PY_WS}*([^\n\r  ]+)\Z")
_RE_SECTION_HEADING = re.compile(rf"({_PATH}#{_PATH}){_PY_WS}*{_DASH}{_PY_WS}*([^\n\r  ]+)\Z")
_RE_SEPARATOR = re.compile(rf"[0-9]{_PY_WS}*{_DASH}{_PY_WS}*[^{re.escape(JS_WS_CHARS)}]")
_RE_CUT = re.compile(rf"{_PY_WS}*{_DASH}{_PY_WS}*")
_RE_PARENTHESIS = re.compile("[()]")
_RE_SPACED_DASH = re.compile(f" {_DASH} ")


def trim(text: str) -> str:
    return text.strip(JS_WS_CHARS)


def parse_doc_id(text: str) -> bool:
    return bool(_RE_DOC.match(text))


def parse_section_id(text: str) -> tuple[str, str] | None:
    found = _RE_SECTION.match(text)
    return (found[1], found[2]) if found else None


def parse_heading(text: str) -> tuple[str, str] | None:
    found = _RE_HEADING.match(trim(text))
    return (found[1], found[2]) if found and trim(found[2]) else None


def parse_section_heading(text: str) -> tuple[str, str] | None:
    found = _RE_SECTION_HEADING.match(trim(text))
    return (found[1], found[2]) if found and trim(found[2]) else None


def separated(text: str) -> bool:
    return bool(_RE_SEPARATOR.search(text))


def candidate_and_title(text: str) -> tuple[str, str]:
    found = _RE_CUT.search(text)
    return (trim(text[: found.start()]), text[found.end() :]) if found else (trim(text), "")


def locate_parenthesis(entry: str) -> int:
    if not entry.endswith(")"):
        return -1
    depth = 0
    for i in reversed([found.start() for found in _RE_PARENTHESIS.finditer(entry)]):
        if entry[i] == ")":
            depth += 1
        else:
            depth -= 1
            if not depth:
                return i
    return -2


@dataclass
class Entry:
    target: str
    title: str
    direction: str
    explanation: str
    open: int


def parse_entry(text: str) -> Entry | str:
    """The entry's fields, or 'unbalanced' or 'format'."""
    entry = text.rstrip(JS_WS_CHARS)
    at = locate_parenthesis(entry)
    if at == -2:
        return "unbalanced"
    gap = entry[: max(at, 0)]
    if at < 0 or not gap or gap[-1] not in JS_WS_CHARS:
        return "format"
    inside = _RE_SPACED_DASH.split(entry[at + 1 : -1], maxsplit=1)
    outside = _RE_SPACED_DASH.split(gap.rstrip(JS_WS_CHARS), maxsplit=1)
    if len(inside) < 2 or len(outside) < 2:
        return "format"
    return Entry(outside[0], outside[1], inside[0], inside[1], at)


def word_character(char: str) -> bool:
    """Letter-like, mark, decimal digit, connector or joiner."""
    kind = unicodedata.category(char)
    return char.isalpha() or kind[0] == "M" or kind in ("Nd", "Pc", "Nl") or char in "‌‍" or "Ⓐ" <= char <= "ⓩ" or "\U0001f130" <= char <= "\U0001f189"
