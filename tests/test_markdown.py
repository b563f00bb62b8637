"""The parser and the facts of single documents, against hand-written truth."""

import pytest

from citegraph.markdown.block import parse_blocks
from citegraph.markdown.facts import TooComplex, extract
from citegraph.markdown.inline import parse_inlines

HEAD = "# 2 - Subject\n\n## 2#1 - One\n\n"
REFS = "\n\n## References\n\n- 1 - First (dependency - x)\n- 8.1 - Eight (constraint - y)\n"


def shape(markdown):
    root, _, labels = parse_blocks(markdown)

    def inline(nodes):
        return [(n.type, n.value) if not n.children else (n.type, inline(n.children)) for n in nodes]

    def block(b):
        if b.type in ("paragraph", "heading"):
            return (b.type + (str(b.depth) if b.depth else ""), inline(parse_inlines(b.text, b.starts, labels)))
        return (b.type, [block(c) for c in b.children]) if b.children else (b.type,)

    return [block(c) for c in root.children]


def text(value):
    return ("text", value)


@pytest.mark.parametrize(
    "markdown, expected",
    [
        ("# a #\n## b ##  \n#c", [("heading1", [text("a")]), ("heading2", [text("b")]), ("paragraph", [text("#c")])]),
        ("a\n===\nb\n---\n", [("heading1", [text("a")]), ("heading2", [text("b")])]),
        ("- - -\n***\n", [("thematicBreak",), ("thematicBreak",)]),
        ("> a\nb\n\nc", [("blockquote", [("paragraph", [text("a\nb")])]), ("paragraph", [text("c")])]),
        ("- a\n\n  b\n- c", [("list", [("item", [("paragraph", [text("a")]), ("paragraph", [text("b")])]), ("item", [("paragraph", [text("c")])])])]),
        ("- a\n+ b", [("list", [("item", [("paragraph", [text("a")])])]), ("list", [("item", [("paragraph", [text("b")])])])]),
        ("a\n2. b", [("paragraph", [text("a\n2. b")])]),
        ("a\n1. b", [("paragraph", [text("a")]), ("list", [("item", [("paragraph", [text("b")])])])]),
        ("```x\n# a\n```\n    # b\n", [("code",), ("code",)]),
        ("<div>\n# a\n</div>\n\n<!-- # b -->\n", [("html",), ("html",)]),
        ("*a **b** c*", [("paragraph", [("emphasis", [text("a "), ("strong", [text("b")]), text(" c")])])]),
        ("***a***", [("paragraph", [("emphasis", [("strong", [text("a")])])])]),
        ("snake_case_name _x_", [("paragraph", [text("snake_case_name "), ("emphasis", [text("x")])])]),
        ("a*b", [("paragraph", [text("a*b")])]),
        ("`` a`b `` `c", [("paragraph", [("inlineCode", "a`b"), text(" `c")])]),
        ("\\*a\\* &amp; &#65; &nope; &#0;", [("paragraph", [text("*a* & A &nope; �")])]),
        ("[a](<b c> 'd') [e]\n\n[e]: f", [("paragraph", [("link", [text("a")]), text(" "), ("linkReference", [text("e")])])]),
        ("[a][] [b][a] [c]\n\n[A]: x 'y'", [("paragraph", [("linkReference", [text("a")]), text(" "), ("linkReference", [text("b")]), text(" [c]")])]),
        ("[a [b](c) d](e)", [("paragraph", [text("[a "), ("link", [text("b")]), text(" d](e)")])]),
        ("![a *b*](c) <http://d.e> <f@g.h>", [("paragraph", [("image", "a b"), text(" "), ("link", [text("http://d.e")]), text(" "), ("link", [text("f@g.h")])])]),
        ("a  \nb\\\nc\nd", [("paragraph", [text("a"), ("break", ""), text("b"), ("break", ""), text("c\nd")])]),
        ("a <br/> <b x='1'>c</b>", [("paragraph", [text("a "), ("html", "<br/>"), text(" "), ("html", "<b x='1'>"), text("c"), ("html", "</b>")])]),
    ],
)
def test_shapes(markdown, expected):
    assert shape(markdown) == expected


@pytest.mark.parametrize("markdown", ["> " * 4000 + "x", "# " + "**" * 4000 + "x" + "**" * 4000, "![" * 4000 + "x" + "](u)" * 4000, "[" * 9000, "*a " * 9000, "`" * 4000 + " `` " * 2000, "- " * 3000 + "x", "<" * 5000, "[a](" * 4000])
def test_deep_nesting_is_parsed(markdown):
    assert extract(markdown) is not None


def test_budget():
    with pytest.raises(TooComplex):
        extract("x" * 11, most_characters=10)


def citations(paragraph, refs=REFS):
    facts = extract(HEAD + paragraph + refs)
    return [(c["keyword"], c["target"], c["conforms"], c["splitter"], c["literal"], c["context"]) for c in facts.citations if c["conforms"] or "#" in c["candidate"]]


def edge(keyword, target, context="2#1"):
    return [(keyword, target, True, None, True, context)]


@pytest.mark.parametrize("paragraph", ["see 1#1#9", "see 1#", "see 1#1oops", "**see 1#1#9**", "see 1#1**x**"])
def test_malformed_targets(paragraph):
    found = citations(paragraph)
    assert len(found) == 1 and not found[0][2]


@pytest.mark.parametrize("paragraph", ["per 60s", "per 10ms", "see 1..2", "per **60s**", "per **60**s", "per 60<span>s</span>", "per 60`s`", "ésee 8.1", "ésee 8.1", "‿see 8.1", "𝐀see 8.1", "**x**see 8.1#3", "see `8.1`", "`see 8.1`", "seen 8.1", "see  x"])
def test_prose_is_no_citation(paragraph):
    assert citations(paragraph) == []


@pytest.mark.parametrize(
    "paragraph, keyword, target",
    [
        ("As they say, see 8.1#3.", "see", "8.1#3"), ("**see 8.1#3**", "see", "8.1#3"), ("_see 8.1_", "see", "8.1"), ("see 8.1#3<br>", "see", "8.1#3"), ("See 8.1  \nnext", "See", "8.1"),
        ("| see 8.1 |", "see", "8.1"), ("\"see 8.1\"", "see", "8.1"), ("see 8.1 x", "see", "8.1"), ("see 8.1 x", "see", "8.1"), ("🔒see 8.1", "see", "8.1"), ("a\r\nper 8.1\r\nb", "per", "8.1"),
        ("> quote\n> see 8.1", "see", "8.1"), ("- item\n  see 8.1", "see", "8.1"), ("&amp; see 8.1", "see", "8.1"), ("x &#10; see 8.1", "see", "8.1"), ("(per 1)", "per", "1"), ("see 8.1!", "see", "8.1"),
    ],
)
def test_citations(paragraph, keyword, target):
    assert citations(paragraph) == edge(keyword, target)


@pytest.mark.parametrize("paragraph, splitter", [("see\n8.1#3", None), ("see 8\\.1#3", None), ("see  8.1", None), ("see **8.1**", "strong"), ("**see** 8.1", "strong"), ("see <b>8.1</b>", "inline HTML"), ("see<br>8.1", "a line break"), ("see [8.1](u)", "link"), ("see &#56;.1#3", None)])
def test_unfindable_citations(paragraph, splitter):
    found = citations(paragraph)
    assert [(c[2], c[3], c[4]) for c in found] == [(True, splitter, False)]


def entry(line, markdown=None):
    facts = extract(markdown or f"# 2 - S\n\n## References\n\n{line}\n")
    return facts, facts.entries[0]


@pytest.mark.parametrize(
    "line, target, title, direction, explanation",
    [
        ("- 1 - T (dependency - a (b) c)", "1", "T", "dependency", "a (b) c"), ("* 1 - T (x (authority - y)", "1", "T (x", "authority", "y"), ("+ 1 – T (contract — y)", "1", "T", "contract", "y"),
        ("1. 8.1 - T (constraint - y)", "8.1", "T", "constraint", "y"), ("1) 1 - T - more (dependency - y - z)", "1", "T - more", "dependency", "y - z"), ("- 1 - T (dependency - a\n  b)", "1", "T", "dependency", "a\nb"),
        ("- [1](u) - T (dependency - x)", "1", "T", "dependency", "x"), ("- 1 - T **(dependency - x)**", "1", "T", "dependency", "x"), ("- 1 - T `(dependency - x)`", "1", "T", "dependency", "x"),
    ],
)
def test_entries(line, target, title, direction, explanation):
    _, found = entry(line)
    assert (found["target"], found["title"], found["direction"], found["explanation"], found["problem"]) == (target, title, direction, explanation, None)
    assert found["obstruction"] is None


@pytest.mark.parametrize("line", ["- **1** - T (dependency - x)", "- 1 - T\n  (dependency - x)", "- 1 - T (**dependency** - x)", "- 1 - T (`dependency` - x)", "-\n  1 - T (dependency - x)", "- 1 - T &#40;dependency - x)"])
def test_entries_a_search_misses(line):
    _, found = entry(line)
    assert found["problem"] is None and found["obstruction"] == "form"


@pytest.mark.parametrize("line, problem", [("- 1 - T dependency - x)", "unbalanced"), ("- 1 - T", "format"), ("- 1 - T(dependency - x)", "format"), ("- 1 - T (dependency)", "format"), ("- T (dependency - x)", "format")])
def test_broken_entries(line, problem):
    assert entry(line)[1]["problem"] == problem


@pytest.mark.parametrize(
    "markdown, nested, obstruction",
    [
        ("## References\n\n- 1 - T (dependency - x)", False, None), ("## **References**\n", False, "form"), ("## References ##\n", False, "form"), ("## References  \n", False, "form"),
        ("> ## References\n>\n> - 1 - T (dependency - x)", True, None), ("## References\n\n> - 1 - T (dependency - x)", True, None), ("x\r## References\n", False, "lone-carriage-return"),
    ],
)
def test_references_heading(markdown, nested, obstruction):
    refs = extract("# 2 - S\n\n" + markdown).references
    assert (refs["nested"], refs["obstruction"]) == (nested, obstruction)


@pytest.mark.parametrize(
    "markdown, obstruction",
    [("# 2 - S", None), ("# **2** - S", "form"), ("2 - S\n===", "form"), (" # 2 - S", "form"), ("#\t2 - S", "form"), ("#  2 - S", "form"), ("# 2\\. - S", None), ("> # 2 - S", "form"), ("x\r# 2 - S", "lone-carriage-return"), ("﻿# 2 - S", "byte-order-mark"), ("﻿\n# 2 - S", None)],
)
def test_root_heading_source_form(markdown, obstruction):
    heading = next(h for h in extract(markdown).headings if h["depth"] == 1)
    assert heading["obstruction"] == obstruction


def issues(*headings):
    facts = extract("# 5.1 - R\n\n" + "\n\n".join(f"{'#' * d} {t}" for d, t in headings))
    return [(h["issue"], h["parent_id"]) for h in facts.headings if h["depth"] > 1]


def test_hierarchy_fold():
    assert issues((2, "5.1#1 - a"), (3, "5.1#1.1 - b"), (2, "5.1#7 - c")) == [(None, "5.1"), (None, "5.1#1"), (None, "5.1")]
    assert issues((3, "5.1#1.1 - a"))[0][0] == "skipped-level"
    assert issues((2, "5.1#1 - a"), (4, "5.1#1.1.1 - b"))[1][0] == "skipped-level"
    assert issues((2, "5.1#1 - a"), (2, "5.1#1 - b"))[1][0] == "duplicate"
    assert issues((2, "5.1#1 - a"), (3, "5.1#2.1 - b"))[1][0] == "misplaced"
    assert issues((2, "4.1#1 - a"), (3, "5.1#1.1 - b")) == [("foreign", None), (None, "4.1#1")]
    assert issues((2, "5.1#1.1 - a"))[0][0] == "path-length"
    assert [i for i, _ in issues((2, "Intro"), (2, "8.1 - x"), (2, "5.1#3 x"))] == ["unnumbered", "section-id", "separator"]


def test_positions_are_utf16():
    heading = extract("# 2 - 🔒\n\n🔒🔒 see 8.1").headings[0]
    assert heading["range"] == {"start_line": 0, "start_character": 0, "end_line": 0, "end_character": 8}
