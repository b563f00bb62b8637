import os
import re

import pytest
from pyspark.sql import functions as F

from citegraph.functions import grammar as g
from citegraph.functions import text as t
from citegraph.sources import folder

VALID_DOC = ["1", "3.1", "7.12", "2.4.3", "0", "10.20", "0.0.0"]
INVALID_DOC = ["", ".1", "1.", "1..2", "abc", "1.a", "1. 2", "-1", "1.2.3 x", " 3.1", "3.1 ", "8.1\n"]
VALID_SECTION = ["3.1#1", "3.1#1.1", "1#2", "7.12#3", "0.0.1#1", "10.20#30.40"]
INVALID_SECTION = ["", "1", "3.1", "3.1.1", "3.1#", "#1", "3.1#1#2", ".1#2", "1#2.", "abc#1", "1#abc"]
HEADINGS = {"1 - Intro": ("1", "Intro"), "3.1 – A - B": ("3.1", "A - B"), "7—x": ("7", "x"), " 1 - x ": ("1", "x")}
NO_HEADINGS = ["", "Intro", "3.1", "3.1 -", "3.1 -  ", "abc - T"]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").select("i", expression(F.col("s")).alias("x")).orderBy("i").collect()
    return [r["x"] for r in rows]


def test_identifiers(spark):
    assert column(spark, VALID_DOC, g.is_doc_id) == [True] * len(VALID_DOC) and column(spark, INVALID_DOC, g.is_doc_id) == [False] * len(INVALID_DOC)
    assert column(spark, VALID_SECTION, g.is_section_id) == [True] * len(VALID_SECTION) and column(spark, INVALID_SECTION, g.is_section_id) == [False] * len(INVALID_SECTION)
    assert all(map(g.parse_doc_id, VALID_DOC)) and not any(map(g.parse_doc_id, INVALID_DOC))
    assert all(map(g.parse_section_id, VALID_SECTION)) and not any(map(g.parse_section_id, INVALID_SECTION))
    assert column(spark, ["", "1", "1.2.3"], g.segment_count) == [0, 1, 3] and column(spark, ["8.1#3.2", "8.1"], g.section_path_length) == [2, 0]
    assert column(spark, ["8.1#3", "8.10#3", None], lambda s: g.extends_doc(s, F.lit("8.1"))) == [True, False, False]


def test_headings(spark):
    assert column(spark, list(HEADINGS), lambda s: F.struct(g.heading_doc_id(s), g.heading_title(s))) == list(HEADINGS.values())
    assert column(spark, NO_HEADINGS, g.heading_doc_id) == [None] * len(NO_HEADINGS)
    assert [g.parse_heading(h) for h in HEADINGS] == list(HEADINGS.values()) and not any(map(g.parse_heading, NO_HEADINGS))
    bad = ["8.1 - X", "8.1.3 - X", "References", "8.1#3", "8.1#3 - ", "#3 - X"]
    assert column(spark, bad, g.section_heading_id) == [None] * len(bad) and not any(map(g.parse_section_heading, bad))
    assert column(spark, ["Report 3-4", "x - y", "3 -"], g.has_separator) == [True, False, False]
    assert column(spark, ["8.1#3 — T - U", "plain"], lambda s: F.struct(g.section_candidate(s), g.title_after_dash(s))) == [("8.1#3", "T - U"), ("plain", "")]


def test_entry_fields_agree_with_the_stage(spark):
    entries = ["1 - T (dependency - a (b) c)", "1 - T (x (authority - y)", "1 - T", "1 - T x)", "1 – T (a — b)  ", "1 - T(a - b)", "1 (a - b)"]
    for text, found in zip(entries, column(spark, entries, g.entry_fields)):
        parsed = g.parse_entry(text)
        assert (tuple(found) if found else None) == ((parsed.target, parsed.title, parsed.direction, parsed.explanation) if isinstance(parsed, g.Entry) else None)


PATTERNS = ["docs/*.md", "docs/**", "**/n.md", "note?.md", "a?b", "**", "", "*.md", "**/*", "a/**/b", "x**y", "(a|b).md", "[a].md", "***"]
PATHS = ["docs/n.md", "docs/deep/n.md", "n.md", "note.md", "note1.md", "a/b", "axb", "a/x/y/b", "x/1/y", "(a|b).md", "[a].md", ""]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_globs_are_their_regex(pattern):
    glob = t.Glob(pattern)
    assert [glob.matches(p) for p in PATHS] == [bool(re.fullmatch(glob.regex()[1:-1], p)) for p in PATHS]


def test_glob_edges_and_speed(spark):
    assert not t.Glob("docs/*.md").matches("docs/deep/n.md") and t.Glob("docs/**").matches("docs/deep/n.md") and t.Glob("**/n.md").matches("n.md")
    assert not t.Glob("**a" * 8 + "b").matches("a" * 5_000)
    assert t.Glob("vendor/**").prunes("vendor") and not any(t.Glob(p).prunes(d) for p, d in [("vendor/**", "vendors"), ("vendor/**", "docs/vendor"), ("vendor/**", "vendor/lib"), ("vendor", "vendor"), ("vendor/*", "vendor")])
    assert column(spark, ["a/README.md", ".readme", "x.tar.md", "noext"], t.base_name) == ["readme", ".readme", "x.tar", "noext"]


def test_lines(spark):
    docs = spark.createDataFrame([("a", 0, "x\r\ny\rz\n\nend\n"), ("b", 1, "")], "uri string, doc_ord long, markdown string")
    rows = [(r["uri"], r["text"], r["start_off"], r["starts_search_line"]) for r in t.markdown_lines(docs).orderBy("uri", "line_no").collect()]
    assert rows[:5] == [("a", "x", 0, True), ("a", "y", 3, True), ("a", "z", 5, False), ("a", "", 7, True), ("a", "end", 8, True)]
    assert [(r["uri"], r["line_no"], r["text"]) for r in t.search_lines(docs).orderBy("uri", "line_no").collect()] == [("a", 1, "x\r"), ("a", 2, "y\rz"), ("a", 3, ""), ("a", 4, "end")]


def test_controls():
    assert t.show_controls("a\tb\n\x1b[31m‮\x7f") == "a\tb\n\\u001b[31m\\u202e\\u007f"


@pytest.fixture
def tree(tmp_path):
    docs = tmp_path / "docs"
    for name in ("3.1.md", "5.1.MD", "README.md", "notes.txt", "_draft.md", ".hidden/x.md", ".x.md", "node_modules/p/a.md", "vendor/a/b.md"):
        (docs / name).parent.mkdir(parents=True, exist_ok=True)
        (docs / name).write_bytes(b"# 1 - x\xff\n")
    (tmp_path / "elsewhere").mkdir()
    (docs / "link-to-dir").symlink_to(tmp_path / "elsewhere")
    (docs / "link.md").symlink_to(docs / "3.1.md")
    (docs / "link.txt").symlink_to(docs / "notes.txt")
    (docs / "dangling").symlink_to(tmp_path / "missing")
    return docs


def test_discovery(spark, tree):
    found = folder.discover(str(tree), ["vendor/**"], project=str(tree.parent))
    assert found.documents == ["3.1.md", "5.1.MD", "_draft.md"] and found.excluded == ["README.md", "node_modules/", "vendor/"]
    assert found.not_followed == ["dangling", "link-to-dir", "link.md"] and not found.unreadable
    rows = folder.read_documents(spark, found).orderBy("doc_ord").collect()
    assert [(r["uri"], r["markdown"]) for r in rows] == [(p, "# 1 - x�\n") for p in found.documents]
    assert found.table(spark).groupBy("kind").count().count() == 3
    assert folder.discover(str(tree), ["link-to-dir/**"]).excluded.count("link-to-dir") == 1


def test_discovery_edges(tree):
    assert folder.discover(str(tree / "none")).unreadable == [(".", "ENOENT")]
    assert folder.discover(str(tree), project_ignore=["docs/**"], project=str(tree.parent)).root_excluded
    assert folder.parse_ignore("# drafts\r\n\r\ndocs/drafts/**\n  notes.md  \n#x/**\n") == ["docs/drafts/**", "notes.md"]
    assert sorted(["a/b.md", "a.md", "a-b.md", "a_b.md"], key=folder.utf16_order) == ["a-b.md", "a.md", "a/b.md", "a_b.md"]
    assert folder.utf16_order("\U00010400") < folder.utf16_order("～")
    assert folder.read_ignore(str(tree)) == []
    if os.geteuid():
        os.chmod(tree / "3.1.md", 0)
        assert folder.discover(str(tree)).unreadable == [("3.1.md", "EACCES")]
