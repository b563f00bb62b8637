"""Rules, corpus pass, statistics, navigation and reports over whole corpora."""

import json

import pytest
from pyspark.sql import functions as F

from citegraph import cli, report
from citegraph.functions import text as t
from citegraph.operators import corpus, navigation, rules
from citegraph.operators.statistics import severity_totals, statistics
from citegraph.plans.validate import lint_document, validate_corpus
from citegraph.scratch import scratch_writer
from citegraph.sources import example
from citegraph.sources.folder import in_memory


def doc(doc_id, title="T", entries=(), body="", references=True):
    lines = [f"# {doc_id} - {title}", "", body, ""]
    if references:
        lines += ["## References", "", *[f"- {e}" for e in entries]]
    return "\n".join(lines) + "\n"


def findings(result, table="corpus_diagnostics"):
    rows = getattr(result, table).collect()
    return sorted((r["uri"], r["rule_id"], r["severity"], r["data"].get("cause") or r["data"].get("reason") or "") for r in rows)


@pytest.fixture(scope="module")
def bundled(spark):
    documents = example.example_corpus(spark)
    return documents, validate_corpus(documents)


def test_example_statistics(bundled):
    row = statistics(bundled[1]).head().asDict()
    assert row == {
        "documents": 9, "documents_with_references": 9, "sections": 34, "doc_ids": 9, "section_ids": 34, "reference_entries": 21, "authority": 5, "constraint": 2, "contract": 2,
        "dependency": 12, "inline_references": 17, "section_precise": 10, "total_edges": 38, "complete": True, "unparsable": [],
    }


def test_example_is_clean(bundled):
    assert report.exit_code(bundled[1]) == 0 and bundled[1].diagnostics.isEmpty()
    assert "nothing to report" in report.validation_pretty(bundled[1]) and json.loads(report.validation_json(bundled[1]))["documents"] == 9
    assert "edges" in report.statistics_pretty(bundled[1]) and json.loads(report.statistics_json(bundled[1]))["sections"] == 34
    nested = {r["doc_id"]: r for r in bundled[1].extracted.collect()}
    assert [s["id"] for s in nested["8.1.3"]["sections"]] == ["8.1.3", "8.1.3#1", "8.1.3#2"] and len(nested["0.0"]["references"]) == 5 and len(nested["0.0"]["inline_references"]) == 3


def test_recipes_find_what_the_graph_holds(bundled):
    documents, result = bundled
    lines = t.search_lines(documents)
    count = lambda *a: navigation.hits(lines, *a).count()
    assert (count("cites_document", "8.1"), count("cites_any_section", "8.1"), count("cites_section_or_below", "8.1#3"), count("cites_document_or_section", "8.1"), count("section_precise")) == (2, 5, 5, 7, 10)
    assert navigation.search(lines, "entries", "8.1").count() == 6 and navigation.search(lines, "entries_by_direction", "8.1", "authority").count() == 4
    assert navigation.governed_by(result.reference_edges, "8.1", "authority").count() == 4 and navigation.governed_by(result.reference_edges, "8.1").count() == 6
    assert navigation.search(lines, "document", "8.1").count() == 1 and navigation.search(lines, "section", "8.1#3").count() == 3 and navigation.search(lines, "corpus_map").count() == 9
    assert navigation.citing(result.inline_edges, "8.1", below=True).count() == 7 and navigation.citing(result.inline_edges, "8.1#3", below=True).count() == 5
    # Every citation of the graph lies on a line its recipe hits.
    for edge in result.inline_edges.select("uri", "to_id").distinct().collect():
        recipe = "cites_section_or_below" if "#" in edge["to_id"] else "cites_document"
        assert not navigation.search(lines.filter(F.col("uri") == edge["uri"]), recipe, edge["to_id"]).isEmpty()
    assert {r["step"] for r in navigation.grounding(result.reference_edges, result.inline_edges, "8.1").collect()} == {3, 4, 5, 6}
    assert navigation.find_text(lines, "WHAT THIS COLLECTION").count() == 9


def test_closure_and_cycles(spark, bundled):
    edges = bundled[1].reference_edges.select(F.col("from_doc_id").alias("a"), F.col("to_doc_id").alias("b"))
    pairs = navigation.closure(edges, scratch_writer(spark))
    reach = {(r["a"], r["b"]) for r in edges.collect()}
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    assert {(r["a"], r["b"]) for r in pairs.collect()} == reach
    assert {r["doc_id"]: r["hops"] for r in navigation.cycles(pairs).collect()}["8.1"] == 2


def test_closure_of_a_long_chain(spark):
    n = 1_200
    pairs = navigation.closure(spark.range(n - 1).selectExpr("id as a", "id + 1 as b"), scratch_writer(spark))
    assert tuple(pairs.agg(F.count("*"), F.count_if(F.col("hops") == F.col("b") - F.col("a")), F.max("hops")).head()) == (n * (n - 1) // 2, n * (n - 1) // 2, n - 1)


def test_corpus_findings(spark):
    result = validate_corpus(
        in_memory(
            spark,
            [
                ("a", doc("1", entries=["2 - T (dependency - x)", "3 - Old (authority - x)", "9 - N (contract - x)"], body="see 2#9 and see 4 and per 77")),
                ("b", doc("2", body="## 2#1 - S")),
                ("c", doc("3", "New", body="## 2#5 - F")),
                ("d", doc("4", body="## 4#1 - S")),
                ("e", doc("4", body="## 4#1 - S\n\n## 2#5 - F")),
                ("f", "no heading"),
            ],
        )
    )
    assert findings(result) == [
        ("a", "corpus/reference-title-mismatch", "warning", ""),
        ("a", "corpus/undeclared-inline-target", "error", ""),
        ("a", "corpus/unresolved-inline-target", "error", ""),
        ("a", "corpus/unresolved-reference-target", "error", ""),
        ("c", "corpus/duplicate-section-id", "error", ""),
        ("d", "corpus/duplicate-doc-id", "error", ""),
        ("d", "corpus/duplicate-section-id", "error", ""),
        ("e", "corpus/duplicate-doc-id", "error", ""),
        ("e", "corpus/duplicate-section-id", "error", ""),
        ("e", "corpus/duplicate-section-id", "error", ""),
    ]
    row = statistics(result).head()
    assert (row["documents"], row["doc_ids"], row["section_ids"]) == (5, 0, 0)
    ok = {r["uri"]: (r["ok"], r["has_extracted"]) for r in result.lint_results.collect()}
    assert ok["a"] == (True, True) and ok["c"] == (False, True) and ok["f"] == (False, False)
    assert report.exit_code(result) == 1 and "(corpus)" not in report.validation_pretty(result)
    totals = severity_totals(result.diagnostics).head()
    assert totals["infos"] == 4 and totals["unparsable"] == 0
    assert {r["uri"] for r in corpus.doc_index(result.identity).filter("doc_id = '4'").collect()} == {"d"}


@pytest.mark.parametrize(
    "markdown, expected",
    [
        ("text", [("R101", "error", "")]),
        ("# 1 - a\n\n# 2 - b", [("R101", "error", "")]),
        ("# Title", [("R101", "error", "")]),
        ("# 3-4", [("R103", "error", "")]),
        ("# 1 - a", [("R103", "error", "")]),
        ("# 1 - a\n\n## References", [("R103", "info", "references-empty")]),
        ("# 1 - a\n\n## References\n\n## References", [("R103", "error", "")]),
        ("# 1 - a\n\n> ## References\n>\n> - 2 - T (dependency - x)", [("R103", "error", "references-placement")]),
        ("# 1 - a\n\n## References\n\n- 2 - T (dependency - x)\n- 2 - T (authority - x)", [("R103", "error", "duplicate")]),
        ("# 1 - a\n\n## References\n\n- 2 - T (Dependency - x)", [("R103", "error", "direction")]),
        ("# 1 - a\n\n## References\n\n- 2..1 - T (dependency - x)", [("R103", "error", "target")]),
        ("# 1 - a\n\n## References\n\n- 2 -   (dependency - x)", [("R103", "error", "format")]),
        ("# 1 - a\n\nsee 2#1\n\n## References\n\n- 3 - T (dependency - x)", [("R104", "error", "undeclared-target")]),
        ("# 1 - a\n\nsee 2\n\n## References\n\n- 3 - T (dependency - x)", [("R104", "warning", "undeclared-target")]),
        ("# 1 - a\n\nsee **2**\n\n## References\n\n- 3 - T (dependency - x)", [("R104", "warning", "citation-source-form")]),
        ("# 1 - a\n\nsee **3**\n\n## References\n\n- 3 - T (dependency - x)", [("R104", "error", "citation-source-form")]),
        ("# 1 - a\n\nsee 1#1\n\n## References\n\n- 3 - T (dependency - x)", []),
    ],
)
def test_document_findings(spark, markdown, expected):
    rows = lint_document(spark, "u", markdown).document_diagnostics.collect()
    assert sorted((r["rule_id"], r["severity"], r["data"].get("cause") or r["data"].get("reason") or "") for r in rows) == expected


def test_unparsable_documents_stop_nothing(spark):
    from citegraph.plans.parse import parse_documents
    from citegraph.plans.validate import CorpusResult

    documents = in_memory(spark, [("a", doc("1")), ("b", "x" * 1_000), ("c", None)])
    result = CorpusResult(parse_documents(documents, most_characters=500))
    row = statistics(result).head()
    assert not row["complete"] and row["unparsable"] == ["b"] and row["documents"] == 1
    assert ("b", "document/unparsable", "error", "unparsable-document") in findings(result, "document_diagnostics")


def test_host_extractions_and_the_empty_corpus(spark):
    identity = spark.createDataFrame([("a", 0, "1", "T", None), ("b", 1, "2", "T", None)], "uri string, doc_ord long, doc_id string, title string, range struct<start_line:int,start_character:int,end_line:int,end_character:int>")
    sections = spark.createDataFrame([("b", 1, 0, "2#1", "S", 2, "2")], "uri string, doc_ord long, ord int, id string, title string, heading_depth int, parent_id string")
    edges = spark.createDataFrame([], "uri string, doc_ord long, ord int, from_doc_id string, to_doc_id string, direction string, title string, explanation string")
    inline = spark.createDataFrame([("a", 0, 0, "1", "2#1", "see")], "uri string, doc_ord long, ord int, from_id string, to_id string, kind string")
    none = lint_document(spark, "x", doc("5")).document_diagnostics.filter("false")
    found = corpus.corpus_diagnostics(identity, sections, edges, inline, none).collect()
    assert [r["rule_id"] for r in found] == ["corpus/undeclared-inline-target"]
    empty = validate_corpus(in_memory(spark, [("a", "x")]).limit(0), keep=False)
    assert statistics(empty).head()["documents"] == 0 and report.exit_code(empty) == 0


def test_section_context_is_an_as_of_join(spark):
    heads = spark.createDataFrame([("u", 2, "1#1"), ("u", 6, "1#2")], "uri string, at int, section_id string")
    runs = spark.createDataFrame([("u", 1, "a"), ("u", 3, "b"), ("u", 9, "c"), ("v", 1, "d")], "uri string, at int, run string")
    rows = navigation.as_of_section(heads, runs).orderBy("uri", "at").collect()
    assert [r["context"] for r in rows] == [None, "1#1", "1#2", None]


def test_hierarchy_against_windows(bundled):
    """In a well-formed corpus a section's parent is the last one before it a level up, which a window tells as well."""
    from pyspark.sql import Window

    rows = bundled[1].sections
    before = Window.partitionBy("uri").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    for level in (2, 3):
        parent = F.last(F.when(F.col("heading_depth") == level - 1, F.col("id")), ignorenulls=True).over(before)
        assert rows.withColumn("p", parent).filter((F.col("heading_depth") == level) & (F.col("p") != F.col("parent_id"))).isEmpty()


def test_strip_identity(spark):
    text = "# 1 - A\n\n## 1#1 - B\n```\n# 1 - kept\n```\nsee 2\n## References\n- 2 - T (dependency - x)\n## 1#2 - C\nend\n"
    rows = report.strip_identity(t.search_lines(in_memory(spark, [("u", text)])), "1").orderBy("line_no").collect()
    assert [r["text"] for r in rows] == ["# A", "", "## B", "```", "# 1 - kept", "```", "see 2", "## C", "end"]


def test_references_block(spark):
    text = "a\n## References\n" + "\n".join(f"l{i}" for i in range(60))
    rows = navigation.references_block(t.search_lines(in_memory(spark, [("u", text)])))
    assert [r["line_no"] for r in rows.orderBy("line_no").collect()] == list(range(2, 43))


def test_rules_of_bare_tables(spark):
    """Rules take tables of facts from anywhere."""
    result = lint_document(spark, "u", doc("1", entries=["2 - T (dependency - x)"], body="see 2"))
    judged = rules.judged_citations(result.parsed, result.identity, result.reference_edges)
    assert [(r["from_id"], r["to_id"], r["kind"]) for r in rules.inline_edges(judged).collect()] == [("1", "2", "see")]


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    from citegraph import streaming

    for name, markdown in example.texts():
        (tmp_path / "docs").mkdir(exist_ok=True)
        (tmp_path / "docs" / name.split("/")[-1]).write_text(markdown)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    streaming.parsed_stream(streaming.folder_stream(spark, str(tmp_path / "docs")), out, check).awaitTermination()
    assert statistics(streaming.corpus_of(spark, out)).head()["total_edges"] == 38
    (tmp_path / "docs" / "9.md").write_text(doc("9", entries=["8.1 - Scheduling (dependency - x)"]))
    streaming.parsed_stream(streaming.folder_stream(spark, str(tmp_path / "docs")), out, check).awaitTermination()
    assert statistics(streaming.corpus_of(spark, out)).head()["documents"] == 10


def test_command_line(capsys):
    args = cli.parser().parse_args(["lint", "x", "--ignore", "a", "--ignore", "b", "--format", "json"])
    assert args.ignore == ["a", "b"] and args.timeout == 120 and args.max_memory == 2048
    assert cli.main(["nonsense"]) == 2 and cli.main(["lint", "--timeout", "0"]) == 2 and cli.main(["--version"]) == 0
    capsys.readouterr()


def test_stream_tells_folders_apart_and_takes_the_last_version(spark, tmp_path):
    import os

    from citegraph import streaming

    docs, out = tmp_path / "docs", str(tmp_path / "out")
    for folder, own, other in (("a", 1, 2), ("b", 2, 1)):
        (docs / folder).mkdir(parents=True)
        (docs / folder / "x.md").write_text(f"# {own} - T{own}\n\nAs said, see {other}.\n\n## References\n\n- {other} - T{other} (authority - holds)\n")
    streaming.parsed_stream(streaming.folder_stream(spark, str(docs)), out, str(tmp_path / "check")).awaitTermination()
    result = streaming.corpus_of(spark, out)
    assert sorted(r["uri"] for r in result.parsed.collect()) == ["a/x.md", "b/x.md"] and result.diagnostics.count() == 0
    assert streaming.refresh(spark, str(docs), out) == 0
    (docs / "a" / "x.md").write_text("# 1 - New\n\n## References\n\n- 2 - T2 (authority - holds)\n")
    os.utime(docs / "a" / "x.md", (2_000_000_000, 2_000_000_000))
    (docs / "c [1].md").write_text("# 3 - Third\n\n## References\n")
    assert streaming.refresh(spark, str(docs), out) == 2 and streaming.refresh(spark, str(docs), out) == 0
    again = streaming.corpus_of(spark, out)
    assert {r["uri"]: r["title"] for r in again.identity.collect()} == {"a/x.md": "New", "b/x.md": "T2", "c [1].md": "Third"}
    assert again.inline_edges.count() == 1
    assert [r["rule_id"] for r in again.diagnostics.filter("severity <> 'info'").collect()] == ["corpus/reference-title-mismatch"]


def test_relative_paths(spark):
    from pyspark.sql import functions as F

    from citegraph.streaming import relative

    for whole, folder, expected in (("file:/data/x/a/b.md", "/data/x", "a/b.md"), ("s3a://bucket/x/b.md", "s3a://bucket/x/", "b.md"), ("file:///data/x/b.md", "file:/data/x", "b.md")):
        assert spark.range(1).select(relative(F.lit(whole), folder).alias("r")).head()["r"] == expected


def test_deep_lists_cost_what_their_size_costs():
    import time

    from citegraph.markdown.facts import extract

    def seconds(levels):
        began = time.process_time()
        extract("".join("  " * i + "- x\n" for i in range(levels)))
        return time.process_time() - began

    seconds(100)
    assert seconds(800) < 40 * max(seconds(200), 0.02)  # 16 times the text
    assert time.process_time() and extract("- " * 4_000 + "x\n").headings == []


def test_documents_of_any_length_are_read_unless_a_host_sets_a_budget(spark):
    from citegraph.plans.validate import validate_corpus
    from citegraph.sources.folder import in_memory

    rows = in_memory(spark, [("a.md", "# 1 - One\n\n" + "words " * 200 + "\n\n## References\n")])
    assert validate_corpus(rows, keep=False).identity.count() == 1
    assert validate_corpus(rows, keep=False, most_characters=100).diagnostics.head()["rule_id"] == "document/unparsable"
