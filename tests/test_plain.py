"""The one-pass parser against the whole one, and queries within a document's row against the same over lines."""

import random

import pytest
from pyspark.sql import functions as F

from citegraph import report
from citegraph.functions import text as t
from citegraph.markdown import plain
from citegraph.markdown.facts import extract
from citegraph.operators import navigation, rules
from citegraph.plans.parse import parse_documents
from citegraph.sources import render
from citegraph.sources.folder import in_memory

PIECES = [
    "# 1 - a", "# 2.1 - b", "## 1#1 - S", "## 1#2 – T", "### 1#1.1 - U x", "## References", "## References ##", "## Words", "#### 1#1.1.1 - d", "see 2#1.", "See 2", "per 3.1.4", "see  2", "see\n3",
    "- 2 - T (dependency - x)", "- 3.1 - *N* (authority - (y) z)", "- 2 (x", "- 2. a", "1. x", "12 words per 5", "words _see_ 2", "s*e*e 2", "`see 2`", "\\see 2", "[a]: b", "[see 2](x)", "- x", "- - y",
    "> q", "---", "===", "  in", "    code", "- # h", "é see 2\U0001f600", "\U0001f600 per 2.", "", "", "", "a  \nsee 2", "a\r\nb", "\tq", "<b>see</b> 2", "&#115;ee 2", "* s", "~~~", "7 - see 2.",
    "(see 2) per 2;see 3#1, per 3#1x seesee 4", "## 1#2 - T #", "## 2.0#7 - F", "-", "- 2 - T  (dependency - x) ", " see 2", "##", "#x", "-  2 - T (contract - q)", "- 1.2 - Ab (contract - q) see 2",
]


def test_plain_documents_give_the_rows_of_the_whole_parser():
    pick = random.Random(7)
    documents = [text.replace("{k}", "3").replace("{t}", "Na_me") for text, _ in render.CASES.values()]
    documents += [between.join(pick.choice(PIECES) for _ in range(pick.randint(1, 9))) + pick.choice(["", "\n"]) for between in ("\n", "\n\n") for _ in range(3_000)]
    plainly = 0
    for document in documents:
        facts = extract(document)
        for wanted in (plain.FACTS, (), ("headings",), ("entries", "citations")):
            rows, whole = plain._Plain(document, wanted).rows(), plain.rows_of(facts, wanted)
            if rows is not None:
                plainly += 1
                assert ([tuple(h) for h in rows[0]], *rows[1:]) == whole, (document, wanted)
    assert plainly > 3_000


@pytest.mark.parametrize("text", ["see` 2", "s*e*e 2", "see\\\n2", "see  \n  2", "&#115;ee 2", "s<b>ee</b> 2", "[see](x) 2"])
def test_no_paragraph_that_cites_is_quiet(text):
    assert not plain.quiet(text) and plain.quiet("see it, per 60s is no number: persee") is False


ODD = [
    ("a", "# 1 - A\n\n## 1#1 - B\n```\n# 1 - kept\n```\nsee 2\n## References\n- 2 - T (dependency - x)\n## 1#2 - C\nend\n"), ("b", ""), ("c", "\n"), ("d", "## References"),
    ("e", "## References\n~~~\n# 1 - in\n## References\n"), ("f", "x\n" * 50 + "## References\n" + "y\n" * 30 + "## References\n" + "z\n" * 60 + "last"), ("g", "```\n## References\n```\n## References\nq\n# 1 - A\n```\n# 1 - A"),
]


def test_queries_over_documents_equal_those_over_lines(spark):
    documents = in_memory(spark, ODD)
    lines = t.search_lines(documents)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(navigation.document_references_blocks(documents)) == rows(navigation.references_block(lines))
    assert rows(report.stripped_documents(documents.withColumn("doc_id", F.lit("1")))) == rows(report.strip_identity(lines, "1"))
    assert rows(navigation.find_in_documents(documents, "LAST")) == rows(navigation.find_text(lines, "LAST")) == [("f",)]
    assert {r["uri"]: r["n"] for r in documents.select("uri", t.search_line_count(F.col("markdown")).alias("n")).collect()} == {u: x.count("\n") + (x != "" and x[-1] != "\n") for u, x in ODD}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_of_a_document_shuffle_nothing(spark):
    parsed = parse_documents(spark.range(2).selectExpr("string(id) as uri", "id as doc_ord", "'# 1 - a' as markdown"))
    tables = [rules.identities(parsed), rules.sections(parsed), rules.section_diagnostics(parsed), rules.judged_entries(parsed), rules.judged_citations(parsed), rules.references_diagnostics(parsed, None, rules.judged_entries(parsed))]
    assert not any("Exchange" in plan(table) for table in tables)
    # A document of the same path twice is two documents.
    twice = parse_documents(in_memory(spark, [("u", "# 1 - a\n\nsee 2\n\n## References\n\n- 2 - T (dependency - x)\n")] * 2))
    assert [r["issue"] for r in rules.judged_entries(twice).collect()] == [None, None] and rules.inline_edges(rules.judged_citations(twice)).count() == 2


def test_case_documents_are_spread_over_tasks(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    assert render.cases(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ledger_of_odd_keys(spark, tmp_path):
    """Suppliers sold twice or unknown, orders of nobody or of no items: as the SQL has it."""
    spark.sql("select 0 r_regionkey, 'R' r_name").write.parquet(f"{tmp_path}/region.parquet")
    spark.sql("select 0 n_nationkey, 'N' n_name, 0 n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("select 5L s_suppkey, 'S5' s_name, 0 s_nationkey union all select 40L, 'S40', 0").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("select 1L c_custkey, 'C1' c_name, 0 c_nationkey union all select 2L, 'C2', 0").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(10, 1), (7, 1), (8, 3), (9, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 40), (7, 5), (7, 5), (7, 6), (10, 5), (8, 5)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    texts = {r["uri"]: r["markdown"] for r in render.ledger(spark, str(tmp_path)).collect()}
    one = texts["customer/1.md"]
    assert [x for x in one.split("\n") if x[:1] == "#"] == ["# 1.1 - C1", "## 1.1#1 - Order 7", "### 1.1#1.1 - Supply 5", "### 1.1#1.2 - Supply 6", "### 1.1#1.3 - Supply 40", "## 1.1#2 - Order 10", "### 1.1#2.1 - Supply 5", "## References"]
    assert [x[:6] for x in one.split("\n") if x[:3] == "- 2"] == ["- 2.5 ", "- 2.40"] and "Order" not in texts["customer/2.md"] and len(texts) == 6
