"""Queries over whole tables against brute force, at the smallest scale."""

import os
import re
from collections import defaultdict

import pytest

from citegraph import queries
from citegraph.sources import render

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    import pyarrow.parquet as pq

    return lambda name: pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_closure_of_the_ledger(spark, tables):
    out = defaultdict(set)
    customer = {r["o_orderkey"]: r["o_custkey"] for r in tables("orders")}
    for r in tables("nation"):
        out[f"3.{r['n_nationkey']}"].add(f"4.{r['n_regionkey']}")
    for r in tables("supplier"):
        out[f"2.{r['s_suppkey']}"].add(f"3.{r['s_nationkey']}")
    for r in tables("customer"):
        out[f"1.{r['c_custkey']}"].add(f"3.{r['c_nationkey']}")
    for r in tables("lineitem"):
        out[f"1.{customer[r['l_orderkey']]}"].add(f"2.{r['l_suppkey']}")
    expected = {}
    for a in list(out):
        now, hops = {a}, 0
        while now:
            hops += 1
            now = {b for x in now for b in out.get(x, ()) if (a, b) not in expected}
            expected |= {(a, b): hops for b in now}
    rows = queries.QUERIES["op_nav_16_closure"](spark, SF).collect()
    assert len(rows) == len(expected) and {(r["a"], r["b"]): r["hops"] for r in rows} == expected


def test_markdown_lines_of_the_documents(spark, tables):
    expected = set()
    for r in tables("documents"):
        text = (r["text"] or "").replace("\n", ("\n", "\r\n", "\r")[r["doc_id"] % 3])
        at, pieces = 0, re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z", text)
        for n, piece in enumerate(pieces):
            expected.add((r["doc_id"], n, at, piece.rstrip("\r\n"), n == 0 or pieces[n - 1].endswith("\n")))
            at += len(piece)
        if not pieces or pieces[-1].endswith("\n"):
            expected.add((r["doc_id"], len(pieces), at, "", True))
    rows = [tuple(r) for r in queries.QUERIES["op_lex_markdown_lines"](spark, SF).collect()]
    assert len(rows) == len(expected) and set(rows) == expected


@pytest.fixture(scope="module")
def ledger(spark):
    texts = {r["uri"]: r["markdown"].split("\n") for r in render.ledger(spark, SF).collect()}
    return {uri: [*enumerate(lines if lines[-1] else lines[:-1], 1)] for uri, lines in texts.items()}


def test_references_blocks_of_the_ledger(spark, ledger):
    expected = []
    for uri, lines in ledger.items():
        heads = [n for n, line in lines if line.startswith("## References")]
        expected += [(uri, n) for n, _ in lines if any(h <= n <= h + 40 for h in heads)]
    found = [tuple(r) for r in queries.QUERIES["op_nav_3_references_block"](spark, SF).collect()]
    assert sorted(found) == sorted(expected) and any(n > 45 for n, _ in max(ledger.values(), key=len)) and any(u.startswith("customer/") for u, _ in found)


def test_find_text_in_the_ledger(spark, ledger):
    found = [r["uri"] for r in queries.QUERIES["op_nav_13_find_text"](spark, SF).collect()]
    expected = {uri for uri, lines in ledger.items() if any("0000001" in line for _, line in lines)}
    assert len(found) == len(expected) and set(found) == expected
    assert any("0000001" not in ledger[uri][0][1] for uri in found)


def test_strip_identity_of_the_ledger(spark, ledger):
    expected = []
    for uri, lines in ledger.items():
        skipped = False
        for n, line in lines:
            if re.match("#{1,6} ", line):
                skipped = line == "## References"
                line = re.sub(r"^(#{1,6} )[1-4]\.[0-9]+(?:#[0-9.]+)? *[-–—] *", r"\1", line)
            if not skipped:
                expected.append((uri, n, line))
    found = [tuple(r) for r in queries.QUERIES["op_snk_7_strip_identity"](spark, SF).collect()]
    assert sorted(found) == sorted(expected) and {u.split("/")[0] for u, _, _ in found} == {"customer", "supplier", "nation", "region"}


def test_search_lines_of_odd_documents(spark, tmp_path):
    """A text without lines, null texts, equal and null keys: a row each, as in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    texts = [(1, ""), (2, None), (3, "\n"), (4, "\n\na"), (5, "a\r\nb\n"), (5, "zwölf"), (None, "x\n\n"), (None, "")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = [tuple(r) for r in queries.QUERIES["op_lex_search_lines"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, con.execute(queries.ORACLE_SQL["op_lex_search_lines"]).fetchall())) and len(rows) == len(texts)
