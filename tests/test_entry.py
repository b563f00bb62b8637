"""The driver's contract, at the smallest scale; the graph queries against their SQL twins."""

import importlib
import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
NAMES = ["op_lex_identifiers", "op_lex_headings", "op_lex_entries", "op_src_meta_documents", "op_r101_identities", "op_r103_reference_edges", "op_r10x_document_diagnostics", "op_jn_corpus_diagnostics", "op_nav_recipes", "op_r101_cases", "op_r102_cases", "op_r103_cases", "op_r104_cases", "op_r104_case_edges", "op_agg_case_statistics", "op_nav_case_recipes", "op_lex_markdown_lines", "op_nav_3_references_block", "op_nav_13_find_text", "op_nav_15_guarantee", "op_nav_16_closure", "op_snk_7_strip_identity"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    import __spark_entry__ as entry

    ours = entry.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda df: sorted(repr(tuple(None if v != v else v for v in r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))
    assert rows(ours) == rows(theirs)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_llm_folders(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("corpus_pipeline")
    assert not any(n.startswith("op1_") or n == "pipeline" for n in entry.queries())
