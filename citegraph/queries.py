"""Queries over the parquet tables, one or more for each group of operators, and their DuckDB twins.

Corpora are rendered from rows (``citegraph.sources.render``), so the twins compute the expected result from the same rows and
never parse Markdown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.functions import grammar as g
from citegraph.functions import text as t
from citegraph.markdown.plain import FACTS
from citegraph.operators import corpus, navigation, rules, statistics
from citegraph.plans.parse import parse_documents
from citegraph.plans.validate import CorpusResult
from citegraph.scratch import scratch_writer
from citegraph.sources import render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_RESULTS: dict[tuple, tuple[CorpusResult, Callable[[], bool]]] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _corpus(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return {"ledger": lambda: render.ledger(spark, sf_dir), "defects": lambda: render.ledger(spark, sf_dir, True), "prose": lambda: render.prose(spark, sf_dir), "cases": lambda: render.cases(spark, sf_dir)}[kind]()


def validated(spark: SparkSession, sf_dir: str, kind: str = "ledger", facts: tuple[str, ...] = FACTS) -> CorpusResult:
    """The validation of a rendered corpus. What is parsed is written once, and shared by the queries of a session that need no more facts."""
    for (app, folder, of, has), (result, exists) in list(_RESULTS.items()):
        if (app, folder, of) == (spark.sparkContext.applicationId, sf_dir, kind) and set(facts) <= set(has) and exists():
            return result
    write = scratch_writer(spark)
    parsed = write(rules.prepared(parse_documents(_corpus(spark, sf_dir, kind), facts=facts)), "parsed")
    # The tables of a document's rules are filters and projections of its row: reading it again is cheaper than keeping them.
    result = CorpusResult(parsed, True)
    _RESULTS[spark.sparkContext.applicationId, sf_dir, kind, facts] = result, write.exists
    return result


def once(spark: SparkSession, sf_dir: str, kind: str = "ledger", facts: tuple[str, ...] = FACTS, kept: tuple[str, ...] = ()) -> CorpusResult:
    """The same for a query that goes over the documents just once: parsed as it is read, nothing is written."""
    return CorpusResult(parse_documents(_corpus(spark, sf_dir, kind), kept=kept, facts=facts))


# -- lexical functions ----------------------------------------------------------

_STRINGS = """
SELECT c_custkey, CASE c_custkey % 16
  WHEN 0 THEN '8.' || CAST(c_custkey AS STRING) WHEN 1 THEN '8..' || CAST(c_custkey AS STRING) WHEN 2 THEN 'a' || CAST(c_custkey AS STRING)
  WHEN 3 THEN '8.1#' || CAST(c_custkey AS STRING) WHEN 4 THEN '8#1.' || CAST(c_custkey AS STRING) || '.2' WHEN 5 THEN '#' || CAST(c_custkey AS STRING)
  WHEN 6 THEN CAST(c_custkey AS STRING) || ' - ' || c_name WHEN 7 THEN '8.' || CAST(c_custkey AS STRING) || '—' || c_name || ' - more'
  WHEN 8 THEN '8#' || CAST(c_custkey AS STRING) || ' – ' || c_name WHEN 9 THEN '8.1#' || CAST(c_custkey AS STRING) || ' -' WHEN 10 THEN '8#1#' || CAST(c_custkey AS STRING)
  WHEN 11 THEN 'Report 3-' || CAST(c_custkey AS STRING) WHEN 12 THEN '  ' || CAST(c_custkey AS STRING) || '.  - ' || c_name WHEN 13 THEN '00.' || CAST(c_custkey AS STRING)
  WHEN 14 THEN c_name ELSE '' END AS s
FROM customer"""


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    render.table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_STRINGS)


_P = "[0-9]+(?:[.][0-9]+)*"


@query(
    f"""WITH strings AS ({_STRINGS}) SELECT c_custkey,
  regexp_full_match(s, '{_P}') AS is_doc, regexp_full_match(s, '{_P}#{_P}') AS is_section,
  CASE WHEN regexp_full_match(s, '{_P}#{_P}') THEN split_part(s, '#', 1) END AS section_doc, CASE WHEN regexp_full_match(s, '{_P}#{_P}') THEN split_part(s, '#', 2) END AS path,
  regexp_full_match(s, '{_P}#{_P}') AND split_part(s, '#', 1) = '8.1' AS extends_8_1,
  CAST(CASE WHEN s = '' THEN 0 ELSE len(string_split(s, '.')) END AS INTEGER) AS segments,
  CAST(CASE WHEN regexp_full_match(s, '{_P}#{_P}') THEN len(string_split(split_part(s, '#', 2), '.')) ELSE 0 END AS INTEGER) AS path_length,
  CAST(c_custkey % 6 - 1 AS BIGINT) AS expected_length, split_part(s, '#', 1) AS target_doc
FROM strings"""
)
def op_lex_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEX-1..6, LEX-12."""
    s = F.col("s")
    return strings(spark, sf_dir).select(
        "c_custkey", g.is_doc_id(s).alias("is_doc"), g.is_section_id(s).alias("is_section"), g.section_doc(s).alias("section_doc"), g.section_path(s).alias("path"),
        g.extends_doc(s, F.lit("8.1")).alias("extends_8_1"), g.segment_count(s).alias("segments"), g.section_path_length(s).alias("path_length"),
        g.expected_path_length(F.col("c_custkey") % 6).alias("expected_length"), g.target_doc(s).alias("target_doc"),
    )


_H = f"^({_P})\\s*[-–—]\\s*(.+)$"
_SH = f"^({_P}#{_P})\\s*[-–—]\\s*(.+)$"


@query(
    f"""WITH strings AS (SELECT c_custkey, s AS raw, trim(s) AS s FROM ({_STRINGS})) SELECT c_custkey,
  CASE WHEN regexp_matches(s, '{_H}') THEN regexp_extract(s, '{_H}', 1) END AS doc_id, CASE WHEN regexp_matches(s, '{_H}') THEN regexp_extract(s, '{_H}', 2) END AS title,
  CASE WHEN regexp_matches(s, '{_SH}') THEN regexp_extract(s, '{_SH}', 1) END AS section_id, CASE WHEN regexp_matches(s, '{_SH}') THEN regexp_extract(s, '{_SH}', 2) END AS section_title,
  regexp_matches(raw, '[0-9]\\s*[-–—]\\s*\\S') AS separated,
  trim(regexp_extract(raw, '^([^-–—]*)', 1)) AS candidate, regexp_extract(raw, '^[^-–—]*[-–—]\\s*(.*)$', 1) AS rest, regexp_matches(raw, '^\\s*[0-9]') AS digit_first
FROM strings"""
)
def op_lex_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEX-7..11, LEX-14."""
    s = F.col("s")
    return strings(spark, sf_dir).select(
        "c_custkey", g.heading_doc_id(s).alias("doc_id"), g.heading_title(s).alias("title"), g.section_heading_id(s).alias("section_id"), g.section_heading_title(s).alias("section_title"),
        g.has_separator(s).alias("separated"), g.section_candidate(s).alias("candidate"), g.title_after_dash(s).alias("rest"), g.starts_with_digit(s).alias("digit_first"),
    )


@query(
    """SELECT s_suppkey, CAST(length('2.' || s_suppkey || ' - ' || s_name || ' ') AS INTEGER) AS open, '2.' || s_suppkey AS target, s_name AS title,
  CASE s_suppkey % 2 WHEN 0 THEN 'dependency' ELSE 'authority' END AS direction, 'sells (in (two) ways) to all' AS explanation FROM supplier"""
)
def op_lex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEX-15, LEX-16."""
    direction = F.when(F.col("s_suppkey") % 2 == 0, "dependency").otherwise("authority")
    entry = F.concat(F.lit("2."), F.col("s_suppkey").cast("string"), F.lit(" - "), "s_name", F.lit(" ("), direction, F.lit(" - sells (in (two) ways) to all)"))
    rows = render.table(spark, sf_dir, "supplier").select("s_suppkey", entry.alias("e"))
    return rows.select("s_suppkey", g.relationship_parenthesis(F.col("e")).alias("open"), g.entry_fields(F.col("e")).alias("f")).select("s_suppkey", "open", "f.*")


@query(
    """WITH pieces AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
SELECT doc_id, CAST(len(p) - CASE WHEN p[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n_lines, CAST(length(p[1]) AS BIGINT) AS first_length FROM pieces"""
)
def op_lex_search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEX-21..23 as searches see lines: a row for each text, also for one without lines."""
    text = F.coalesce("text", F.lit(""))
    first = F.length(F.substring_index(text, "\n", 1))
    return render.table(spark, sf_dir, "documents").select("doc_id", t.search_line_count(text).cast("long").alias("n_lines"), first.cast("long").alias("first_length"))


@query(
    r"""WITH texts AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), CASE doc_id % 3 WHEN 1 THEN chr(13) || chr(10) WHEN 2 THEN chr(13) ELSE chr(10) END) AS t FROM documents),
pieces AS (SELECT doc_id, regexp_split_to_array(t, '\r\n|\n|\r') AS lines, regexp_extract_all(t, '\r\n|\n|\r') AS ends FROM texts),
each AS (SELECT doc_id, unnest(lines) AS text, unnest(list_concat([NULL], ends)) AS ended, unnest(list_concat(ends, [NULL])) AS ends, unnest(range(len(lines))) AS line_no FROM pieces)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(coalesce(sum(length(text) + coalesce(length(ends), 0)) OVER before, 0) AS INTEGER) AS start_off, text, coalesce(ends_with(ended, chr(10)), true) AS starts_search_line
FROM each WINDOW before AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def op_lex_markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LEX-21, LEX-22 over all texts: a lone CR, CRLF and LF all end a Markdown line; two thirds of the texts get CRLF or a lone CR for their line feeds."""
    text = F.coalesce("text", F.lit(""))
    ending = F.when(F.col("doc_id") % 3 == 1, "\r\n").when(F.col("doc_id") % 3 == 2, "\r").otherwise("\n")
    rows = render.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uri"), F.col("doc_id").alias("doc_ord"), F.replace(text, F.lit("\n"), ending).alias("markdown"))
    return t.markdown_lines(rows).select(F.col("doc_ord").alias("doc_id"), "line_no", "start_off", "text", "starts_search_line")


# -- discovery --------------------------------------------------------------------

_GLOBS = ("**/en/*", "*.example.org/**", "**/1*.html", "m.*/??/**", "**/*", "blog.*", "**/de/**", "www.**.html")


@query(
    "WITH paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '') AS path FROM pages), globs(pattern, re) AS (VALUES "
    + ", ".join(f"('{p}', '{t.Glob(p).regex()}')" for p in _GLOBS)
    + ") SELECT page_id, pattern FROM paths, globs WHERE regexp_matches(path, re)"
)
def op_src_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6, SRC-8, JN-8: paths by patterns."""
    patterns = spark.createDataFrame([(p,) for p in _GLOBS], "pattern string")
    return t.matching_patterns(render.paths(spark, sf_dir), patterns).select("page_id", "pattern")


@query(
    """WITH paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://', ''), '[?#].*$', '') AS path FROM pages),
named AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN path || '/README.md' WHEN 1 THEN path || '/.license' ELSE path || '/Changelog.old.md' END AS path FROM paths),
based AS (SELECT page_id, lower(regexp_replace(split_part(path, '/', -1), '(.)[.][^.]*$', '\\1')) AS base FROM named)
SELECT page_id, base, base IN ('navigation-protocol','readme','claude','agents','contributing','changelog','license','licence','code_of_conduct','security','authors','notice') AS meta FROM based"""
)
def op_src_meta_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7, API-6."""
    ends = F.when(F.col("page_id") % 3 == 0, "/README.md").when(F.col("page_id") % 3 == 1, "/.license").otherwise("/Changelog.old.md")
    base = t.base_name(F.concat("path", ends))
    return render.paths(spark, sf_dir).select("page_id", base.alias("base"), base.isin(*t.META_NAMES).alias("meta"))


@query(
    """WITH files AS (SELECT n_nationkey, '# skipped' || chr(13) || chr(10) || '  ' || n_name || '/**  ' || chr(10) || chr(10) || '*.tmp' AS body FROM nation),
lines AS (SELECT n_nationkey, trim(unnest(string_split(replace(body, chr(13), ''), chr(10)))) AS pattern FROM files)
SELECT n_nationkey, pattern FROM lines WHERE pattern <> '' AND NOT starts_with(pattern, '#')"""
)
def op_src_ignore_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9 as a table expression."""
    body = F.concat(F.lit("# skipped\r\n  "), "n_name", F.lit("/**  \n\n*.tmp"))
    lines = render.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.split(body, "\\r?\\n")).alias("line"))
    return lines.select("n_nationkey", g.js_trim(F.col("line")).alias("pattern")).filter("pattern <> '' and not startswith(pattern, '#')")


# -- the extracted graph ------------------------------------------------------------

_PLACES = "places AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)"
_SUPPLIES = (
    _PLACES + ", pairs AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), supplies AS (SELECT o_custkey, k, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS j "
    "FROM pairs JOIN places ON l_orderkey = o_orderkey)"
)
_IDENTITY = """SELECT '4.' || r_regionkey AS doc_id, r_name AS title FROM region UNION ALL SELECT '3.' || n_nationkey, n_name FROM nation
UNION ALL SELECT '2.' || s_suppkey, s_name FROM supplier UNION ALL SELECT '1.' || c_custkey, c_name FROM customer"""
_SECTIONS = f"""WITH {_SUPPLIES}
SELECT doc_id AS id, title, CAST(1 AS INTEGER) AS heading_depth, CAST(NULL AS VARCHAR) AS parent_id FROM ({_IDENTITY})
UNION ALL SELECT '1.' || o_custkey || '#' || k, 'Order ' || o_orderkey, 2, '1.' || o_custkey FROM places
UNION ALL SELECT '1.' || o_custkey || '#' || k || '.' || j, 'Supply ' || l_suppkey, 3, '1.' || o_custkey || '#' || k FROM supplies"""
_EDGES = f"""WITH {_SUPPLIES}
SELECT '3.' || n_nationkey AS from_doc_id, '4.' || n_regionkey AS to_doc_id, 'constraint' AS direction, 'lies within it' AS explanation FROM nation
UNION ALL SELECT '2.' || s_suppkey, '3.' || s_nationkey, 'contract', 'trades under its law' FROM supplier
UNION ALL SELECT '1.' || c_custkey, '3.' || c_nationkey, 'authority', 'its law holds' FROM customer
UNION ALL SELECT DISTINCT '1.' || o_custkey, '2.' || l_suppkey, 'dependency', 'delivers (goods) to the customer' FROM supplies"""
_INLINE = f"WITH {_SUPPLIES} SELECT '1.' || o_custkey || '#' || k || '.' || j AS from_id, '2.' || l_suppkey AS to_id, 'per' AS kind FROM supplies"


@query(_IDENTITY)
def op_r101_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-1..4, R101-5, SRC-1."""
    return once(spark, sf_dir, facts=()).identity.select("doc_id", "title")


@query(_SECTIONS)
def op_r102_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R102-4..12."""
    return once(spark, sf_dir, facts=("headings",)).sections.select("id", "title", "heading_depth", "parent_id")


@query(_EDGES)
def op_r103_reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-5..7, R103-15."""
    return once(spark, sf_dir, facts=("entries",)).reference_edges.select("from_doc_id", "to_doc_id", "direction", "explanation")


@query(_INLINE)
def op_r104_inline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-8..10, R104-1, R104-2, R104-10."""
    return once(spark, sf_dir, facts=("entries", "citations")).inline_edges.select("from_id", "to_id", "kind")


@query(f"WITH ids AS ({_IDENTITY}) SELECT doc_id, CASE split_part(doc_id, '.', 1) WHEN '1' THEN 'customer' WHEN '2' THEN 'supplier' WHEN '3' THEN 'nation' ELSE 'region' END || '/' || split_part(doc_id, '.', 2) || '.md' AS uri FROM ids")
def op_snk_doc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-8, AGG-13."""
    return validated(spark, sf_dir, facts=("headings",)).doc_index.select("doc_id", "uri")


@query(f"WITH s AS ({_SECTIONS}) SELECT id AS section_id, 'customer/' || split_part(split_part(id, '#', 1), '.', 2) || '.md' AS uri FROM s WHERE heading_depth > 1")
def op_snk_section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validated(spark, sf_dir, facts=("headings",)).section_index.select("section_id", "uri")


@query(
    f"""WITH s AS ({_SECTIONS}), e AS ({_EDGES}), i AS ({_INLINE}), d AS ({_IDENTITY})
SELECT (SELECT count(*) FROM d) AS documents, (SELECT count(DISTINCT from_doc_id) FROM e) AS documents_with_references, (SELECT count(*) FROM s WHERE heading_depth > 1) AS sections,
  (SELECT count(*) FROM d) AS doc_ids, (SELECT count(*) FROM s WHERE heading_depth > 1) AS section_ids, (SELECT count(*) FROM e) AS reference_entries,
  (SELECT count(*) FROM e WHERE direction = 'authority') AS authority, (SELECT count(*) FROM e WHERE direction = 'dependency') AS dependency,
  (SELECT count(*) FROM e WHERE direction = 'constraint') AS constraint_, (SELECT count(*) FROM e WHERE direction = 'contract') AS contract,
  (SELECT count(*) FROM i) AS inline_references, CAST(0 AS BIGINT) AS section_precise, (SELECT count(*) FROM e) + (SELECT count(*) FROM i) AS total_edges, true AS complete"""
)
def op_agg_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1..8."""
    return statistics.statistics(validated(spark, sf_dir)).withColumnRenamed("constraint", "constraint_").drop("unparsable")


# -- defects: every kind against its predicate on the rows -----------------------------

_KIND = f"(c_custkey % {render.PERIOD})"
_NUMBER = {v: k for k, v in render.DEFECTS.items()}
_RULES = [
    ("unnumbered", "R101", "error", ""), ("setext", "R101", "error", "heading-source-form"), ("skipped-level", "R102", "error", ""), ("foreign-section", "R102", "error", ""),
    ("missing-references", "R103", "error", ""), ("bad-direction", "R103", "error", ""), ("unbalanced", "R103", "error", "references-entry-unbalanced"), ("repeated-entry", "R103", "error", ""),
    ("malformed-citation", "R104", "error", "malformed-target"), ("split-citation", "R104", "error", "citation-source-form"), ("undeclared-prose", "R104", "warning", ""),
]
_DOCUMENT_DEFECTS = (
    f"WITH {_SUPPLIES} SELECT 'region/' || r_regionkey || '.md' AS uri, 'R103' AS rule_id, 'info' AS severity, 'references-empty' AS cause, CAST(1 AS BIGINT) AS n FROM region "
    + " ".join(f"UNION ALL SELECT 'customer/' || c_custkey || '.md', '{rule}', '{severity}', '{cause}', 1 FROM customer WHERE {_KIND} = {_NUMBER[kind]}" for kind, rule, severity, cause in _RULES)
    + f" UNION ALL SELECT 'customer/' || o_custkey || '.md', 'R104', 'warning', '', count(*) FROM supplies WHERE o_custkey % {render.PERIOD} = {_NUMBER['missing-references']} GROUP BY o_custkey"
)


@query(_DOCUMENT_DEFECTS)
def op_r10x_document_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R101-1..7, R102-1..8, R103-1..14, R104-3..9, SF-1..2, SET-2."""
    rows = validated(spark, sf_dir, "defects").document_diagnostics
    return rows.groupBy("uri", "rule_id", "severity", F.coalesce(F.col("data")["cause"], F.lit("")).alias("cause")).agg(F.count("*").alias("n"))


# -- cases: a document for each check of the rules ------------------------------------

_CASES = "cases(kind, rule_id, severity, cause, reason, obstruction) AS (VALUES " + ", ".join(
    f"({at}, {', '.join(repr(x) for x in finding)})" for at, (_, findings) in enumerate(render.CASES.values()) for finding in findings
) + ")"


def _case_sql(rule: str) -> str:
    return (
        f"WITH {_CASES} SELECT 'part/' || p_partkey || '.md' AS uri, severity, cause, reason, obstruction, CAST(count(*) AS BIGINT) AS n "
        f"FROM part JOIN cases ON p_partkey % {len(render.CASES)} = kind WHERE rule_id = '{rule}' GROUP BY ALL"
    )


def _case_findings(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    rows = validated(spark, sf_dir, "cases").rule_diagnostics(rule)
    columns = [F.coalesce(F.col("data")[c], F.lit("")).alias(c) for c in ("cause", "reason", "obstruction")]
    return rows.groupBy("uri", "severity", *columns).agg(F.count("*").alias("n"))


@query(_case_sql("R101"))
def op_r101_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R101-1..7, SF-1, SF-2, LEX-24: a document without, with two, with misnumbered or unsearchable titles."""
    return _case_findings(spark, sf_dir, "R101")


@query(_case_sql("R102"))
def op_r102_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R102-1..8: every reason for which a section is rejected."""
    return _case_findings(spark, sf_dir, "R102")


@query(_case_sql("R103"))
def op_r103_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R103-1..14, PRS-6, LEX-15, LEX-16, LEX-25: the References section and its entries."""
    return _case_findings(spark, sf_dir, "R103")


@query(_case_sql("R104"))
def op_r104_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R104-3..9, LEX-17, LEX-18: malformed, split, not literal and undeclared citations."""
    return _case_findings(spark, sf_dir, "R104")


_CASE_EDGES = ", ".join(f"({list(render.CASES).index(name)}, '{target}')" for name, targets in render.CASE_EDGES.items() for target in targets)


@query(f"WITH e(kind, target) AS (VALUES {_CASE_EDGES}) SELECT 'part/' || p_partkey || '.md' AS uri, replace(target, '{{k}}', CAST(p_partkey AS VARCHAR)) AS to_id FROM part JOIN e ON p_partkey % {len(render.CASES)} = kind")
def op_r104_case_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R104-8, R104-10, AGG-6: citations that become edges, among them section-precise ones and those of the own document."""
    return validated(spark, sf_dir, "cases").inline_edges.select("uri", "to_id")


_PRECISE = " UNION ALL ".join(f"SELECT {at} AS kind, {sum('#' in t for t in render.CASE_EDGES.get(name, []))} AS n" for at, name in enumerate(render.CASES))


@query(
    f"WITH p AS ({_PRECISE}), own AS (SELECT p_partkey, n FROM part JOIN p ON p_partkey % {len(render.CASES)} = kind) "
    "SELECT CAST(sum(n) AS BIGINT) AS section_precise, true AS complete, CAST(0 AS BIGINT) AS unparsable FROM own"
)
def op_agg_case_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6, AGG-8: section-precise citations, and whether every document was read."""
    return statistics.statistics(validated(spark, sf_dir, "cases")).select("section_precise", "complete", F.size("unparsable").cast("long").alias("unparsable"))


def _parts_of(*cases: str) -> str:
    return f"(SELECT CAST(count(*) AS BIGINT) FROM part WHERE p_partkey % {len(render.CASES)} IN ({', '.join(str(list(render.CASES).index(c)) for c in cases)}))"


@query(
    f"SELECT 'cites_any_section' AS recipe, {_parts_of('section of a declared document', 'malformed citation')} AS n UNION ALL SELECT 'cites_section_or_below', {_parts_of('section of a declared document')} "
    f"UNION ALL SELECT 'section_precise', {_parts_of('section of a declared document', 'own section', 'undeclared section', 'malformed citation')}"
)
def op_nav_case_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV-5, NAV-6, NAV-8 where they hit: lines that cite sections."""
    wanted = [("cites_any_section", "6.1"), ("cites_section_or_below", "6.1#2"), ("section_precise", "")]
    row = t.search_lines(render.cases(spark, sf_dir)).agg(*[F.count_if(F.col("text").rlike(navigation.pattern(r, i))).alias(r) for r, i in wanted])
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("recipe"), F.col(r).alias("n")) for r, _ in wanted])).alias("x")).select("x.*")


_CORPUS_DEFECTS = f"""WITH {_SUPPLIES}, c AS (SELECT *, 'customer/' || c_custkey || '.md' AS uri, {_KIND} AS kind FROM customer), last AS (SELECT max(c_custkey) AS top FROM customer)
SELECT uri, 'corpus/duplicate-doc-id' AS rule_id, 'error' AS severity, CAST(1 AS BIGINT) AS n FROM c, last WHERE kind = {_NUMBER['shared-doc-id']} AND c_custkey < top OR kind = {_NUMBER['shared-doc-id'] + 1}
UNION ALL SELECT uri, 'corpus/reference-title-mismatch', 'warning', 1 FROM c WHERE kind = {_NUMBER['stale-title']}
UNION ALL SELECT uri, 'corpus/unresolved-reference-target', 'error', 1 FROM c WHERE kind = {_NUMBER['unresolved-entry']}
UNION ALL SELECT uri, 'corpus/unresolved-inline-target', 'error', 1 FROM c WHERE kind = {_NUMBER['unresolved-section']}
UNION ALL SELECT uri, 'corpus/undeclared-inline-target', 'error', 1 FROM c WHERE kind = {_NUMBER['undeclared-prose']}
UNION ALL SELECT uri, 'corpus/undeclared-inline-target', 'error', count(*) FROM c JOIN supplies ON c_custkey = o_custkey WHERE kind = {_NUMBER['missing-references']} GROUP BY uri
UNION ALL SELECT uri, 'corpus/duplicate-section-id', 'error', 1 FROM c WHERE kind = {_NUMBER['foreign-section']} AND (SELECT count(*) FROM c WHERE kind = {_NUMBER['foreign-section']}) > 1"""


@query(_CORPUS_DEFECTS)
def op_jn_corpus_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-1..6, AGG-10, AGG-11, SET-1, SET-3, SET-4."""
    rows = validated(spark, sf_dir, "defects").corpus_diagnostics
    return rows.groupBy("uri", "rule_id", "severity").agg(F.count("*").alias("n"))


@query(
    f"""WITH d AS ({_DOCUMENT_DEFECTS}), uris AS (SELECT 'customer/' || c_custkey || '.md' AS uri, {_KIND} <> {_NUMBER['unnumbered']} AS has_extracted FROM customer
UNION ALL SELECT 'supplier/' || s_suppkey || '.md', true FROM supplier UNION ALL SELECT 'nation/' || n_nationkey || '.md', true FROM nation UNION ALL SELECT 'region/' || r_regionkey || '.md', true FROM region)
SELECT uri, NOT EXISTS (SELECT 1 FROM d WHERE d.uri = uris.uri AND severity = 'error') AS ok, has_extracted FROM uris"""
)
def op_agg_lint_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, API-1, API-2, JN-7."""
    return validated(spark, sf_dir, "defects").lint_results.select("uri", "ok", "has_extracted")


@query(
    f"WITH d AS ({_DOCUMENT_DEFECTS}), c AS ({_CORPUS_DEFECTS}), a AS (SELECT severity, n FROM d UNION ALL SELECT severity, n FROM c) SELECT CAST(coalesce(sum(n) FILTER (severity = 'error'), 0) AS BIGINT) AS errors, "
    "CAST(coalesce(sum(n) FILTER (severity = 'warning'), 0) AS BIGINT) AS warnings, CAST(coalesce(sum(n) FILTER (severity = 'info'), 0) AS BIGINT) AS infos, CAST(0 AS BIGINT) AS unparsable FROM a"
)
def op_agg_severity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9, AGG-14."""
    return statistics.severity_totals(validated(spark, sf_dir, "defects").diagnostics)


@query()
def op_snk_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1, SRT-2..4: report lines as JSON, in order."""
    from citegraph.report import json_rows

    return json_rows(validated(spark, sf_dir, "defects"))


@query(f"SELECT '7.' || doc_id AS doc_id, CAST(CASE WHEN doc_id = 1 THEN 0 ELSE 1 END AS BIGINT) AS citations FROM documents WHERE doc_id IS NOT NULL")
def op_prs_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRS-1..12 over long, noisy texts in four languages: one citation each, found at the end. The first document cites itself, which its entry would too; it is left out."""
    parsed = once(spark, sf_dir, "prose", ("entries", "citations")).parsed
    rows = rules.declaring(parsed).select(F.col("own_id").alias("doc_id"), F.size(rules.cited()).alias("n"))
    return rows.select("doc_id", F.when(F.col("doc_id") == "7.1", F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("citations"))


# -- navigation ----------------------------------------------------------------------


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.search_lines(render.ledger(spark, sf_dir))


_RECIPE_CASES = [("document", "1.2", ""), ("section", "1.2#1", ""), ("cites_document", "2.1", ""), ("cites_any_section", "2.1", ""), ("cites_document_or_section", "2.2", ""), ("section_precise", "", ""), ("entries", "3.1", ""), ("entries_by_direction", "3.1", "authority"), ("references_heading", "", ""), ("corpus_map", "", "")]


@query(
    f"""WITH {_SUPPLIES}, d AS ({_IDENTITY}), e AS (SELECT to_doc_id, direction FROM ({_EDGES}))
SELECT 'document' AS recipe, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'section', count(*) FROM (SELECT 1 FROM places WHERE o_custkey = 2 AND k = 1 UNION ALL SELECT 1 FROM supplies WHERE o_custkey = 2 AND k = 1)
UNION ALL SELECT 'cites_document', count(*) FROM supplies WHERE l_suppkey = 1 UNION ALL SELECT 'cites_any_section', 0 UNION ALL SELECT 'cites_document_or_section', count(*) FROM supplies WHERE l_suppkey = 2
UNION ALL SELECT 'section_precise', 0 UNION ALL SELECT 'entries', count(*) FROM e WHERE to_doc_id = '3.1' UNION ALL SELECT 'entries_by_direction', count(*) FROM e WHERE to_doc_id = '3.1' AND direction = 'authority'
UNION ALL SELECT 'references_heading', count(*) FROM d UNION ALL SELECT 'corpus_map', count(*) FROM d"""
)
def op_nav_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV-1..12, JN-12: how many lines each recipe hits, in one pass over the lines."""
    lines = ledger_lines(spark, sf_dir)
    counts = [F.count_if(F.col("text").rlike(navigation.pattern(r, i, d))).alias(r) for r, i, d in _RECIPE_CASES]
    row = lines.agg(*counts)
    return row.select(F.explode(F.array(*[F.struct(F.lit(r).alias("recipe"), F.col(r).alias("n")) for r, _, _ in _RECIPE_CASES])).alias("x")).select("x.*")


@query(f"WITH e AS ({_EDGES}) SELECT to_doc_id AS doc_id, direction, count(*) AS governs FROM e GROUP BY ALL")
def op_nav_11_governs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV-9, NAV-11 structured: what each document governs, by direction."""
    return once(spark, sf_dir, facts=("entries",)).reference_edges.groupBy(F.col("to_doc_id").alias("doc_id"), "direction").agg(F.count("*").alias("governs"))


@query(f"WITH {_SUPPLIES} SELECT 'customer/' || o_custkey || '.md' AS uri, count(*) AS n FROM (SELECT o_custkey FROM supplies WHERE l_suppkey = 3) GROUP BY o_custkey")
def op_nav_4_citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV-4..7 structured."""
    return navigation.citing(once(spark, sf_dir, facts=("entries", "citations")).inline_edges, "2.3", below=True).groupBy("uri").agg(F.count("*").alias("n"))


# Line numbers of a customer's document: two lines of title, four for every order and supply, then References, a blank and the entries.
_BLOCKS = f"""WITH {_SUPPLIES}, parts AS (SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey FROM places UNION ALL SELECT o_custkey FROM supplies) GROUP BY o_custkey),
sold AS (SELECT o_custkey, count(DISTINCT l_suppkey) AS n FROM supplies GROUP BY o_custkey),
blocks AS (SELECT 'customer/' || c_custkey || '.md' AS uri, 3 + 4 * coalesce(parts.n, 0) AS head, 2 + coalesce(sold.n, 0) AS after FROM customer LEFT JOIN parts ON parts.o_custkey = c_custkey LEFT JOIN sold ON sold.o_custkey = c_custkey
UNION ALL SELECT 'supplier/' || s_suppkey || '.md', 3, 2 FROM supplier UNION ALL SELECT 'nation/' || n_nationkey || '.md', 3, 2 FROM nation UNION ALL SELECT 'region/' || r_regionkey || '.md', 3, 0 FROM region)"""


@query(f"{_BLOCKS} SELECT uri, CAST(head + unnest(range(0, least(after, 40) + 1)) AS INTEGER) AS line_no FROM blocks")
def op_nav_3_references_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV-3 over the whole ledger: the References heading and the 40 lines behind it, as a range join within each document."""
    return navigation.document_references_blocks(render.ledger(spark, sf_dir)).select("uri", "line_no")


@query(
    f"""WITH {_SUPPLIES}, held AS (SELECT o_custkey FROM places WHERE contains(CAST(o_orderkey AS VARCHAR), '0000001') UNION ALL SELECT o_custkey FROM supplies JOIN supplier ON l_suppkey = s_suppkey WHERE contains(lower(s_name), '0000001'))
SELECT 'customer/' || c_custkey || '.md' AS uri FROM customer WHERE contains(lower(c_name), '0000001') OR c_custkey IN (SELECT o_custkey FROM held)
UNION SELECT 'supplier/' || s_suppkey || '.md' FROM supplier WHERE contains(lower(s_name), '0000001')"""
)
def op_nav_13_find_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV-13 over all lines of the ledger: documents that hold a text."""
    return navigation.find_in_documents(render.ledger(spark, sf_dir), "0000001")


@query(
    f"""WITH {_SUPPLIES}, e AS ({_EDGES}) SELECT CAST(CASE direction WHEN 'authority' THEN 1 WHEN 'constraint' THEN 2 WHEN 'contract' THEN 3 ELSE 4 END AS INTEGER) AS step, to_doc_id AS target, direction AS detail FROM e WHERE from_doc_id = '1.7'
UNION ALL SELECT 5, '2.' || l_suppkey, 'per' FROM supplies WHERE o_custkey = 7"""
)
def op_nav_14_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV-14."""
    result = validated(spark, sf_dir, facts=("entries", "citations"))
    return navigation.grounding(result.reference_edges, result.inline_edges, "1.7")


@query(
    f"""WITH {_SUPPLIES}, e AS ({_EDGES}) SELECT what, CAST(n AS BIGINT) AS n, CAST(0 AS BIGINT) AS missed FROM (
  SELECT 'identifiers' AS what, count(*) AS n FROM (SELECT doc_id FROM ({_IDENTITY}) UNION ALL SELECT '' FROM places UNION ALL SELECT '' FROM supplies)
  UNION ALL SELECT 'entries', count(*) FROM e UNION ALL SELECT 'citations', count(*) FROM supplies)"""
)
def op_nav_15_guarantee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV-15: every extracted identifier, entry and citation stands on a line of its own document, where the recipe looks for it."""
    number = "([0-9]+(?:\\.[0-9]+)*(?:#[0-9]+(?:\\.[0-9]+)*)?)"
    of_lines = lambda pattern: "(?md)" + pattern.replace("\\s", "[^\\S\n]").replace("[^0-9.#]", "[^0-9.#\n]")
    # Patterns bound to the beginning of a line, over a whole text; that of citations stays within a line by itself.
    patterns = {
        "identifiers": of_lines(f"^#+ {number}[^0-9.#]"),
        "entries": of_lines(navigation.RECIPES["entries"].replace("{id}", number)),
        "citations": navigation.RECIPES["cites_document_or_section"].replace("{id}", number),
    }
    ids = {
        "identifiers": F.concat(F.array("own_id"), F.transform(F.filter("headings", lambda h: h["extracted"]), lambda h: h["section_id"])),
        "entries": F.array_distinct(F.filter("targets", lambda x: x.isNotNull())),
        "citations": rules.cited(),
    }
    rows = rules.declaring(once(spark, sf_dir, kept=("markdown",)).parsed)
    rows = rows.select(*[c.alias(what) for what, c in ids.items()], *[F.array_distinct(F.regexp_extract_all("markdown", F.lit(p), F.lit(1))).alias(f"{what}_seen") for what, p in patterns.items()])
    missed = lambda what: F.size(F.filter(what, lambda x: ~F.array_contains(f"{what}_seen", x)))
    sums = [F.struct(F.lit(what).alias("what"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in (("n", F.size(what)), ("missed", missed(what)))]) for what in ids]
    return rows.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query(
    f"""WITH RECURSIVE {_SUPPLIES}, e AS (SELECT DISTINCT a, b FROM (SELECT from_doc_id AS a, to_doc_id AS b FROM ({_EDGES}) UNION ALL SELECT '1.' || o_custkey, '2.' || l_suppkey FROM supplies)),
r(a, b, hops) AS (SELECT a, b, 1 FROM e UNION SELECT r.a, e.b, r.hops + 1 FROM r JOIN e ON r.b = e.a) SELECT a, b, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY a, b"""
)
def op_nav_16_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NAV-16 over all reference and citation edges of the ledger, between documents. The ledger has no cycles, so its SQL ends; cycles are for the tests."""
    result = validated(spark, sf_dir, facts=("entries", "citations"))
    cited = result.inline_edges.select(g.target_doc(F.col("from_id")).alias("a"), g.target_doc(F.col("to_id")).alias("b"))
    edges = result.reference_edges.select(F.col("from_doc_id").alias("a"), F.col("to_doc_id").alias("b")).unionByName(cited)
    return navigation.closure(edges, scratch_writer(spark))


@query(
    """WITH points AS (SELECT l_orderkey, l_suppkey, max(CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END) OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS context
FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) SELECT CAST(l_orderkey AS VARCHAR) AS uri, l_suppkey AS at, CAST(context AS VARCHAR) AS context FROM points WHERE l_suppkey % 3 <> 0"""
)
def op_jn_11_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10, JN-11, PRS-10: runs with the last heading before them."""
    rows = render.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("uri"), F.col("l_suppkey").alias("at")).distinct()
    heads = rows.filter("at % 3 = 0").select("uri", "at", F.col("at").cast("string").alias("section_id"))
    runs = rows.filter("at % 3 <> 0").select("uri", "at", F.col("at").cast("string").alias("run"))
    return navigation.as_of_section(heads, runs).select("uri", "at", "context")


@query(
    f"""WITH cited AS (SELECT '1.' || o_custkey AS id FROM orders UNION ALL SELECT '9.' || o_custkey FROM orders WHERE o_custkey % 10 = 0), d AS ({_IDENTITY})
SELECT id, count(*) AS n FROM cited WHERE id NOT IN (SELECT doc_id FROM d) GROUP BY id"""
)
def op_jn_13_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-3, JN-9, JN-13: identifiers cited in other files that the corpus has not. Pulled out of lines by a pattern."""
    orders = render.table(spark, sf_dir, "orders")
    key = F.col("o_custkey").cast("string")
    lines = orders.select(F.concat(F.lit("as noted, see 1."), key, F.when(F.col("o_custkey") % 10 == 0, F.concat(F.lit(" and per 9."), key)).otherwise(F.lit("")), F.lit(", or not")).alias("text"))
    ids = lines.select(F.explode(F.regexp_extract_all("text", F.lit(g.citation_pattern("[0-9]+(?:\\.[0-9]+)*")), 2)).alias("id"))
    result = validated(spark, sf_dir, facts=("headings",))
    # Counted before they are looked up: most are cited many times.
    _, missing = corpus.resolve(ids.groupBy("id").agg(F.count("*").alias("n")), result.identity, corpus.sub_sections(result.sections))
    return missing.select("id", "n")


@query(
    f"""WITH {_SUPPLIES}, heads AS (SELECT o_custkey, k, 0 AS j, '## Order ' || o_orderkey AS head, 'Booked and kept.' AS body FROM places
UNION ALL SELECT o_custkey, k, j, '### Supply ' || l_suppkey, 'Delivered per 2.' || l_suppkey || '.' FROM supplies),
placed AS (SELECT *, 3 + 4 * (row_number() OVER (PARTITION BY o_custkey ORDER BY k, j) - 1) AS line FROM heads),
titles AS (SELECT CASE split_part(doc_id, '.', 1) WHEN '1' THEN 'customer' WHEN '2' THEN 'supplier' WHEN '3' THEN 'nation' ELSE 'region' END || '/' || split_part(doc_id, '.', 2) || '.md' AS uri, title FROM ({_IDENTITY}))
SELECT uri, CAST(u.n AS INTEGER) AS line_no, CASE u.n WHEN 1 THEN '# ' || title ELSE '' END AS text FROM titles, (VALUES (1), (2)) AS u(n)
UNION ALL SELECT 'customer/' || o_custkey || '.md', CAST(line + u.n AS INTEGER), CASE u.n WHEN 0 THEN head WHEN 2 THEN body ELSE '' END FROM placed, (VALUES (0), (1), (2), (3)) AS u(n)"""
)
def op_snk_7_strip_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-7 over the whole ledger: headings without their own identity, References dropped."""
    from citegraph.report import stripped_documents

    parsed = once(spark, sf_dir, facts=(), kept=("markdown",)).parsed
    return stripped_documents(rules.owned(parsed).select("uri", "markdown", F.col("own_id").alias("doc_id")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation of the ledger: the documents that govern most, with the corpus' own counts."""
    result = validated(spark, sf_dir, facts=("entries",))
    governs = result.reference_edges.groupBy("to_doc_id", "direction").agg(F.count("*").alias("governs"))
    named = governs.join(result.identity.select(F.col("doc_id").alias("to_doc_id"), "title"), "to_doc_id")
    return named.select(F.col("to_doc_id").alias("doc_id"), "title", "direction", "governs")
