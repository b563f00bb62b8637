"""Corpora rendered from relational tables, so that what they hold is known from the rows and not from the parser.

The ledger: regions 4.r, nations 3.n, suppliers 2.s and customers 1.c. A customer has a section for each order and, below
it, one for each supplier of the order, which cites the supplier. References: customer to nation (authority) and suppliers
(dependency), supplier to nation (contract), nation to region (constraint). Titles are the names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: custkey % PERIOD -> the one defect such a customer's document has.
PERIOD = 40
DEFECTS = {
    1: "missing-references", 2: "stale-title", 3: "unresolved-entry", 4: "malformed-citation", 5: "setext", 6: "unnumbered", 8: "shared-doc-id", 10: "undeclared-prose",
    11: "unresolved-section", 12: "skipped-level", 13: "foreign-section", 14: "split-citation", 15: "bad-direction", 16: "unbalanced", 17: "repeated-entry", 18: "unit-prose",
}


#: Suppliers whose names are broadcast, at most; beyond that they are joined by a shuffle.
BROADCAST = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_places(orders: DataFrame) -> DataFrame:
    """o_orderkey, o_custkey, k: the order's place among its customer's."""
    return orders.select("o_orderkey", "o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k"))


def order_supplies(lineitem: DataFrame, supplier: DataFrame) -> DataFrame:
    """l_orderkey, supplies: the order's suppliers (s, name); each counts once. A key without a supplier has no name."""
    names = supplier.select("s_suppkey", "s_name")
    names = F.broadcast(names) if names.count() <= BROADCAST else names
    named = lineitem.select("l_orderkey", "l_suppkey").join(names, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    named = named.filter("l_suppkey is not null").select("l_orderkey", F.struct(F.col("l_suppkey").alias("s"), F.col("s_name").alias("name")).alias("x"))
    return named.groupBy("l_orderkey").agg(F.collect_set("x").alias("supplies"))


def _values(array: pa.Array) -> list:
    """``to_pylist``, several times as fast where nothing is null."""
    return array.to_pylist() if array.null_count else array.to_numpy(zero_copy_only=False).tolist()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A customer's orders (k, o, supplies) as the text of its sections and of its entries."""
    for batch in batches:
        lists = batch.column("orders")
        orders = lists.flatten()
        keys, places, below = _values(orders.field("o")), _values(orders.field("k")), orders.field("supplies")
        supplies = below.flatten()
        pairs = list(zip(_values(supplies.field("s")), _values(supplies.field("name"))))
        lengths = _values(pc.fill_null(pc.list_value_length(below), 0))
        sections, entries = [], []
        at = first = 0
        for c, count in zip(batch.column("c_custkey").to_pylist(), _values(pc.fill_null(pc.list_value_length(lists), 0))):
            found, sold = [], set()
            for k, o, size in zip(places[at : at + count], keys[at : at + count], lengths[at : at + count]):
                own = pairs[first : first + size]
                first += size
                sold.update(own)
                if o is not None:
                    lines = "".join([f"### 1.{c}#{k}.{j} - Supply {s}\n\nDelivered per 2.{s}.\n\n" for j, s in enumerate(sorted({s for s, _ in own}), 1)])
                    found.append((k, f"## 1.{c}#{k} - Order {o}\n\nBooked and kept.\n\n{lines}"))
            at += count
            found.sort()
            sections.append("".join([text for _, text in found]))
            entries.append("".join([f"- 2.{s} - {name} (dependency - delivers (goods) to the customer)\n" for s, name in sorted(x for x in sold if x[1] is not None)]))
        kept = [n for n in batch.schema.names if n != "orders"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sections, pa.string()), pa.array(entries, pa.string())], [*kept, "sections", "suppliers"])


def customer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custkey, name, nation, sections (text), suppliers (entries' text).

    Keys are grouped twice, by order and by customer; texts are written last, from a customer's row, so no shuffle moves them.
    """
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    supplies = order_supplies(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"))
    orders = order_places(table(spark, sf_dir, "orders")).join(supplies, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    # So many tasks, whatever their bytes: texts and all that is done with them come after this shuffle.
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    customers = customers.repartition(spread, "c_custkey")
    orders = orders.repartition(spread, "o_custkey").groupBy("o_custkey").agg(F.collect_list(F.struct("k", F.col("o_orderkey").alias("o"), "supplies")).alias("orders"))
    rows = customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "n_nationkey", "n_name", "n_regionkey", "orders")
    schema = T.StructType([f for f in rows.schema if f.name != "orders"]).add("sections", "string").add("suppliers", "string")
    return rows.mapInArrow(_written, schema)


def _document(uri: Column, order: Column, markdown: Column) -> list[Column]:
    return [uri.alias("uri"), order.cast("long").alias("doc_ord"), markdown.alias("markdown"), F.lit(None).cast("int").alias("version")]


def ledger(spark: SparkSession, sf_dir: str, defects: bool = False) -> DataFrame:
    """documents(uri, doc_ord, markdown, version) of the ledger corpus."""
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    key = lambda name: F.col(name).cast("string")
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    regions = region.select(*_document(say("region/", key("r_regionkey"), ".md"), 4 * 10**9 + F.col("r_regionkey"), say("# 4.", key("r_regionkey"), " - ", F.col("r_name"), "\n\n## References\n")))
    nations = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(
        *_document(
            say("nation/", key("n_nationkey"), ".md"), 3 * 10**9 + F.col("n_nationkey"),
            say("# 3.", key("n_nationkey"), " - ", F.col("n_name"), "\n\n## References\n\n- 4.", key("r_regionkey"), " - ", F.col("r_name"), " (constraint - lies within it)\n"),
        )
    )
    suppliers = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(
        *_document(
            say("supplier/", key("s_suppkey"), ".md"), 2 * 10**9 + F.col("s_suppkey"),
            say("# 2.", key("s_suppkey"), " - ", F.col("s_name"), "\n\n## References\n\n- 3.", key("n_nationkey"), " - ", F.col("n_name"), " (contract - trades under its law)\n"),
        )
    )
    c, n, name = key("c_custkey"), key("n_nationkey"), F.col("c_name")
    kind = F.col("c_custkey") % PERIOD if defects else F.lit(-1)
    number = {v: k for k, v in DEFECTS.items()}
    is_ = lambda defect: kind == number[defect]
    shared = is_("shared-doc-id")
    title = F.when(is_("setext"), say("1.", c, " - ", name, "\n===\n")).when(is_("unnumbered"), say("# ", name, "\n")).when(shared, say("# 1.", (F.col("c_custkey") + 1).cast("string"), " - ", name, "\n")).otherwise(say("# 1.", c, " - ", name, "\n"))
    prose = (
        F.when(is_("malformed-citation"), F.lit("It follows see 2.1#1#9 in part.\n\n"))
        .when(is_("undeclared-prose"), say("It follows see 4.", key("n_regionkey"), " in part.\n\n"))
        .when(is_("unresolved-section"), say("It follows see 3.", n, "#99 in part.\n\n"))
        .when(is_("skipped-level"), say("#### 1.", c, "#1.1.1 - Deep\n\n"))
        .when(is_("foreign-section"), F.lit("## 2.0#7 - Foreign\n\n"))
        .when(is_("split-citation"), say("It follows see\n3.", n, " in part.\n\n"))
        .when(is_("unit-prose"), F.lit("It waits for one tick per 60s.\n\n"))
        .otherwise(F.lit(""))
    )
    nation_entry = say("- 3.", n, " - ", F.col("n_name"), F.when(is_("stale-title"), F.lit(" (old)")).otherwise(F.lit("")), " (authority - its law holds)\n")
    more = (
        F.when(is_("unresolved-entry"), say("- 9.", c, " - Nobody (dependency - is gone)\n"))
        .when(is_("bad-direction"), F.lit("- 2.0 - Someone (owner - has no such label)\n"))
        .when(is_("unbalanced"), F.lit("- 2.0 - Someone dependency - never opened)\n"))
        .when(is_("repeated-entry"), say("- 3.", n, " - ", F.col("n_name"), " (authority - once more)\n"))
        .otherwise(F.lit(""))
    )
    body = F.when(shared, F.lit("")).otherwise(F.col("sections"))
    references = F.when(is_("missing-references"), F.lit("")).otherwise(say("## References\n\n", nation_entry, F.when(shared, F.lit("")).otherwise(F.col("suppliers")), more))
    customers = customer_parts(spark, sf_dir).select(*_document(say("customer/", c, ".md"), 10**9 + F.col("c_custkey"), say(title, "\n", prose, body, references)))
    return regions.unionByName(nations).unionByName(suppliers).unionByName(customers)


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as bodies under rendered level-1 headings."""
    rows = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return rows.select(*_document(F.concat(F.lit("prose/"), key, F.lit(".md")), F.col("doc_id"), F.concat(F.lit("# 7."), key, F.lit(" - Prose\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\nIt ends, see 7.1.\n\n## References\n\n- 7.1 - Prose (dependency - the first of them)\n"))))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path: page urls without scheme, query and fragment, as file paths."""
    rest = F.regexp_replace("url", "^[^:]*://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(rest, "[?#][\\s\\S]*\\z", "").alias("path"))


def _case(body: str = "", entries: str = "- 6.1 - Base (authority - holds)\n", title: str = "# 6.{k} - {t}\n", references: str = "## References\n\n") -> str:
    return f"{title}\n{body}{references}{entries}"


#: name -> (a document's Markdown for key {k} and title {t}, the findings that its rules make: rule, severity, cause, reason, obstruction).
CASES: dict[str, tuple[str, list[tuple[str, str, str, str, str]]]] = {
    "clean": (_case("## 6.{k}#1 - Part\n\n### 6.{k}#1.1 - Below\n\nAs said, see 6.1.\n\n"), []),
    "no heading": ("Only words stand here.\n", [("R101", "error", "", "", "")]),
    "two titles": (_case("# 6.{k} - Again\n\n"), [("R101", "error", "", "", "")]),
    "unnumbered title": (_case(title="# Words alone\n"), [("R101", "error", "", "", "")]),
    "title without dash": (_case(title="# 6.{k} {t}\n"), [("R101", "error", "", "", "")]),
    "title of another form": (_case(title="# 6..{k} - {t}\n"), [("R101", "error", "", "", "")]),
    "byte order mark": (_case(title="\ufeff# 6.{k} - {t}\n"), [("R101", "error", "heading-source-form", "", "byte-order-mark")]),
    "underlined title": (_case(title="6.{k} - {t}\n===\n"), [("R101", "error", "heading-source-form", "", "form")]),
    "title behind a lone return": (_case(title="Words.\r# 6.{k} - {t}\n"), [("R101", "error", "heading-source-form", "", "lone-carriage-return")]),
    "section without dash": (_case("## 6.{k}#1 Part\n\n"), [("R102", "error", "", "separator", "")]),
    "unnumbered section": (_case("## Part\n\n"), [("R102", "error", "", "unnumbered", "")]),
    "section with a document's number": (_case("## 6.{k} - Part\n\n"), [("R102", "error", "", "section-id", "")]),
    "underlined section": (_case("6.{k}#1 - Part\n---\n\n"), [("R102", "error", "heading-source-form", "", "form")]),
    "foreign section": (_case("## 7.{k}#1 - Part\n\n"), [("R102", "error", "", "foreign", "")]),
    "path too long": (_case("## 6.{k}#1.1 - Part\n\n"), [("R102", "error", "", "path-length", "")]),
    "section twice": (_case("## 6.{k}#1 - Part\n\n## 6.{k}#1 - Part\n\n"), [("R102", "error", "", "duplicate", "")]),
    "skipped level": (_case("#### 6.{k}#1.1.1 - Deep\n\n"), [("R102", "error", "", "skipped-level", "")]),
    "misplaced section": (_case("## 6.{k}#1 - Part\n\n### 6.{k}#2.1 - Below\n\n"), [("R102", "error", "", "misplaced", "")]),
    "below a foreign section": (_case("## 7.{k}#1 - Part\n\n### 6.{k}#1.1 - Below\n\n"), [("R102", "error", "", "foreign", "")]),
    "no References": (_case(references="", entries=""), [("R103", "error", "", "", "")]),
    "References twice": (_case("## References\n\n- 6.1 - Base (authority - holds)\n\n", entries=""), [("R103", "error", "", "", "")]),
    "References within a quote": (_case(references="> ## References\n>\n", entries="> - 6.1 - Base (authority - holds)\n"), [("R103", "error", "references-placement", "", "")]),
    "no entries": (_case(entries=""), [("R103", "info", "references-empty", "", "")]),
    "References with closing signs": (_case(references="## References ##\n\n"), [("R103", "error", "references-heading-source-form", "", "form")]),
    "References behind a lone return": (_case(references="Words.\r## References\n\n"), [("R103", "error", "references-heading-source-form", "", "lone-carriage-return")]),
    "entry without dash": (_case(entries="- 6.1 Base (authority - holds)\n"), [("R103", "error", "", "separator", "")]),
    "entry unbalanced": (_case(entries="- 6.1 - Base authority - holds)\n"), [("R103", "error", "references-entry-unbalanced", "unbalanced", "")]),
    "entry without label": (_case(entries="- 6.1 - Base\n"), [("R103", "error", "", "format", "")]),
    "entry of a section": (_case(entries="- 6.1#2 - Base (authority - holds)\n"), [("R103", "error", "", "target", "")]),
    "entry of no direction": (_case(entries="- 6.1 - Base (Authority - holds)\n"), [("R103", "error", "", "direction", "")]),
    "entry twice": (_case(entries="- 6.1 - Base (authority - holds)\n- 6.1 - Base (contract - too)\n"), [("R103", "error", "", "duplicate", "")]),
    "bad entry, then a good one": (_case(entries="- 6.1 - Base (owner - holds)\n- 6.1 - Base (contract - too)\n"), [("R103", "error", "", "direction", "")]),
    "entry with a bold number": (_case(entries="- **6.1** - Base (authority - holds)\n"), [("R103", "error", "references-entry-source-form", "", "form")]),
    "entry with a bold label": (_case(entries="- 6.1 - Base (**authority** - holds)\n"), [("R103", "error", "references-entry-source-form", "", "form")]),
    "malformed citation": (_case("It follows see 6.1#1#9 in part.\n\n"), [("R104", "error", "malformed-target", "", "")]),
    "words like a citation": (_case("It waits, per 6..1 of them, for 2 per 60s.\n\n"), []),
    "citation with a bold number": (_case("It follows see **6.1** in part.\n\n"), [("R104", "error", "citation-source-form", "undeclared-target", "")]),
    "citation over two lines": (_case("It follows see\n6.1 in part.\n\n"), [("R104", "error", "citation-source-form", "undeclared-target", "")]),
    "citation with two blanks": (_case("It follows see  6.1 in part.\n\n"), [("R104", "error", "citation-source-form", "undeclared-target", "")]),
    "undeclared citation with two blanks": (_case("It follows see  7.{k} in part.\n\n"), [("R104", "warning", "citation-source-form", "undeclared-target", "")]),
    "citation with an escaped dot": (_case("It follows see 6\\.1 in part.\n\n"), [("R104", "error", "citation-source-form", "undeclared-target", "")]),
    "undeclared document": (_case("It follows see 7.{k} in part.\n\n"), [("R104", "warning", "", "undeclared-target", "")]),
    "undeclared section": (_case("It follows see 7.{k}#1 in part.\n\n"), [("R104", "error", "", "undeclared-target", "")]),
    "section of a declared document": (_case("It follows see 6.1#2 in part, per 6.1#2.1.\n\n"), []),
    "own section": (_case("## 6.{k}#1 - Part\n\nSee 6.{k}#1 and per 6.{k}.\n\n"), []),
}
#: name -> the targets of its citations that become edges.
CASE_EDGES = {"clean": ["6.1"], "section of a declared document": ["6.1#2", "6.1#2.1"], "own section": ["6.{k}#1", "6.{k}"]}


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents(uri, doc_ord, markdown, version): a document for each part, of the cases in turn."""
    key = F.col("p_partkey").cast("string")
    templates = F.array(*[F.lit(text) for text, _ in CASES.values()])
    text = F.element_at(templates, (F.col("p_partkey") % len(CASES) + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{k}"), key), F.lit("{t}"), F.coalesce("p_name", F.lit("")))
    # The table is a small file of many documents: spread, or few tasks would parse them all.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return parts.select(*_document(F.concat(F.lit("part/"), key, F.lit(".md")), F.col("p_partkey"), text))
