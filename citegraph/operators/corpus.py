"""The corpus pass: uniqueness, resolution, declaration and the indexes, as joins and group-bys over the extracted tables.

Works on any extraction, also one that a host has built itself. Duplicates keep the first document in corpus order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.functions import grammar as g
from citegraph.operators.rules import Finding, diagnose, text, union


def _members(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in them more than once, with all their uris in corpus order. Counted first: only rows of duplicated keys are joined and grouped."""
    twice = rows.groupBy(key).count().filter("count > 1").select(key)
    rows = rows.join(twice, key, "left_semi")
    groups = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("doc_ord", "ord", "uri"))).alias("members"))
    return rows.join(groups.select(key, F.array_distinct(F.transform("members", lambda m: m["uri"])).alias("uris")), key)


def duplicate_doc_ids(identity: DataFrame) -> DataFrame:
    rows = _members(identity.withColumn("ord", F.lit(0)), "doc_id")
    return diagnose(
        rows, Finding(F.lit(True), "corpus/duplicate-doc-id", "error", 201, text("DocID ", F.col("doc_id"), " is used by several documents"),
        {"duplicateUris": F.array_join("uris", "\n")}, "corpus", doc_id=F.col("doc_id"), range=F.lit(None)),
    )


def sub_sections(sections: DataFrame) -> DataFrame:
    return sections.filter("heading_depth > 1").withColumnRenamed("id", "section_id")


def duplicate_section_ids(sections: DataFrame) -> DataFrame:
    rows = _members(sub_sections(sections), "section_id")
    return diagnose(
        rows, Finding(F.lit(True), "corpus/duplicate-section-id", "error", 202, text("SectionID ", F.col("section_id"), " is used by several documents"),
        {"duplicateUris": F.array_join("uris", "\n")}, "corpus", section_id=F.col("section_id"), range=F.lit(None)),
    )


def cross_document_sections(sections: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """SectionIDs met in several documents once those that a rule rejected count too; ids extracted twice are reported already."""
    own = sub_sections(sections).select("uri", "doc_ord", "section_id", F.lit(1).alias("extracted"))
    # An id that no finding names can only be met twice by being extracted twice.
    own = own.join(diagnostics.select("section_id"), "section_id", "left_semi")
    named = diagnostics.filter("section_id is not null").select("uri", "doc_ord", "section_id", F.lit(0).alias("extracted"))
    rows = own.unionByName(named).groupBy("uri", "doc_ord", "section_id").agg(F.max("extracted").alias("extracted")).withColumn("ord", F.lit(0))
    twice = rows.groupBy("section_id").agg(F.sum("extracted").alias("times")).filter("times > 1").select("section_id")
    rows = _members(rows.join(twice, "section_id", "left_anti"), "section_id")
    return diagnose(
        rows, Finding(F.lit(True), "corpus/duplicate-section-id", "error", 208, text("SectionID ", F.col("section_id"), " is used by several documents"),
        {"duplicateUris": F.array_join("uris", "\n")}, "corpus", section_id=F.col("section_id"), range=F.lit(None)),
    )


def doc_index(identity: DataFrame) -> DataFrame:
    """doc_id, uri, title: the first document of each DocID."""
    turn = Window.partitionBy("doc_id").orderBy("doc_ord")
    return identity.withColumn("turn", F.row_number().over(turn)).filter("turn = 1").select("doc_id", "uri", "title")


def section_index(sections: DataFrame) -> DataFrame:
    turn = Window.partitionBy("section_id").orderBy("doc_ord", "ord")
    return sub_sections(sections).withColumn("turn", F.row_number().over(turn)).filter("turn = 1").select("section_id", "uri")


def reference_findings(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Entries whose target no document has, and entries with another title than the document's: one join for both."""
    rows = edges.join(docs.select(F.col("doc_id").alias("to_doc_id"), F.col("title").alias("canonical"), F.lit(True).alias("known")), "to_doc_id", "left")
    differs = F.col("known") & (F.col("title") != F.col("canonical"))
    rows = rows.filter(F.col("known").isNull() | differs).withColumn("differs", F.col("known") & (g.js_trim(F.col("title")) != g.js_trim(F.col("canonical"))))
    return diagnose(
        rows,
        Finding("known is null", "corpus/unresolved-reference-target", "error", 203, text("no document has the DocID ", F.col("to_doc_id")),
        {"unresolvedDocId": F.col("to_doc_id")}, "corpus", ord=F.col("ord") * 2, doc_id=F.col("from_doc_id")),
        Finding("differs", "corpus/reference-title-mismatch", "warning", 203, text("the entry for ", F.col("to_doc_id"), " has another title than the document"),
        {"referencedTitle": F.col("title"), "canonicalTitle": F.col("canonical"), "targetDocId": F.col("to_doc_id")}, "corpus", ord=F.col("ord") * 2 + 1, doc_id=F.col("from_doc_id")),
    )


def unresolved_citations(inline: DataFrame, docs: DataFrame, sections: DataFrame) -> DataFrame:
    known = docs.select(F.col("doc_id").alias("to_id")).unionByName(sections.select(F.col("section_id").alias("to_id")))
    rows = inline.join(known, "to_id", "left_anti")
    return diagnose(
        rows, Finding(F.lit(True), "corpus/unresolved-inline-target", "error", 204, text("nothing has the identifier ", F.col("to_id")),
        {"unresolvedTargetId": F.col("to_id"), "fromId": F.col("from_id"), "kind": F.col("kind")}, "corpus"),
    )


def undeclared_citations(inline: DataFrame, identity: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges to a section of another, existing document without a References entry: only a host's own extraction can hold them."""
    rows = inline.filter(F.contains("to_id", F.lit("#"))).withColumn("target_doc", g.target_doc(F.col("to_id")))
    rows = rows.join(identity.select("uri", F.col("doc_id").alias("own_id")), "uri").filter("target_doc <> own_id")
    rows = rows.join(docs.select(F.col("doc_id").alias("target_doc")), "target_doc", "left_semi")
    rows = rows.join(edges.select("uri", F.col("to_doc_id").alias("target_doc")), ["uri", "target_doc"], "left_anti")
    return diagnose(
        rows, Finding(F.lit(True), "corpus/undeclared-inline-target", "error", 205, text("the document has no References entry for ", F.col("target_doc")),
        {"targetId": F.col("to_id"), "targetDocId": F.col("target_doc"), "fromId": F.col("from_id"), "kind": F.col("kind")}, "corpus", doc_id=F.col("own_id")),
    )


def escalations(diagnostics: DataFrame, docs: DataFrame) -> DataFrame:
    """R104 warnings about undeclared targets become errors where the target exists after all."""
    rows = diagnostics.filter("rule_id = 'R104' and severity = 'warning'").withColumn("target_doc", F.col("data")["targetDocId"])
    rows = rows.filter(F.col("data")["reason"] == "undeclared-target").join(docs.select(F.col("doc_id").alias("target_doc")), "target_doc", "left_semi")
    return diagnose(
        rows, Finding(F.lit(True), "corpus/undeclared-inline-target", "error", 206, text("the document has no References entry for ", F.col("target_doc"), ", which exists"),
        {k: F.col("data")[k] for k in ("cause", "targetId", "targetDocId", "fromId", "kind")}, "corpus", doc_id=F.col("doc_id")),
    )


def corpus_diagnostics(identity: DataFrame, sections: DataFrame, edges: DataFrame, inline: DataFrame, document_diagnostics: DataFrame) -> DataFrame:
    docs, index = doc_index(identity), sub_sections(sections)
    return union(
        duplicate_doc_ids(identity),
        duplicate_section_ids(sections),
        reference_findings(edges, docs),
        unresolved_citations(inline, docs, index),
        undeclared_citations(inline, identity, edges, docs),
        escalations(document_diagnostics, docs),
        cross_document_sections(sections, document_diagnostics),
    )


def indexed(identity: DataFrame, sections: DataFrame) -> DataFrame:
    """One row (``one``) if no DocID or SectionID is extracted twice, else none."""
    ids = identity.select(F.col("doc_id").alias("id")).unionByName(sub_sections(sections).select(F.col("section_id").alias("id")))
    most = ids.groupBy("id").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    return most.filter("most <= 1").select(F.lit(1).alias("one"))


def resolve(ids: DataFrame, docs: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identifiers cited anywhere (column ``id``) that the corpus has, and those it has not."""
    known = docs.select(F.col("doc_id").alias("id")).unionByName(sections.select(F.col("section_id").alias("id")))
    return ids.join(known, "id", "left_semi"), ids.join(known, "id", "left_anti")
