"""Validation of a corpus as a set of lazy tables over one parsed table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.operators import corpus, rules
from citegraph.plans.parse import parse_documents

#: Rule ids of the published format this engine is compatible with, for hosts that depend on them: neutral id -> number.
RULE_NUMBERS = {"R101": "101", "R102": "102", "R103": "103", "R104": "104"}


@dataclass
class CorpusResult:
    """Everything a validation gives. Tables are computed when they are asked for; with ``keep``, shared ones once."""

    parsed: DataFrame
    keep: bool = False

    def _kept(self, table: DataFrame) -> DataFrame:
        """Tables that several others read: cached, so that plans stay small and no join runs twice."""
        return table.persist() if self.keep else table

    @cached_property
    def identity(self) -> DataFrame:
        return rules.identities(self.parsed)

    @cached_property
    def sections(self) -> DataFrame:
        return rules.sections(self.parsed)

    @cached_property
    def judged_entries(self) -> DataFrame:
        return rules.judged_entries(self.parsed)

    @cached_property
    def reference_edges(self) -> DataFrame:
        return rules.reference_edges(self.judged_entries)

    @cached_property
    def judged_citations(self) -> DataFrame:
        return rules.judged_citations(self.parsed)

    @cached_property
    def inline_edges(self) -> DataFrame:
        return rules.inline_edges(self.judged_citations)

    def rule_diagnostics(self, rule: str) -> DataFrame:
        """The findings of one of a document's rules, or of its being unparsable (rule "document")."""
        tables = {
            "document": lambda: rules.unparsable_diagnostics(self.parsed),
            "R101": lambda: rules.identity_diagnostics(self.parsed),
            "R102": lambda: rules.section_diagnostics(self.parsed),
            "R103": lambda: rules.references_diagnostics(self.parsed, None, self.judged_entries),
            "R104": lambda: rules.citation_diagnostics(self.judged_citations),
        }
        return tables[rule]()

    @cached_property
    def document_diagnostics(self) -> DataFrame:
        return self._kept(rules.union(*(self.rule_diagnostics(r) for r in ("document", *RULE_NUMBERS))))

    @cached_property
    def corpus_diagnostics(self) -> DataFrame:
        return self._kept(corpus.corpus_diagnostics(self.identity, self.sections, self.reference_edges, self.inline_edges, self.document_diagnostics))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self.document_diagnostics.unionByName(self.corpus_diagnostics)

    @cached_property
    def lint_results(self) -> DataFrame:
        """uri, version, ok, has_extracted: a document is ok without errors of its own; the corpus' errors don't count."""
        errors = self.document_diagnostics.filter("severity = 'error'").select("uri").distinct().withColumn("bad", F.lit(True))
        rows = rules.with_identity(self.parsed).select("uri", "doc_ord", "version", F.col("own_id").isNotNull().alias("has_extracted")).join(errors, "uri", "left")
        return rows.select("uri", "doc_ord", "version", F.col("bad").isNull().alias("ok"), "has_extracted")

    # An index exists only while no identifier is extracted twice, so its rows are those of the extraction.

    @cached_property
    def doc_index(self) -> DataFrame:
        """doc_id, uri; empty if any identifier is extracted twice."""
        return self.identity.select("doc_id", "uri").join(F.broadcast(self._indexed)).select("doc_id", "uri")

    @cached_property
    def section_index(self) -> DataFrame:
        return corpus.sub_sections(self.sections).join(F.broadcast(self._indexed)).select("section_id", "uri")

    @cached_property
    def _indexed(self) -> DataFrame:
        return corpus.indexed(self.identity, self.sections)

    @cached_property
    def extracted(self) -> DataFrame:
        """The nested form: one row for each document with an identity."""
        pack = lambda rows, *columns: rows.groupBy("uri").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*columns).alias("v")))), lambda x: x["v"]).alias("items"))
        s = pack(self.sections, "id", "title", "heading_depth", "parent_id").withColumnRenamed("items", "sections")
        r = pack(self.reference_edges, "from_doc_id", "to_doc_id", "direction", "explanation", "title").withColumnRenamed("items", "references")
        i = pack(self.inline_edges, "from_id", "to_id", "kind").withColumnRenamed("items", "inline_references")
        return self.identity.select("uri", "doc_ord", "doc_id", "title").join(s, "uri", "left").join(r, "uri", "left").join(i, "uri", "left")

    def ordered_diagnostics(self) -> DataFrame:
        """Report order: by document, its own findings by rule and place, then the corpus' by phase."""
        return self.diagnostics.orderBy("doc_ord", F.col("scope") == "corpus", "phase", "ord", "rule_id", "message")


def validate_corpus(documents: DataFrame, keep: bool = True, most_characters: int | None = None) -> CorpusResult:
    """documents(uri, doc_ord, markdown, version). ``keep`` caches the tables that feed others, the parsed one first of all.

    ``most_characters``: a host's own budget; longer documents are then reported as unparsable. Without it any length is read.
    """
    parsed = parse_documents(documents, most_characters)
    return CorpusResult(parsed.persist() if keep else parsed, keep)


def lint_document(spark, uri: str, markdown: str, version: int | None = None) -> CorpusResult:
    """One text; corpus findings are those of a corpus of this document alone and play no part in ``document_diagnostics``."""
    rows = spark.createDataFrame([(uri, 0, markdown, version)], "uri string, doc_ord long, markdown string, version int")
    return validate_corpus(rows, keep=False)
