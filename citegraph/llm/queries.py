"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm import attention_mil, curriculum, imatch, line_dedup, packing, prefix_forest, simhash, sql, substring_dedup, toxicity, url_reputation
from citegraph.llm.common import Scratch

URL_RULES = (
    url_reputation.Rule("org", "/", "allow"),
    url_reputation.Rule("example.org", "/es/", "block"),
    url_reputation.Rule("example.org", "/en/1", "block"),
    url_reputation.Rule("com", "/fr/", "allow"),
    url_reputation.Rule("com", "/de/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, Scratch(spark, "forest"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "packing"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    fold = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(5)) == 0
    model = attention_mil.fit(documents, labels.filter(~fold("doc_id")), Scratch(spark, "mil"))
    scored = attention_mil.scores(documents, model)
    return scored.select("doc_id", fold("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), Scratch(spark, "lines"))


def op7_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = curriculum.plan(table(spark, sf_dir, "documents"), Scratch(spark, "curriculum"))
    return curriculum.by_position(planned.select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "last_position"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "substrings"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    graded = toxicity.severities(documents, toxicity.fit(documents, labels, Scratch(spark, "toxicity")))
    return graded.select("doc_id", "severity", (F.col("severity") >= toxicity.LIMIT).cast("int").alias("toxic"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref"), (1 - F.col("quality")).alias("bad"))
    judged = url_reputation.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES, scratch=Scratch(spark, "urls"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_forest": op1_prefix_forest,
    "op2_imatch": op2_imatch,
    "op3_packing": op3_packing,
    "op4_attention_mil": op4_attention_mil,
    "op5_simhash": op5_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_curriculum": op7_curriculum,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_url_reputation": op10_url_reputation,
}

ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": sql.LINE_DEDUP,
    "op7_curriculum": sql.CURRICULUM,
    "op8_substring_dedup": sql.SUBSTRING_DEDUP,
    "op10_url_reputation": sql.URL_REPUTATION,
}
