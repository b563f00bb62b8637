"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame, written and reread for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citegraph.llm import curriculum, line_dedup, packing, simhash, toxicity
from citegraph.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays under the limit; the model is fitted on the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels, Scratch(spark, "toxicity"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one."""
    return line_dedup.without_repeated_lines(docs, Scratch(spark, "lines"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near copies."""
    return simhash.without_near_copies(docs, Scratch(spark, "simhash"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the curriculum takes them, range-sorted by training position."""
    return curriculum.mixed(docs, Scratch(spark, "curriculum"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; each source's documents in the order of the files, which the mix wrote by training position."""
    return packing.pack(docs, Scratch(spark, "packing"), in_file_order=True).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near copies", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: The toxicity stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents table; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
