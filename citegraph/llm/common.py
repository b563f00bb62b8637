"""Shared pieces: scratch tables in the cluster's shared folder, term statistics, word rules."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: bytes.split() without arguments cuts at just these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
NULL_ID = -(2**63)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a session without one (tests, local mode) gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='citegraph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", codec).parquet(path)
        # The declared schema saves a look into the files and keeps empty tables readable.
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished phases now, not at the next full collection."""
    for _ in range(2):  # references held from Python go first, then those of the JVM; the cleaner works behind both
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def map_arrow(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """mapInArrow whose function takes and gives dicts of columns, a bounded slice of rows at a time."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(slices(batches)):
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, wanted)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that no step holds many long texts at once."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        parts = max(1, -(-batch.nbytes // most_bytes))
        step = max(1, -(-batch.num_rows // parts))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


class TermHash(dict):
    """Term (bytes) -> 64-bit XXH64; remembers at most a million terms."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[term] = xxhash.xxh64_intdigest(term)
        return value


def as_signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64, copy=False).view(np.int64)


def frequent_terms(groups: DataFrame, terms_of, total: int, least_share: float, most_share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Terms that occur in least_share..most_share of all groups, with their counts, ascending by hash.

    ``terms_of(batch)`` yields arrays of uint64 term hashes, one array of distinct terms for each group
    (document or line). Counts cover all groups. Every task sums its own terms before the shuffle. The result's size is
    bounded by (mean distinct terms of a group) / least_share, whatever the corpus: each returned term
    takes up at least least_share * total of the group-term pairs.
    """

    def count(batches):
        pending, held = [], 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def fold():
            if pending:
                parts.append(np.unique(np.concatenate(pending), return_counts=True))
                pending.clear()
            keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, at, np.concatenate([p[1] for p in parts]))
            parts[:] = [(keys, counts)]

        def out():
            keys, counts = parts.pop()
            for i in range(0, len(keys), 100_000):
                yield {"term": pa.array(as_signed(keys[i : i + 100_000])), "n": pa.array(counts[i : i + 100_000])}

        for batch in batches:
            for terms in terms_of(batch):
                pending.append(terms)
                held += len(terms)
                if held > 1_000_000:
                    fold()
                    held = 0
                    if len(parts[0][0]) > 3_000_000:
                        yield from out()
        if pending or parts:
            fold()
            yield from out()

    counts = map_arrow(groups, count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = counts.filter((F.col("n") >= F.lit(least_share * total)) & (F.col("n") <= F.lit(most_share * total)))
    table = kept.toArrow()
    terms = np.asarray(table["term"].to_numpy()).view(np.uint64)
    order = np.argsort(terms)
    return terms[order], np.asarray(table["n"].to_numpy())[order]


def positions_in(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted value in the sorted ones, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return at, sorted_values[at] == wanted
