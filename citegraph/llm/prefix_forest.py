"""Nearest neighbours by a forest of hash-prefix trees.

Every tree gives a vector a long hash string (``BITS`` signs of random projections of the centred vector) and keeps a
block's strings as one sorted array. A query descends every tree to its longest matching prefix, by binary search, and then all
trees ascend together, one bit at a time: the vectors that share the current prefix length in any tree are
its candidates. The ascent stops at the level that first yields ``share`` of the block (never fewer than 4 k vectors);
candidates are scored by their inner product in double precision on the original vectors.

Strings are of variable use: a query in a dense region stops at a long prefix, one in an empty region at a short one.
Centre and scale of the hashing are fitted on ``SAMPLE`` vectors; all vectors are indexed. The share needed for
a recall of 0.9 depends on the data: it is fitted on that sample against brute force (see ``fit``).

Vectors are cut into blocks of at most ``BLOCK`` rows by a hash of their id; the stated queries go to every block, in blocks of
their own, and a block returns each query's best k. Nothing but the sample reaches the driver.

Defined cases: null or zero vectors, and those holding null or non-finite components, take no part. Vectors of another
length than the queries' are no candidates for them. Repeated rows with one vec_id: all take part as candidates, a query never meets its own id, and repeated query rows
give one answer. Ties in score go to the smaller vec_id. A null vec_id takes no part. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from citegraph.llm.common import Scratch, map_arrow

TREES = 16
BITS = 48
BLOCK = 8_192
SAMPLE = 4_096
TARGET = 0.96
SHARES = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


@dataclass
class Hashing:
    centre: np.ndarray
    planes: np.ndarray  # (trees, dimensions, bits)
    share: float = 1.0

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings as integers, first bit highest."""
        out = np.zeros((len(self.planes), len(vectors)), np.uint64)
        moved = vectors - self.centre
        for t, planes in enumerate(self.planes):
            bits = moved @ planes > 0
            for b in range(bits.shape[1]):
                out[t] = (out[t] << np.uint64(1)) | bits[:, b]
        return out


class Forest:
    """The sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hashing: Hashing) -> None:
        self.ids, self.vectors, self.hashing = ids, vectors, hashing
        strings = hashing.strings(vectors)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.strings = np.take_along_axis(strings, self.order, axis=1)

    def ranges(self, queries: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries) bounds of the entries that share the first ``length`` bits."""
        bits = self.hashing.planes.shape[2]
        low = (queries >> np.uint64(bits - length)) << np.uint64(bits - length)
        high = low + np.uint64((1 << (bits - length)) - 1)
        begin = np.stack([np.searchsorted(s, q) for s, q in zip(self.strings, low)])
        end = np.stack([np.searchsorted(s, q, side="right") for s, q in zip(self.strings, high)])
        return begin, end

    def candidates(self, vectors: np.ndarray, least: int):
        """For each query, the entries met when the joint ascent first reaches ``least`` of them."""
        bits = self.hashing.planes.shape[2]
        queries = self.hashing.strings(vectors)
        least = min(least, len(self.ids))
        left = np.arange(len(vectors))
        marks = np.zeros(len(self.ids), bool)
        for length in range(bits, -1, -1):
            begin, end = self.ranges(queries[:, left], length)
            hopeful = (end - begin).sum(axis=0) >= least
            stay = []
            for j, q in enumerate(left.tolist()):
                if not hopeful[j]:
                    stay.append(q)
                    continue
                marks[:] = False
                for t in range(len(self.order)):
                    marks[self.order[t, begin[t, j] : end[t, j]]] = True
                found = np.flatnonzero(marks)
                if len(found) >= least:
                    yield q, found
                else:
                    stay.append(q)
            left = np.array(stay, np.int64)
            if not len(left):
                return

    def search(self, query_ids: np.ndarray, vectors: np.ndarray, k: int, share: float):
        """(query id, vec_ids, scores): each query's best k candidates, nearest first."""
        least = max(int(np.ceil(share * len(self.ids))), 4 * k)
        for q, found in self.candidates(vectors, least + 1):
            scores = self.vectors[found] @ vectors[q]
            own = self.ids[found] != query_ids[q]
            found, scores = found[own], scores[own]
            if len(found) > 4 * k:  # all that tie with the k-th stay
                edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= edge
                found, scores = found[keep], scores[keep]
            order = np.lexsort((self.ids[found], -scores))[:k]
            yield query_ids[q], self.ids[found][order], scores[order]


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vec (array of double) of the vectors that take part."""
    vec = F.col("embedding").cast("array<double>")
    fine = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(fine)


def fit(vectors: DataFrame, k: int, trees: int = TREES, bits: int = BITS, seed: int = 7) -> Hashing | None:
    """Hashing fitted on at most SAMPLE vectors: projections of unit-variance data, and the least share of SHARES whose
    recall for 128 sample queries reaches TARGET against brute force (margin over the 0.9 to be kept on other rows)."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return None
    lengths = pd.Series(map(len, rows["vec"]))
    width = int(lengths.mode()[0])
    sample = np.array([v for v in rows["vec"].to_pylist() if len(v) == width])
    rng = np.random.default_rng(seed)
    scale = sample.std(axis=0)
    scale[scale == 0] = 1
    planes = rng.standard_normal((trees, width, bits)) / scale[None, :, None]
    hashing = Hashing(sample.mean(axis=0), planes)
    forest = Forest(np.arange(len(sample)), sample, hashing)
    queries = np.arange(min(128, len(sample)))
    exact = sample[queries] @ sample.T
    exact[queries, queries] = -np.inf
    k = min(k, len(sample) - 1)
    if k <= 0:
        return hashing
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    for share in SHARES:
        least = max(int(np.ceil(share * len(sample))), 4 * k) + 1
        hit = [np.isin(best[q], found).mean() for q, found in forest.candidates(sample[queries], least)]
        if np.mean(hit) >= TARGET:
            hashing.share = share
            break
    return hashing


def nearest(embeddings: DataFrame, is_query: Column, k: int, scratch: Scratch, hashing: Hashing | None = None, block: int = BLOCK) -> DataFrame:
    """embeddings(vec_id, embedding) -> query_id, rank (from 1), vec_id, score: k nearest of the rows where ``is_query`` holds."""
    spark = embeddings.sparkSession
    vectors = scratch.write(usable(embeddings), "vectors")
    count = vectors.count()
    hashing = hashing or fit(vectors, k)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if hashing is None:
        return empty
    width = len(hashing.centre)
    shared = spark.sparkContext.broadcast(hashing)  # trees * width * bits numbers
    blocks = max(1, -(-count // block))
    rows = vectors.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("part"), F.lit(0).alias("asks"), "vec_id", "vec")
    asking = vectors.filter(is_query).dropDuplicates(["vec_id"]).filter(F.size("vec") == width)
    asking = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.lit(1).alias("asks"), "vec_id", "vec")
    laid = rows.filter(F.size("vec") == width).unionByName(asking).repartition(blocks, "part").sortWithinPartitions("part", "asks", "vec_id")

    def run(batches):
        part, held, forest = None, [], None

        def answer(ids, vecs):
            out = {"query_id": [], "vec_id": [], "score": []}
            for q, found, scores in forest.search(ids, vecs, k, shared.value.share):
                out["query_id"].append(np.full(len(found), q))
                out["vec_id"].append(found)
                out["score"].append(scores)
            return {n: pa.array(np.concatenate(v) if v else np.zeros(0)).cast(t) for (n, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.float64()))}

        for batch in batches:
            parts, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            vecs = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            edges = np.flatnonzero(np.concatenate([[True], (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])]))
            for i, j in zip(edges, [*edges[1:], len(ids)]):
                if parts[i] != part:
                    part, held, forest = parts[i], [], None
                if not asks[i]:
                    held.append((ids[i:j].copy(), vecs[i:j].copy()))
                    continue
                if not held:
                    continue
                if forest is None:
                    forest = Forest(*(np.concatenate(x) for x in zip(*held)), shared.value)
                for a in range(i, j, 1_024):
                    b = min(j, a + 1_024)
                    yield answer(ids[a:b], vecs[a:b])

    best = map_arrow(laid, run, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
