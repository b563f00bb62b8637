"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > j) = sigmoid(w . x - t_j) with one weight vector for all thresholds t_0 < t_1; the expected severity is the sum of
P(grade > j). Grades: 0 clean, 1 toxic, 2 toxic with many marked terms. Labels say toxic or not;
a toxic document counts as grade 2 in training if it has more marked terms than the median toxic one.

x counts, for each feature, the distinct words of the whole text that have it. A word's features are itself, its prefixes of 4,
5 and 6 letters and its suffixes of 4 and 5. The model keeps the features in ``LEAST`` toxic documents or more that are at least
``ODDS`` times as frequent in toxic ones, so most words of clean text weigh nothing. The sample bounds their number.

Fitted on at most ``SAMPLE`` labelled documents of each class (whole texts), taken by hash of doc_id. All documents are scored.

Defined cases: null and empty texts have no features and the severity of an empty text. Labels that are null are ignored; a doc_id
labelled twice is toxic if either label says so, and a labelled doc_id with several texts is learned from the least of them. Without labels of both classes nothing is toxic (severity 0).
Repeated rows are scored each. Extra columns are ignored by ``severities`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import Scratch, as_signed, map_arrow

SAMPLE = 2_500
LEAST, ODDS = 3, 8
LIMIT = 0.5
WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> set[int]:
    """Hashes of a word's features."""
    parts = {f"={word}"} | {f"<{word[:n]}" for n in (4, 5, 6) if len(word) >= n} | {f">{word[-n:]}" for n in (4, 5) if len(word) >= n}
    return {xxhash.xxh64_intdigest(p) for p in parts}


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def word_score(self, word: str) -> float:
        own = np.fromiter(word_features(word), np.uint64)
        if not len(self.features):
            return 0.0
        at = np.searchsorted(self.features, own)
        at[at == len(self.features)] = 0
        return float(self.weights[at][self.features[at] == own].sum())

    def severity(self, score: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -40, 40)))).sum(axis=1)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, steps: int = 300, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam on the mean negative log-likelihood of sparse (row, column, value) triples."""
    levels = int(grades.max())
    n = len(grades)
    share = np.array([(grades > j).mean() for j in range(levels)]).clip(1e-3, 1 - 1e-3)
    start = np.log((1 - share) / share)
    # Thresholds stay ordered as a first one and the logarithms of the gaps.
    params = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, first, gaps = params[:width], params[width], np.exp(params[width + 1 :])
        cuts = first + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, values * w[columns], n)
        above = sigmoid(score[:, None] - cuts[None])  # P(grade > j)
        upper = np.concatenate([np.ones((n, 1)), above], axis=1)[np.arange(n), grades]
        lower = np.concatenate([above, np.zeros((n, 1))], axis=1)[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-12)
        slope = above * (1 - above)
        d_upper = np.concatenate([np.zeros((n, 1)), slope], axis=1)[np.arange(n), grades] / p
        d_lower = np.concatenate([slope, np.zeros((n, 1))], axis=1)[np.arange(n), grades] / p
        d_score = -(d_upper - d_lower) / n
        d_cuts = np.zeros(levels)
        np.add.at(d_cuts, grades[grades > 0] - 1, d_upper[grades > 0] / n)
        np.add.at(d_cuts, grades[grades < levels], -d_lower[grades < levels] / n)
        grad = np.concatenate([np.bincount(columns, values * d_score[rows], width) + ridge * w, [d_cuts.sum()], [d_cuts[j + 1 :].sum() * gaps[j] for j in range(levels - 1)]])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = params[width] + np.concatenate([[0], np.cumsum(np.exp(params[width + 1 :]))])
    return params[:width], cuts


def _feature_rows(batches):
    """row, toxic, feature, n: distinct words of each sampled text by feature."""
    known: dict[str, np.ndarray] = {}
    for batch in batches:
        for doc, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
            parts = []
            for word in distinct_words(text):
                if word not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known[word] = np.fromiter(word_features(word), np.uint64)
                parts.append(known[word])
            features, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            for i in range(0, max(1, len(features)), 100_000):
                part = features[i : i + 100_000]
                yield {"doc": pa.array(np.full(len(part), doc)), "toxic": pa.array(np.full(len(part), toxic, np.int32)), "feature": pa.array(as_signed(part)), "n": pa.array(n[i : i + 100_000].astype(np.int32))}


def fit(documents: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> OrdinalModel:
    """documents(doc_id, text), labels(doc_id, toxic) -> model."""
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.array([40.0, 40.0]))
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.filter("toxic = 1").orderBy(*order).limit(sample).union(marks.filter("toxic = 0").orderBy(*order).limit(sample))
    chosen = scratch.write(chosen.select(F.col("doc_id").alias("doc"), "toxic"), "chosen")
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("doc")).groupBy("doc", "toxic").agg(F.min(F.col("text").cast("string")).alias("text"))  # 2 * sample rows
    rows = scratch.write(map_arrow(texts, _feature_rows, "doc long, toxic int, feature long, n int"), "features")
    sizes = {r["toxic"]: r["c"] for r in rows.groupBy("toxic").agg(F.countDistinct("doc").alias("c")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return none
    bad, good = sizes[1], sizes[0]
    counts = rows.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) * (good + 1.0) / ((F.col("c") + 0.5) * (bad + 1.0)))
    kept = counts.filter((F.col("t") >= LEAST) & (odds > float(np.log(ODDS))))
    features = np.sort(np.array([r[0] for r in kept.select("feature").collect()], np.int64).view(np.uint64))  # of 2 * sample texts
    if not len(features):
        return none
    triples = rows.join(kept.select("feature"), "feature").select("doc", "feature", "n").toPandas()  # 2 * sample rows of marked features
    marked = dict(rows.select("doc", "toxic").distinct().toPandas().itertuples(index=False, name=None))
    place = {d: i for i, d in enumerate(sorted(marked))}
    at = np.array([place[d] for d in triples["doc"]], np.int64)
    column = np.searchsorted(features, triples["feature"].to_numpy().view(np.uint64))
    value = triples["n"].to_numpy(float)
    toxic = np.array([marked[d] for d in sorted(marked)], np.int64)
    hits = np.bincount(at, value, len(toxic))
    grades = toxic * (1 + (hits > np.median(hits[toxic == 1])))
    if grades.max() < 2:
        grades[np.argmax(hits * toxic)] = 2  # equal counts all round: one of them stands for the upper grade
    weights, cuts = fit_ordinal(at, column, value, grades, len(features))
    return OrdinalModel(features, weights, cuts)


class _Scorer:
    """Sums of word scores; a word's score is remembered, for half a million words at most."""

    def __init__(self, model: OrdinalModel) -> None:
        self.model, self.known = model, {}

    def severities(self, texts) -> np.ndarray:
        known, totals = self.known, []
        for text in texts:
            total = 0.0
            for word in sorted(distinct_words(text)):
                score = known.get(word)
                if score is None:
                    if len(known) > 500_000:
                        known.clear()
                    score = known[word] = self.model.word_score(word)
                total += score
            totals.append(total)
        return self.model.severity(np.array(totals))


def severities(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """documents(doc_id, text) -> doc_id, severity (0 to 2)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = _Scorer(shared.value)
        for batch in batches:
            yield {"doc_id": batch.column(0), "severity": pa.array(scorer.severities(t.as_py() for t in batch.column(1)))}

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, severity double")


def without_toxic(documents: DataFrame, labels: DataFrame, scratch: Scratch, limit: float = LIMIT) -> DataFrame:
    """The documents whose expected severity stays under ``limit``, with all their columns."""
    model = fit(documents, labels, scratch)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def severity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(shared.value)
        for texts in batches:
            yield pd.Series(scorer.severities(texts), dtype=float)

    return documents.filter(F.pandas_udf(severity, "double")(F.col("text").cast("string")) < limit)
