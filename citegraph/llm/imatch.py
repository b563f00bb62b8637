"""I-Match fingerprints over several randomised lexicons.

Terms are lower-cased runs of letters, digits and non-ASCII bytes. The lexicon holds the terms whose document
frequency lies in a band (inverse document frequency neither too low nor too high), counted over all
documents. A fingerprint is a list of 48 hashes, one for each randomised subset of the lexicon: the sorted distinct terms of
the text that the subset keeps, hashed together. Subsets keep 1/2, 1/8, 1/32 or 1/128 of the lexicon
(twelve each), so that texts of a dozen and of thousands of terms both find subsets of a few terms.
Likeness of two fingerprints: for each rate, equal hashes as a share of the subsets in which either text has a term;
the largest share among rates with at least four such subsets (of all subsets together, if no rate has four).

The lexicon is bounded: a term in at least ``least`` of all documents takes that share of the
document-term pairs, so there are at most (mean terms of a document) / ``least`` of them, 8 bytes each.

Defined cases: null texts are empty. A text without lexicon terms has the fingerprint of its whole
text's SHA-256, alike (1.0) to equal texts alone. One document is its own next document. Rows that repeat a doc_id are
ordered by text; a null doc_id comes first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import NULL_ID, TermHash, frequent_terms, map_arrow, positions_in, release_shuffles

#: What is no part of a term becomes a blank, so that bytes.split() finds the terms.
_BLANKED = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
RATES = (1, 3, 5, 7)  # a subset keeps 2**-rate of the lexicon
EACH = 12
#: Document share of lexicon terms: at least one in 10,000 documents (and two of them), at most one in 20.
LEAST, MOST = 1e-4, 0.05
EMPTY = "-"
#: Documents of a range, and ranges at most: what the driver holds of them (a bound and a first id each) has this bound, whatever the corpus.
RANGE, MOST_RANGES = 2_000, 32_768
SUBSETS = len(RATES) * EACH
_hexed = xxhash.xxh32_hexdigest


def terms(text: str | None, hashed: TermHash) -> np.ndarray:
    """Sorted distinct term hashes of a text."""
    found = set((text or "").lower().encode().translate(_BLANKED).split())
    own = np.fromiter(map(hashed.__getitem__, found), np.uint64, len(found))
    own.sort()
    return own


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Lexicon:
    """Sorted term hashes, and for each term the set of subsets that keep it, as bits."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        self._subsets = None

    def __reduce__(self):
        return Lexicon, (self.terms,)

    @property
    def subsets(self) -> np.ndarray:
        if self._subsets is None:
            self._subsets = np.zeros(len(self.terms), np.uint64)
            for i, rate in enumerate(r for r in RATES for _ in range(EACH)):
                kept = (_mix(self.terms, i + 1) >> np.uint64(64 - rate)) == 0
                self._subsets |= kept.astype(np.uint64) << np.uint64(i)
        return self._subsets


def fingerprint(text: str | None, lexicon: Lexicon, hashed: TermHash) -> str:
    """Hex hashes of the subsets, joined by dots; ``-`` for a subset without terms."""
    own = terms(text, hashed)
    at, known = positions_in(lexicon.terms, own)
    own, at = own[known], at[known]
    if not len(own):
        return "=" + hashlib.sha256((text or "").encode()).hexdigest()
    member = np.unpackbits(lexicon.subsets[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :SUBSETS].T.astype(bool)
    kept = np.broadcast_to(own, member.shape)[member].tobytes()
    ends = (8 * np.cumsum(member.sum(axis=1))).tolist()
    return ".".join([_hexed(kept[a:b]) if b > a else EMPTY for a, b in zip([0, *ends], ends)])


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    pairs = list(zip(a.split("."), b.split(".")))
    by_rate = [[x == y for x, y in pairs[i : i + EACH] if x != EMPTY or y != EMPTY] for i in range(0, len(pairs), EACH)]
    shares = [sum(p) / len(p) for p in by_rate if len(p) >= 4]
    together = [x for p in by_rate for x in p]
    return max(shares) if shares else sum(together) / max(1, len(together))


def lexicon(documents: DataFrame, least: float = LEAST, most: float = MOST) -> Lexicon:
    """The terms within the band, counted over all documents."""
    total = documents.count()

    def each(batch):
        hashed = TermHash()
        for text in batch.column(0):
            yield terms(text.as_py(), hashed)

    low = max(least, 2 / max(1, total))
    found, _ = frequent_terms(documents.select(F.col("text").cast("string")), each, total, low, most)
    return Lexicon(found)


def _by_range(documents: DataFrame, rows_each: int) -> DataFrame:
    """part, follower, id, text: documents by ranges of doc_id; each range's first document comes once more, as follower of the range before.

    Ranges come from quantiles of doc_id; a range's bound and first id go through the driver, of MOST_RANGES ranges at most.
    Beyond that ranges grow; they are sorted on disk and read in order, so none needs to fit in memory.
    """
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = min(MOST_RANGES, max(1, documents.count() // rows_each))
    steps = [i / parts for i in range(1, parts)]
    cuts = np.array(sorted(set(rows.agg(F.percentile_approx("id", steps, 10 * parts)).head()[0] or [])) if steps else [], np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), side="right").astype(np.int32))

    keyed = rows.withColumn("part", part_of("id"))
    firsts = sorted(keyed.groupBy("part").agg(F.min("id").alias("first")).collect())
    before = {r["first"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}

    @F.pandas_udf("int")
    def follows(ids: pd.Series) -> pd.Series:
        return ids.map(before).astype("Int32")

    follower = rows.withColumn("part", follows("id")).filter("part is not null").groupBy("part", "id").agg(F.min("text").alias("text"))
    both = keyed.select("part", F.lit(0).alias("follower"), "id", "text").unionByName(follower.select("part", F.lit(1).alias("follower"), "id", "text"))
    return both.repartition(max(1, len(firsts)), "part").sortWithinPartitions("part", "follower", "id", "text")


def fingerprint_with_edits(documents: DataFrame, least: float = LEAST, most: float = MOST, rows_each: int = RANGE) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text: the last floor(n_chars / 4) code points replaced by as many first ones of the next document.
    Texts are shuffled once, by ranges of doc_id, and sorted within; only a range's first document is sent twice.
    """
    spark = documents.sparkSession
    words = lexicon(documents, least, most)
    release_shuffles(spark)
    shared = spark.sparkContext.broadcast(words)
    laid = _by_range(documents, rows_each)

    def run(batches: Iterator[pa.RecordBatch]):
        hashed, held = TermHash(), None
        for batch in batches:
            out = {k: [] for k in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for part, follower, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = fingerprint(text, shared.value, hashed)
                if held and held[0] == part:
                    _, _, before_id, before_text, before_print = held
                    cut = len(before_text) // 4
                    edited = before_text[: len(before_text) - cut] + text[:cut]
                    changed = fingerprint(edited, shared.value, hashed)
                    row = (None if before_id == NULL_ID else before_id, len(before_text), hashlib.sha256(edited.encode()).hexdigest(), before_print, changed, likeness(before_print, changed), likeness(before_print, own))
                    for k, v in zip(out, row):
                        out[k].append(v)
                held = None if follower else (part, follower, doc_id, text, own)
            if out["doc_id"]:
                yield out

    return map_arrow(laid, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
