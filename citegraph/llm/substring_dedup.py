"""Substring dedup over a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words of one document. Its fingerprint is the least 64-bit hash of the
``GRAM``-word sequences in it, so equal windows have equal fingerprints and neighbouring windows mostly share theirs:
one index row stands for a whole run of windows (about one row in eight words) and holds their verifying hashes.

The index is a set of immutable runs, each a table sorted by fingerprint and cut into the same buckets. A new batch of documents is
shuffled once into a run of its own, which is merge-joined with every live run, bucket by bucket: history is read in order and
not shuffled. Rows whose fingerprint occurs in history, or twice in the batch, are verified window by window; a window
that stands in an older batch, or earlier in its own (smaller doc_id, earlier start), is a repeat. Then ``fanout`` neighbouring runs
of a level are merged into one of the next, where of rows with the same windows the oldest stays. A batch never reads an older text.

Verification: fingerprints come from one 64-bit hash of a word, verifying hashes of all ``WINDOW`` words from another with its own seed,
so windows that count as equal agree in a hash of 64 bits besides the 64 of the fingerprint. Words of up to eight bytes and equal length collide in neither.

Hot passages: each task first settles the repeats among its own rows; only its first occurrences of a window go
through the shuffle, so a passage that a third of all documents share arrives once for each slice of 8 MB of text. Fingerprints of more
than ``HOT`` rows (a common sequence in ever new surroundings) are split by window, so that no task gathers them.

Defined cases: null and empty texts have no words. Texts shorter than a window lose nothing. Rows that repeat
doc_id and text count as one document (all keep the same words); rows that repeat a doc_id with another text are documents ordered by
a hash of the text. A null doc_id comes first. A batch that is added again meets its own rows, which are no repeats of
themselves. Extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.common import NULL_ID, Scratch, as_signed, map_arrow, release_shuffles
from citegraph.llm.line_dedup import block_spans, word_hashes

WINDOW = 20
GRAM = 5
FANOUT = 4
BATCHES = 4
#: Rows of a fingerprint from which they are split by window.
HOT = 100_000
#: A bucket of a run is one sorted file: with this setting joins read it in order and don't sort it again.
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"
_SHIFTS = (1, 2, 4, 8)  # least of 16 neighbours, by doubling
assert WINDOW - GRAM + 1 == 16
_SEED = 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolling(words: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Mixed polynomial hash of every ``length`` consecutive word hashes, by doubling."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    total, done, size = None, 0, 1  # the hash of the first ``done`` words; ``block``: that of ``size`` words
    block = words
    while size <= length:
        if length & size:
            if total is None:
                total, done = block, size
            else:  # the words so far, then a block
                n = len(words) - done - size + 1
                total = total[:n] * np.uint64(pow(factor, size, 1 << 64)) + block[done : done + n]
                done += size
        if 2 * size <= length:
            block = block[:-size] * np.uint64(pow(factor, size, 1 << 64)) + block[size:]
        size *= 2
    return _mix(total)


def hashed_texts(texts: pa.Array, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts without nulls: two independent 64-bit hashes of every word, and each text's number of words; in blocks that fit a processor's cache."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    low, high, counts, begin = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + block, side="right")) - 1)
        part = offsets[begin : end + 1]
        own = data[part[0] : part[-1]]
        starts, sizes, _, _ = block_spans(own, part - part[0])
        low.append(word_hashes(own, starts, sizes))
        high.append(word_hashes(own, starts, sizes, _SEED))
        counts.append(np.diff(np.searchsorted(starts, part - part[0])))
        begin = end
    return np.concatenate(low), np.concatenate(high), np.concatenate(counts)


def keyed(documents: DataFrame) -> DataFrame:
    """id, tie, text: the order of documents, without nulls."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


#: A row of a run; without digests it is a stretch of windows that its slice has settled as repeats (fp then only spreads it).
ENTRY = "fp long, batch int, id long, tie long, begin int, count int, digests binary"
_SPAN = "id long, tie long, begin int, count int"


class FingerprintIndex:
    """Runs under ``path``, named level-first-last-buckets by the batches they hold; a run within a larger finished one is dead.

    A killed append or compaction leaves a folder without _SUCCESS, which is ignored.
    """

    def __init__(self, spark, path: str, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._tables: list[str] = []

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _folder(self, run: tuple) -> str:
        return f"{self.path}/{'-'.join(map(str, run))}"

    def runs(self) -> list[tuple[int, int, int, int]]:
        """(level, first batch, last batch, buckets) of the live runs, oldest first."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        found = []
        for status in fs.listStatus(path(self.path)):
            name = status.getPath().getName()
            if re.fullmatch(r"\d+-\d+-\d+-\d+", name) and fs.exists(path(f"{self.path}/{name}/_SUCCESS")):
                found.append(tuple(map(int, name.split("-"))))
        live = [r for r in found if not any(o != r and o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)]
        return sorted(live, key=lambda r: r[1])

    def _name(self) -> str:
        self._tables.append(f"run_{uuid.uuid4().hex}")
        return self._tables[-1]

    def _write(self, rows: DataFrame, run: tuple) -> None:
        """rows are partitioned by bucket; the writer sorts them by fp."""
        fs, path = self._fs()
        fs.delete(path(self._folder(run)), True)
        writer = rows.write.bucketBy(run[3], "fp").sortBy("fp").format("parquet")
        writer.option("compression", "lz4").option("parquet.enable.dictionary", "false").option("path", self._folder(run)).saveAsTable(self._name())

    def _read(self, run: tuple) -> DataFrame:
        """A run as a bucketed table; the catalog entry lives as long as this object, the files outlive it."""
        name = self._name()
        self.spark.sql(f"CREATE TABLE {name} ({ENTRY}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {run[3]} BUCKETS LOCATION '{self._folder(run)}'")
        return self.spark.table(name)

    def close(self) -> None:
        """Forget the catalog entries."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")

    def append(self, batch: DataFrame, scratch: Scratch, compact: bool = True) -> DataFrame:
        """A new run for a batch of documents (id, tie, text) -> id, tie, begin, count: the batch's windows that are repeats, as stretches."""
        before = self.spark.conf.get(_ORDERED)
        try:
            self.spark.conf.set(_ORDERED, "true")
            history = self.runs()
            turn = history[-1][2] + 1 if history else 0
            run = (0, turn, turn, self.buckets)
            rows = map_arrow(batch, _entries(turn), ENTRY)
            self._write(rows.repartition(self.buckets, "fp"), run)
            release_shuffles(self.spark)
            gone = self._merge_join(run, history, scratch)
            if compact:
                self.compact()
        finally:
            self.spark.conf.set(_ORDERED, before)
            self.close()
        return gone

    def _merge_join(self, run: tuple, history: list[tuple], scratch: Scratch) -> DataFrame:
        """What a new run repeats of itself and of the runs before it."""
        name = f"{run[1]}-{uuid.uuid4().hex[:8]}"
        every = self._read(run)
        fresh, settled = every.filter("digests is not null"), every.filter("digests is null")
        met = [self._read(r).filter("digests is not null").join(fresh.select("fp"), "fp", "left_semi").select(*fresh.columns) for r in history]
        known = fresh.limit(0)
        for rows in met:
            known = known.union(rows)
        known = scratch.write(known, f"known-{name}", "lz4")
        times = fresh.groupBy("fp").agg(F.count("*").alias("n")).union(known.groupBy("fp").agg(F.count("*").alias("n")))
        times = times.groupBy("fp").agg(F.sum("n").alias("n")).filter("n > 1")
        places = [t.join(times, "fp").select(*fresh.columns, (F.col("n") > HOT).alias("hot"), F.lit(new).alias("new")) for t, new in ((fresh, True), (known, False))]
        split = map_arrow(places[0].union(places[1]), _split_hot, ENTRY + ", new boolean")
        laid = split.repartition("fp").sortWithinPartitions("fp", "batch", "id", "tie", "begin")
        gone = map_arrow(laid, _first_wins, _SPAN).union(settled.select("id", "tie", "begin", "count"))
        gone = scratch.write(gone, f"gone-{name}")
        scratch.drop(f"known-{name}")
        release_shuffles(self.spark)
        return gone

    def compact(self) -> None:
        """Merge any ``fanout`` neighbouring runs of a level into one sorted run of the next."""
        while True:
            runs = self.runs()
            level = next((v for v in sorted({r[0] for r in runs}) if sum(r[0] == v for r in runs) >= self.fanout), None)
            if level is None:
                return
            due = [r for r in runs if r[0] == level][: self.fanout]
            rows = self._read(due[0])
            for run in due[1:]:
                rows = rows.union(self._read(run))
            turn = Window.partitionBy("fp", "digests").orderBy("batch", "id", "tie", "begin")
            merged = rows.filter("digests is not null").withColumn("turn", F.row_number().over(turn)).filter("turn = 1").drop("turn")
            self._write(merged, (level + 1, due[0][1], due[-1][2], due[0][3]))
            fs, path = self._fs()
            for r in due:
                fs.delete(path(self._folder(r)), True)


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of so many 64-bit words each, from their values on end."""
    offsets = np.concatenate([[0], np.cumsum(8 * counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _flat(column: pa.Array) -> np.ndarray:
    """The 64-bit words of a binary column without nulls, on end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.int64) if len(column) else np.zeros(0, np.int64)


def _entries(turn: int):
    """The rows of a batch's run: runs of windows, without those that hold nothing but repeats of their slice; these as settled stretches."""

    def run(batches):
        for batch in batches:
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            low, high, words = hashed_texts(batch.column(2))
            text_of = np.repeat(np.arange(len(words)), words)
            # All texts on end; a window counts if its first and its last word are of one text.
            place = np.flatnonzero(text_of[: -WINDOW + 1] == text_of[WINDOW - 1 :])
            if not len(place):
                continue
            least = _rolling(low, GRAM, 0x9E3779B97F4A7C15)
            for shift in _SHIFTS:
                least = np.minimum(least[:-shift], least[shift:])
            fp, row, digest = least[place], text_of[place], _rolling(high, WINDOW, 0xC2B2AE3D27D4EB4F)[place]
            at = place - (np.cumsum(words) - words)[row]
            # Runs of windows that share a fingerprint.
            heads = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])]))
            rfp, rbegin, rrow, rcount = fp[heads], at[heads], row[heads], np.diff(np.append(heads, len(fp)))
            ends = np.cumsum(rcount)
            later = np.zeros(len(fp), bool)
            both = digest ^ _mix(fp)
            order = np.argsort(both)
            twice = np.flatnonzero(both[order][1:] == both[order][:-1])
            some = np.unique(np.concatenate([order[twice], order[twice + 1]]))  # windows with a double
            order = some[np.lexsort((at[some], ties[row[some]], ids[row[some]], digest[some], fp[some]))]
            same = (fp[order][1:] == fp[order][:-1]) & (digest[order][1:] == digest[order][:-1])
            later[order[1:][same]] = True
            later[order] &= ~_twin_of_first(same, ids[row[order]], ties[row[order]], at[order])
            sent = np.flatnonzero(np.add.reduceat(~later, ends - rcount) > 0)
            kept = np.zeros(len(rfp), bool)
            kept[sent] = True
            gone_row, gone_at, gone_n = _stretches(row[later], at[later])
            none = len(gone_row)
            spread = _mix(ids[gone_row].view(np.uint64) + gone_at.astype(np.uint64))
            yield {
                "fp": pa.array(as_signed(np.concatenate([rfp[sent], spread]))),
                "batch": pa.array(np.full(len(sent) + none, turn, np.int32)),
                "id": pa.array(np.concatenate([ids[rrow[sent]], ids[gone_row]])),
                "tie": pa.array(np.concatenate([ties[rrow[sent]], ties[gone_row]])),
                "begin": pa.array(np.concatenate([rbegin[sent], gone_at]).astype(np.int32)),
                "count": pa.array(np.concatenate([rcount[sent], gone_n]).astype(np.int32)),
                "digests": pa.concat_arrays([_binary(digest[np.repeat(kept, rcount)], rcount[sent]), pa.nulls(none, pa.binary())]),
            }

    return run


def _split_hot(batches):
    """Rows of hot fingerprints as one row for each window, under a fingerprint of its own; equal windows still meet."""
    names = [f.split()[0] for f in ENTRY.split(", ")]
    for batch in batches:
        hot = np.asarray(batch.column(7).to_numpy(zero_copy_only=False), bool)
        if (~hot).any():
            cool = batch.filter(pa.array(~hot))
            yield {n: cool.column(i) for i, n in enumerate(names)} | {"new": cool.column(8)}
        if hot.any():
            rows = batch.filter(pa.array(hot))
            fp, number, ids, ties, begin, count = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            digest = _flat(rows.column(6))
            row = np.repeat(np.arange(len(fp)), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]
            own = _mix(fp[row].view(np.uint64) ^ digest.view(np.uint64))
            values = (as_signed(own), number[row], ids[row], ties[row], at.astype(np.int32), np.ones(len(row), np.int32))
            yield dict(zip(names, map(pa.array, values))) | {"digests": _binary(digest, np.ones(len(row), np.int64)), "new": rows.column(8).take(pa.array(row))}


def _twin_of_first(same, ids, ties, at) -> np.ndarray:
    """Of sorted windows (``same``: equal to the one before), those that are their group's first itself, met again in an identical row."""
    if not len(ids):
        return np.zeros(0, bool)
    start = np.concatenate([[0], np.flatnonzero(~same) + 1])
    first = start[np.concatenate([[0], np.cumsum(~same)])]
    return (ids == ids[first]) & (ties == ties[first]) & (at == at[first])


def _stretches(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a row as (row, first, number)."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])) if len(row) else np.zeros(0, np.int64)
    return row[begins], at[begins], np.diff(np.append(begins, len(row)))


def _first_wins(batches):
    """Rows sorted by (fp, batch, id, tie, begin): of the new ones, the windows seen before under their fingerprint."""
    held_fp, held, held_key = None, np.zeros(0, np.int64), None  # the last fingerprint's digests, sorted, and where each came first
    for batch in batches:
        fp, _, ids, ties, begin, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        new = np.asarray(batch.column(7).to_numpy(zero_copy_only=False), bool)
        digest = _flat(batch.column(6))
        row = np.repeat(np.arange(len(fp)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[row]
        wfp = fp[row]
        order = np.lexsort((np.arange(len(row)), digest, wfp))
        same = (wfp[order][1:] == wfp[order][:-1]) & (digest[order][1:] == digest[order][:-1])
        later = np.zeros(len(row), bool)
        later[order[1:][same]] = True
        later[order] &= ~_twin_of_first(same, ids[row[order]], ties[row[order]], at[order])
        if held_fp is not None and wfp[0] == held_fp:
            # What an earlier batch of rows held is a repeat, unless it is that very window: same document and place.
            spot = np.searchsorted(held, digest)
            spot[spot == len(held)] = 0
            seen = (wfp == held_fp) & (held[spot] == digest)
            itself = (np.stack([ids[row], ties[row], at], axis=1) == held_key[spot]).all(axis=1)
            later = np.where(seen, ~itself, later)
        tail = wfp == fp[-1]
        digests, where = np.unique(digest[tail], return_index=True)
        keys = np.stack([ids[row][tail], ties[row][tail], at[tail]], axis=1)[where]
        if held_fp == fp[-1]:
            fresh = ~np.isin(digests, held)
            digests, keys = np.concatenate([held, digests[fresh]]), np.concatenate([held_key, keys[fresh]])
            by = np.argsort(digests)
            digests, keys = digests[by], keys[by]
        held_fp, held, held_key = fp[-1], digests, keys
        later &= new[row]
        gone_row, gone_at, gone_n = _stretches(row[later], at[later])
        yield {"id": pa.array(ids[gone_row]), "tie": pa.array(ties[gone_row]), "begin": pa.array(gone_at.astype(np.int32)), "count": pa.array(gone_n.astype(np.int32))}


def _apply(batches):
    for batch in batches:
        out = {k: [] for k in ("id", "n_words", "n_removed", "kept")}
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist()):
            words = text.as_py().split()
            if not spans:
                for k, v in zip(out, (None if doc_id == NULL_ID else doc_id, len(words), 0, b" ".join(words).decode())):
                    out[k].append(v)
                continue
            steps = np.zeros(len(words) + 1, np.int64)
            for span in spans:
                steps[span["begin"]] += 1
                steps[span["begin"] + span["count"] - 1 + WINDOW] -= 1
            gone = np.cumsum(steps[:-1]) > 0
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if gone.any() else b" ".join(words)
            for k, v in zip(out, (None if doc_id == NULL_ID else doc_id, len(words), int(gone.sum()), kept.decode())):
                out[k].append(v)
        yield out


def dedup(documents: DataFrame, scratch: Scratch, index: FingerprintIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """documents(doc_id, text) -> id, n_words, n_removed, kept (the remaining words, space-joined).

    With an ``index`` the documents are its next batch: windows that stand in its older batches are repeats, whatever
    their doc_id. Otherwise they go into an index of their own in ``batches`` by ascending ranges of doc_id.
    """
    spark = documents.sparkSession
    rows = keyed(documents)
    if index is None:
        own = FingerprintIndex(spark, f"{scratch.root}/index", fanout=2)
        steps = [i / batches for i in range(1, batches)]
        cuts = sorted(set(rows.agg(F.percentile_approx("id", steps, 1_000)).head()[0] or []))
        gone = None
        for low, high in zip([None, *cuts], [*cuts, None]):
            part = rows if low is None else rows.filter(F.col("id") > low)
            found = own.append(part if high is None else part.filter(F.col("id") <= high), scratch, compact=high is not None)
            gone = found if gone is None else gone.union(found)
    else:
        gone = index.append(rows, scratch)
    spans = scratch.write(gone.groupBy("id", "tie").agg(F.collect_list(F.struct("begin", "count")).alias("spans")), "gone")  # a document's own
    if index is None:
        scratch.drop("index")
    release_shuffles(spark)
    joined = rows.join(spans, ["id", "tie"], "left").select("id", "text", "spans")
    return map_arrow(joined, _apply, "id long, n_words long, n_removed long, kept string")
