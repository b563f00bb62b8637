"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window of ``window`` tokens gives each source a quantum in
proportion to its target; a source takes floor(quantum + deficit) tokens and carries the rest as
deficit to the next window. After w windows source s has therefore taken floor(w * quantum_s) tokens, which is
the whole state of the round-robin: any partition can start at any window with the deficits
that the windows before it left. Windows follow each other without gaps and are cut into sequences, so that
only the very last sequence is padded. Quanta are exact fractions of integers (targets by default: the sources' own
token counts, so all queues end together; a queue that ends early just leaves its share to the rest).

Documents are tokenized once, into a table in the shared folder whose rows carry their place within (stretch, source);
prefix sums over (source, stretch) then place every token. Cut pieces never need a global sort. A stretch is what a task reads;
with ``in_file_order`` it is what lies between two splits of a Parquet file, and queues follow the files by name and their
rows in turn, however Spark deals files to tasks: the order in which a sorted table was written.

Defined cases: a null text is empty (one end-of-document id). The null source is a queue of its own, the last one. Repeated
rows are packed as often as they occur. An empty table gives no pieces. Extra columns are ignored. More than
``most_queues`` sources are folded into that many queues by hash; their targets add up.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.common import Scratch, map_arrow

END = 0
SEQUENCE = 1024
#: Tokens of a window: 64 sequences.
WINDOW = 64 * SEQUENCE


class Tokenizer:
    """Ids of a byte-level BPE vocabulary, equal to the tokenizers library's, from its rank file (several times as fast).

    The special token's string in a text is that special token, as tokenizers has it by default.
    """

    def __init__(self, ranks: str, pattern: str, special: Mapping[str, int]) -> None:
        self.args = (ranks, pattern, dict(special))
        self._made = None

    def __reduce__(self):
        return Tokenizer, self.args

    def encode(self, text: str) -> np.ndarray:
        if self._made is None:
            import tiktoken

            ranks, pattern, special = self.args
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._made = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
        return np.asarray(self._made.encode_to_numpy(text, allowed_special="all"), np.uint32)


def default_tokenizer() -> Tokenizer:
    import public_tokenizers

    return Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})


def tokenized(documents: DataFrame, tokenizer: Tokenizer, scratch: Scratch, most_queues: int, in_file_order: bool = False) -> DataFrame:
    """Table file, task, queue, doc_id, n, before, ids: ``before`` counts the tokens of the queue earlier in the stretch (file, task).

    ``task`` is the task's number, or with ``in_file_order`` the first byte of the split; ``file`` is empty without.

    ids are little-endian 16-bit words where the vocabulary allows it, else 32-bit.
    """

    def run(batches):
        number = TaskContext.get().partitionId()
        sums: dict[tuple, int] = {}
        last: dict[tuple, int] = {}
        for batch in batches:
            out = {k: [] for k in ("file", "task", "queue", "doc_id", "n", "before", "ids")}
            for doc_id, text, queue, file, split, row in zip(*(c.to_pylist() for c in batch.columns)):
                task = number
                if in_file_order:
                    task = split
                    if row <= last.get((file, split), -1):
                        raise ValueError(f"rows of {file} are not read in turn")
                    last[file, split] = row
                ids = np.append(tokenizer.encode(text or ""), np.uint32(END))
                begun = sums.get((file, task, queue), 0)
                sums[file, task, queue] = begun + len(ids)
                for k, v in zip(out, (file, task, queue, doc_id, len(ids), begun, ids.astype("<u4" if ids.max() > 65535 else "<u2").tobytes())):
                    out[k].append(v)
            yield out

    names = documents.select("source").distinct()
    many = names.limit(most_queues + 1).count() > most_queues
    place = [F.col(f"_metadata.{c}") for c in ("file_name", "file_block_start", "row_index")] if in_file_order else [F.lit(""), F.lit(0), F.lit(0)]
    rows = documents.select("doc_id", "text", "source", *(c.alias(k) for k, c in zip(("file", "split", "row"), place)))
    if many:
        queued = rows.withColumn("queue", F.pmod(F.xxhash64("source"), F.lit(most_queues)).cast("int"))
    else:
        order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        places = names.select(F.col("source").alias("name"), order.cast("int").alias("queue"))
        queued = rows.join(F.broadcast(places), F.col("source").eqNullSafe(F.col("name")))  # at most most_queues rows
    return scratch.write(map_arrow(queued.select("doc_id", "text", "queue", "file", "split", "row"), run, "file string, task long, queue int, doc_id long, n long, before long, ids binary"), "tokens", "lz4")


def pack(
    documents: DataFrame,
    scratch: Scratch,
    tokenizer: Tokenizer | None = None,
    targets: Mapping[int, int] | None = None,
    length: int = SEQUENCE,
    window: int = WINDOW,
    most_queues: int = 10_000,
    broadcast_rows: int = 100_000,
    in_file_order: bool = False,
) -> DataFrame:
    """documents(doc_id, text, source) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, ids.

    One row for each piece: ``start`` is its place in its document, ``offset`` its place in its sequence; ``ids`` holds
    its ids as little-endian unsigned 32-bit words. ``targets`` weighs queues (sources in code point order, null last).
    ``in_file_order``: documents, a Parquet table as read, stand in their queue in the order in which they were written.
    """
    tokens = tokenized(documents, tokenizer or default_tokenizer(), scratch, most_queues, in_file_order)
    by_task = scratch.write(tokens.groupBy("file", "task", "queue").agg(F.sum("n").alias("n")), "by_task")
    totals = sorted((r["queue"], r["n"]) for r in by_task.groupBy("queue").agg(F.sum("n").alias("n")).collect())  # most_queues rows at most
    queues = np.array([q for q, _ in totals], np.int64)
    have = [int(n) for _, n in totals]
    weight = [int(targets.get(q, 0)) for q, _ in totals] if targets else have
    if targets and min(weight, default=1) <= 0:
        raise ValueError("every queue needs a target above zero")
    shares = (queues, have, weight, sum(weight))
    earlier = Window.partitionBy("queue").orderBy("file", "task").rowsBetween(Window.unboundedPreceding, -1)
    begin = by_task.select(F.col("file").alias("f"), F.col("task").alias("t"), F.col("queue").alias("q"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if by_task.count() <= broadcast_rows:  # tasks x sources; beyond that, a shuffle join
        begin = F.broadcast(begin)
    placed = tokens.join(begin, (F.col("file") == F.col("f")) & (F.col("task") == F.col("t")) & (F.col("queue") == F.col("q")))

    def cut(batches):
        layout = Layout(*shares, window)
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", "ids")}
            for queue, doc_id, n, before, base, ids in zip(*(c.to_pylist() for c in batch.columns)):
                words = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                for start, stop, at in layout.runs(queue, base + before, base + before + n):
                    a = start - base - before
                    while start < stop:
                        step = min(stop - start, length - at % length)
                        piece = words[a : a + step].tobytes()
                        for k, v in zip(out, (doc_id, a, step, zlib.crc32(piece), n, at // length, at % length, queue, piece)):
                            out[k].append(v)
                        start, a, at = start + step, a + step, at + step
            yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int, ids binary"
    return map_arrow(placed.select("queue", "doc_id", "n", "before", "base", "ids"), cut, schema)


class Layout:
    """Where each queue's tokens go: exact integer arithmetic over the whole round-robin."""

    def __init__(self, queues: np.ndarray, have: list[int], weight: list[int], total: int, window: int) -> None:
        self.at = {int(q): i for i, q in enumerate(queues)}
        self.have, self.weight, self.total, self.window = have, weight, max(1, total), window
        self.known: dict[int, list[int]] = {}

    def taken(self, i: int, w: int) -> int:
        """Tokens that queue i has given after w windows."""
        return min(self.have[i], w * self.window * self.weight[i] // self.total)

    def starts(self, w: int) -> list[int]:
        """Place in the whole stream of each queue's run in window w."""
        if w not in self.known:
            if len(self.known) > 1_000:
                self.known.clear()
            done = [self.taken(i, w) for i in range(len(self.have))]
            at, places = sum(done), []
            for i, d in enumerate(done):
                places.append(at)
                at += self.taken(i, w + 1) - d
            self.known[w] = places
        return self.known[w]

    def runs(self, queue: int, begin: int, end: int):
        """Tokens begin..end of a queue as (first, last, place in the stream), one for each window they touch."""
        i = self.at[queue]
        while begin < end:
            # The last window whose start is at or before begin: taken(w) <= begin < taken(w + 1).
            w = ((begin + 1) * self.total - 1) // (self.window * self.weight[i])
            first = self.taken(i, w)
            stop = min(end, self.taken(i, w + 1))
            yield begin, stop, self.starts(w)[i] + begin - first
            begin = stop
