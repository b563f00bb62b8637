"""Line dedup: exact set-similarity join over the token sets of lines.

A line's tokens are its distinct words. A line is removed if an earlier line (smaller doc_id, or earlier in the same
document) has a Jaccard similarity of at least 0.8 with it; lines are judged on the input, not on what is left.

Tokens are ordered by rarity: those in fewer than one line in 50,000 first (by hash), then the others by their
number of lines. Equal sets are one class, kept at its first line. Classes meet in the inverted lists of their prefixes (the
rarest size - ceil(0.8 size) + 1 tokens); length and positional filters drop most pairs, and what is left is verified on
whole token sets by integer arithmetic. The frequency table is bounded by (mean tokens of a line) * 50,000 entries.

No list gives all its pairs: for each class it gives the ``CLOSE`` fitting pairs with earlier ones whose signatures are nearest. Only
classes that these leave unmatched are then held against the rest, in lists of the entries that have more pairs, so a swarm
of near copies costs a few pairs each. Lists of more than ``LONG`` classes give just one pair for each class at first. Lists of words with ``HOT`` occurrences or more are cut by size bands. Each slice of 8 MB
of text settles its own equal lines before the shuffle. Sets are equal if they agree in a key of 124 bits; words are told apart by 63.

Defined cases: null and empty texts and blank lines are kept as they are. Rows that repeat doc_id and text lose the same lines;
rows that repeat a doc_id with another text are ordered by a hash of the text. A null doc_id comes first.
Extra columns are ignored by ``dedup_lines`` and kept by ``without_repeated_lines``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import NULL_ID, Scratch, as_signed, map_arrow, release_shuffles

#: Jaccard similarity as a fraction.
UP, DOWN = 4, 5
LEAST = 2e-5
LONG = 20_000
#: Fitting pairs that a list gives at once for the later class of each; a class with more is held against the rest if these don't match.
CLOSE = 2
#: Occurrences from which a word's list takes the way that never holds a whole list in memory; entries of a bucket of the other way.
HOT, BUCKET = 500_000, 400_000
#: Low bits of a class's key that tell apart classes whose other 60 bits are equal.
ALIKE = 15


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))


def prefix_length(size: np.ndarray) -> np.ndarray:
    return size - -(-size * UP // DOWN) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[list(b"\t\n\x0b\x0c\r ")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words beyond so many bytes are hashed one by one.
_WIDE = 4_096


def hashed_words(texts: pa.Array, block: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of texts: the hash of every word, the line it stands in (numbered through), and each text's first line number plus the end.

    All words at once from the column's bytes, in blocks of texts that fit a processor's cache; no Python object is made for a word.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    words, lines, firsts, line = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], 0
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + block, side="right")) - 1)
        part = offsets[begin : end + 1]
        found, at, first = _block_words(data[part[0] : part[-1]], part - part[0])
        words.append(found)
        lines.append(at + line)
        firsts.append(first[:-1] + line)
        line += int(first[-1])
        begin = end
    return np.concatenate(words), np.concatenate(lines), np.concatenate([*firsts, [line]])


def _block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, sizes, line, first_lines = block_spans(data, offsets)
    return word_hashes(data, starts, sizes), line, first_lines


def block_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts on end: where each word starts, its size and line, and each text's first line number plus the end."""
    breaks = np.flatnonzero(data == 10)
    # A text begins a line of its own, empty or not.
    first_lines = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    # Where solid bytes begin and end; the end of a text ends a word as a blank does.
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(_BLANK[data], out=solid[1:-1])
    edges = solid[1:] != solid[:-1]
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])  # empty texts begin where others do
    split = inner[solid[inner] & solid[inner + 1]]
    bounds = np.flatnonzero(edges)
    starts, ends = bounds[::2], bounds[1::2]
    if len(split):
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    if not len(starts):
        return starts, starts, starts, first_lines
    # Line breaks and texts' beginnings passed by each word.
    passed = np.bincount(np.searchsorted(starts, np.concatenate([breaks, offsets])), minlength=len(starts) + 1)[:-1]
    line = np.cumsum(passed) - 1
    return starts, ends - starts, line, first_lines


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words, eight bytes of each at a time."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    value = sizes.astype(np.uint64) * _ODD + np.uint64(seed)
    at, left, own = starts, sizes, np.arange(len(starts))
    while len(own):
        block = eight[at]
        short = left < 8
        block[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        value[own] = _mix((value[own] ^ block) * _ODD)
        going = (left > 8) & (sizes[own] <= _WIDE)
        own, at, left = own[going], at[going] + 8, left[going] - 8
    for i in np.flatnonzero(sizes > _WIDE):
        value[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes(), seed)
    return value


def word_counts(documents: DataFrame, scratch: Scratch, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all words that occur at least ``least`` times a line (and twice); each task adds up its own before the shuffle."""

    def count(batches):
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # distinct words of each slice, with their counts

        def out():
            none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keys, counts = _added(*map(np.concatenate, zip(none, *parts)))
            parts.clear()
            bucket = (keys >> np.uint64(32)).astype(np.int64) % buckets
            for rows in _packed({"bucket": bucket, "term": as_signed(keys), "n": counts}):
                yield rows | {"lines": pa.nulls(len(rows["bucket"]), pa.int64())}

        for batch in batches:
            words, _, lines = hashed_words(batch.column(0))
            parts.append(np.unique(words, return_counts=True))
            yield {"bucket": pa.array([-1]), "term": pa.nulls(1, pa.binary()), "n": pa.nulls(1, pa.binary()), "lines": pa.array([int(lines[-1])], pa.int64())}
            if sum(len(p[0]) for p in parts) > 3_000_000:
                yield from out()
        yield from out()

    def add(batches):
        for rows in _unpacked(batches, ("term", "n")):
            keys, counts = _added(rows["term"], rows["n"])
            keep = counts > 1  # a word that occurs once in all is never frequent
            yield {"term": pa.array(keys[keep]), "n": pa.array(counts[keep])}

    buckets = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = scratch.write(map_arrow(documents, count, "bucket long, term binary, n binary, lines long"), "word_parts", "lz4")
    lines = parts.agg(F.sum("lines")).head()[0] or 0
    laid = parts.filter("bucket >= 0").select("bucket", "term", "n").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    kept = map_arrow(laid, add, "term long, n long").filter(F.col("n") >= F.lit(max(least * lines, 2))).toArrow()
    scratch.drop("word_parts")
    return kept["term"].to_numpy().view(np.uint64), kept["n"].to_numpy()


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[begins], np.add.reduceat(counts[order], begins)


def _packed(rows: dict[str, np.ndarray]):
    """One row for each bucket, with the bucket's values of every other column as bytes: cheap to shuffle."""
    order = np.argsort(rows["bucket"], kind="stable")
    bucket = rows["bucket"][order]
    begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(bucket))
    out = {"bucket": pa.array(bucket[begins])}
    for name, values in rows.items():
        if name != "bucket":
            raw = values[order].tobytes()
            out[name] = pa.array([raw[8 * a : 8 * b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())
    yield out


def _unpacked(batches, names):
    """The values of each bucket, from rows sorted by bucket."""
    held: list[list[np.ndarray]] = []
    at = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at and held:
                yield {n: np.concatenate(v) for n, v in zip(names, zip(*held))}
                held = []
            at = row[0]
            held.append([np.frombuffer(v, np.int64) for v in row[1:]])
    if held:
        yield {n: np.concatenate(v) for n, v in zip(names, zip(*held))}


class Ranks:
    """Word hash -> signed code: the rank of a frequent word (0 and up, rarest first), else the hash as a negative number.

    A direct-mapped table; of frequent words that meet in a slot one counts as rare, which is an order as good as any.
    """

    SLOTS = 1 << 22

    def __init__(self, terms: np.ndarray, counts: np.ndarray) -> None:
        order = np.lexsort((terms, counts))
        self.terms = terms[order]
        #: Codes from here on belong to words so frequent that their lists may be long.
        self.hot = int(np.searchsorted(counts[order], HOT))
        self._slots = None

    def __reduce__(self):
        return _ranks, (self.terms, self.hot)

    def codes(self, words: np.ndarray) -> np.ndarray:
        if self._slots is None:
            self._slots = np.full(self.SLOTS, -1, np.int32)
            self._slots[(self.terms & np.uint64(self.SLOTS - 1)).astype(np.int64)] = np.arange(len(self.terms))
        rare = (words | np.uint64(1 << 63)).view(np.int64)
        if not len(self.terms):
            return rare
        rank = self._slots[(words & np.uint64(self.SLOTS - 1)).astype(np.int64)]
        return np.where((rank >= 0) & (self.terms[rank] == words), rank, rare)


def _ranks(terms: np.ndarray, hot: int) -> Ranks:
    made = Ranks(terms[:0], np.zeros(0, np.int64))
    made.terms, made.hot = terms, hot
    return made


def _sorted_sets(codes: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and lines, sorted by line and code, without repeats. ``line`` is ascending already."""
    # One 64-bit key: the line, then the code's order in 43 bits: ranks above all hashes, of which the first 42 bits count.
    dense = np.cumsum(np.concatenate([[0], line[1:] != line[:-1]]))
    if len(dense) and dense[-1] < 1 << 20:
        order_ = np.where(codes < 0, (codes & ((1 << 63) - 1)) >> 21, codes + (1 << 42))
        key = (dense << 43) | order_
        order = np.argsort(key)
        codes, line, key = codes[order], line[order], key[order]
        new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (line[1:] != line[:-1])])
        if not ((key[1:] == key[:-1]) & new[1:]).any():  # no two hashes alike in their first bits
            return codes[new], line[new]
    order = np.lexsort((codes, line))
    codes, line = codes[order], line[order]
    new = np.concatenate([[True], (codes[1:] != codes[:-1]) | (line[1:] != line[:-1])])
    return codes[new], line[new]


_SET = ("k", "k2", "id", "tie", "line", "size", "s1", "s2", "rare", "tokens", "top")
_SET_SCHEMA = "k long, k2 long, id long, tie long, line int, size int, s1 long, s2 long, rare int, tokens binary, top long"


def _token_rows(ranks):
    """Per line: its set's 128-bit key (k, k2), size, 128-bit signature, and its codes in order of rarity as bytes.

    A bit of the signature is the parity of the codes that fall on it: two signatures differ in at most as many bits as the sets do in codes,
    and common codes hide none of it, however large the sets.
    The bytes hold the ``rare`` negative codes in 8 bytes each, then the ranks in 4. A line that repeats one of the same slice has no key.
    """

    def run(batches):
        for batch in batches:
            ids, ties = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            words, line, first_lines = hashed_words(batch.column(2))
            if not len(words):
                continue
            flat, line = _sorted_sets(ranks.value.codes(words), line)
            begins = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
            ends = np.append(begins[1:], len(flat))
            sizes = ends - begins
            rows = np.searchsorted(first_lines, line[begins], side="right") - 1
            numbers = (line[begins] - first_lines[rows]).astype(np.int32)
            mixed = _mix(flat.view(np.uint64))
            k, k2 = (np.add.reduceat(x, begins).view(np.int64) for x in (mixed, _mix(mixed + np.uint64(1))))
            k &= ~ALIKE
            bit = np.uint64(1) << (mixed & np.uint64(63))
            high = (mixed & np.uint64(64)) > 0
            s1, s2 = (np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), begins).view(np.int64) for x in (high, ~high))
            rare = np.add.reduceat((flat < 0).astype(np.int64), begins)
            order = np.lexsort((numbers, ties[rows], ids[rows], k2, k))
            new = np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (k2[order][1:] != k2[order][:-1])])
            lead = order[new]
            first = np.zeros(len(rows), bool)
            first[lead] = True
            # A line that is the first one itself, met again in an identical document, is no repeat.
            at = lead[np.cumsum(new) - 1]
            twin = np.zeros(len(rows), bool)
            twin[order] = (ids[rows][order] == ids[rows][at]) & (ties[rows][order] == ties[rows][at]) & (numbers[order] == numbers[at])
            keep = np.flatnonzero(first | ~twin)
            wide, narrow = flat.tobytes(), np.maximum(flat, 0).astype(np.int32).tobytes()
            tokens = [wide[8 * b : 8 * (b + r)] + narrow[4 * (b + r) : 4 * e] if f else None for b, r, e, f in zip(begins[keep].tolist(), rare[keep].tolist(), ends[keep].tolist(), first[keep].tolist())]
            later = ~first[keep]
            columns = (
                pa.array(k[keep], mask=later), pa.array(k2[keep]), pa.array(ids[rows][keep]), pa.array(ties[rows][keep]), pa.array(numbers[keep]),
                pa.array(np.where(later, 0, sizes[keep]).astype(np.int32)), pa.array(s1[keep]), pa.array(s2[keep]), pa.array(rare[keep].astype(np.int32)), pa.array(tokens, pa.binary()),
                pa.array(flat[begins + prefix_length(sizes) - 1][keep]),
            )
            yield dict(zip(_SET, columns))

    return run


def decoded(tokens: bytes, rare: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(tokens, np.int64, rare), np.frombuffer(tokens, np.int32, offset=8 * rare)])


def _classes(batches):
    """Rows sorted by (k, lone, k2, id, tie, line): the first of a key leads its class, the others are repeats (size 0, no tokens), as are lone rows.

    Classes that share k and differ in k2 are numbered in the low bits of k, which from here on is a class's own.
    """
    last, number = None, 0  # (k, k2, id, tie, line) of the lead, and its number among those of its k
    for batch in batches:
        missing = batch.column(11).to_numpy(zero_copy_only=False)
        values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        lead, twin = np.zeros(len(missing), bool), np.zeros(len(missing), bool)
        own = np.flatnonzero(~missing)
        if len(own):
            k, k2 = values[0][own], values[1][own]
            new = np.concatenate([[last is None or (k[0], k2[0]) != last[:2]], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])])
            lead[own[new]] = True
            group = np.cumsum(new) - 1
            # Places of new classes: how many of the same k came before, in this batch and at the end of the one before.
            head = np.concatenate([[True], k[1:] != k[:-1]])
            seen = np.cumsum(new)
            base_ = np.where(head, seen - new, 0)
            place = seen - np.maximum.accumulate(base_) - 1
            if last is not None and k[0] == last[0]:
                place[: int(np.searchsorted(k, k[0], side="right"))] += number + 1
            if place.max() > ALIKE:
                raise ValueError("more than 16 sets share 60 bits of their key")
            number = int(place[-1])
            values[0] = values[0].copy()
            values[0][own] = k | place
            twin[own] = True
            for i in (2, 3, 4):
                leads = values[i][own[new]]
                base = np.where(group >= 0, leads[np.maximum(group, 0)] if len(leads) else 0, last[i] if last else 0)
                twin[own] &= values[i][own] == base
            if new.any():
                last = (k[new][-1], k2[new][-1], *(v[own[new][-1]] for v in values[2:5]))
        keep = pa.array(missing | lead | ~twin)
        columns = list(batch.columns[:11])
        columns[0] = pa.array(values[0])
        columns[5] = pa.array(np.where(lead, values[5], 0).astype(np.int32))
        columns[9] = pa.compute.if_else(pa.array(lead), columns[9], pa.scalar(None, pa.binary()))
        yield dict(zip(_SET, (c.filter(keep) for c in columns)))


#: ``at``: the size of the set, shifted by 32 bits, and the token's place in it.
_ENTRY = ("token", "k", "id", "at", "s1", "s2")
_ENTRY_SCHEMA = "token long, k long, id long, at long, s1 long, s2 long"


def _prefix_rows(batch) -> dict[str, np.ndarray]:
    """One row for each token of a class's prefix, with its place."""
    k, id_, size, s1, s2, rare = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
    count = prefix_length(size.astype(np.int64))
    row = np.repeat(np.arange(len(size)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    blob = batch.column(6).cast(pa.large_binary())
    begin = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob)][row]
    raw = np.concatenate([np.frombuffer(blob.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    wide, narrow = (np.ndarray((len(raw) - 7,), kind, raw, strides=(1,)) for kind in ("<i8", "<i4"))
    is_rare = place < rare[row]
    tokens = np.empty(len(row), np.int64)
    tokens[is_rare] = wide[(begin + 8 * place)[is_rare]]
    tokens[~is_rare] = narrow[(begin + 8 * rare[row] + 4 * (place - rare[row]))[~is_rare]]
    return dict(zip(_ENTRY, (tokens, k[row], id_[row], (size.astype(np.int64)[row] << 32) | place, s1[row], s2[row])))


def _bands() -> np.ndarray:
    """First sizes of bands: a set is never similar to one beyond the next band."""
    begins = [1]
    while begins[-1] < 1 << 31:
        begins.append(begins[-1] * DOWN // UP + 1)
    return np.array(begins, np.int64)


BANDS = _bands()


def _hot_entries(hot: int):
    """Entries of hot tokens, each in the list of its token and size band and in that of the next band: similar sets meet in one of them."""

    def run(batches):
        for batch in batches:
            rows = _prefix_rows(batch)
            own = rows["token"] >= hot
            rows = {n: v[own] for n, v in rows.items()}
            band = np.searchsorted(BANDS, rows["at"] >> 32, side="right")
            both = {n: np.concatenate([v, v]) for n, v in rows.items()}
            both["token"] = _mix(_mix(both["token"].view(np.uint64)) + np.concatenate([band, band + 1]).astype(np.uint64)).view(np.int64)
            yield {n: pa.array(v) for n, v in both.items()}

    return run


def _packed_entries(hot: int, buckets: int):
    def run(batches):
        held, size = [], 0

        def out():
            rows = {n: np.concatenate([h[n] for h in held]) for n in _ENTRY}
            bucket = (_mix(rows["token"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            held.clear()
            return _packed({"bucket": bucket} | rows)

        for batch in batches:
            rows = _prefix_rows(batch)
            own = rows["token"] < hot
            held.append({n: v[own] for n, v in rows.items()})
            size += int(own.sum())
            if size > 500_000:
                yield from out()
                size = 0
        if held:
            yield from out()

    return run


def _fits(rows, i, j) -> np.ndarray:
    """Filters for entries i before j in order of size: length, position (as first common token), and the overlap the signatures allow."""
    small, large = rows["size"][i], rows["size"][j]
    need = -(-UP * (small + large) // (UP + DOWN))
    fit = (DOWN * small >= UP * large) & (np.minimum(small - rows["place"][i], large - rows["place"][j]) >= need)
    left = np.flatnonzero(fit)
    i, j, slack = i[left], j[left], (small + large - 2 * need)[left]
    fit[left] = (_apart(rows, i, j) <= slack) & (rows["k"][i] != rows["k"][j])
    return fit


def _apart(rows, i, j) -> np.ndarray:
    """Bits in which the signatures differ."""
    return sum(np.bitwise_count((rows[s][i] ^ rows[s][j]).view(np.uint64)).astype(np.int64) for s in ("s1", "s2"))


def _by_document(rows, i, j) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' entries, that of the earlier document first; both ways if one document has both."""
    id_ = rows["id"]
    swap, same = id_[i] > id_[j], id_[i] == id_[j]
    return np.concatenate([np.where(swap, j, i), j[same]]), np.concatenate([np.where(swap, i, j), i[same]])


def _oriented(rows, i, j) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' keys, as ``_by_document`` has them."""
    return tuple(rows["k"][x] for x in _by_document(rows, i, j))


def _closest(rows, i, j) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fitting pairs, for each later entry the ``CLOSE`` ones whose signatures are nearest, as entries (earlier, later); and the entries of all other pairs."""
    earlier, later = _by_document(rows, i, j)
    order = np.lexsort((_apart(rows, earlier, later) / (rows["size"][earlier] + rows["size"][later]), later))
    earlier, later = earlier[order], later[order]
    begins = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]])) if len(later) else np.zeros(0, np.int64)
    near = np.arange(len(later)) - np.repeat(begins, np.diff(np.append(begins, len(later)))) < CLOSE
    return earlier[near], later[near], np.concatenate([earlier[~near], later[~near]])


def _columns(batch, names) -> dict:
    rows = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
    return rows | {"size": rows["at"] >> 32, "place": rows["at"] & 0xFFFFFFFF}


def _windows(rows, chunk: int = 500_000):
    """All fitting pairs (i, j) of entries sorted by (token, at): for each j the earlier ones of its list whose size is near enough
    and whose token lies in the part of the prefix that a smaller or equal set needs."""
    token, size, place = rows["token"], rows["size"], rows["place"]
    n = len(token)
    index = np.flatnonzero(place < size - -(-2 * UP * size // (UP + DOWN)) + 1)
    number = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]]))
    key = (number << 32) | size
    low = np.searchsorted(index, np.searchsorted(key, (number << 32) | -(-UP * size // DOWN)))
    high = np.searchsorted(index, np.arange(n))
    count = np.maximum(high - low, 0)
    done = np.concatenate([[0], np.cumsum(count)])
    begin = 0
    while begin < n:
        end = max(int(np.searchsorted(done, done[begin] + chunk, side="right")) - 1, begin + 1)
        c = count[begin:end]
        j = np.repeat(np.arange(begin, end), c)
        i = index[np.repeat(low[begin:end] - (done[begin:end] - done[begin]), c) + np.arange(c.sum())]
        fit = _fits(rows, i, j)
        yield i[fit], j[fit]
        begin = end


def _by_lists(batches, names, going_on):
    """Batches of sorted rows cut at the ends of lists; a list beyond LONG rows comes in several parts, with ``going_on(rows)`` for each but the last."""
    carry = None
    for batch in batches:
        rows = _columns(batch, names)
        if carry is not None:
            rows = {n: np.concatenate([carry[n], rows[n]]) for n in rows}
        cut = int(np.searchsorted(rows["token"], rows["token"][-1]))
        if cut:
            yield {n: v[:cut] for n, v in rows.items()}
        carry = {n: v[cut:] for n, v in rows.items()}
        if len(carry["token"]) > LONG:
            going_on.add(int(carry["token"][0]))
            yield carry
            carry = {n: v[:0] for n, v in carry.items()}
    if carry is not None and len(carry["token"]):
        yield carry


def _hot_candidates(batches):
    """Of entries sorted by (token, at)."""
    long_lists: set[int] = set()
    return _candidates(_by_lists(batches, _ENTRY, long_lists), long_lists)


def _bucket_candidates(batches):
    """Of packed entries, a bucket at a time."""

    def lists():
        for rows in _unpacked(batches, _ENTRY):
            order = np.lexsort((rows["at"], rows["token"]))
            rows = {n: v[order] for n, v in rows.items()}
            yield rows | {"size": rows["at"] >> 32, "place": rows["at"] & 0xFFFFFFFF}

    return _candidates(lists(), set())


def _candidates(parts, long_lists):
    """Parts of whole lists: of each class's fitting pairs (a, b) the closest, and the entries of pairs beyond these once more (b null).

    Of lists beyond LONG rows each class with one earlier one alone, and all entries once more.
    """
    leads: dict[int, dict] = {}  # of the long list in hand: by size, the entry of the earliest document
    kinds = dict.fromkeys(_ENTRY, np.int64)
    for rows in parts:
        token = rows["token"]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        counts = np.diff(np.append(starts, len(token)))
        long_ = (counts > LONG) | np.isin(token[starts], list(long_lists))
        short = np.flatnonzero(np.repeat(~long_, counts))
        a, b, again = [], [], []
        if len(short):
            part = {n: v[short] for n, v in rows.items()}
            others = np.zeros(len(short), bool)
            for i, j in _windows(part):
                earlier, later, more = _closest(part, i, j)
                a.append(part["k"][earlier])
                b.append(part["k"][later])
                others[more] = True
            again.append(short[others])
        for start, count in zip(starts[long_].tolist(), counts[long_].tolist()):
            part = {n: v[start : start + count] for n, v in rows.items()}
            if leads.get("token") != int(token[start]):
                leads.clear()
                leads["token"] = int(token[start])
            for s in np.unique(part["size"]).tolist():
                own = np.flatnonzero(part["size"] == s)
                first = own[np.argmin(part["id"][own])]
                entry = {n: v[first : first + 1] for n, v in part.items()}
                if s not in leads or entry["id"][0] < leads[s]["id"][0]:
                    leads[s] = entry
                lead = min((v for z, v in leads.items() if z != "token" and DOWN * z >= UP * s), key=lambda v: v["id"][0])
                both = {n: np.concatenate([lead[n], part[n][own]]) for n in part}
                i, j = np.zeros(len(own), np.int64), np.arange(1, len(own) + 1)
                good = _fits(both, i, j)
                for side, keys in zip((a, b), _oriented(both, i[good], j[good])):
                    side.append(keys)
            again.append(np.arange(start, start + count))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        again = np.concatenate(again) if again else np.zeros(0, np.int64)
        pair = np.concatenate([np.ones(len(a), bool), np.zeros(len(again), bool)])
        out = {n: pa.array(np.concatenate([x, np.zeros(len(again), np.int64)]), mask=~pair) for n, x in (("a", a), ("b", b))}
        yield out | {n: pa.array(np.concatenate([np.zeros(len(a), kind), rows[n][again]]), mask=pair) for n, kind in kinds.items()}


def _rest(batches):
    """Entries of long lists sorted by (token, at) with ``open`` for unmatched classes: all fitting pairs with at least one open class.

    Parts of a list meet every earlier part that the length filter lets in; classes beyond it leave memory. What is held is bounded
    by the list of one token and two size bands.
    """
    names = (*_ENTRY, "open")
    earlier = None
    for rows in _by_lists(batches, names, set()):
        if earlier is not None:
            near = (earlier["token"] == rows["token"][0]) & (DOWN * earlier["size"] >= UP * rows["size"][0])
            earlier = {n: v[near] for n, v in earlier.items()}
            rows = {n: np.concatenate([earlier[n], rows[n]]) for n in rows}
        done = len(earlier["token"]) if earlier is not None else 0
        for i, j in _windows(rows):
            new = (j >= done) & (rows["open"][i] | rows["open"][j])
            if new.any():
                yield dict(zip(("a", "b"), map(pa.array, _oriented(rows, i[new], j[new]))))
        last = rows["token"] == rows["token"][-1]
        earlier = {n: v[last] for n, v in rows.items()}


def _verify(batches):
    """The later class of each pair whose sets are similar."""
    for batch in batches:
        found = []
        for later, a_tokens, a_rare, b_tokens, b_rare in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = decoded(a_tokens, a_rare), decoded(b_tokens, b_rare)
            at = np.searchsorted(x, y)  # codes ascend in both
            at[at == len(x)] = 0
            if (UP + DOWN) * np.count_nonzero(x[at] == y) >= UP * (len(x) + len(y)):
                found.append(later)
        yield {"k": pa.array(found, pa.int64())}


def _verified(pairs: DataFrame, sets: DataFrame, *hint: str) -> DataFrame:
    """k of the later class of each similar pair. Both joins use the buckets of ``sets``: only the pairs are shuffled (and hashed, with the hint, so that no set is sorted)."""
    side = lambda n: sets.select(F.col("k").alias(n), F.struct("id", "tie", "line").alias(f"{n}_at"), F.col("tokens").alias(f"{n}_tokens"), F.col("rare").alias(f"{n}_rare"))
    hinted = lambda df: df.hint(*hint) if hint else df
    both = hinted(hinted(pairs.select("a", "b").distinct()).join(side("a"), "a")).join(side("b"), "b")
    later = F.when(F.col("a_at") > F.col("b_at"), F.col("a")).otherwise(F.col("b"))
    return map_arrow(both.select(later.alias("later"), "a_tokens", "a_rare", "b_tokens", "b_rare"), _verify, "k long").distinct()


def _kept(text, lines):
    """The text without the lines of the given numbers."""
    return F.when(lines.isNotNull(), F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(lines, i)), "\n")).otherwise(text)


def repeated_lines(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """id, tie, lines: numbers (from 0) of each document's lines that repeat an earlier one."""
    spark = documents.sparkSession
    rows = keyed(documents)
    terms, counts = word_counts(rows.select("text"), scratch, LEAST)
    ranks = spark.sparkContext.broadcast(Ranks(terms, counts))  # at most (words of a line) / LEAST terms
    release_shuffles(spark)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Lines without a key (repeats already) are spread by their own hash, which then stands in for k.
    spread = map_arrow(rows, _token_rows(ranks), _SET_SCHEMA).withColumn("lone", F.col("k").isNull()).withColumn("k", F.coalesce("k", F.xxhash64("id", "tie", "line")))
    ready = spread.repartition(parts, "k").sortWithinPartitions("k", "lone", "k2", "id", "tie", "line")
    name = f"line_classes_{uuid.uuid4().hex}"
    try:
        return _repeated(spark, ready, name, ranks, parts, scratch)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for old in ("word_parts", "classes", "offered", "gone", "more"):
            scratch.drop(old)
        release_shuffles(spark)


def _repeated(spark, ready: DataFrame, name: str, ranks, parts: int, scratch: Scratch) -> DataFrame:
    """id, tie, lines from the sorted rows of ``_token_rows``."""
    classes = map_arrow(ready.select(*_SET, "lone"), _classes, _SET_SCHEMA)
    classes.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").option("parquet.enable.dictionary", "false").option("path", f"{scratch.root}/classes").bucketBy(parts, "k").format("parquet").saveAsTable(name)
    release_shuffles(spark)
    classes = spark.table(name)
    sets = classes.filter("size > 0")

    columns, offer = ("k", "id", "size", "s1", "s2", "rare", "tokens"), f"a long, b long, {_ENTRY_SCHEMA}"
    hot = ranks.value.hot
    total = sets.agg(F.coalesce(F.sum(F.col("size") - F.ceil(F.col("size") * UP / DOWN) + 1), F.lit(0))).head()[0]
    buckets = max(parts, int(total) // BUCKET)
    packed = map_arrow(sets.select(*columns), _packed_entries(hot, buckets), "bucket long, " + ", ".join(f"{n} binary" for n in _ENTRY))
    offered = map_arrow(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket"), _bucket_candidates, offer)
    rows_ = map_arrow(sets.filter(F.col("top") >= hot).select(*columns), _hot_entries(hot), _ENTRY_SCHEMA)
    rows_ = map_arrow(rows_.repartition("token").sortWithinPartitions("token", "at"), _hot_candidates, offer)
    offered = scratch.write(offered.union(rows_), "offered")
    release_shuffles(spark)
    # First each class against the ones closest to it; the rest only for those left unmatched.
    gone = scratch.write(_verified(offered.filter("b is not null"), sets, "shuffle_hash"), "gone")
    release_shuffles(spark)
    matched = gone.select(F.col("k").alias("b"))
    open_ = offered.filter("b is null").join(gone.select("k", F.lit(True).alias("matched")), "k", "left").select(*_ENTRY, F.col("matched").isNull().alias("open"))
    rest = map_arrow(open_.repartition("token").sortWithinPartitions("token", "at"), _rest, "a long, b long")
    more = scratch.write(_verified(rest.join(matched, "b", "left_anti"), sets), "more")
    release_shuffles(spark)

    similar = sets.join(gone.union(more).distinct(), "k", "left_semi").select("id", "tie", "line")
    equal = classes.filter("size = 0").select("id", "tie", "line")
    return scratch.write(similar.union(equal).groupBy("id", "tie").agg(F.sort_array(F.collect_set("line")).alias("lines")), "lines")  # a document's own lines


def dedup_lines(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_lines, n_removed, text (what is left)."""
    lines = repeated_lines(documents, scratch)  # a few numbers for a document: hashed, so that whole texts need no sort
    text, gone = F.col("text"), F.col("lines")
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return keyed(documents).join(lines.hint("shuffle_hash"), ["id", "tie"], "left").select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        _kept(text, gone).alias("text"),
    )


def without_repeated_lines(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents with all their columns, and only the lines that repeat no earlier one; n_chars follows the text."""
    lines = repeated_lines(documents, scratch).select(F.col("id").alias("__id"), F.col("tie").alias("__tie"), F.col("lines").alias("__lines"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("__text_tie", F.xxhash64(text))
    out = rows.join(lines.hint("shuffle_hash"), (F.col("__doc") == F.col("__id")) & (F.col("__text_tie") == F.col("__tie")), "left").withColumn("text", _kept(F.col("text"), F.col("__lines")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*documents.columns)
