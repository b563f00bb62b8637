"""SimHash fingerprints and their near-duplicate join by a binary trie.

Fingerprint: of every word shingle's XXH64 (seed 42), a bit is 1 if set in over half the hashes.
Two fingerprints link at ``budget`` or fewer differing bits. The join walks the binary trie of a sorted
group of fingerprints by pairs of nodes, adds up differing bits and drops a pair beyond the budget.

Placement: 64 bits in four blocks; with at most three errors one block is equal in both, and of the
remaining 48 bits, again in four parts, one is equal too. Each distinct fingerprint goes to 16 groups
keyed by such a block and part (28 equal bits), which loses no pair; each group holds one sub-trie.
A group holds only distinct fingerprints, so thousands of copies are one entry; links within a group leave
it as a spanning forest, never as all pairs. Components are then found by min-label propagation with
pointer jumping over those links, written to the shared folder each round.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other. Texts of
fewer words than a shingle have one shingle, the whole sequence. Rows that repeat a doc_id are separate
texts of one document: each keeps its row, and they share that document's component. Rows with a null doc_id are
documents of their own that name no component: one with no named member has a null component_id. Extra columns
are ignored by ``near_duplicates`` and kept by ``without_near_copies``.

``near_copies`` links by the same trie join over fingerprints of its longer shingles, and besides by exact Jaccard similarity of
shingle sets, 0.8 or more. That lies about ten bits of a fingerprint apart, a budget at which no trie over 64 bits prunes, so for these
pairs candidates share one of 32 bands of 4 min-hashes (a pair at 0.8 has none with probability 5e-8); each is verified on whole
sets. Texts without words are equal to each other.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.common import NULL_ID, Scratch, as_signed, map_arrow, release_shuffles

BITS = 64
_ONE = np.uint64(1)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of a lower-cased text."""
    parts = text.split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hashed(b" ".join(parts), 42)], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.array([hashed(line[i:j], 42) for i, j in zip(starts, ends[words - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: bits set in over half the hashes; none gives zero."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 50_000):  # one byte for each bit: 3 MB at a time
        part = hashes[i : i + 50_000].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """documents(doc_id, text) -> doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [majority(shingle_hashes((t.as_py() or b"").lower(), words)) for t in texts]
            yield {"doc_id": batch.column(0), "fp": pa.array(as_signed(np.array(fps, np.uint64)))}

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


class _Forest:
    """Union-find over a group's entries; ``labels`` are refreshed roots, used to drop pairs already joined."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = self.root(i), self.root(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((i, j))

    def labels(self) -> np.ndarray:
        up = np.array(self.parent)
        while True:
            over = up[up]
            if np.array_equal(over, up):
                return up
            up = over


def trie_links(values: np.ndarray, budget: int = 3, top: int = BITS - 1, chunk: int = 200_000) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct sorted uint64 ``values``: pairs of their indices.

    A node is a range of the sorted values that share the bits above ``bit``. The stack holds blocks of
    node pairs (range, range, bit, differing bits so far), deepest first. A pair whose two nodes already lie in one
    component is dropped; a pair of single leaves is verified by counting its differing bits.
    """
    n = len(values)
    forest = _Forest(n)
    if n < 2:
        return []
    near = np.bitwise_count(values[1:] ^ values[:-1]) <= budget  # neighbours in the sorted array
    at = np.flatnonzero(near)
    forest.join(at, at + 1)
    one = lambda x: np.array([x], np.int64)
    stack = [(one(0), one(n), one(0), one(n), one(top), one(0))]
    while stack:
        lo1, hi1, lo2, hi2, bit, off = stack.pop()
        if len(lo1) > chunk:
            for i in range(0, len(lo1), chunk):
                stack.append(tuple(x[i : i + chunk] for x in (lo1, hi1, lo2, hi2, bit, off)))
            continue
        labels = forest.labels()
        changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        joined = (changes[hi1 - 1] == changes[lo1]) & (changes[hi2 - 1] == changes[lo2]) & (labels[lo1] == labels[lo2])
        small = (hi1 - lo1) * (hi2 - lo2) <= 16
        leaf = ~joined & (small | (bit < 0))
        if leaf.any():  # verify what is left below these nodes
            a, b = _products(lo1[leaf], hi1[leaf], lo2[leaf], hi2[leaf])
            good = (a < b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            forest.join(a[good], b[good])
        go = ~joined & ~leaf
        if not go.any():
            continue
        lo1, hi1, lo2, hi2, bit, off = (x[go] for x in (lo1, hi1, lo2, hi2, bit, off))
        m1, m2 = _splits(values, lo1, hi1, bit), _splits(values, lo2, hi2, bit)
        same = (lo1 == lo2) & (hi1 == hi2)
        new = []
        for p1, q1, p2, q2, cost, skip in (
            (lo1, m1, lo2, m2, 0, None),
            (m1, hi1, m2, hi2, 0, None),
            (lo1, m1, m2, hi2, 1, None),
            (m1, hi1, lo2, m2, 1, same),  # of a node with itself this is the mirror image
        ):
            keep = (p1 < q1) & (p2 < q2) & (off + cost <= budget)
            if skip is not None:
                keep &= ~skip
            new.append((p1[keep], q1[keep], p2[keep], q2[keep], bit[keep] - 1, off[keep] + cost))
        stack.append(tuple(np.concatenate(x) for x in zip(*new)))
    return forest.links


def _splits(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """First index in each range whose bit is set, by binary search over all ranges at once."""
    lo, hi, shift = lo.copy(), hi.copy(), bit.astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        probe = np.minimum(mid, len(values) - 1)
        set_ = ((values[probe] >> shift) & _ONE).astype(bool)
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)


def _products(lo1, hi1, lo2, hi2) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of small range pairs."""
    w1, w2 = hi1 - lo1, hi2 - lo2
    count = w1 * w2
    pair = np.repeat(np.arange(len(count)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return lo1[pair] + k // w2[pair], lo2[pair] + k % w2[pair]


def _rotations(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of 16 (block, part): group key, and the fingerprint with those 28 bits turned to the top."""
    keys, turned = [], []
    low48, low36 = np.uint64((1 << 48) - 1), np.uint64((1 << 36) - 1)
    for block in range(4):
        r = np.uint64(16 * block)
        a = fps if block == 0 else (fps << r) | (fps >> np.uint64(64 - 16 * block))
        head, tail = a >> np.uint64(48), a & low48
        for part in range(4):
            s = np.uint64(12 * part)
            t = tail if part == 0 else ((tail << s) | (tail >> np.uint64(48 - 12 * part))) & low48
            keys.append(np.uint64(block * 4 + part) << np.uint64(28) | head << np.uint64(12) | t >> np.uint64(36))
            turned.append(t & low36)
    return np.concatenate(keys), np.concatenate(turned), np.tile(np.arange(len(fps)), 16)


def links(distinct: DataFrame, budget: int = 3) -> DataFrame:
    """distinct(fp) -> a, b: links (a > b as signed) that span every component within each group."""

    def spread(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 20_000):
                part = fps[i : i + 20_000]
                keys, _, at = _rotations(part)
                yield {"key": pa.array(as_signed(keys)), "fp": pa.array(as_signed(part[at]))}

    def walk(batches):
        carry = [np.zeros(0, np.int64)] * 2
        for batch in batches:
            key = np.concatenate([carry[0], batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([carry[1], batch.column(1).to_numpy(zero_copy_only=False)])
            last = np.searchsorted(key, key[-1])  # the last group may go on in the next batch
            carry = [key[last:], fp[last:]]
            yield from groups(key[:last], fp[:last])
        yield from groups(*carry)

    def groups(key, fp):
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        found_a, found_b = [], []
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            own = fp[start : start + size].view(np.uint64)
            kind = int(key[start]) >> 28
            turned = _turn(own, kind // 4, kind % 4)
            order = np.argsort(turned)
            for i, j in trie_links(turned[order], budget, top=35):
                x, y = int(own[order[i]].astype(np.int64)), int(own[order[j]].astype(np.int64))
                found_a.append(max(x, y))
                found_b.append(min(x, y))
        if found_a:
            yield {"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())}

    spreaded = map_arrow(distinct.select("fp"), spread, "key long, fp long")
    placed = spreaded.repartition("key").sortWithinPartitions("key")
    return map_arrow(placed, walk, "a long, b long").distinct()


def _turn(fps: np.ndarray, block: int, part: int) -> np.ndarray:
    low48, low36 = np.uint64((1 << 48) - 1), np.uint64((1 << 36) - 1)
    a = fps if block == 0 else (fps << np.uint64(16 * block)) | (fps >> np.uint64(64 - 16 * block))
    t = a & low48
    if part:
        t = ((t << np.uint64(12 * part)) | (t >> np.uint64(48 - 12 * part))) & low48
    return t & low36


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges(a, b) -> node, root: the least node of every component, for nodes with an edge.

    Alternates large-star and small-star: every node links its larger neighbours to its least one, then
    its smaller ones. Rounds are logarithmic in practice; each is written to the shared folder and ends with a count
    of changed links. Hot nodes are aggregated map-side by min, no neighbour list is collected.
    """
    edges = scratch.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}0")
    turn = 0
    while True:
        turn += 1
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = scratch.write(large.filter("a <> b").distinct(), f"{name}{turn}l")
        # Small-star: a's smaller neighbours and a itself point to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        small = scratch.write(small.filter("a <> b").distinct(), f"{name}{turn}")
        changed = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        scratch.drop(f"{name}{turn}l")
        scratch.drop(f"{name}{turn - 1}")
        edges = small
        if not changed:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(documents: DataFrame, scratch: Scratch, words: int = 3, budget: int = 3) -> DataFrame:
    """documents(doc_id, text) -> doc_id, fp, component_id: the smallest doc_id reachable over links."""
    prints = scratch.write(fingerprints(documents, words).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "fp"), "prints")
    distinct = prints.groupBy("fp").agg(F.min(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))).alias("first"))
    found = scratch.write(links(distinct, budget), "links")
    # Rows that repeat a doc_id with different texts tie their fingerprints together.
    ties = prints.filter(F.col("doc_id") != NULL_ID).groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("a")).filter("a <> b").select("doc_id", "b")
    ties = prints.join(ties, "doc_id").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    roots = components(found.union(ties), scratch)
    of_print = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = of_print.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = scratch.write(of_print.join(named, "root").select("fp", "component_id"), "classes")
    release_shuffles(scratch.spark)
    # A fingerprint shared by a third of all rows: salt the rows, repeat the classes.
    salts = 8
    left = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    right = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return left.join(right, ["fp", "salt"]).select(real("doc_id"), "fp", "component_id")


BANDS, ROWS = 32, 4
_SEEDS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_ODD = _SEEDS[1] | _ONE


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band of the least values that its functions take over a set; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(hashes), 2_000):
        least = np.minimum(least, ((hashes[None, i : i + 2_000] ^ _SEEDS[0]) * _ODD).min(axis=1))
    raw = least.tobytes()
    step = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[b * step : (b + 1) * step], b) for b in range(BANDS)], np.uint64)


def _sets(documents: DataFrame, words: int, whole: bool) -> DataFrame:
    """doc_id, node (a hash of the shingle set), its size, and the set itself (``whole``) or its band keys, as bytes; fp, the fingerprint, unless ``whole``."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("node", "size", "data", "fp")}
            for text in batch.column(1).cast(pa.large_binary()):
                hashes = shingle_hashes((text.as_py() or b"").lower(), words)
                own = np.unique(hashes)
                out["fp"].append(0 if whole else majority(hashes))
                out["node"].append(xxhash.xxh64_intdigest(own.tobytes()))
                out["size"].append(len(own))
                out["data"].append((own if whole else band_keys(own)).tobytes())
            yield {"doc_id": batch.column(0), "node": pa.array(as_signed(np.array(out["node"], np.uint64))), "size": out["size"], "data": out["data"], "fp": pa.array(as_signed(np.array(out["fp"], np.uint64)))}

    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")
    return map_arrow(documents.select(id_, F.col("text").cast("string")), run, "doc_id long, node long, size long, data binary, fp long")


def _exploded(nodes: DataFrame) -> DataFrame:
    """node, size, data (band keys) -> key, node, size."""

    def run(batches):
        for batch in batches:
            data = batch.column(2).to_pylist()
            count = np.fromiter(map(len, data), np.int64, len(data)) // 8
            of = np.repeat(np.arange(len(data)), count)
            yield {"key": pa.array(np.frombuffer(b"".join(data), np.int64))} | {k: pa.array(batch.column(i).to_numpy(zero_copy_only=False)[of]) for i, k in enumerate(("node", "size"))}

    return map_arrow(nodes.select("node", "size", "data"), run, "key long, node long, size long")


def _alike(batches):
    """Pairs whose sets have a Jaccard similarity of 0.8 or more."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            good.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        keep = pa.array(good)
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}


def _near_prints(prints: DataFrame, budget: int) -> DataFrame:
    """prints(node, fp) -> a, b: links among nodes that span those of fingerprints at ``budget`` or fewer differing bits."""
    own = prints.select("node", "fp").distinct()
    least = own.groupBy("fp").agg(F.min("node").alias("least"))
    equal = own.join(least, "fp").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    x, y = least.toDF("a", "node_a"), least.toDF("b", "node_b")
    return equal.union(links(least, budget).join(x, "a").join(y, "b").select("node_a", "node_b"))


def near_copies(documents: DataFrame, scratch: Scratch, words: int = 5, budget: int = 3) -> DataFrame:
    """documents(doc_id, text) -> doc_id, component_id: the smallest doc_id reachable over pairs whose fingerprints differ in at most
    ``budget`` bits or whose similarity is 0.8 or more."""
    prints = scratch.write(_sets(documents, words, False), "sets")
    bits = scratch.write(_near_prints(prints, budget), "bits")
    nodes = prints.dropDuplicates(["node"])
    keyed = _exploded(nodes)
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = scratch.write(keyed.join(shared, "key"), "members")
    # The sets of texts that share a band, made anew.
    wanted = members.select("node").distinct()
    ids = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.max("doc_id").alias("doc")).select("doc").distinct()
    texts = documents.join(ids, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("doc"), "left_semi")
    sets = scratch.write(_sets(texts, words, True).join(wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", "data"), "candidates")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        x, y = (sets.select(F.col("node").alias(k), F.col("data").alias(f"of_{k}")) for k in ("a", "b"))
        return scratch.write(map_arrow(pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b"), _alike, "a long, b long"), name)

    near = lambda: 5 * F.least("sa", "sb") >= 4 * F.greatest("sa", "sb")
    # First each member with its bucket's least one; then all pairs that this has not joined, so hot buckets are seldom quadratic.
    sizes = members.select(F.col("node").alias("least"), F.col("size").alias("sb")).distinct()
    stars = members.filter("node <> least").select("node", F.col("size").alias("sa"), "least").distinct().join(sizes, "least").filter(near())
    stars = scratch.write(stars.select(F.col("node").alias("a"), F.col("least").alias("b")), "stars")
    found = verified(stars, "alike").union(bits)
    ties = prints.filter(F.col("doc_id") != NULL_ID).groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("a")).filter("a <> b").select("doc_id", "b")
    ties = scratch.write(prints.select("doc_id", "node").join(ties, "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b"), "ties")
    roots = components(found.union(ties), scratch, "first")
    rooted = members.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key")
    rooted = scratch.write(rooted.join(split, "key", "left_semi"), "rooted")
    x, y = rooted.toDF("key", "a", "sa", "ra"), rooted.toDF("key", "b", "sb", "rb")
    rest = x.join(y, "key").filter((F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & near()).select("a", "b").distinct()
    more = verified(rest.join(stars, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        roots = components(found.union(ties).union(more), scratch, "second")
    of_node = prints.groupBy("node").agg(F.min(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))).alias("first"))
    of_node = of_node.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = of_node.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = of_node.join(named, "root").select("node", "component_id")
    real = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id")
    return scratch.write(prints.select("doc_id", "node").join(classes, "node").select(real, "component_id"), "copies")


def without_near_copies(documents: DataFrame, scratch: Scratch, words: int = 5) -> DataFrame:
    """The documents with all their columns, one (the smallest doc_id) of each component of ``near_copies``.

    Rows that repeat the doc_id that stays are one document: its first text stays. Rows with a null doc_id all stay.
    """
    classes = near_copies(documents, scratch, words)
    gone = classes.filter("doc_id <> component_id").select("doc_id").distinct()
    rows = documents.join(gone, "doc_id", "left_anti")
    turn = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text")
    again = classes.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id")
    if again.isEmpty():  # the usual case spares the texts a shuffle
        return rows.select(*documents.columns)
    return rows.withColumn("__turn", F.row_number().over(turn)).filter("__turn = 1 or doc_id is null").select(*documents.columns)
