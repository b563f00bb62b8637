"""Operators of llm against brute force on small fixtures, with nulls, empty and repeated rows, ties and clashing column names."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from citegraph.llm import attention_mil, curriculum, imatch, line_dedup, packing, prefix_forest, simhash, substring_dedup, toxicity, url_reputation
from citegraph.llm.common import Scratch, TermHash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, k string, part string"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), None if t is None else len(t), 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=40):
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = ["\n".join(words(rng, int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 5)))) for _ in range(40)]
    near = [b + " extra" for b in base[:6]]
    long_ = words(rng, 5_000, 3_000)
    return [*base, None, "", "   \n\t", *near, base[0], base[0], long_, long_ + " more", "é ü " * 30]


def line_oracle(texts):
    lines = [(i, n, line) for i, t in enumerate(texts) for n, line in enumerate((t or "").split("\n"))]
    sets = [(i, n, set(line.encode().split())) for i, n, line in lines]
    gone = set()
    for (i, n, x), (j, m, y) in itertools.combinations(sets, 2):
        if x and y and 9 * len(x & y) >= 4 * (len(x) + len(y)):
            gone.add((j, m))
    return {i: "\n".join(line for n, line in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("long_", "hot"), [(1_000, 500_000), (2, 500_000), (1_000, 5), (2, 5)])
def test_line_dedup_is_brute_force(spark, texts, monkeypatch, long_, hot):
    monkeypatch.setattr(line_dedup, "LONG", long_)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = np.random.default_rng(8)
    swarm = words(rng, 40, 400)
    texts = [*texts[:43], *[swarm.replace(f"w{k} ", "", 1) for k in range(60)], swarm]
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts), Scratch(spark, "t")).collect()}
    assert found == line_oracle(texts)


def test_similar_sizes_share_a_band_or_lie_in_neighbouring_ones():
    sizes = np.arange(1, 3_000)
    band = np.searchsorted(line_dedup.BANDS, sizes, side="right")
    assert all(band[min(5 * s // 4, 2_999) - 1] - band[s - 1] <= 1 for s in sizes.tolist())


def test_swarms_and_large_sets_offer_few_pairs():
    """Near copies give each class a few pairs a list, not all; sets of many words that share a few of them hardly any."""
    rng = np.random.default_rng(9)
    base = [f"s{k}" for k in range(100)]
    swarm = [" ".join(base[:k] + base[k + 1 :]) for k in range(100)]
    large = [" ".join(f"w{k}" for k in rng.choice(2_000, 200, replace=False)) for _ in range(200)]

    def offered(texts):
        pa, ranks = line_dedup.pa, type("Held", (), {"value": line_dedup.Ranks(np.zeros(0, np.uint64), np.zeros(0, np.int64))})
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["id", "tie", "text"])
        (sets,) = line_dedup._token_rows(ranks)([batch])
        names = ("k", "id", "size", "s1", "s2", "rare", "tokens")
        rows = line_dedup._prefix_rows(pa.RecordBatch.from_arrays([sets[n] for n in names], names=list(names)))
        order = np.lexsort((rows["at"], rows["token"]))
        rows = {n: v[order] for n, v in rows.items()} | {"size": rows["at"][order] >> 32, "place": rows["at"][order] & 0xFFFFFFFF}
        found = [r for t in line_dedup._candidates([rows], set()) for r in pa.table(t).to_pylist()]
        return rows, [(r["a"], r["b"]) for r in found if r["b"] is not None], [r["k"] for r in found if r["b"] is None]

    rows, pairs, again = offered(swarm)
    assert 0 < len(pairs) <= 2 * len(rows["token"]) and set(itertools.chain(*pairs)) | set(again) <= set(rows["k"].tolist())
    assert 0 < len(again) <= len(rows["token"])
    assert len(set(offered(large)[1])) < 0.01 * 200 * 199 / 2


def test_sets_that_share_a_key_are_classes_of_their_own():
    """Rows of (k, k2) in order, cut into batches at every place."""
    pairs = [(16, 1), (16, 1), (16, 2), (16, 3), (16, 3), (32, 1), (32, 1), (48, 5)]
    expected = [(16, True), (16, False), (17, True), (18, True), (18, False), (32, True), (32, False), (48, True)]
    for cut in range(1, len(pairs)):
        batches = []
        for low, high in ((0, cut), (cut, len(pairs))):
            part = range(low, high)
            values = [[pairs[i][0] for i in part], [pairs[i][1] for i in part], [i for i in part], [0 for _ in part], [0 for _ in part], [3 for _ in part]]
            rest = [[0 for _ in part], [0 for _ in part], [0 for _ in part], [b"x" for _ in part], [0 for _ in part], [False for _ in part]]
            batches.append(line_dedup.pa.RecordBatch.from_arrays([line_dedup.pa.array(v) for v in values + rest], names=[*line_dedup._SET, "lone"]))
        found = [(k, size > 0) for out in line_dedup._classes(batches) for k, size in zip(out["k"].to_pylist(), out["size"].to_pylist())]
        assert found == expected


def test_words_are_told_apart_at_empty_texts():
    texts = ["a b", "", "", "b a\n\na", "", "x" * 5_000, "a", " ", "b"]
    hashes, lines, first = line_dedup.hashed_words(line_dedup.pa.array(texts))
    split = [(w, n) for t, start in zip(texts, first) for n, line in enumerate(t.split("\n"), start) for w in line.split()]
    assert lines.tolist() == [n for _, n in split] and first[-1] == sum(t.count("\n") + 1 for t in texts)
    known = {}
    assert all(known.setdefault(w, h) == h for (w, _), h in zip(split, hashes.tolist())) and len(set(known.values())) == len(known) == 3


def test_line_dedup_repeated_rows_and_empty_table(spark):
    docs = frame(spark, ["a b c d e", "a b c d e\nz"])
    twice = docs.union(docs.filter("doc_id = 0"))
    rows = line_dedup.dedup_lines(twice, Scratch(spark, "t")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [(0, "a b c d e"), (0, "a b c d e"), (1, "z")]
    assert line_dedup.dedup_lines(docs.limit(0), Scratch(spark, "t")).count() == 0
    kept = line_dedup.without_repeated_lines(docs, Scratch(spark, "t"))
    assert kept.columns == docs.columns and {r["text"]: r["n_chars"] for r in kept.collect()} == {"a b c d e": 9, "z": 1}


def substring_oracle(texts):
    first, out = {}, {}
    docs = [(i, (t or "").encode().split()) for i, t in enumerate(texts)]
    for i, w in docs:
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, w in docs:
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (i, s):
                gone.update(range(s, s + 20))
        out[i] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


@pytest.mark.parametrize("hot", [100_000, 1])
def test_substring_dedup_is_brute_force(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    repeats = ["a " * 60, "b c " * 40, "x " + "a " * 25]
    texts = [*texts, *repeats]
    rows = substring_dedup.dedup(frame(spark, texts), Scratch(spark, "t")).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == substring_oracle(texts)


def test_substring_index_grows_by_batches_and_compacts(spark, texts):
    scratch = Scratch(spark, "t")
    index = substring_dedup.FingerprintIndex(spark, f"{scratch.root}/index", fanout=2)
    docs = frame(spark, texts)
    for low in range(0, len(texts), 20):
        index.append(substring_dedup.keyed(docs.filter(f"doc_id >= {low} and doc_id < {low + 20}")), scratch)
    assert len(index.runs()) <= 2 and index.runs()[0][0] >= 1
    rows = substring_dedup.dedup(docs, scratch, index).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == substring_oracle(texts)
    same = docs.filter("doc_id = 3")
    kept = substring_dedup.dedup(same.union(same), Scratch(spark, "t")).collect()
    assert len(kept) == 2 and all(r["n_removed"] == 0 for r in kept)
    assert substring_dedup.dedup(docs.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("appended", [True, False])
def test_substring_second_batch_meets_history(spark, texts, appended):
    """A batch alone against an index of older documents, whose ids are larger: history wins."""
    scratch = Scratch(spark, "t")
    index = substring_dedup.FingerprintIndex(spark, f"{scratch.root}/index", fanout=2)
    rng = np.random.default_rng(4)
    passage, twice = words(rng, 30, 3_000), words(rng, 25, 3_000)
    batch = [*texts[40:], words(rng, 9, 3_000) + " " + passage + " tail", twice + " x " + twice, "all of it is new here " + words(rng, 40, 3_000)]
    history = [*texts[:40], texts[-3], "before " + passage]
    older = spark.createDataFrame([(1_000 + i, t) for i, t in enumerate(history)], "doc_id long, text string")
    for part in ("doc_id < 1020", "doc_id >= 1020"):
        index.append(substring_dedup.keyed(older.filter(part)), scratch)
    new = frame(spark, batch)
    if appended:
        index.append(substring_dedup.keyed(new), scratch)
    n = len(history)
    expected = {i - n: v for i, v in substring_oracle([*history, *batch]).items() if i >= n}
    rows = substring_dedup.dedup(new, scratch, index).collect()
    assert {r["id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows} == expected
    assert expected[len(batch) - 3][1] >= 30 and expected[len(batch) - 1][1] == 0


def test_substring_history_is_read_in_order(spark, texts):
    """A batch meets the runs before it in a merge join that neither shuffles nor sorts them."""
    plans = []

    class Spy(Scratch):
        def write(self, df, name, codec="zstd"):
            if name.startswith("known"):
                plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().write(df, name, codec)

    scratch = Spy(spark, "t")
    index = substring_dedup.FingerprintIndex(spark, f"{scratch.root}/index")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for part in ("doc_id < 20", "doc_id >= 20"):
            index.append(substring_dedup.keyed(frame(spark, texts).filter(part)), scratch)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plans[1] and "Sort [" not in plans[1] and "Exchange" not in plans[1]


def test_substring_hashes_are_of_whole_words():
    texts = ["one two\tthree", "", " ", "two", "x" * 5_000 + " é\u00a0ü\none", "longer-than-eight-bytes longer-than-eight-bytez"]
    low, high, counts = substring_dedup.hashed_texts(line_dedup.pa.array(texts), block=8)
    parts = [w for t in texts for w in t.encode().split()]
    assert counts.tolist() == [len(t.encode().split()) for t in texts]
    for hashes in (low.tolist(), high.tolist()):
        assert [hashes.index(h) for h in hashes] == [parts.index(w) for w in parts]
    assert not set(low.tolist()) & set(high.tolist())


def simhash_oracle(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) > n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_oracle(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(fps)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_simhash_is_brute_force(spark, texts):
    rows = sorted(simhash.near_duplicates(frame(spark, texts), Scratch(spark, "t")).collect())
    fps = [simhash_oracle(t) for t in texts]
    assert [r["fp"] % 2**64 for r in rows] == fps
    assert [r["component_id"] for r in rows] == components_oracle(fps)


def test_trie_links_span_every_component():
    rng = np.random.default_rng(1)
    for top in (63, 35):
        seeds = rng.integers(0, 2 ** (top + 1), 30, dtype=np.uint64)
        flips = [s ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for s in seeds for a, b in rng.integers(0, top + 1, (12, 2))]
        values = np.unique(np.concatenate([seeds, np.array(flips, np.uint64)]))
        forest = simhash._Forest(len(values))
        found = simhash.trie_links(values, 3, top)
        assert all((int(values[i]) ^ int(values[j])).bit_count() <= 3 for i, j in found)
        forest.join(*np.array(found).T)
        assert [forest.root(i) for i in range(len(values))] == components_oracle([int(v) for v in values])


def test_simhash_nulls_repeats_and_stage(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text), (2, text), (2, "quite other words stand in here today"), (None, text), (None, "nothing like it at all"), (5, "alone it stands here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(docs, Scratch(spark, "t")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in found) == [(-1, -1), (-1, 1), (1, 1), (2, 1), (2, 1), (5, 5)]
    kept = simhash.without_near_copies(docs, Scratch(spark, "t")).collect()
    assert sorted(r["doc_id"] or -1 for r in kept) == [-1, -1, 1, 5]
    assert simhash.near_duplicates(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_near_copies_link_by_fingerprints_too(spark):
    """Five-word fingerprints within three bits link, also where few of the shingles are shared: here a passage that both texts repeat."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{k}" for k in range(21))
    texts = [" ".join([passage] * 80 + [f"x{rng.integers(9_000)}" for _ in range(30)]) for _ in range(2)]
    texts += [" ".join(f"y{rng.integers(9_000)}" for _ in range(60)) for _ in range(3)]
    fps = [simhash_oracle(t, 5) for t in texts]
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    assert components_oracle(fps) == [0, 0, 2, 3, 4] and 5 * len(sets[0] & sets[1]) < 4 * len(sets[0] | sets[1])
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame(spark, texts), Scratch(spark, "t")).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}


def test_near_copies_are_brute_force(spark):
    """Texts re-wrapped and edited, a fifth of them too much: components of Jaccard 0.8 or more on five-word shingles."""
    rng = np.random.default_rng(6)
    texts = []
    for i in range(40):
        base = [f"v{k}" for k in rng.integers(0, 5_000, 300)]
        texts.append("\n".join(" ".join(base[k : k + 12]) for k in range(0, 300, 12)))
        for edits in (0, 2, 5, 14):
            copy = list(base)
            for at in rng.integers(0, 300, edits):
                copy[at] = f"e{rng.integers(5_000)}"
            texts.append("\n".join(" ".join(copy[k : k + 17]) for k in range(0, 300, 17)))
    texts += [None, "", " \n"]
    sets = [set(zip(*[(w := (t or "").split())[k:] for k in range(5)])) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    kept = simhash.without_near_copies(frame(spark, texts).repartition(4), Scratch(spark, "t"))
    assert {r["doc_id"] for r in kept.collect()} == set(label) and 41 < len(set(label)) < 100


def test_imatch_edits_and_likeness(spark, texts):
    rows = {r["doc_id"]: r for r in imatch.fingerprint_with_edits(frame(spark, texts), least=0.001, most=0.9, rows_each=7).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    same = [i for i, t in enumerate(texts) if t == texts[0]]
    assert len({rows[i]["fingerprint"] for i in same}) == 1
    assert imatch.fingerprint_with_edits(frame(spark, ["only one text"])).collect()[0]["near_next"] == 1.0
    assert imatch.fingerprint_with_edits(frame(spark, texts).limit(0)).count() == 0


def plain_fingerprint(text, lexicon):
    """The fingerprint in plain Python integers."""
    m = 2**64 - 1
    own = sorted(h for w in {w.encode() for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower())} if (h := xxhash.xxh64_intdigest(w)) in lexicon)
    if not own:
        return None
    out = []
    for i, rate in enumerate(r for r in (1, 3, 5, 7) for _ in range(12)):
        kept = []
        for h in own:
            x = h ^ ((i + 1) * 0x9E3779B97F4A7C15 & m)
            x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
            x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
            if (x ^ (x >> 31)) >> (64 - rate) == 0:
                kept.append(h)
        out.append(xxhash.xxh32_hexdigest(b"".join(h.to_bytes(8, "little") for h in kept)) if kept else None)
    return out


def plain_likeness(a, b, x, y):
    if x is None or y is None:
        return float(x is y and a == b)
    if x == y:
        return 1.0
    shares, every = [], []
    for rate in range(4):
        pairs = [(x[i], y[i]) for i in range(12 * rate, 12 * rate + 12) if x[i] or y[i]]
        every += pairs
        if len(pairs) >= 4:
            shares.append(sum(p == q for p, q in pairs) / len(pairs))
    return max(shares) if shares else sum(p == q for p, q in every) / max(1, len(every))


def test_imatch_is_brute_force(spark, texts):
    """Fingerprints and both likenesses, with repeated rows, a null doc_id and more ranges than the driver may hold."""
    texts = [*texts, "nothing of the lexicon here", "nothing of the lexicon here", "other lone words"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [set(re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())) for _, t in rows]
    times = pd.Series([w for own in known for w in own]).value_counts()
    lexicon = {xxhash.xxh64_intdigest(w.encode()) for w, n in times.items() if 3 <= n <= 0.5 * len(rows)}
    order = sorted((-1 if i is None else i, t or "") for i, t in rows)
    expected = []
    for at, (i, t) in enumerate(order):
        following = order[(at + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        prints = [plain_fingerprint(x, lexicon) for x in (t, edited, following)]
        expected.append((i, plain_likeness(t, edited, *prints[:2]), plain_likeness(t, following, prints[0], prints[2]), *prints[:2]))
    found = imatch.fingerprint_with_edits(docs, least=3 / len(rows), most=0.5, rows_each=5).collect()
    shown = lambda p: None if p[0] == "=" else [None if x == "-" else x for x in p.split(".")]
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["near_edited"], r["near_next"], shown(r["fingerprint"]), shown(r["edited_fingerprint"])) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert len({r["fingerprint"] for r in found if r["doc_id"] in (3,)}) == 1 and any(p is None for *_, p, _ in got)


def test_imatch_ranges_have_a_bound(spark, texts, monkeypatch):
    plain = {r["doc_id"]: r for r in imatch.fingerprint_with_edits(frame(spark, texts), least=0.001, most=0.9, rows_each=3).collect()}
    monkeypatch.setattr(imatch, "MOST_RANGES", 2)
    assert {r["doc_id"]: r for r in imatch.fingerprint_with_edits(frame(spark, texts), least=0.001, most=0.9, rows_each=3).collect()} == plain


def test_imatch_lexicon_counts_documents(spark, texts):
    found = set(imatch.lexicon(frame(spark, texts), 0.06, 0.5).terms.tolist())
    hashed, n = TermHash(), len(texts)
    counts = pd.Series(np.concatenate([imatch.terms(t, hashed) for t in texts])).value_counts()
    assert found == {k for k, v in counts.items() if max(0.06 * n, 2) <= v <= 0.5 * n}


def test_packing_round_trip(spark, texts):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    texts = [*texts, "an <|endoftext|> inside", "x" * 3_000, " " * 500]
    docs = frame(spark, texts, {i: None if i % 5 == 0 else f"s{i % 3}" for i in range(len(texts))})
    packed = packing.pack(docs, Scratch(spark, "t"), window=4_096).toPandas()
    exact = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = packed[packed.doc_id == i].sort_values("start")
        assert b"".join(pieces.ids) == np.array(ids, "<u4").tobytes()
        assert (pieces.start.tolist() == [0, *np.cumsum(pieces.length)[:-1]]) and set(pieces.doc_tokens) == {len(ids)}
        assert all(zlib.crc32(p) == c for p, c in zip(pieces.ids, pieces.ids_crc32))
    laid = packed.sort_values(["sequence_id", "offset"])
    place = laid.sequence_id * 1024 + laid.offset
    assert (place.tolist() == [0, *np.cumsum(laid.length)[:-1]]) and (laid.offset + laid.length <= 1024).all()


def test_packing_ids_are_those_of_tokenizers():
    """Random Unicode: any planes, controls, combining marks, blanks of all kinds, digits, quotes and special strings."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    exact, ours = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json")), packing.default_tokenizer()
    rng = np.random.default_rng(11)
    ranges = [(0, 0x80), (0x80, 0x250), (0x300, 0x370), (0x370, 0x600), (0x2000, 0x2070), (0x3040, 0x3100), (0x4E00, 0x9FFF), (0xAC00, 0xAD00), (0xE000, 0xE100), (0xFE00, 0x10000), (0x1F300, 0x1F700), (0xE0000, 0xE0100)]
    bits = ["<|endoftext|>", "<|endoftext", "'s", "'LL", " \n\n", "\t\t ", "\u00a0", "\r\n", "0123456", "\u200d", "e\u0301"]
    for _ in range(400):
        parts = []
        for _ in range(int(rng.integers(1, 30))):
            low, high = ranges[rng.integers(len(ranges))]
            parts.append("".join(map(chr, rng.integers(low, high, int(rng.integers(1, 8))))) if rng.random() < 0.7 else bits[rng.integers(len(bits))])
        text = "".join(parts)
        assert ours.encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids, ascii(text)


def test_packing_meets_given_targets(spark):
    """Every window holds the targets' shares while all queues last, deficits carried over; then what is left follows without gaps."""
    rng = np.random.default_rng(2)
    docs = frame(spark, [words(rng, int(rng.integers(20, 200))) for _ in range(90)], {i: ("big", "mid", None)[i % 3] for i in range(90)})
    packed = packing.pack(docs, Scratch(spark, "t"), window=512, targets={0: 5, 1: 2, 2: 1}).toPandas()
    total = packed.groupby("queue").length.sum()
    packed["at"] = packed.sequence_id * 1024 + packed.offset
    spots = np.concatenate([np.full(r.length, r.queue) for r in packed.sort_values("at").itertuples()])
    lasting = int(min(total[q] * 8 / w for q, w in ((0, 5), (1, 2), (2, 1)))) // 512
    assert lasting > 3 and len(spots) == total.sum()
    for w in range(1, lasting):
        counts = np.bincount(spots[: w * 512], minlength=3)
        assert (abs(counts - w * 512 * np.array([5, 2, 1]) / 8) <= 3).all()
    with pytest.raises(ValueError):
        packing.pack(docs, Scratch(spark, "t"), targets={0: 1})


def test_packing_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "one two", "a"), (1, "one two", "a"), (None, "three", None), (None, None, "a")], "doc_id long, text string, source string")
    packed = packing.pack(docs, Scratch(spark, "t")).toPandas()
    assert sorted(packed.doc_id.fillna(-1)) == [-1, -1, 1, 1] and packed.length.sum() == packed.doc_tokens.sum()


def test_packing_windows_hold_the_target_mix(spark):
    rng = np.random.default_rng(2)
    docs = frame(spark, [words(rng, int(rng.integers(20, 200))) for _ in range(90)], {i: "big" if i % 3 else "small" for i in range(90)})
    packed = packing.pack(docs, Scratch(spark, "t"), window=2_048).toPandas()
    total = packed.groupby("queue").length.sum()
    packed["at"] = packed.sequence_id * 1024 + packed.offset
    for w in range(1, int(packed.length.sum()) // 2_048):
        inside = packed[(packed["at"] + packed.length) <= w * 2_048 + 2].groupby("queue").length.sum()
        assert (abs(inside - w * 2_048 * total / total.sum()) <= 4).all()
    assert packing.pack(docs.limit(0), Scratch(spark, "t")).count() == 0


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_curriculum_targets_and_positions(spark, texts):
    sources = {i: [None, "a", "b", "c", "z"][min(i % 7, 4)] for i in range(len(texts))}
    docs = frame(spark, texts, sources)
    rows = curriculum.plan(docs, Scratch(spark, "t")).toPandas()
    size = {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    sizes = {s: sum(size[i] for i in size if sources[i] == s) for s in set(sources.values())}
    target = water(sizes)
    for r in rows.itertuples():
        source = None if pd.isna(r.source) else r.source
        assert r.size == size[r.doc_id] and r.source_size == sizes[source] and r.target == pytest.approx(target[source]) and 0 <= r.taken <= 3 * r.size
        assert pd.isna(r.position) or 0 <= r.position <= 1
    taken = rows.fillna({"source": "null"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(taken.taken - taken.target) < 1).all()
    again = curriculum.plan(docs.repartition(3), Scratch(spark, "t")).toPandas()
    pd.testing.assert_frame_equal(rows.sort_values("doc_id").reset_index(drop=True), again.sort_values("doc_id").reset_index(drop=True))
    mix = curriculum.mixed(docs, Scratch(spark, "t"))
    assert mix.columns == docs.columns and 0 < mix.count() <= 3 * len(texts)
    assert curriculum.plan(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_curriculum_reads_sources_round_and_round(spark, texts):
    """Copies, words and positions of every document by walking its source word by word, and the plan's order."""
    sources = {i: [None, "a", "b", "c", "z"][min(i % 7, 4)] for i in range(len(texts))}
    docs = frame(spark, texts, sources)
    docs = docs.union(docs.filter("doc_id = 3")).union(docs.filter("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))
    plan = curriculum.plan(docs, Scratch(spark, "t"))
    rows = curriculum.by_position(plan).toPandas()
    assert len(rows) == len(texts) + 2 and rows.position.fillna(-1.0).is_monotonic_increasing
    place = {r.source if isinstance(r.source, str) else None: r.place for r in rows.itertuples()}
    for source, turn in place.items():
        own = rows[rows.source.isna() if source is None else rows.source == source]
        key = lambda r: hashlib.md5((texts[9] if pd.isna(r.doc_id) else str(int(r.doc_id))).encode()).hexdigest()
        turned = sorted(own.itertuples(), key=key)
        demand, done, begun, taken = int(own.target.iloc[0]), 0, [[] for _ in turned], [0] * len(turned)
        while done < demand:
            for i, r in enumerate(turned):
                if r.size and done < demand:
                    begun[i].append(done)
                    taken[i] += min(r.size, demand - done)
                    done += r.size
        shape = curriculum.SHAPES[turn % 3]
        grid = np.linspace(0, 1, 20_001)
        weight = np.interp(grid, np.linspace(0, 1, len(shape)), shape)
        met = np.concatenate([[0], np.cumsum(weight[1:] + weight[:-1])]) / (weight[1:] + weight[:-1]).sum()
        for i, r in enumerate(turned):
            assert (r.copies, r.taken) == (len(begun[i]), taken[i])
            if begun[i]:
                at = [float(np.interp(b / r.target, met, grid)) for b in (begun[i][0], begun[i][-1])]
                assert [r.position, r.last_position] == pytest.approx(at, abs=1e-3)
            else:
                assert pd.isna(r.last_position) and pd.isna(r.position) == (r.size > 0)
            if r.size == 0:
                assert r.position == pytest.approx(float(np.interp(min(r.start / r.target, 1), met, grid)), abs=1e-3)


def test_curriculum_position_inverts_the_integral(spark):
    for place, shape in enumerate(curriculum.SHAPES):
        grid = np.linspace(0, 1, 20_001)
        weight = np.interp(grid, np.linspace(0, 1, len(shape)), shape)
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)]) / ((weight[1:] + weight[:-1]) / 2).sum()
        done = [0, 1, 130, 500, 777, 1000]
        rows = spark.createDataFrame([(d,) for d in done], "d long").select(curriculum.position(F.col("d"), F.lit(1000.0), F.lit(place)).alias("u")).collect()
        assert [r["u"] for r in rows] == pytest.approx([float(np.interp(d / 1000, demand, grid)) for d in done], abs=1e-4)


def test_prefix_forest_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((900, 24)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1020, [0.0] * 24, 1), (1040, [float("nan")] * 24, 1), (1060, [None] * 24, 1), (None, vectors[0].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int")
    found = prefix_forest.nearest(table, F.col("vec_id") % 20 == 0, 20, Scratch(spark, "t"), block=300).toPandas()
    exact = vectors.astype(float) @ vectors.astype(float).T
    hits = []
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        scores = exact[q].copy()
        scores[q] = -np.inf
        order = np.lexsort((np.arange(900), -scores))[:20]
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.tolist() == pytest.approx([exact[q, v] for v in own.vec_id], abs=1e-12)
        hits.append(np.isin(order, own.vec_id).mean())
    assert len(hits) == 45 and np.mean(hits) >= 0.9
    few = prefix_forest.nearest(table.filter("vec_id < 5"), F.col("vec_id") % 20 == 0, 20, Scratch(spark, "t")).toPandas()
    assert sorted(few.vec_id) == [1, 2, 3, 4]
    assert prefix_forest.nearest(table.limit(0), F.lit(True), 20, Scratch(spark, "t")).count() == 0


def test_url_reputation_rules_and_hosts(spark):
    rules = (url_reputation.Rule("org", "/", "allow"), url_reputation.Rule("example.org", "/es/", "block"), url_reputation.Rule("com", "/de/", "block"))
    urls = {1: "http://A.Example.ORG/es/1?x", 2: "https://org/", 3: "http://xorg/es/", 4: None, 5: "no scheme", 6: "http://h.com", 7: "ftp://b.com/de/#f", 8: "http://a.org:80/es/q"}
    urls |= {100 + i: f"http://bad.net/{i}" for i in range(60)} | {200 + i: f"http://good.net/{i + 100}" for i in range(60)}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 60)) for i in range(160)] + [(None, 1), (3, None)], "ref long, bad int")
    rows = {r["page_id"]: r for r in url_reputation.judge_urls(pages, outcomes, rules).collect()}
    assert len(rows) == len(urls)
    assert (rows[1]["host"], rows[1]["path"], rows[1]["rule"], rows[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert rows[2]["rule"] == "org/" and rows[3]["rule"] is None and rows[7]["verdict"] == "block"
    assert (rows[4]["host"], rows[4]["path"]) == ("", "") == (rows[5]["host"], rows[5]["path"])
    assert rows[6]["path"] == "" and rows[8]["host"] == "a.org:80" and rows[8]["rule"] is None
    assert rows[100]["verdict"] == "block" and rows[200]["verdict"] == "allow"
    assert url_reputation.judge_urls(pages.limit(0), outcomes.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_reputation.judge_urls(pages.filter("page_id > 99"), outcomes.limit(0), rules).collect()} == {"allow"}


def test_url_domains_and_suffixes(spark):
    hosts = {
        "a.b.example.com": ("example.com", "com"), "news.bbc.co.uk:80": ("bbc.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"), "[2001:db8::1]:80": ("[2001:db8::1]", "[2001:db8::1]"),
        "me@x.org": ("x.org", "org"), "localhost": ("localhost", "localhost"), "": ("", ""), "1.2.3.4.5": ("4.5", "5"),
    }
    domain, suffix = url_reputation.domain_and_suffix(F.col("host"))
    rows = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", domain.alias("d"), suffix.alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in rows} == hosts
    bare, last = url_reputation.domain_and_suffix(F.lit("news.bbc.co.uk"), ())
    assert tuple(spark.range(1).select(bare, last).head()) == ("co.uk", "uk")


def test_url_reputation_repeats_nulls_and_clashes(spark):
    """Repeated pages are judged each and count each; a null page_id and columns named as ours do no harm; written levels change nothing."""
    rows = [(i % 40, f"http://h{i % 40 % 3}.bad.co.uk/{i % 40}", "x", 1, "y") for i in range(80)] + [(None, "http://10.0.0.1/3", "x", 1, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, salt int, n string")
    outcomes = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "ref long, bad int")
    plain = sorted(map(tuple, url_reputation.judge_urls(pages, outcomes, ()).collect()), key=repr)
    written = sorted(map(tuple, url_reputation.judge_urls(pages, outcomes, (), scratch=Scratch(spark, "t")).collect()), key=repr)
    assert plain == written and len(plain) == 81 and {r[1] for r in plain} == {"h0.bad.co.uk", "h1.bad.co.uk", "h2.bad.co.uk", "10.0.0.1"}
    rate = {r[1]: r[5] for r in plain}
    assert rate["h0.bad.co.uk"] > rate["h1.bad.co.uk"]


@pytest.fixture(scope="module")
def graded(spark):
    rng = np.random.default_rng(9)
    texts, toxic, quality = [], [], []
    for i in range(300):
        bad, junk = i % 4 == 0, i % 5 == 0
        body = words(rng, int(rng.integers(20, 120)), 500)
        body = " ".join(w.upper() + "!!" for w in body.split()) if junk else body
        texts.append(body + (" you awfulness scumbag" if bad else "") + (" scumbagger" if bad and i % 8 == 0 else ""))
        toxic.append(int(bad))
        quality.append(int(not junk))
    labels = spark.createDataFrame([(i, t, q) for i, (t, q) in enumerate(zip(toxic, quality))] + [(None, 1, 1), (7, None, None)], "doc_id long, toxic int, quality int")
    return frame(spark, [*texts, None, ""]), labels, toxic, quality


def test_toxicity_held_out(spark, graded):
    docs, labels, toxic, _ = graded
    model = toxicity.fit(docs, labels.filter("doc_id < 200 or doc_id is null"), Scratch(spark, "t"))
    assert model.thresholds[0] < model.thresholds[1]
    rows = {r["doc_id"]: r["severity"] for r in toxicity.severities(docs, model).collect()}
    assert len(rows) == 302 and all(0 <= s <= 2 for s in rows.values())
    assert all((rows[i] >= toxicity.LIMIT) == bool(toxic[i]) for i in range(200, 300))
    assert rows[300] == rows[301] < toxicity.LIMIT
    kept = toxicity.without_toxic(docs, labels, Scratch(spark, "t"))
    assert kept.columns == docs.columns and kept.count() == 302 - sum(toxic)
    assert toxicity.without_toxic(docs, labels.limit(0), Scratch(spark, "t")).count() == 302
    assert toxicity.severities(docs.limit(0), model).count() == 0


def test_toxicity_severity_is_the_plain_sum(spark, graded):
    """Features and expected severity by the book, word by word."""
    docs, labels, *_ = graded
    model = toxicity.fit(docs, labels, Scratch(spark, "t"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    for r in toxicity.severities(docs, model).collect()[::7]:
        text = docs.filter(F.col("doc_id") == r["doc_id"]).head()["text"]
        score = 0.0
        for word in set(re.findall(r"[^\W\d_]+", (text or "").lower())):
            named = ["=" + word] + ["<" + word[:n] for n in (4, 5, 6) if len(word) >= n] + [">" + word[-n:] for n in (4, 5) if len(word) >= n]
            score += sum(weight.get(xxhash.xxh64_intdigest(x), 0.0) for x in set(named))
        assert r["severity"] == pytest.approx(sum(1 / (1 + np.exp(t - score)) for t in model.thresholds))


def test_toxicity_keeps_every_marked_feature(spark):
    """Thousands of marked words, all kept; a repeated doc_id with two texts gives the same model whatever the order of rows."""
    rng = np.random.default_rng(3)
    bad = [" ".join(f"{''.join(map(chr, rng.integers(97, 123, 9)))}" for _ in range(1_200)) for _ in range(2)]
    rows = [(i, bad[i % 2] if i < 8 else words(rng, 30), 1) for i in range(40)] + [(0, "aaa another text", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, Scratch(spark, "t"))
    assert len(model.features) > 10_000
    again = toxicity.fit(docs.orderBy(F.col("doc_id").desc(), "text").repartition(3), labels, Scratch(spark, "t"))
    assert np.array_equal(model.features, again.features) and np.allclose(model.weights, again.weights)
    twice = toxicity.without_toxic(docs.union(docs), labels, Scratch(spark, "t"))
    assert twice.columns == docs.columns and twice.count() == 2 * 33


def test_ordinal_fit_orders_three_grades():
    grades = np.repeat([0, 1, 2], 50)
    rows = np.arange(150)
    weights, cuts = toxicity.fit_ordinal(rows, np.zeros(150, np.int64), grades.astype(float) + 1, grades, 1)
    assert weights[0] > 0 and cuts[0] < cuts[1]
    severity = toxicity.OrdinalModel(np.zeros(0, np.uint64), weights, cuts).severity(weights[0] * np.array([1.0, 2.0, 3.0]))
    assert severity[0] < 0.6 < severity[1] < 1.5 < severity[2]


def test_attention_mil_held_out(spark, graded):
    docs, labels, _, quality = graded
    model = attention_mil.fit(docs, labels.filter("doc_id < 200 or doc_id is null"), Scratch(spark, "t"))
    rows = {r["doc_id"]: r["score"] for r in attention_mil.scores(docs, model).collect()}
    assert len(rows) == 302 and all(0 <= s <= 1 for s in rows.values()) and rows[300] == rows[301]
    assert np.mean([(rows[i] >= 0.3) == bool(quality[i]) for i in range(200, 300)]) > 0.95
    assert {r["score"] for r in attention_mil.scores(docs, attention_mil.fit(docs, labels.limit(0), Scratch(spark, "t"))).collect()} == {0.5}


def test_attention_score_is_the_plain_forward_pass(spark, graded):
    """Passages, gates, attention and probability written out one by one; long, empty and repeated rows."""
    docs, labels, *_ = graded
    model = attention_mil.fit(docs, labels, Scratch(spark, "t"))
    w = model.weights
    rows = [(1, "plain words stand here"), (1, "plain words stand here"), (2, "Loud!! " * 5_000), (3, None), (None, "x" * 200_000), (4, " ")]
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    expected = []
    for i, text in rows:
        bag = (attention_mil.passage_features((text or "").encode(), TermHash()) - model.mean) / model.scale
        encoded = [np.tanh(x @ w["W"] + w["b"]) for x in bag]
        weight = np.exp([(np.tanh(h @ w["V"]) * sigmoid(h @ w["U"])) @ w["u"] for h in encoded])
        z = sum(a * h for a, h in zip(weight / weight.sum(), encoded))
        expected.append((-1 if i is None else i, sigmoid(z @ w["c"] + w["d"][0])))
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in attention_mil.scores(more, model).collect())
    assert [i for i, _ in found] == [i for i, _ in sorted(expected)] and [s for _, s in found] == pytest.approx([s for _, s in sorted(expected)], abs=1e-6)
    assert attention_mil.scores(docs.limit(0), model).count() == 0


def test_attention_trains_on_all_passages(spark, monkeypatch):
    """Bags of long documents arrive whole, in any size of the parts that a step holds."""
    rng = np.random.default_rng(3)
    long_ = [words(rng, 64 * n, 500) for n in (90, 40, 1, 7)]
    docs = frame(spark, long_)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    seen, real = [], attention_mil.train
    monkeypatch.setattr(attention_mil, "train", lambda bags, marks: seen.append([np.array(b) for b in bags]) or real(bags, marks, epochs=3))
    whole = attention_mil.fit(docs, labels, Scratch(spark, "t"))
    assert all(np.array_equal(b, attention_mil.passage_features(t.encode(), TermHash())) for b, t in zip(seen[0], long_, strict=True))
    monkeypatch.setattr(attention_mil, "PART", 50)
    parts = attention_mil.fit(docs, labels, Scratch(spark, "t"))
    assert all(np.allclose(whole.weights[k], parts.weights[k]) for k in whole.weights)


def test_attention_gradient_is_right():
    """One step of training moves the loss as the written-out gradient says."""
    rng = np.random.default_rng(0)
    bags = [rng.standard_normal((int(rng.integers(1, 5)), attention_mil.WIDTH)).astype(np.float32) for _ in range(40)]
    labels = np.array([float(b[:, 0].max() > 0.5) for b in bags])
    loss = lambda m: -np.mean(labels * np.log(m.score(bags) + 1e-9) + (1 - labels) * np.log(1 - m.score(bags) + 1e-9))
    assert loss(attention_mil.train(bags, labels, epochs=30)) < 0.5 * loss(attention_mil.train(bags, labels, epochs=1))
