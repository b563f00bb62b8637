"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded: features e -> h = tanh(W e + b). Gated attention
a = softmax(u . (tanh(V h) * sigmoid(U h))) weighs the passages, and the document's probability is
sigmoid(c . sum(a h) + d). All weights are learned together from document labels alone.

Features of a passage: shares of byte classes (letters by case, digits, blanks, each ASCII sign, four ranges of other bytes), equal
neighbouring bytes and words, distinct words, word lengths, and how far the passage's words recur in the whole text. No
language, source or id goes in. Every passage of every text is scored; training takes at most ``SAMPLE`` labelled
documents of each class (by hash of doc_id), all passages of each. Their features lie in a file of the driver, read by batches.

Defined cases: null and empty texts are one empty passage. Null labels are ignored; a doc_id with several labels counts by the
largest. Without labels of both classes every score is the share of label 1 (0.5 without any). Repeated rows are scored each.
A null doc_id is scored and never trained on. Extra columns are ignored.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import Scratch, TermHash, map_arrow

PASSAGE = 64
SAMPLE = 4_000
#: Passages that a step of training holds at once, but for a longer document.
PART = 20_000
HIDDEN, GATE = 24, 12

_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[32] = 4
for _b in b"\t\n\x0b\x0c\r":
    _CLASS[_b] = 5
for _i, _b in enumerate(_SIGNS):
    _CLASS[_b] = 6 + _i
_HIGH = 6 + len(_SIGNS)
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = _HIGH, _HIGH + 1, _HIGH + 2, _HIGH + 3
CLASSES = _HIGH + 4
WIDTH = CLASSES + 8
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def passage_features(text: bytes, hashed: TermHash) -> np.ndarray:
    """(passages, WIDTH) features of a whole text."""
    words = text.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    data = np.frombuffer(text, np.uint8)
    solid = ~BLANK[data]
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    count = -(-len(words) // PASSAGE)
    edge = np.append(begins[::PASSAGE], len(data))
    edge[0] = 0
    place = np.repeat(np.arange(count), np.diff(edge))
    size = np.diff(edge).astype(float)
    shares = np.bincount(place * CLASSES + _CLASS[data], minlength=count * CLASSES).reshape(count, CLASSES) / size[:, None]
    h = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    lengths = np.fromiter(map(len, words), float, len(words))
    of = np.arange(len(words)) // PASSAGE
    n = np.bincount(of).astype(float)
    _, code, times = np.unique(h, return_inverse=True, return_counts=True)
    pairs = np.unique(of * len(times) + code)
    distinct = np.bincount(pairs // len(times), minlength=count)
    twin = np.concatenate([[0.0], (h[1:] == h[:-1])])
    runs = np.concatenate([[0.0], data[1:] == data[:-1]])
    mean = np.bincount(of, lengths) / n
    extra = np.stack(
        [
            distinct / n,
            np.bincount(of, twin, count) / n,
            np.bincount(place, runs, count) / size,
            mean / 10,
            np.sqrt(np.maximum(np.bincount(of, lengths**2) / n - mean**2, 0)) / 10,
            np.bincount(of, np.log1p(times[code]), count) / n / np.log1p(len(words)),
            np.log1p(n) / np.log1p(PASSAGE),
            np.full(count, len(times) / len(words)),
        ],
        axis=1,
    )
    return np.concatenate([shares, extra], axis=1).astype(np.float32)


@dataclass
class AttentionModel:
    """weights: name -> array; without weights the model gives ``base`` for every text."""

    base: float = 0.5
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH))
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, x: np.ndarray, bag: np.ndarray, starts: np.ndarray):
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -40, 40)))
        e = (t * s) @ w["u"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"][0], -40, 40)))
        return h, t, s, a, z, p

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each bag of passage features."""
        if not self.weights or not bags:
            return np.full(len(bags), self.base)
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        x = (np.concatenate(bags) - self.mean) / self.scale
        return self.forward(x, np.repeat(np.arange(len(bags)), sizes), np.cumsum(sizes) - sizes)[-1]


def _parts(own: np.ndarray, bags: list[np.ndarray]) -> list[np.ndarray]:
    """A batch in parts of about PART passages; a longer document is not cut."""
    place = np.cumsum([len(bags[j]) for j in own]) // PART
    return np.split(own, np.flatnonzero(place[1:] != place[:-1]) + 1)


def _gradient(model: AttentionModel, part: list[np.ndarray], labels: np.ndarray, batch: int) -> dict[str, np.ndarray]:
    """What some bags add to the gradient of a batch's mean loss."""
    w = model.weights
    sizes = np.fromiter(map(len, part), np.int64, len(part))
    x = (np.concatenate(part) - model.mean) / model.scale
    bag, starts = np.repeat(np.arange(len(part)), sizes), np.cumsum(sizes) - sizes
    h, t, s, a, z, p = model.forward(x, bag, starts)
    dz_out = (p - labels) / batch
    g = {"c": z.T @ dz_out, "d": np.array([dz_out.sum()])}
    dz = dz_out[:, None] * w["c"][None]
    dh = a[:, None] * dz[bag]
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    g["u"] = (t * s).T @ de
    dt, ds = de[:, None] * w["u"][None] * s * (1 - t * t), de[:, None] * w["u"][None] * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (dh + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(axis=0)
    return g


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 3, epochs: int = 40, batch: int = 64) -> AttentionModel:
    """Adam on the log loss; gradients written out. Bags keep their order, so reruns agree."""
    base = float(labels.mean()) if len(labels) else 0.5
    model = AttentionModel(base)
    if len(labels) == 0 or labels.min() == labels.max():
        return model
    total = sum(map(len, bags))
    model.mean = sum(b.sum(axis=0, dtype=float) for b in bags) / total
    model.scale = np.sqrt(sum(((b - model.mean) ** 2).sum(axis=0) for b in bags) / total) + 0.02
    rng = np.random.default_rng(seed)
    shape = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "u": (GATE,), "c": (HIDDEN,), "d": (1,)}
    model.weights = {k: rng.normal(0, 0 if k in "bd" else 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
    model.weights["d"][0] = np.log(base / (1 - base))
    m = {k: np.zeros(s) for k, s in shape.items()}
    v = {k: np.zeros(s) for k, s in shape.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            w = model.weights
            g = {k: np.zeros(s) for k, s in shape.items()}
            for some in _parts(own, bags):
                for k, part in _gradient(model, [bags[j] for j in some], labels[some], len(own)).items():
                    g[k] += part
            step += 1
            for k in w:
                grad = g[k] + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(documents: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> AttentionModel:
    """documents(doc_id, text), labels(doc_id, quality 0/1) -> model; at most ``sample`` documents of each label."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ones, zeros = (marks.filter(F.col("quality") == q).orderBy(*order).limit(sample) for q in (1, 0))
    chosen = scratch.write(ones.union(zeros).select(F.col("doc_id").alias("doc"), "quality"), "chosen")
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("doc")).select("doc", "quality", F.col("text").cast("string"))

    def encode(batches):
        hashed = TermHash()
        for batch in batches:
            out = {"doc": [], "quality": [], "bag": []}
            for doc, quality, text in zip(*(c.to_pylist() for c in batch.columns)):
                bag = passage_features((text or "").encode(), hashed)
                out["doc"].append(doc)
                out["quality"].append(quality)
                out["bag"].append(bag.tobytes())
            yield out

    # At most 2 * sample bags, one at a time to the file.
    found = scratch.write(map_arrow(texts, encode, "doc long, quality int, bag binary"), "bags")
    with tempfile.TemporaryFile() as file:
        marks_, sizes = [], []
        for row in found.orderBy("doc", "bag").toLocalIterator():
            file.write(row["bag"])
            marks_.append(row["quality"])
            sizes.append(len(row["bag"]) // (4 * WIDTH))
        file.flush()
        every = np.memmap(file, np.float32, "r", shape=(sum(sizes), WIDTH)) if sizes else np.zeros((0, WIDTH), np.float32)
        bags = np.split(every, np.cumsum(sizes)[:-1]) if sizes else []
        return train(bags, np.array(marks_, float))


def scores(documents: DataFrame, model: AttentionModel) -> DataFrame:
    """documents(doc_id, text) -> doc_id, score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hashed = TermHash()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            done = []
            for i in range(0, len(texts), 256):
                done.append(shared.value.score([passage_features(t.as_py() or b"", hashed) for t in texts[i : i + 256]]))
            yield {"doc_id": batch.column(0), "score": pa.array(np.concatenate(done))}

    return map_arrow(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")
