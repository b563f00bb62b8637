"""The pipeline's stages against a brute-force version of each, every stage on what the one before it kept."""

import numpy as np
import pytest

import corpus_pipeline
from citegraph.llm import curriculum, toxicity
from citegraph.llm.common import Scratch
from tests.llm.test_operators import components_oracle, line_oracle, simhash_oracle, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    path = str(tmp_path_factory.mktemp("sf"))
    clean = ["\n".join(words(rng, int(rng.integers(8, 40)), 2_000) for _ in range(3)) for _ in range(60)]
    toxic = [words(rng, 60, 2_000) + " you awfulness scumbag" for _ in range(30)]
    texts = [*clean, *toxic, clean[0], clean[1] + "\n" + words(rng, 12, 2_000), None, "", clean[2].replace("\n", " \n")]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(60 <= i < 90)) for i in range(0, 90, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path, texts


def test_every_stage(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, scratch, kept = docs.columns, Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, path), name.replace(" ", "_"))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    clean = {r["doc_id"]: r["text"] for r in kept["toxicity"].collect()}
    assert set(clean) == {i for i in range(len(texts)) if not 60 <= i < 90} and all(clean[i] == texts[i] for i in clean)
    order = sorted(clean)
    stripped = {r["doc_id"]: r["text"] or "" for r in kept["line dedup"].collect()}
    assert stripped == {order[i]: t for i, t in line_oracle([clean[i] for i in order]).items()}
    labels = components_oracle([simhash_oracle(stripped[i], 5) for i in order])
    single = {r["doc_id"] for r in kept["near copies"].collect()}
    assert single == {order[i] for i in set(labels)}
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in curriculum.plan(kept["near copies"], Scratch(spark, "t")).collect()}
    copies = {r["doc_id"]: r["count"] for r in kept["mixing"].groupBy("doc_id").count().collect()}
    assert copies == {i: n for i, (size, t) in taken.items() if (n := 1 if size == 0 else int(t / size + 0.5))}
    packed = kept["packing"].toPandas()
    whole = packed.groupby("doc_id").agg(length=("length", "sum"), one=("doc_tokens", "first"))
    assert all(r.length == r.one * copies[i] for i, r in whole.iterrows()) and set(whole.index) == set(copies)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) == sorted(tuple(r) for r in kept["packing"].collect())


def test_clean_documents_stay(spark, folder):
    path, _ = folder
    model = toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"), Scratch(spark, "t"))
    fresh = spark.createDataFrame([(1, "quite ordinary words"), (2, "an awfulness of a scumbag"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["severity"] >= toxicity.LIMIT for r in toxicity.severities(fresh, model).collect()} == {1: False, 2: True, 3: False}


def test_packing_follows_the_training_positions(spark, tmp_path):
    """Files grow, so that Spark deals the last ones first."""
    rng = np.random.default_rng(7)
    rows = [(i, words(rng, 20 + 3 * i, 2_000), f"s{i % 3}") for i in range(240)]
    for part in range(8):
        path = f"{tmp_path}/part-{part:05d}.parquet"
        spark.createDataFrame(rows[30 * part : 30 * part + 30], "doc_id long, text string, source string").toPandas().to_parquet(path)
    packed = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path)), "").toPandas()
    packed["at"] = packed.sequence_id * 1024 + packed.offset
    for _, own in packed.groupby("queue"):
        assert own.sort_values("at").doc_id.drop_duplicates().tolist() == sorted(set(own.doc_id))
    assert packed.doc_id.nunique() == 240


def test_mix_is_written_by_training_position(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    corpus_pipeline.mix(spark, docs, "").write.parquet(f"{tmp_path}/mix")
    packed = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/mix"), "").toPandas()
    packed["at"] = packed.sequence_id * 1024 + packed.offset
    first = packed[packed.start == 0].sort_values("at").drop_duplicates("doc_id")
    at = {r["doc_id"]: r["position"] or 0.0 for r in curriculum.plan(docs, Scratch(spark, "t")).collect()}
    for _, own in first.groupby("queue"):
        places = [at[i] for i in own.doc_id]
        assert places == sorted(places)
