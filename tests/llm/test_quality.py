import zlib

import numpy as np
import pytest

from parley.llm import quality


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(tables):
    docs, labels = tables
    scores = quality.quality_scores(docs, labels).toPandas()
    assert len(scores) == docs.count()
    assert scores.score.between(0, 1).all()
    assert ((scores.score >= 0.3).astype(int) == scores.predicted).all()
    assert (scores.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scores.doc_id]).all()
    both = scores[scores.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = both.score[both.quality == 1].to_numpy(), both.score[both.quality == 0].to_numpy()
    assert len(good) > 20 and len(bad) > 2
    assert (good[:, None] > bad[None, :]).mean() > 0.85


def test_held_out_labels_are_not_used(spark, tables):
    from pyspark.sql import functions as F

    docs, labels = tables
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.quality_scores(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(a.score, b.score, atol=1e-9)


def test_odd_rows(spark):
    rows = [(i, f"plain words of document {i} and more of them" if i % 2 else "### $$$ %%%" * 5, "s") for i in range(60)] + [(None, "no id", "s"), (100, None, "s"), (101, "", "s"), (102, "w " * 100_000, "s"), (3, "repeated", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, 0, 5) for i in range(60)] + [(None, 1, 0, 5), (7, None, 0, 5), (8, 4, 0, 5)], "doc_id long, quality int, toxic int, label int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    none = quality.quality_scores(docs, labels.where("false")).select("score").distinct().count()
    assert none == 1
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def test_pooled_features_by_plain_loops():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32)
    texts = [None, b"", b"  ", b"one", b"one, two! two two three", "ünï cödé à la".encode() * 3, b"x " * 5000]
    got = quality.pooled(texts, vectors, quality.WordHashes(3))
    for text, x in zip(texts, got, strict=True):
        rows = [quality.WordHashes(3)[t] % quality.BUCKETS for t in quality.tokens_of(text)]
        want = np.zeros(quality.FEATURES)
        if rows:
            v = vectors[rows].astype(float)
            want[: quality.DIMS], want[quality.DIMS : 2 * quality.DIMS] = v.mean(0), v.std(0)
            if len(rows) > 1:
                want[-2] = np.mean([v[i] @ v[i + 1] for i in range(len(v) - 1)])
                want[-1] = np.mean([a == b for a, b in zip(rows, rows[1:], strict=False)])
        assert np.allclose(x, want, atol=1e-3)


def test_word_vectors_by_plain_loops(spark):
    texts = [f"a{i % 5} b{i % 3}, c a{i % 2}" for i in range(40)] + ["alone", None, ""]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    at, sign = quality.index_table()
    table, hashes = np.zeros((quality.BUCKETS, quality.DIMS)), quality.WordHashes(3)
    for t in texts:
        rows = [hashes[w] % quality.BUCKETS for w in quality.tokens_of((t or "").encode())]
        for i, own in enumerate(rows):
            for other in rows[max(0, i - 1) : i] + rows[i + 1 : i + 2]:
                for k in range(quality.ENTRIES):
                    table[own, at[other, k]] += sign[other, k]
    assert np.allclose(got, table / np.maximum(1, np.linalg.norm(table, axis=1, keepdims=True)), atol=1e-5)


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, quality.FEATURES))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    net = quality.fit(x, y)
    held = np.arange(600) % quality.CALIBRATE == quality.CALIBRATE - 1
    loss = {t: -np.mean(np.log(np.where(y[held] == 1, p, 1 - p))) for t in np.exp(np.linspace(np.log(0.25), np.log(8), 61)) for p in [1 / (1 + np.exp(-net.logits(x[held]) / t))]}
    assert np.isclose(net.temperature, min(loss, key=loss.get))


def test_the_least_of_clashing_labels_counts(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "### !!! ") * (3 + i % 4)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    twice = labels.union(spark.createDataFrame([(i, 1) for i in range(0, 200, 3)], labels.schema))
    a, b = (quality.quality_scores(docs, x.repartition(n)).orderBy("doc_id").toPandas() for x, n in ((labels, 1), (twice, 5)))
    assert np.allclose(a.score, b.score, atol=1e-6)
