import collections
import math
import random

from pyspark.sql import functions as F

from parley.llm import mixing

SCHEMA = "doc_id long, source string, text string, size int, target string, block int"


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, "t", 2) for i, s, t in rows], SCHEMA)


def brute_targets(sizes):
    """Proportional shares of the total with caps, by the plain loop."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def sample(seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["b", "a", "Z", "é", None, "tiny"][: 5 if i % 50 else 6]), "w " * rng.randint(0, 60)) for i in range(1500)]
    return rows + [(5000, "solo", "one two"), (5001, None, None), (5002, "a", ""), (5003, "a", "x " * 40_000), (None, "a", "no id here"), (7, "b", "same id again")]


def test_targets_and_taken(spark):
    rows = sample()
    got = mixing.mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken <= 3 * r.size
        assert r.taken == sum(d["words"] for d in r.draws)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


def test_reruns_agree_whatever_the_partitions(spark):
    rows = sample(2)
    a = mixing.mix_sources(docs(spark, rows).repartition(1)).orderBy("doc_id", "size").drop("source").collect()
    b = mixing.mix_sources(docs(spark, rows[::-1]).repartition(7)).orderBy("doc_id", "size").drop("source").collect()
    assert [(r.doc_id, r.taken, sorted(r.draws)) for r in a] == [(r.doc_id, r.taken, sorted(r.draws)) for r in b]


def test_tree_keeps_every_block(spark):
    counts = [1000, 300, 0, 7, 1]
    rows = mixing.split_quotas(spark.createDataFrame([(counts,)], "counts array<long>"), 4).collect()
    assert sorted(r.shard for r in rows) == list(range(16))
    assert [sum(c) for c in zip(*(r.counts for r in rows), strict=True)][:5] == counts
    sizes = [sum(r.counts) for r in rows]
    assert max(sizes) - min(sizes) <= 1
    assert all(c >= 0 for r in rows for c in r.counts)


def test_draws_follow_the_hypergeometric_distribution(spark):
    total, good, draws, n = 60, 25, 20, 4000
    rows = spark.range(n).select(F.lit(total).cast("long").alias("total"), F.lit(good).cast("long").alias("good"), F.lit(draws).cast("long").alias("draws"), ((F.col("id") + 0.5) / n).alias("u"))
    seen = collections.Counter(r.drawn for r in mixing.hypergeometric(rows).collect())
    for k in range(0, 21):
        p = math.comb(good, k) * math.comb(total - good, draws - k) / math.comb(total, draws) if draws - k <= total - good else 0
        assert abs(seen[k] / n - p) < 2 / n + 1e-9
    edge = spark.createDataFrame([(0, 0, 0, 0.5), (5, 5, 3, 0.9), (5, 0, 3, 0.9), (5, 2, 5, 0.1), (5, 2, 0, 0.1), (10**6, 5 * 10**5, 5 * 10**5, 0.5)], "total long, good long, draws long, u double")
    assert [r.drawn for r in mixing.hypergeometric(edge).collect()][:5] == [0, 3, 0, 2, 0]


def test_shards_and_places(spark):
    mix = mixing.mix_sources(docs(spark, sample(3)))
    rows = mixing.mixed_rows(mix)
    assert rows.agg(F.sum("words")).first()[0] == mix.agg(F.sum("taken")).first()[0]
    assert rows.select("shard").distinct().count() > 32


def test_no_rows_and_no_words(spark):
    assert mixing.mix_sources(docs(spark, [(1, "a", "x")]).where("false")).count() == 0
    got = mixing.mix_sources(docs(spark, [(1, "a", ""), (2, None, None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
