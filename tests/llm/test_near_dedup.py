import random

from parley.llm import near_dedup

SCHEMA = "doc_id long, text string, key string, component_id int, _of int"


def shingles(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 100
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[: max(1, int(len(own) * rng.uniform(0.7, 1)))]
            rows.append((n, " ".join(own)))
            n += rng.randint(1, 3)
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a  B"), (6, "a b c d e"), (7, "A B C D E"), (8, "x " * 30_000), (9, "x " * 40_000), (10, "ünï cödé"), (11, "Ünï cödé")]
    assert found(spark, rows) == brute(rows)


def test_chain_and_large_group(spark):
    words = [f"w{i}" for i in range(100)]
    chain = [(i, " ".join(words[2 * i : 2 * i + 60])) for i in range(20)]
    copies = [(1000 + i, "one group of copies of the very same text " * 3) for i in range(400)]
    near = [(2000 + i, " ".join([f"n{k}" for k in range(80)] + [f"own{i}"])) for i in range(300)]
    rows = chain + copies + near
    got = found(spark, rows)
    assert {got[i][1] for i, _ in copies} == {1000}
    assert {got[i][1] for i, _ in near} == {2000}
    small = brute(chain)
    assert {i: got[i] for i, _ in chain} == small


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=str)
    assert near_dedup.near_duplicates(df.where("false")).count() == 0
    assert near_dedup.keep_one_per_group(df).count() == 3


def test_every_bin_is_filled():
    import numpy as np

    for n in (1, 2, 5, 1000):
        bins = near_dedup.sketch(near_dedup.mix64(np.arange(1, n + 1, dtype=np.uint64)))
        assert (bins != near_dedup._EMPTY).all()


def test_bins_agree_as_often_as_sets_do():
    import numpy as np

    every = near_dedup.mix64(np.arange(1, 1201, dtype=np.uint64))
    shares = []
    for i in range(40):
        own = near_dedup.mix64(every ^ np.uint64(i * 7919))
        shares.append((near_dedup.sketch(own[:1000]) == near_dedup.sketch(own[200:])).mean())
    assert abs(np.mean(shares) - 800 / 1200) < 0.02


def near_threshold(rng, n=60):
    """A group whose members share a core but lie on both sides of the threshold, with strays that form pairs of their own."""
    core = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(n):
        own = list(core)
        for k in range(rng.choice((4, 6, 7, 8, 10))):
            own[rng.randrange(200)] = f"{i // 2}x{k}"
        rows.append((10 * i + rng.randrange(5), " ".join(own)))
    return rows


def test_strays_of_large_buckets_match_brute_force(spark, monkeypatch):
    """Blocks far smaller than the buckets, and ids joined by a shuffle instead of a broadcast."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "SLICE", 9)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    rows = near_threshold(random.Random(6))
    want = brute(rows)
    assert len({c for _, c, _ in want.values()}) > 3
    assert found(spark, rows) == want


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    rows = near_threshold(random.Random(8), 30)
    assert found(spark, rows) == brute(rows)


def test_long_texts_that_are_no_words(spark):
    rows = [(1, "z" * 2_000_000), (2, "z" * 2_000_000), (3, "\n" * 1_000_000), (4, "a b c d e " * 100_000), (5, "a b c d e " * 120_000)]
    got = found(spark, rows)
    assert [got[i][1] for i in (1, 2, 3, 4, 5)] == [1, 1, 3, 4, 4]
