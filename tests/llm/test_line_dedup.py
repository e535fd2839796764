import numpy as np

from parley.llm import line_dedup

LONG = "this line is long enough to count"


def brute(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(d) for k, d in holders.items() if len(d) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, 9, "m", 1) for i, t in rows], "doc_id long, text string, n_lines long, row string, kept int")
    out = line_dedup.drop_repeated_lines(df)
    assert out.columns == ["kept_text", "n_lines", "n_dropped", "doc_id", "text", "row", "kept"]
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    rows = [(i, f"own line number {i} of some length\n  {LONG.upper() if i % 2 else LONG}\t\nshort\nshort\n{LONG} {i // 3}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, LONG + "\n" + LONG), (103, LONG), (None, LONG), (104, "é" * 19), (105, "é" * 20), (106, "é" * 20), (107, "É" * 20 + "\n" + "é" * 20), (108, "a\x85" + LONG), (109, "x" * 500_000)]
    assert found(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert found(spark, [(1, "a")][:0] or [(1, "a")]) == brute([(1, "a")])
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64))
    table = line_dedup.PerfectHash.build(keys)
    assert sorted(table.positions(keys)) == list(range(len(keys)))
    again, _ = line_dedup.PerfectHash.from_bytes(table.to_bytes())
    assert (again.positions(keys) == table.positions(keys)).all()
    assert len(line_dedup.PerfectHash.build(np.empty(0, np.uint64)).positions(keys)) == len(keys)


def test_index_knows_only_its_own_lines():
    rng = np.random.default_rng(3)
    h, p, n, last = (rng.integers(-(2**62), 2**62, 3000) for _ in range(4))
    index = line_dedup.LineIndex.from_bytes(line_dedup.LineIndex.build(h, p, n, last).to_bytes())
    at = index.find(h, p)
    assert (index.counts[at] == n).all() and (index.last[at] == last).all()
    assert (index.find(h, p + 1) == -1).all()


def test_keys_that_share_their_joint_bits_get_another_seed():
    h = np.arange(50, dtype=np.int64)
    prints = np.arange(50, dtype=np.int64) * 7
    # the second pair's print is such that the first seed gives both the same 64 bits
    first = line_dedup.LineIndex._joint(h[:1], prints[:1])
    prints[1] = (first ^ line_dedup.mix64(h[1:2].view(np.uint64))).view(np.int64)[0]
    assert line_dedup.LineIndex._joint(h[1:2], prints[1:2]) == first
    index = line_dedup.LineIndex.build(h, prints, h + 100, h + 200)
    assert index.seed > 0
    for x in (index, line_dedup.LineIndex.from_bytes(index.to_bytes())):
        at = x.find(h, prints)
        assert (x.counts[at] == h + 100).all() and (x.last[at] == h + 200).all()
    assert line_dedup.PerfectHash.build(np.array([1, 1], np.uint64)) is None
