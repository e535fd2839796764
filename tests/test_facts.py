"""Facts against loops: merging, chains of successors, clusters, slots; and overlaps of windows by trying all starts."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from parley.operators import facts as O

FACTS = "conversation_id long, kind string, content string, evidence array<long>, confidence double, status string, enabled boolean, as_of long"
FOUND = "conversation_id long, kind string, content string, message_id long, confidence double, ts_sec long"
SAID = "conversation_id long, kind string, content string, action string, seq long"


def test_merging_facts(spark):
    held = [(1, "likes", "tea", [1, 2], 0.7, "active", True, 10), (1, "likes", "gone", [5], 0.6, "superseded", False, 10), (1, "likes", "old", [7], 0.5, "active", True, 3), (1, "plan", "odd", [8], 0.5, "uncertain", False, 3)]
    found = [(1, "likes", "tea", 2, 0.9, 20), (1, "likes", "tea", 3, 0.9, 30), (1, "likes", "gone", 6, 0.9, 40), (2, "plan", "trip", 9, 0.5, 50), (2, "plan", "trip", 4, 0.8, 45), (1, "plan", "odd", 8, 0.9, 60), (3, "x", "forgotten", 11, 0.9, 1)]
    found += [(4, "x", "often", i, 0.5, i) for i in range(30)]
    said = [(3, "x", "forgotten", "forget", 1), (1, "likes", "tea", "forget", 1), (1, "likes", "tea", "restore", 2), (1, "likes", "old", "restore", 3), (1, "likes", "old", "inaccurate", 4)]
    frames = [spark.createDataFrame(r, s) for r, s in ((held, FACTS), (found, FOUND), (said, SAID))]
    once = O.merged_facts(*frames)
    got = {r.content: tuple(r)[3:] for r in once.collect()}
    assert got == {
        "tea": ([1, 2, 3], 0.76, "active", True, 30), "gone": ([5, 6], 0.66, "superseded", False, 40), "old": ([7], 0.5, "active", False, 3), "odd": ([8], 0.5, "uncertain", False, 60),
        "trip": ([4, 9], 0.86, "active", True, 50), "forgotten": ([11], 0.9, "active", False, 1), "often": (list(range(30)), 0.95, "active", True, 29),
    }
    assert sorted(O.merged_facts(once, frames[1], frames[2]).collect()) == sorted(once.collect())


def test_chains_of_a_thousand_and_cycles(spark):
    links = [(f"c{i}", f"c{i + 1}" if i < 999 else None) for i in range(1_000)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("s", "s"), ("x", "nowhere"), ("y", None)]
    links += [(f"t{i}", f"t{i // 2}") for i in range(1, 300)] + [("t0", None)]
    random.Random(1).shuffle(links)
    got = {r.id: (r.head, r.steps) for r in O.heads(spark.createDataFrame(links, "id string, successor string")).collect()}
    to = dict(links)

    def walk(x):
        steps, seen = 0, set()
        while to.get(x) not in (None, x):
            if x in seen:
                return None, None
            seen.add(x)
            x, steps = to[x], steps + 1
        return x, steps

    assert got == {x: walk(x) for x in to}
    assert got["c0"] == ("c999", 999) and got["d"] == (None, None) and got["x"] == ("nowhere", 1)


def at(t):
    return datetime.datetime.fromtimestamp(t, datetime.UTC)


def test_clusters_are_the_fold(spark):
    pick, rows, t = random.Random(4), [], 1_700_000_000
    for i in range(900):
        t += pick.choice((0, 0, 10, 100, 300, 600, 601, 5_000) if i % 100 else (90_000,))
        base = i // 8 + pick.randrange(2)
        rows.append((i % 2, pick.choice("ab"), i, at(t), t, pick.choice((0.1, 0.5, 0.5, 0.9)), pick.choice(([base, base + 1, base + 2], [base], [], None, [base, base, base + 1]))))
    frame = spark.createDataFrame(rows, "conversation_id long, kind string, id long, ts timestamp, ts_sec long, score double, evidence array<long>")
    want = []
    for key in {r[:2] for r in rows}:
        clusters = []
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (r[4], r[2])):
            fits = [c for c in clusters if r[4] - c[-1][4] <= 600 and len(set(r[6] or ()) & set(c[-1][6] or ())) >= 2]
            fits[-1].append(r) if fits else clusters.append([r])
        for c in clusters:
            best = max(c, key=lambda r: r[5])
            want.append((*key, best[2], best[4], len(c), sorted({x for r in c for x in r[6] or ()})))
    got = [(r.conversation_id, r.kind, r.representative, r.source_sec, r.n, list(r.evidence)) for r in O.evidence_clusters(frame.repartition(6)).collect()]
    assert sorted(got) == sorted(want)
    assert max(w[4] for w in want) >= 3


def test_slots_are_the_fold(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 12))
    rows = [(k, i, round(float(rng.choice([0.5, 0.6, 0.7])), 1), (centres[rng.integers(0, 16 if k == "many" else 3)] + rng.normal(0, 0.25, 12)).tolist()) for i, k in enumerate(rng.choice(["many", "few", "hot", "hot"], 500).tolist())]
    rows += [(None, 900, 0.5, [1.0, 0.0]), (None, 901, 0.5, [1.0, 0.1]), ("zero", 902, 0.5, [0.0, 0.0]), ("zero", 903, 0.5, [0.0, 0.0]), ("zero", 904, 0.5, None)]
    frame = spark.createDataFrame(rows, "key string, id long, confidence double, vector array<double>")
    want = {}
    for key in {r[0] for r in rows}:
        leaders = []
        for r in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[2], -r[1])):
            v = None if r[3] is None else np.array(r[3])
            fits = lambda c: v is not None and c is not None and np.linalg.norm(v) * np.linalg.norm(c) > 0 and v @ c / (np.linalg.norm(v) * np.linalg.norm(c)) >= 0.72  # noqa: E731, B023
            slot = next((n for n, (_, c) in enumerate(leaders) if fits(c)), None)
            if slot is None and len(leaders) < 10:
                slot = len(leaders)
                leaders.append((r[1], v))
            want[r[1]] = (slot, None if slot is None else leaders[slot][0])
    got = {r.id: (r.slot, r.leader) for r in O.slots(frame).collect()}
    assert got == want
    assert any(s is None for s, _ in want.values())


def test_overlaps_by_all_starts(spark):
    pick, rows = random.Random(5), []
    for k in range(120):
        rows.append((k, [pick.choice(("a", "b", "c", "", None, "dd")) for _ in range(pick.randrange(14))], [pick.choice(("a", "b", "c", "e")) for _ in range(pick.randrange(14))]))
    rows += [(500, None, ["a"]), (501, [], []), (502, ["x"] * 60, ["x"] * 60)]
    got = {r.key: tuple(r[1:]) for r in O.best_overlap(spark.createDataFrame(rows, "key long, expected array<string>, actual array<string>")).collect()}
    for k, expected, actual in rows:
        e, a = ([x for x in side or [] if x] for side in (expected, actual))
        best = (0, 0, -1, -1)
        for i in range(len(e)):
            for j in range(len(a)):
                n = 0
                while i + n < len(e) and j + n < len(a) and e[i + n] == a[j + n]:
                    n += 1
                weight = sum(len(e) - x for x in range(i, i + n))
                if n > best[0] or (n == best[0] and weight > best[1]):
                    best = (n, weight, i, j)
        total = len(e) * (len(e) + 1) / 2
        assert got[k] == (*best, best[0] / len(e) if e else 0.0, best[1] / total if total else 0.0)
    assert O.best_overlap(spark.createDataFrame([], "key long, expected array<string>, actual array<string>")).agg(F.count("*")).first()[0] == 0
