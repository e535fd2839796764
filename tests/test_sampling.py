"""The sample against picking and trimming by loops."""

import random

from parley.operators import sampling as S


def loop(pairs, sessions, now, q):
    pairs = sorted(pairs, key=lambda p: (p[1], p[0]))  # (id, ts, polarity, chars)
    polarity = lambda p: p[2] or 0

    def balance(rows, quota):
        groups = {}
        for r in rows:
            groups.setdefault(polarity(r), []).append(r)
        order = sorted(groups.values(), key=lambda g: -len(g))
        turns = [g[i] for i in range(len(rows)) for g in order if i < len(g)]
        return turns[:quota]

    origin = balance(pairs[: 2 * q.origin], q.origin)
    newest = pairs[::-1]
    recent = balance(([p for p in newest if p[1] >= now - q.recent_seconds] or newest)[: 2 * q.recent], q.recent)
    counts = {}
    for p in pairs:
        if polarity(p) == -1:
            counts[p[1] // q.bucket_seconds] = counts.get(p[1] // q.bucket_seconds, 0) + 1
    worst = max(counts, key=lambda b: (counts[b], b), default=None)
    conflict = [p for p in pairs if p[1] // q.bucket_seconds == worst][: q.conflict]
    starts = []
    for start, _ in sorted(sessions, reverse=True):
        before = [e for s, e in sessions if s < start]
        if before and start - max(before) > q.silence_seconds:
            starts.append(start)
    icebreak = [p for s in starts[: q.icebreak] for p in [next((p for p in pairs if p[1] >= s), None)] if p]
    seen, windows = set(), []
    for name, rows in zip(S.WINDOWS, (origin, conflict, recent, icebreak), strict=True):
        own = sorted({p for p in rows if p[0] not in seen}, key=lambda p: (p[1], p[0]))
        seen |= {p[0] for p in own}
        if own:
            windows.append((name, own))

    def drop(largest):
        largest[1].pop(-1 if largest[0] == "origin" else 0)

    while sum(len(w) for _, w in windows) > q.most_pairs:
        largest = max(windows, key=lambda w: (len(w[1]), w[0] != "origin"))
        if len(largest[1]) <= q.least_each:
            break
        drop(largest)
    while sum(p[3] for _, w in windows for p in w) > q.most_chars:
        among = [w for w in windows if len(w[1]) > q.least_each]
        if not among:
            break
        drop(max(among, key=lambda w: (sum(p[3] for p in w[1]), w[0] != "origin")))
    return {(name, p[0]) for name, w in windows for p in w}


def test_sample_is_the_loop(spark):
    pick, data = random.Random(3), {}
    for c in range(12):
        t, pairs, sessions = 1_700_000_000 + c, [], []
        for i in range(pick.choice((1, 5, 30, 150))):
            gap = pick.choice((60, 3_600, 50_000, 90_000, 200_000))
            t += gap
            pairs.append((c * 1_000 + i, t, pick.choice((-1, 0, 0, 1, None)), pick.choice((20, 200, 900))))
            if gap > 40_000 or not sessions:
                sessions.append((t, t))
            sessions[-1] = (sessions[-1][0], t)
        data[c] = pairs, sessions
    now = 1_700_000_000 + 40 * 86_400
    pairs = spark.createDataFrame([(c, *p) for c, (ps, _) in data.items() for p in ps], "conversation_id long, pair_id long, ts_sec long, polarity int, chars long")
    sessions = spark.createDataFrame([(c, *s) for c, (_, ss) in data.items() for s in ss], "conversation_id long, start_sec long, end_sec long")
    for q in (S.QUOTAS, S.Quotas(most_pairs=20, most_chars=3_000), S.Quotas(most_chars=10)):
        got = {}
        for r in S.stratified(pairs, sessions, now, q).collect():
            got.setdefault(r.conversation_id, set()).add((r.window, r.pair_id))
        assert got == {c: loop(*data[c], now, q) for c in data}


def test_trimming():
    rows = lambda n, chars: [(i, i, chars) for i in range(n)]
    kept = S.trimmed({"origin": rows(12, 10), "conflict": rows(12, 10), "recent": rows(12, 10), "icebreak": rows(6, 10)})
    assert {w: len(r) for w, r in kept.items()} == {"origin": 12, "conflict": 11, "recent": 11, "icebreak": 6}
    assert kept["conflict"][0][0] == 1
    kept = S.trimmed({"origin": rows(4, 5_000), "icebreak": rows(3, 10)})
    assert [r[0] for r in kept["origin"]] == [0, 1] and len(kept["icebreak"]) == 2
    assert S.trimmed({"origin": []}) == {}
