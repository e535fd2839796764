import time

import numpy as np
import pandas as pd

from parley.llm import chroma


def melody(seed, notes=120):
    rng = np.random.default_rng(seed)
    phase = np.cumsum(np.repeat(440 * 2 ** (rng.integers(-12, 24, notes) / 12), chroma.HOP * 2)) / chroma.RATE
    return np.sin(2 * np.pi * phase)


def pcm(x):
    return (np.clip(x, -1, 1) * 12_000).astype("<i2").tobytes()


def test_excerpts_with_noise_are_aligned(spark):
    songs = {i: melody(i) for i in range(12)}
    rng = np.random.default_rng(5)
    rows = [(i + 1, pcm(x), "k") for i, x in songs.items()]
    start = 20 * chroma.HOP
    rows.append((100, pcm(songs[3][start : start + 16_000] + rng.normal(0, 0.02, 16_000)), "k"))
    rows.append((200, pcm(songs[7]), "k"))
    rows.append((300, pcm(melody(99)), "k"))
    rows += [(400, None, "k"), (500, b"", "k"), (501, b"\x01", "k"), (None, pcm(songs[1]), "k"), (8, pcm(songs[7]), "k")]
    df = spark.createDataFrame(rows, "media_id long, content binary, key string")
    got = chroma.match_recordings(df, "media_id", "content").collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    hits = [x for x in by[100].links if x["class_id"] == 4]
    assert len(hits) == 1 and abs(hits[0]["offset"] - 20) <= 1 and hits[0]["bit_error"] < 0.25
    assert by[200].class_id == 8
    assert by[300].links is None or not by[300].links
    assert by[400].class_id == by[500].class_id == 400 and by[400].n_prints == 0
    assert by[1].links is None


def test_links_match_brute_force(spark):
    rows = [(i, pcm(np.roll(melody(i % 6, 60), 0)[: 9000 + 200 * (i % 3)])) for i in range(0, 1200, 50)]
    df = spark.createDataFrame(rows, "id long, content binary")
    got = {r.id: r for r in chroma.match_recordings(df, "id", "content").collect()}
    prints = {i: chroma.fingerprint(x).astype(np.int64) for i, x in rows}
    for q in (i for i in prints if i % 100 == 0 and got[i].class_id == i):
        want = set()
        for o in prints:
            if got[o].class_id != o or o == q:
                continue
            votes = {}
            for x, key in enumerate(prints[q]):
                for y in np.flatnonzero(prints[o] == key) if key > 0 else []:
                    votes[int(y) - x] = votes.get(int(y) - x, 0) + 1
            if votes:
                k = max(votes, key=lambda v: (votes[v], -abs(v), v))
                a, b = prints[q][max(0, -k) :], prints[o][max(0, k) :]
                n = min(len(a), len(b))
                heard = (a[:n] > 0) & (b[:n] > 0)
                error = np.bitwise_count((a[:n] ^ b[:n])[heard].astype(np.uint32)).sum() / max(1, 32 * heard.sum())
                if heard.sum() >= chroma.LEAST_OVERLAP and error <= chroma.MOST_ERRORS:
                    want.add(o)
        assert {x["class_id"] for x in got[q].links or []} == want


def test_wav_header_and_no_rows(spark):
    data = pcm(melody(1, 20))
    wav = b"RIFF" + (36 + len(data)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\0" * 16 + b"data" + len(data).to_bytes(4, "little") + data
    assert (chroma.fingerprint(wav) == chroma.fingerprint(data)).all()
    assert chroma.match_recordings(spark.createDataFrame([], "i long, c binary"), "i", "c").count() == 0


def test_links_without_equal_integers_are_found_at_any_offset(spark):
    rng = np.random.default_rng(3)
    rows = [(i + 1, pcm(melody(i, 60))) for i in range(6)] + [(700, pcm(melody(0, 9))), (701, pcm(melody(0, 9)[:2000]))]
    for k in range(6):
        part = melody(k, 60)[(10 + k) * chroma.HOP + 40 :][:6000]
        rows += [(100 * (k + 1), pcm(part + rng.normal(0, 0.15 + 0.15 * k, len(part))))]
    df = spark.createDataFrame(rows, "id long, content binary")
    got = {r.id: {x["class_id"]: x for x in r.links or []} for r in chroma.match_recordings(df, "id", "content").collect()}
    prints = {i: chroma.fingerprint(x).astype(np.int64) for i, x in rows}
    without_votes = 0
    for q in (i for i in prints if i % 100 == 0):
        want = {}
        for o in prints:
            for k in range(-len(prints[q]) + 1, len(prints[o])) if o != q else []:
                a, b = prints[q][max(0, -k) :], prints[o][max(0, k) :]
                n = min(len(a), len(b))
                heard = (a[:n] > 0) & (b[:n] > 0)
                error = np.bitwise_count((a[:n] ^ b[:n])[heard].astype(np.uint32)).sum() / max(1, 32 * heard.sum())
                if heard.sum() >= chroma.LEAST_OVERLAP and error <= chroma.MOST_ERRORS:
                    want.setdefault(o, {})[k] = (int(heard.sum()), round(float(error), 6), int(((a[:n] == b[:n]) & heard).sum()))
        assert set(got[q]) == set(want)
        for o, x in got[q].items():
            overlap, error, votes = want[o][x["offset"]]
            assert (x["overlap"], x["votes"]) == (overlap, votes) and abs(x["bit_error"] - error) < 1e-5 and votes == max(v[2] for v in want[o].values())
        without_votes += sum(all(v[2] == 0 for v in w.values()) for w in want.values())
    assert without_votes


def by_position(queries, others):
    """Links of each query and other by bit errors, position by position."""
    found = {}
    for q, own in queries:
        for o, there in others:
            for k in range(-len(own) + 1, len(there)) if o != q else []:
                a, b = own[max(0, -k) :], there[max(0, k) :]
                n = min(len(a), len(b))
                heard = (a[:n] > 0) & (b[:n] > 0)
                errors, overlap = int(np.bitwise_count((a[:n] ^ b[:n])[heard]).sum()), int(heard.sum())
                if overlap >= chroma.LEAST_OVERLAP and errors <= chroma.MOST_ERRORS * 32 * overlap:
                    votes = int(((a[:n] == b[:n]) & heard).sum())
                    found[q, o] = max(found.get((q, o), (-1,)), (votes, -errors / (32 * overlap), -abs(k), k, overlap))
    return found


def recordings(rows):
    return pd.DataFrame({"id": [i for i, _ in rows], "prints": [p.astype(np.int64) for _, p in rows]})


def test_links_of_all_lengths_with_quiet_parts(monkeypatch):
    rng = np.random.default_rng(8)
    song = rng.integers(1, 2**32, 400, dtype=np.uint32)
    rows = []
    for i in range(40):
        n = int(rng.integers(1, 60)) if i % 5 else int(rng.integers(60, 300))
        at = int(rng.integers(0, 400 - n))
        flips = np.bitwise_or.reduce((rng.random((32, n)) < (i % 9) * 0.04).astype(np.uint32) << np.arange(32, dtype=np.uint32)[:, None], axis=0)
        part = song[at : at + n] ^ flips
        if i % 3 == 0:
            part[rng.random(n) < 0.4] = 0
        rows.append((i, part))
    rows += [(40, np.zeros(50, np.uint32)), (41, np.empty(0, np.uint32)), (42, song[:8]), (43, song[:7])]
    want = by_position(rows, rows)
    assert len({q for q, _ in want}) > 20
    for most in (chroma._SLICE, 60_000):
        monkeypatch.setattr(chroma, "_SLICE", most)
        monkeypatch.setattr(chroma, "_TILE", most)
        got = chroma._compared(recordings(rows), recordings(rows))
        assert {(r.q_id, r.o_id): (r.votes, -r.bit_error, -abs(r.offset), r.offset, r.overlap) for r in got.itertuples()} == want


def test_comparing_takes_less_than_every_position():
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(1, 2**32, 54, dtype=np.uint32)) for i in range(1200)]
    queries, others = recordings(rows[:256]), recordings(rows[176:])
    line = np.concatenate([np.concatenate([p, np.zeros(47, np.uint32)]) for _, p in rows[176:]])
    began = time.thread_time()
    for _, own in rows[:256]:
        errors = np.zeros(len(line) - len(own) + 1, np.uint16)
        for j, x in enumerate(own):
            errors += np.bitwise_count(line[j : j + len(errors)] ^ x)
    every = time.thread_time() - began
    began = time.thread_time()
    chroma._compared(others, queries)
    assert time.thread_time() - began < every / 2
