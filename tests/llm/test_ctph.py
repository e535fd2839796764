import hashlib
import random

import numpy as np

from parley.llm import ctph


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "b", True) for i, t in rows], "doc_id long, text string, bucket string, guest boolean")
    return ctph.fingerprints(df).collect()


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_contract(spark):
    rng = random.Random(8)
    rows = [(3 * i, text(rng, rng.randint(0, 300))) for i in range(150)] + [(1000, None), (1001, ""), (1002, "x"), (1003, "same words here"), (1004, "same words here"), (1005, "y" * 400_000)]
    order = sorted(rows)
    got = {r.doc_id: r for r in found(spark, rows)}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == ctph.fingerprint(t.encode())
        assert r.edited_fingerprint == ctph.fingerprint(edited.encode())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_next == ctph.likeness([(r.fingerprint, ctph.fingerprint(following.encode()))])[0]
    assert got[1003].fingerprint == got[1004].fingerprint and got[1003].near_next == 1
    long = [got[i] for i, t in order if t and len(t) > 600 and len(set(t)) > 5]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.15


def test_edit_likeness_matches_brute_force():
    rng = random.Random(1)
    pairs = [("".join(rng.choice("AB") for _ in range(rng.randint(1, 12))), "".join(rng.choice("AB") for _ in range(rng.randint(1, 12)))) for _ in range(200)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + 2 * (x != y)))
            row = new
        return row[-1]

    want = [1 - distance(a, b) / (len(a) + len(b)) for a, b in pairs]
    assert np.allclose(ctph._edit_likeness(pairs), want)


def test_an_edit_moves_only_nearby_chunks():
    rng = random.Random(2)
    a = text(rng, 800)
    b = a[:2000] + "inserted words" + a[2000:]
    assert ctph.likeness([(ctph.fingerprint(a.encode()), ctph.fingerprint(b.encode()))])[0] > 0.85
    assert ctph.likeness([(ctph.fingerprint(a.encode()), ctph.fingerprint(text(rng, 800).encode()))])[0] < 0.6


def test_odd_tables(spark):
    assert len(found(spark, [(None, "a"), (None, "b"), (5, "c"), (5, "c")])) == 4
    one = found(spark, [(9, "abcdef")])
    assert one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert ctph.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_periodic_texts_have_bounded_signatures():
    for text in (b"abcdefg " * 400_000, b"a" * 3_000_000, b"<tr><td>1</td></tr>\n" * 150_000):
        own, other = ctph.fingerprint(text), ctph.fingerprint(text[: len(text) - 1000] + b"xyz")
        assert all(len(x) <= ctph.MOST_LETTERS for x in own.split(":")[1:])
        assert 0 <= ctph.likeness([(own, other)])[0] <= 1
    table = b"".join(b"<tr><td>%d</td></tr>\n" % (i % 10) for i in range(150_000))
    assert ctph.likeness([(ctph.fingerprint(table), ctph.fingerprint(table + b"more"))])[0] > 0.9


def test_most_rows_without_an_id_or_with_one(spark):
    """They spread over all ranges, and follow each other as their hashes tell; clashing columns don't matter."""
    rng = random.Random(3)
    rows = [(pick, text(rng, 30)) for pick in [None] * 120 + [7] * 120 + list(range(40))] + [(7, "the same")] * 60
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, role string, part int, fingerprint string").repartition(5)
    got = ctph.fingerprints(frame)
    assert got.count() == len(rows)
    hashes = {r.text: r.h for r in frame.selectExpr("text", "xxhash64(text) as h").distinct().collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = sorted((str(i), len(t), hashlib.sha256(ctph.edited(t, ordered[(n + 1) % len(ordered)][1]).encode()).hexdigest()) for n, (i, t) in enumerate(ordered))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got.collect()) == want
