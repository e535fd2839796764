import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from parley.llm import lm_mixing


def brute(rows):
    train, n_all = Counter(), 0
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + ["\n"]
    for i, t in rows:
        if not held(i):
            train.update(toks(t))
    n_all = sum(train.values())
    out = []
    for i, t in rows:
        ws = toks(t)
        out.append((i, held(i), len(ws), sum(w in train for w in ws), n_all, sum(math.log10((train[w] + 1) / (n_all + len(train) + 1)) for w in ws)))
    return out


def scored(spark, rows):
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, token string")
    return lm_mixing.lm_scores(df).collect()


ROWS = [(i, f"the cat number {i % 9} sat on the mat and word{i} ran " * (1 + i % 4)) for i in range(120)] + [(200, None), (201, ""), (202, "ÄÖ ünï à voilà Å\u0085\u00a0x " * 3), (203, "big " * 30_000), (204, "the THE tHe"), (204, "the THE tHe")]


def test_base_and_counts(spark):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in scored(spark, ROWS)), key=str)
    assert got == sorted(((*x[:5], round(x[5], 5)) for x in brute(ROWS)), key=str)


def test_scores_are_log_probabilities_and_beat_the_base(spark):
    rows = scored(spark, ROWS)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    long = [r for r in rows if r.held_out and r.n_tokens > 10]
    assert long and sum(r.score for r in long) > sum(r.base_score for r in long)


def test_probabilities_of_single_tokens_add_up_to_at_most_one(spark):
    """Over all texts of one token: known words, and unknown ones of one letter."""
    words = sorted({w for _, t in ROWS[:120] for w in t.split()})
    probes = [(10_000 + i, w) for i, w in enumerate(words + [chr(c) for c in range(33, 127)])]
    held = [(i, t) for i, t in probes if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = {r.doc_id: r.score for r in scored(spark, ROWS[:120] + held)}
    assert sum(10 ** rows[i] for i, _ in held) <= 1 + 1e-6


def test_codes_are_prefix_free():
    nodes, bits = lm_mixing._huffman([5, 1, 1, 2, 9])
    codes = ["".join(map(str, b)) for b in bits]
    assert all(not b.startswith(a) for a in codes for b in codes if a is not b)
    assert sum(2.0 ** -len(c) for c in codes) == 1
    assert all(len(n) == len(b) for n, b in zip(nodes, bits, strict=True))


def test_no_rows_and_no_training_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm_mixing.lm_scores(df).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = scored(spark, [(held, "alone here")])[0]
    assert (r.held_out, r.train_tokens, r.n_known, r.n_tokens) == (True, 0, 0, 3)
    assert np.isfinite(r.score)


def code_of(words, total=None):
    return lm_mixing.Code.of([(w, n) for w, n in words.most_common() if n > 1], total or sum(words.values())).ready()


def chunks_of(texts, code):
    return list(lm_mixing.chunks(lm_mixing.Tokens.of(pa.array(texts, pa.string()), code), code))


def test_tables_count_every_decision_of_all_texts(spark):
    """More texts than a chunk holds, among them one that comes in pieces."""
    texts = [f"a{i % 7} b{i % 5} c rare{i}" for i in range(300)] + ["long words here " * 9000, None, " "]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    words = Counter(w for t in texts for w in [*(t or "").split(), "\n"])
    code = code_of(words)
    known = spark.createDataFrame([(w,) for w in words if w != "\n"], "token string")
    odds = lm_mixing.context_odds(df, known, code)
    counts, n = np.zeros((lm_mixing.HASHED, 2 << code.slot_bits), np.int64), 0
    for d in [*(d for d, _, _ in chunks_of(texts, code)), lm_mixing.spelled([w.encode() for w in words if w != "\n"], code)[0]]:
        n += len(d.bit)
        for k, s in enumerate(d.slots):
            np.add.at(counts[k], 2 * s + d.bit, 1)
    of_word = {w: int(n) for w, n in zip(code.words, code.tokens.length[2:], strict=True)}
    escape, end = (int(x) for x in code.tokens.length[:2])
    want = sum(of_word.get(w.encode(), end if w == "\n" else escape) * c for w, c in words.items())
    assert n == want + sum(int(code.spelling.length[b]) for w in words if w != "\n" for b in w.encode() + b" ")
    for k in range(lm_mixing.HASHED):
        assert (odds[k] == lm_mixing.packed(counts[k, ::2], counts[k, 1::2])).all()


def test_words_are_split_at_ascii_blanks_only():
    rng = random.Random(3)
    parts = ["à", "Å", "\u0085", "\u00a0", "\u2003", "\x1c", "A", "b", " ", "\t", "\n", "\x0b", "\x0c", "\r", "中", "🙂"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", " ", "x" * 5000]
    for rows in (pa.array(texts), pa.array(texts).slice(7, 60), pa.array([None, ""], pa.string()), pa.array([], pa.string())):
        lengths, words = lm_mixing.split_words(rows)
        want = [(t or "").encode().lower().split() for t in rows.to_pylist()]
        assert lengths.tolist() == [len(w) for w in want]
        assert words.to_pylist() == [w for ws in want for w in ws]


def test_word_hashes_hang_on_the_word_alone():
    words = [f"w{i}".encode() for i in range(3000)] + [b"w" * 5000, "ünï".encode(), b"a", b"aa", b"ab", b"ba"]
    got = lm_mixing.word_hashes(pa.array(words, pa.large_binary()))
    assert len(set(got.tolist())) == len(words)
    assert (lm_mixing.word_hashes(pa.array(words[::-1], pa.large_binary()).slice(3, 10)) == got[::-1][3:13]).all()


def test_tables_grow_with_the_corpus():
    words = Counter(a=5, b=3)
    assert [code_of(words, total).slot_bits for total in (10, 10**7, 10**8)] == [18, 20, lm_mixing.MOST_SLOT_BITS]


def plain_score(text, code, model):
    """A text's natural log probability decision by decision, with weights and own counts as plain numbers."""
    ((d, _, _),) = chunks_of([text], code)
    total, moved, own, lo = 0.0, [0.0] * lm_mixing.PREDICTORS, {}, 0
    for length in d.run_length.tolist():
        slope, seen = [0.0] * lm_mixing.PREDICTORS, []
        for i in range(lo, lo + length):
            gate, x = plain_predictions(d, i, model)
            n0, n1 = (min(15, own.get((int(d.own[i]), b), 0)) for b in (0, 1))
            x.append(math.log((n1 + 0.4) / (n0 + 0.4)))
            z, sign = sum((a + m) * b for a, m, b in zip(map(float, model.weights[gate]), moved, x, strict=True)), 2 * int(d.bit[i]) - 1
            right = 1 / (1 + math.exp(-sign * z))
            total += math.log(right)
            slope = [s + sign * (1 - right) * v for s, v in zip(slope, x, strict=True)]
            seen.append((int(d.own[i]), int(d.bit[i])))
        moved = [m + lm_mixing.RATE * s / (length + lm_mixing.STEADY) for m, s in zip(moved, slope, strict=True)]
        for key in seen:
            own[key] = own.get(key, 0) + 1
        lo += length
    return total


def plain_predictions(d, i, model):
    first = int(d.plain[i])
    gate, x = 0, [(first >> 4) / 256]
    for t, s in zip(model.tables, d.slots, strict=True):
        v = int(t[s[i]])
        known = v & 15
        gate = gate * 4 + ((known > 0) + (known > 2) + (known > 5)) * (known <= first & 15)
        x.append((v >> 4) / 256)
    return gate, x


def test_score_is_that_of_plain_loops():
    code = code_of(Counter(w for _, t in ROWS[:120] for w in [*t.split(), "\n"]))
    rng = np.random.default_rng(5)
    model = lm_mixing.Model([rng.integers(-8000, 8000, 1 << code.slot_bits).astype(np.int16) for _ in range(lm_mixing.HASHED)])
    texts = ["the cat sat oddly on the mat " * 30, "x", "", "number 4 and word7 ran again and again ünï"]
    ((d, _, _),) = chunks_of(texts, code)
    for t, score in zip(texts, model.run(d, len(texts)), strict=True):
        assert math.isclose(score, plain_score(t, code, model), rel_tol=1e-4, abs_tol=1e-3)
    words = [b"oddly", "ünï".encode(), b"a"]
    d, begin = lm_mixing.spelled(words, code)
    logs = []
    for i in range(len(d.bit)):
        gate, x = plain_predictions(d, i, model)
        z = sum(a * b for a, b in zip(map(float, model.weights[gate]), x, strict=False))
        logs.append(-math.log1p(math.exp(-z if d.bit[i] else z)))
    ends = [*begin[1:], len(logs)]
    assert np.allclose(model.spell(words, code), [sum(logs[a:b]) for a, b in zip(begin, ends, strict=True)], rtol=1e-4)


def test_a_long_text_scores_alike_in_pieces(monkeypatch):
    code = code_of(Counter(w for _, t in ROWS[:120] for w in [*t.split(), "\n"]))
    model = lm_mixing.Model([np.zeros(1 << code.slot_bits, np.int16) for _ in range(lm_mixing.HASHED)])
    text, scores = "the cat sat on the mat and word3 ran " * 700, []
    for size in (24_000, 1_024):
        monkeypatch.setattr(lm_mixing, "CHUNK", size)
        scores.append(sum(model.run(d, 1, carry)[0] for d, _, carry in chunks_of([text], code)))
    assert math.isclose(*scores, rel_tol=0.02)


def test_neighbours_do_not_matter():
    code = code_of(Counter(w for _, t in ROWS[:120] for w in [*t.split(), "\n"]))
    model = lm_mixing.Model([np.zeros(1 << code.slot_bits, np.int16) for _ in range(lm_mixing.HASHED)])
    one, two = "the cat sat oddly " * 40, "another text " * 90
    ((a, _, _),), ((b, _, _),) = chunks_of([one], code), chunks_of([two, one, None], code)
    assert math.isclose(model.run(a, 1)[0], model.run(b, 3)[1], rel_tol=1e-5)


def test_text_of_one_very_long_word_and_of_blanks(spark):
    rows = [(1, "y" * 300_000), (2, " \n" * 200_000), (3, "a b c")]
    got = {r.doc_id: r for r in scored(spark, rows)}
    assert [got[i].n_tokens for i in (1, 2, 3)] == [2, 1, 4]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    assert math.isclose(got[1].bits_per_byte, -got[1].score * math.log2(10) / 300_001)


def test_short_texts_are_refined():
    assert lm_mixing._blocks(np.array([0, 15, 16, 31, 32, 255, 256, 511, 512])).tolist() == [0, 0, 1, 1, 2, 4, 5, 5, 6]
