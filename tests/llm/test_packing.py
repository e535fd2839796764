import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from parley.llm import packing

ROWS = [(i, f"some words of document {i} " * (1 + i % 40)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "z " * 30_000), (1003, "<|endoftext|> ünï 中文 🙂\n\n x"), (None, "no id"), (7, "the same id again"), (7, "the same id again")]


def ids_of(text):
    whole = Tokenizer.from_file(packing.default_vocabulary())
    whole.encode_special_tokens = True
    return [*whole.encode(text or "", add_special_tokens=False).ids, 0]


def test_every_id_lies_in_one_piece(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in ROWS], "doc_id long, text string, key int, bucket int")
    got = packing.pack_documents(df).toPandas()
    want = defaultdict(list)
    for i, t in ROWS:
        want[i].append(ids_of(t))
    filled = got.groupby("sequence_id")["length"].sum()
    assert filled.max() <= packing.LENGTH and ((filled == packing.LENGTH) | (filled & (filled - 1) == 0)).all()
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all()
    assert got.length.sum() == sum(len(x) for v in want.values() for x in v)
    for (i, start, length, crc, total) in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False):
        texts = [x for x in want[None if i != i else int(i)] if len(x) == total]
        assert any(zlib.crc32(np.array(x[int(start) : int(start + length)], "<u4").tobytes()) == crc for x in texts)
    single = got[~got.doc_id.duplicated(keep=False) | got.doc_id.isin([i for i in want if i is not None and len(want[i]) == 1])].dropna()
    for i, p in single.groupby("doc_id"):
        p = p.sort_values("start")
        assert (p.start.to_numpy() == np.concatenate([[0], np.cumsum(p.length)[:-1]])).all()
        assert p.length.sum() == len(want[int(i)][0])


def test_many_runs_of_blanks_take_no_longer_than_other_texts():
    import time

    encode = packing.tokenizer(packing.default_vocabulary())
    for text in (("x" + " " * 19_999) * 50, ("x" + "\n" * 2_000) * 100, ("word" + " " * 199) * 1_000, ("word" + " " * 200) * 1_000):
        began = time.perf_counter()
        ids = encode(text)
        assert time.perf_counter() - began < 8
        assert [*ids, 0] == ids_of(text)


def test_the_curve_visits_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    at = packing.hilbert_index(cells, bits=3)
    assert sorted(at) == list(range(512))
    path = cells[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_likeness_of_neighbours(spark):
    """Documents about the same words stand closer on the curve than others do."""
    rng = np.random.default_rng(4)
    themes = [[f"{chr(97 + t)}{w}" for w in range(12)] for t in range(6)]
    rows = [(i, " ".join(rng.choice(themes[i % 6], 60))) for i in range(240)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values(["sequence_id", "offset"])
    order = got.drop_duplicates("doc_id").doc_id.to_numpy() % 6
    assert (order[1:] == order[:-1]).mean() > 0.35


def test_no_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_runs_give_the_ids_of_the_library():
    encode = packing.tokenizer(packing.default_vocabulary())
    for text in (" " * 1_000_000, "a\n" + "\n" * 1_000_000 + "b", "x" * 300_000, "x \t" * 10_000, "\u3000" * 60_000 + "z", "=" * 200_000):
        assert [*encode(text), 0] == ids_of(text)


def test_ranges_grow_with_partitions_and_nothing_hangs_on_ids(spark):
    rows = [(None, f"text number {i} " * (1 + i % 7)) for i in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.length.sum() == sum(len(ids_of(t)) for _, t in rows)
    assert (got.sequence_id // (1 << 40)).nunique() > 18
