"""Redaction: hand-worked texts, the plain patterns, and overlaps by brute force."""

import random
import re

from pyspark.sql import functions as F

from parley.functions import redaction as R


def kinds(text):
    return [f.kind for f in R.redact(text)[1]]


def test_classes_next_to_chinese_characters():
    assert kinds("我身份证11010519491231002X你记一下") == ["id_card"]
    assert kinds("卡号6222 0212 3456 7890 123别忘") == ["bank_card"]
    assert kinds("打13812345678找我") == kinds("打+86 13812345678找我") == ["phone"]
    assert kinds("发到a.b@example.com吧") == ["email"]
    assert kinds("看https://example.com/x?y=1，密码") == ["url"]
    assert R.redact("看https://example.com/x?y=1，密码")[1][0].value == "https://example.com/x?y=1"
    assert kinds("座机010-12345678转") == kinds("热线400-123-4567") == ["landline"]
    assert kinds("key: sk-abcdefghij0123456789") == ["api_key"]
    assert kinds("pkg@1.0，1381234567，20240101") == []


def test_addresses_and_what_only_looks_like_one():
    assert kinds("我住在幸福路小院里") == ["address"]
    assert kinds("北京市海淀区中关村") == ["address"]
    assert kinds("今天去幸福路随便走走") == []
    assert kinds("今天去幸福路12号") == ["address"]
    assert kinds("今天的星穹铁道更新了") == []
    assert R.redact("今天的星穹铁道更新了")[0] == "今天的星穹铁道更新了"


def test_overlaps_and_placeholders():
    text, spans = R.redact("幸福路88号13812345678收")
    assert len(spans) == 1 and text.count("[") == 1
    a, b = (R.redact(f"打13812345678{x}")[0] for x in ("吧", "，再打13812345678"))
    assert a.split("]")[0] == b.split("]")[0] and b.count(a[1:-1]) == 2
    f = lambda s, e, k="x": R.Found(s, e, k, "")
    assert R.resolved([f(0, 3), f(2, 9), f(3, 5), f(3, 7), f(8, 9)]) == [f(0, 3), f(3, 7), f(8, 9)]


def test_the_linear_search_finds_what_the_pattern_finds():
    pick, plain = random.Random(1), re.compile(R.PATTERNS["address"])
    for _ in range(4_000):
        text = "".join(pick.choices("一二天路街市区号楼单元室巷道12-ab ，x", k=pick.randrange(70)))
        assert list(R._addresses(text)) == [m.span() for m in plain.finditer(text)], text
    assert R.redact("天" * 300_000 + "路" * 3)[1] == []


def test_greedy_choice_is_by_start_then_length():
    pick = random.Random(2)
    alphabet = ["13812345678", "a@b.com", "http://x.cn/1", "6222021234567890123", "路", "幸福", "住在", " ", "12号", "，"]
    for _ in range(500):
        text = "".join(pick.choices(alphabet, k=12))
        found, (out, kept) = R.matches(text), R.redact(text)
        for f in found:  # each match is kept, or a kept one that begins before it or with it overlaps it
            assert f in kept or any(k.start <= f.start < k.end for k in kept)
        assert all(a.end <= b.start for a, b in zip(kept, kept[1:], strict=False))
        at = 0
        for k in kept:
            assert out[at:].startswith(text[(kept[kept.index(k) - 1].end if kept.index(k) else 0) : k.start] + k.placeholder)
            at += k.start - (kept[kept.index(k) - 1].end if kept.index(k) else 0) + len(k.placeholder)


def test_columns(spark):
    rows = [(1, "打13812345678吧"), (2, None), (3, ""), (4, "plain"), (5, "x" * 500_000 + " a@b.com")]
    f = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r for r in f.select("id", R.redacted(F.col("t")).alias("r"), R.entities(F.col("t")).alias("e")).select("id", "r.*", "e").collect()}
    assert got[1].redacted.startswith("打[PHONE_") and [tuple(s)[:3] for s in got[1].spans] == [(1, 12, "phone")]
    assert got[2].redacted is None and got[2].e == [] and got[3].redacted == "" and got[4].spans == []
    assert got[5].e == ["email"] and got[5].spans[0].start == 500_001


def test_a_batch_is_taken_apart_in_slices():
    import pyarrow as pa

    seen = []

    def run(texts):
        seen.append(sum(map(len, texts)))
        return pa.array(map(len, texts), pa.int64())

    texts = ["x" * 300_000, "", "y" * 5_000_000, *["z" * 1_000] * 9_000]
    got = R._in_slices(pa.array(texts), run, pa.int64())
    assert got.to_pylist() == [len(t) for t in texts]
    assert sorted(seen)[-1] == 5_000_000 and sorted(seen)[-2] <= 2_000_000
    assert R._in_slices(pa.array([], pa.string()), run, pa.int64()).to_pylist() == []
