import hashlib
import random

import numpy as np
import pytest
import sentencepiece as spm

from parley.llm import pieces, queries

ODD = [
    None, "", " ", "  ", "   a", "a ", "Hello  world\n\tx é ▁a ① ﬁ", "▁", "▁▁ ▁", "\n\n \n", "<s> </s> <unk> <0x0A>", "ﬀ é   　x", "日本語のテキスト", "🙂👍🏽 ok", "\x00\x01", "a" * 3_000, " " * 3_000,
    "1234567890.12 %", "x" + "\n" * 500 + "y", "the cat " * 2_000, "naïve façade", "�?", "AB̀C",
]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    with open(pieces.default_model(), "rb") as f:
        return pieces.Pieces(f.read())


def agree(own, library, text):
    ids, starts, ends = own.encode(text.encode())
    assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True), text[:80]
    assert own.decode(ids).decode() == library.decode(ids.tolist())
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in zip(starts, ends, strict=True)) == raw
    assert all(a <= b for a, b in zip(starts, ends, strict=True)) and ends[-1] == len(raw)
    return ids, starts, ends


def test_library_on_odd_and_random_texts(own, library):
    pick = random.Random(1)
    for text in ODD:
        agree(own, library, text or "")
    alphabet = [*"abcdeeeTHE.,'- 12 ", "  ", "\n", "é", "ß", "▁", "▁▁", "日", "🙂", "́", "the", "ing ", " ", "\x7f"]
    for _ in range(3_000):
        agree(own, library, "".join(pick.choices(alphabet, k=pick.randrange(40))))


def test_scans_and_heap_merge_alike(own):
    pick = random.Random(5)
    for _ in range(2_000):
        stretch = "".join(pick.choices("▁▁aeinrst", k=pick.randrange(1, 60)))
        assert own._short(stretch) == list(own._long(stretch))


def test_spans_are_what_pieces_stand_for(own):
    text = "  Hello  wörld 🙂"
    ids, starts, ends = own.encode(text.encode())
    for i, a, b in zip(ids.tolist(), starts, ends, strict=True):
        span = text.encode()[a:b]
        if own.kinds[i] != pieces.CONTROL:
            assert own.surfaces[i].lstrip(b" ") == span.lstrip(b" ")
            assert own.surfaces[i] == span or a == 0  # but for the blank that is put before a text


def test_decoding_of_any_ids(own, library):
    pick = random.Random(2)
    few = [0, 1, 2, *range(3, 259), *(own.ids[p] for p in ("▁", "▁▁", "▁the", "a", "é"))]
    for _ in range(3_000):
        ids = pick.choices(few, k=pick.randrange(9))
        assert own.decode(np.array(ids, "<u4")).decode() == library.decode(ids), ids


def test_bytes_that_are_no_utf8(own):
    for raw in (b"\xff", b"a\xc3", b"\xe2\x96 x", b"ok \xf0\x9f\x99 \x80"):
        ids, starts, ends = own.encode(raw)
        assert b"".join(raw[a:b] for a, b in zip(starts, ends, strict=True)) == raw
        assert own.decode(ids).decode() == "".join(pieces._character(raw, i)[0].decode() for i in lead(raw))


def lead(raw):
    i = 0
    while i < len(raw):
        yield i
        i += pieces._character(raw, i)[1]


@pytest.mark.parametrize("rules", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("dummy", [False, True])
def test_compiled_character_maps(rules, squeeze, dummy):
    """The maps that the library compiles, and its alignment, which counts characters."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    names = {"add_dummy_prefix": dummy, "escape_whitespaces": True, "remove_extra_whitespaces": squeeze}
    theirs = spm.SentencePieceNormalizer(rule_name=rules, **names)
    spec = pb.ModelProto.FromString(theirs.serialized_model_proto()).normalizer_spec
    assert bool(spec.precompiled_charsmap) == (rules != "identity")
    for k, v in names.items():
        setattr(spec, k, v)
    normalize, pick = pieces.Normalizer(spec), random.Random(3)
    alphabet = [*"aBc. ", "  ", "ﬁ", "①", "　", " ", "e", "́", "ｱ", "ﾞ", "한", "㌔", "\t", "\n", "🙂", "İ", "ß", "​", "Å"]
    texts = [t or "" for t in ODD] + ["".join(pick.choices(alphabet, k=pick.randrange(25))) for _ in range(400)]
    for text in texts:
        found, project = normalize(text.encode())
        expected, places = theirs.normalize(text, with_offsets=True)
        assert found.decode() == expected, text
        if found:
            starts = np.cumsum([0, *(len(c.encode()) for c in expected)])
            bytes_of = np.cumsum([0, *(len(c.encode()) for c in text)])
            assert project(starts).tolist() == bytes_of[places].tolist()[: len(starts)]


def test_documents(spark, library):
    rows = [*enumerate(ODD), (None, "no id"), (3, "twice"), (3, "twice"), (99, "long word" * 50_000), (100, "many words " * 100_000)]
    frame = spark.createDataFrame([(i, t, b"x", 7) for i, t in rows], "doc_id long, text string, ids binary, n_tokens int").repartition(3)
    encoded = pieces.encode_documents(frame)
    assert encoded.columns == ["doc_id", "n_tokens", "ids", "starts", "ends"]
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in pieces.decode_documents(encoded).collect()), key=repr)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expected.append((i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids)))
    assert got == sorted(expected, key=repr)
    spans = {r.doc_id: (np.frombuffer(r.starts, "<u4"), np.frombuffer(r.ends, "<u4")) for r in encoded.collect()}
    assert spans[100][1][-1] == len("many words " * 100_000)
    none = pieces.decode_documents(pieces.encode_documents(frame.where("doc_id = -1")))
    assert none.collect() == [] and none.columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_query_over_all_documents(spark, library):
    at = "/root/testdata/sf0.01"
    found = {r.doc_id: tuple(r[1:]) for r in queries.op12_sentencepiece(spark, at).collect()}
    rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[r.doc_id] == (len(ids), digest, hashlib.sha256(library.decode(ids).encode()).hexdigest())
