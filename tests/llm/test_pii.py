import hashlib
import random
import re

from parley.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [c for c in s if "0" <= c <= "9"]


def luhn(ds):
    total = 0
    for i, d in enumerate(reversed(ds)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def base(text):
    return [x for x in pii.find_spans(text, pii.automaton()) if x[2] in pii.BASE]


def test_random_texts_match_the_patterns():
    rng = random.Random(3)
    parts = ["@", ".", "a", "b-", "+", "1", "23", "255", "256", " ", "-", "(", ")", "é", "\n", "%", "4111 1111 1111 1111", "user@host.org", "+49 30 123456-78", "10.0.0.1", "٣", "０", "://", "token = "]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert base(text) == brute(text), text


def test_documents_match_the_patterns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op7_pii_anchor_expansion(spark, sf_dir).collect()}
    for r in rows:
        spans = brute(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
        assert [got[r.doc_id][f"n_{k}"] for k in pii.BASE] == [sum(x[2] == k for x in spans) for k in pii.BASE]


def test_accounts_come_on_top():
    text = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" IBAN: DE89370400440532013000 http://bob:hunter2@h/ mytoken = abcdefg1'
    spans = [text[s:e] for s, e, k in pii.find_spans(text, pii.automaton()) if k == "account"]
    assert spans == ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "DE89370400440532013000", "bob:hunter2"]


def test_accounts_and_addresses_are_validated():
    found = lambda text: [(text[s:e], k) for s, e, k in pii.find_spans(text, pii.automaton()) if k not in pii.BASE]
    account = lambda *values: [(v, "account") for v in values]
    assert found("DE89 3704 0044 0532 0130 00 THE END, iban: GB82 WEST 1234 5698 7654 32 AND MORE") == account("DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32")
    assert found("iban: DE89370400440532013001, IBAN DE8937040044053201300") == []
    assert found("SSN: 123-45-6789, ssn 219099999, ssn: 000-12-3456, ssn 900-12-3456, ssn 123-00-4567, ssn: 123-45-67890") == account("123-45-6789", "219099999")
    assert found("passport no: X1234567, passport number is ABCDEFG") == account("X1234567")
    assert found("Account no. 12 345 678 and account number: 12345") == account("12 345 678")
    assert found('password: hunter, password: hunter22 secret is "abcdefgh1"') == account("hunter22", "abcdefgh1")
    assert found("at 221b Baker Street, 12 the road, 5 Grand View Avenue. 9 Lane 10 Downing Streets") == [("221b Baker Street", "address"), ("5 Grand View Avenue", "address")]
    assert found("iban " * 20_000 + "1 " * 50_000 + " street" * 20_000) == []


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "a@b.cd", "s"), (3, "x" * 300_000 + " a@b.cd", "s"), (3, "ü a@b.cd", "s")], "doc_id long, text string, spans string")
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in pii.personal_data(df).collect()]
    assert sorted(got, key=str) == sorted([(1, []), (2, []), (None, [(0, 6, "email")]), (3, [(300_001, 300_007, "email")]), (3, [(2, 8, "email")])], key=str)
    assert pii.personal_data(df.where("false")).count() == 0
