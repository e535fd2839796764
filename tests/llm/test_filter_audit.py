import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from parley.llm import filter_audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    """Every order is applied to the documents one filter after the other."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    parts = defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text)}
        fails |= {"D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > first[text]}
        parts[lang or ""].append((i, {k for k, v in fails.items() if v}))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = rows, []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + removed
                shapley[f] += len(removed)
                out[part, order, step] = [len(left), len(removed), redundant, sum(r[1] == {f} for r in rows), sum(r[0] in good for r in removed), sum(r[0] in toxic for r in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def documents():
    pick = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["LOUD", "SHOUT", "a#b", "é", " x"]
    docs = [(None, None, None), (None, "copy me", "en"), (None, "copy me", "en"), (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "copy me", "en"), (4, "copy me", "fr"), (7, "copy me", "fr"), (5, "COPY ME", "")]
    for i in range(150):
        n = pick.choice((5, 99, 100, 101, 300))
        docs.append((pick.randrange(200), pick.choice((" ", "\n", "  ")).join(pick.choices(vocabulary[: pick.choice((20, 300, 405))], k=n)), pick.choice(("en", "fr", None, ""))))
        if pick.random() < 0.3:
            docs.append((pick.randrange(200), docs[-1][1], "de"))
    docs += [(1_000 + i, "the hot copy " * 50, "en") for i in range(80)] + [(2_000, "long " * 200_000, "long")]
    return docs


LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 200, 2)] + [(1, None, 1), (1, 1, None), (None, 1, 1), (1_003, 1, 0), (1_003, 0, 1), (2, None, None)]


def test_all_orders_by_brute_force(spark):
    docs = documents()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, lang string, part string, mask int")
    labels = spark.createDataFrame([(*x, "y") for x in LABELS], "doc_id long, quality int, toxic int, n string")
    found = filter_audit.audit_filters(frame, labels)
    assert found.columns == COLUMNS
    assert [t for _, t in found.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    expected = brute(docs, LABELS)
    assert len(expected) == 600 * 5
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in found.collect()} == expected


def test_parts_tell_the_same_however_rows_lie(spark):
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    one, many = (sorted(filter_audit.mask_cells(d, labels).collect()) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many
    assert sum(r.n for r in one) == docs.count()


@pytest.mark.parametrize("table", ["documents", "labels"])
def test_empty_tables(spark, table):
    docs = [] if table == "documents" else [(1, "a b", "en"), (2, "a b", "en")]
    found = filter_audit.audit_filters(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(found) == (600 if docs else 0)
    assert all(r.good_lost == r.toxic_lost == 0 for r in found)
    assert {r.filter_order: r.removed for r in found if r.step == 1 and r.filter_order[0] == "E"} == ({o: 1 for o in {r.filter_order for r in found} if o[0] == "E"} if docs else {})


def test_other_conditions(spark):
    docs = spark.createDataFrame([(1, "x", "en"), (2, "y y", "en"), (3, "x", "en")], "doc_id long, text string, lang string")
    found = filter_audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), (lambda text, words: text == "x",)).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found} == {
        ("AB", 1): (1, 2, 0, 1, 3), ("AB", 2): (1, 0, 1, 0, 1), ("BA", 1): (2, 1, 0, 0, 1), ("BA", 2): (1, 1, 1, 1, 3),
    }
