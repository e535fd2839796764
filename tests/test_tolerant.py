"""Malformed objects of many kinds; well-formed ones come through as they are."""

import json
import random

from pyspark.sql import functions as F

from parley.functions.tolerant import find_object, tolerant_json

CASES = [
    ('{"a": 1}', {"a": 1}), ('Sure! {"a": "he said "hi" to me", "b": 2} bye', {"a": 'he said "hi" to me', "b": 2}), ('```json\n{"a": [1, 2,], "b": {"c": 3,},}\n```', {"a": [1, 2], "b": {"c": 3}}),
    ('{"a": 1, "b": [1, 2', {"a": 1, "b": [1, 2]}), ('{"a": "cut of', {"a": "cut of"}), ('{"a": 1, "b"', {"a": 1, "b": None}), ('{"a": 1, "b": ', {"a": 1, "b": None}), ('{"a": 1, "b": tr', {"a": 1}), ('{"a": 1,', {"a": 1}), ("{", {}),
    ('<think>like {"a": "..."} maybe</think> {"a": "real"}', {"a": "real"}), ('<think>{"a": 1}</think> no object', {"a": 1}), ('{"a": 1} then {"b": 2}', {"b": 2}), ('{"a": 1} then {not json}', {"a": 1}),
    ('{"a": "line\nbreak\ttab"}', {"a": "line\nbreak\ttab"}), ('{"a": "x\\"y", "b": "\\\\"}', {"a": 'x"y', "b": "\\"}), ('{"a": [1, {"b": 2}', {"a": [1, {"b": 2}]}), ('{"a": [1, 2}', {"a": [1, 2]}),
    ("no object", None), ("", None), (None, None), ("[1, 2]", None), ('"say" {"a": 1}', {"a": 1}), ("{]}", {}), ('{"中": "他说"好"了"}', {"中": '他说"好"了'}),
]


def test_cases():
    for text, want in CASES:
        assert find_object(text) == want, text


def value(pick, depth=0):
    kind = pick.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return [value(pick, depth + 1) for _ in range(pick.randrange(4))]
    if kind == 6:
        return {f"k{i}": value(pick, depth + 1) for i in range(pick.randrange(4))}
    return pick.choice([1, -2.5, True, None, "plain", "with , and } and ] and :", 'a "quoted" word', "back\\slash", "é\n", ""])


def test_what_is_well_formed_stays():
    pick = random.Random(1)
    for _ in range(2_000):
        o = {f"k{i}": value(pick) for i in range(pick.randrange(5))}
        text = json.dumps(o, ensure_ascii=pick.random() < 0.5, indent=pick.choice((None, 2)))
        assert find_object(f"Here: {text} done") == o
        cut = find_object(text[: pick.randrange(1, len(text) + 1)])
        assert isinstance(cut, dict) and set(cut) <= {*o, *(k for k in cut if any(x.startswith(k) for x in o))}


def test_long_texts_and_columns(spark):
    assert find_object('{"a": "' + "x" * 1_000_000) == {"a": "x" * 1_000_000}
    assert find_object('{"a": ' + "[" * 200_000) is None
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, t string")
    got = {r.id: r.j for r in rows.select("id", tolerant_json(F.col("t")).alias("j")).collect()}
    assert {i: None if j is None else json.loads(j) for i, j in got.items()} == {i: w for i, (_, w) in enumerate(CASES)}
