"""Counts of documents' words against DuckDB on odd tables, and that no single word is shuffled by its document."""

import contextlib
import io

import duckdb
import pytest

from parley import registry
from parley.operators import words
from parley.views import table

DOCS = [
    (0, "a b a b c", "en"), (1, "a b", "en"), (1, "b b d", "de"), (1, None, "de"), (2, "B c!c", None), (3, None, "en"), (4, "", "fr"), (None, "a a z", "en"), (None, "z a", None),
    (5, "ä-ß a a a a a a", "fr"), (999, "x y a", "en"), (1000, "x a a", "en"), (1001, "x", "en"), (-1, "c b", "en"), (2000, "x", "fr"), *((i, "q q word w%d" % (i % 3), "en") for i in range(50, 70)),
]
LABELS = [(0,), (1,), (1,), (2,), (None,), (5,), (4,), (2000,), (2000,)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", ["arr_06", "txt_02", "agg_29", "top_02"])
def test_as_sql_on_repeated_ids_and_nulls(spark, odd, name):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
    want = duck.execute(registry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in registry.queries()[name](spark, odd).collect()]
    assert len(want) > 2
    assert sorted(got, key=repr) == sorted((tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in want), key=repr)


def test_blocks_of_any_size(spark, odd):
    docs = table(spark, odd, "documents")
    one, two = (sorted(map(tuple, words.neighbour_products(docs, n).collect())) for n in (1, 1000))
    assert one == two and len(one) > 20


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["txt_02", "top_02"])
def test_words_are_taken_after_the_join(spark, sf_dir, name):
    shown = plan(registry.queries()[name](spark, sf_dir))
    assert "Join" not in shown[: shown.index("Generate explode")]


@pytest.mark.parametrize(("name", "exchanges"), [("agg_29", 0), ("arr_06", 1)])
def test_texts_are_shuffled_once_at_most(spark, sf_dir, name, exchanges):
    shown = plan(registry.queries()[name](spark, sf_dir))
    assert shown.count("Exchange") == exchanges
