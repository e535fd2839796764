"""Scores that share units and pairs: each is computed once, and odd rows give what their SQL gives."""

import os

import duckdb
import pytest

from parley import registry
from tests.test_queries import rows


def test_overall_score_reads_units_once(spark, sf_dir):
    plan = registry.queries()["mth_17"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and plan.count("Exchange") <= 40


@pytest.fixture(scope="module")
def odd_dir(sf_dir, tmp_path_factory):
    """Events of which some share an id, and vectors of which some are missing or given twice."""
    to = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.sql(f"""copy (select * from '{sf_dir}/events.parquet' union all select event_id, ts + interval 40 minute, user_id, event_type, value + 200, replace(props, '3', '7') from '{sf_dir}/events.parquet' where event_id % 17 = 0)
      to '{to}/events.parquet' (format parquet)""")
    con.sql(f"""copy (select * from '{sf_dir}/embeddings.parquet' where vec_id % 5 <> 2 union all select vec_id, list_reverse(embedding), label from '{sf_dir}/embeddings.parquet' where vec_id % 7 = 0)
      to '{to}/embeddings.parquet' (format parquet)""")
    return str(to)


@pytest.mark.parametrize("name", ["mth_10", "mth_12", "mth_16", "mth_17"])
def test_shared_ids(spark, odd_dir, name):
    con = duckdb.connect()
    for f in os.listdir(odd_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{odd_dir}/{f}'")
    assert rows(registry.queries()[name](spark, odd_dir).toPandas()) == rows(con.sql(registry.oracle_sql()[name]).df())
