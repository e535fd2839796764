"""The registered queries: each a function of (spark, data folder), with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley import views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("scans", "joins", "aggregates", "timelines", "rankings", "texts", "scores", "search", "rules", "live")


def operator(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under an operator's id; ``sql`` is what DuckDB runs on the same tables."""

    def register(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def declare(name: str, meaning: str, text: str) -> Query:
    """Registers a query whose text both Spark SQL and DuckDB understand.

    ``{m}`` and the like stand for the canonical views, ``{documents}`` and the like for the tables, ``{div}`` for integer division.
    """
    inputs = list(dict.fromkeys(re.findall(r"\{(\w+)\}", text.replace("{div}", ""))))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text.replace("{div}", "div"), **{x: views.frame(spark, sf_dir, x) for x in inputs})

    run.__name__, run.__doc__ = name, meaning
    plain = text.replace("{div}", "//")
    for x in inputs:
        plain = plain.replace(f"{{{x}}}", x)
    return operator(name, views.with_views(inputs, plain))(run)


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"parley.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
