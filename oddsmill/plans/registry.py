"""Registered queries and the SQL that states what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsmill.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 3e-12, digits) + 0.0 for c, kind in df.dtypes if kind == "double"})


def query(sql: str | None = None, **more: str):
    """Registers a query; ``sql`` may use all views, and ``more`` are further ones for it alone."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, **more)
        return f

    return register
