"""Collects queries and their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import STAMP
from suite.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Timestamps as text and doubles rounded to 9 digits, so both engines print the same."""
    out = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, STAMP)
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 9)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; `sql` is its DuckDB check over the named views."""

    def keep(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: flat(fn(spark, sf_dir))
        if sql is not None:
            CHECKS[name] = with_views(sql, *views) if views else sql.strip()
        return fn

    return keep


def stamp(column: str) -> str:
    """DuckDB text of a timestamp, as `flat` prints it."""
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')"
