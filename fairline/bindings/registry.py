"""Pairs every registered query with its DuckDB twin under one output spec.

A spec such as ``"user_id:l day:d rate:f"`` lists output columns and types; it
is applied to the DataFrame and to the SQL alike, so both round the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Summation order moves values by far less than this; it keeps exact halves on one side of the rounding.
_NUDGE = 1e-9
_DIGITS = {"f": 6, "g": 3}
_SPARK = {"l": "bigint", "i": "int", "s": "string", "d": "date"}
_DUCK = {"l": "BIGINT", "i": "INTEGER", "s": "VARCHAR", "d": "DATE"}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def _spark_column(name: str, kind: str) -> Column:
    if kind in _DIGITS:
        value = F.round(F.col(name).cast("double") + _NUDGE, _DIGITS[kind])
        return F.when(value == 0, F.lit(0.0)).otherwise(value).alias(name)
    return F.col(name).cast(_SPARK[kind]).alias(name)


def _quoted(name: str) -> str:
    return f'"{name}"'


def _duck_column(name: str, kind: str) -> str:
    if kind in _DIGITS:
        value = f"round(CAST({_quoted(name)} AS DOUBLE) + CAST({_NUDGE} AS DOUBLE), {_DIGITS[kind]})"
        return f"CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END AS {_quoted(name)}"
    return f"CAST({_quoted(name)} AS {_DUCK[kind]}) AS {_quoted(name)}"


def shaped_sql(spec: str, body: str) -> str:
    body = body.strip().rstrip(";")
    return f"SELECT {', '.join(_duck_column(n, k) for n, k in _fields(spec))} FROM ({body}) AS result_rows"


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; without ``sql`` the check is rows-only."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_column(n, k) for n, k in _fields(spec)])

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = shaped_sql(spec, sql)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
