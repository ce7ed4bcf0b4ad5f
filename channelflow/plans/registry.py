"""Named queries: a Spark plan over the tables of a folder and, where SQL can express it, the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, with no negative zero: sums in another order then compare equal."""
    return df.select(*[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
