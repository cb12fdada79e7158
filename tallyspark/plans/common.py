"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one order's items that a task takes: what is built of a row is many times as long as the row, so the bytes of a
#: shuffle, by which Spark joins small partitions, say too little, and tasks would spill what they sort.
ROWS_A_TASK = 250_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys in as many tasks as its rows need; a small table in no more than the session's shuffle partitions."""
    rows, usual = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(usual, rows // 20_000), -(-rows // ROWS_A_TASK)), *keys)


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) by its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def money(c: str | Column) -> Column:
    """Money is exact before it is summed, so the order of rows can't change a sum."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def dbl(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")
