"""Tables that are used more than once, in the folder that the cluster shares, and columns that are."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a local one only where Spark itself is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='tallyspark-')}"
    return f"{base}/tallyspark-files/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written and read again: its lineage is cut, and a lost executor costs no more than the table's own files."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns, computed once for a row: a later filter on them would otherwise be pushed below and compute each use again."""
    return df.withColumns({name: F.when(F.monotonically_increasing_id() >= 0, c) for name, c in columns.items()})
