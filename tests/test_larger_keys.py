"""Queries beside their SQL on keys as large tables have them."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from oracle import compare

from tallyspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,shift", [("check_rows", 999800), ("section_rows", 998900)])
def test_part_keys_of_seven_digits(spark, tmp_path, name, shift):
    # Part keys on both sides of the longest number that a check may have.
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + shift)
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    part = next((tmp_path / "lineitem.parquet").glob("*.parquet"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "lineitem.parquet").write_bytes(part.read_bytes())
    assert compare(spark, name, str(tmp_path / "t"), QUERIES[name], ORACLES[name]) is None
