import random

from pyspark.sql import functions as F

from tallyspark.functions.text import natural_key
from tallyspark.operators.order import places


def test_places_of_a_whole_table_without_a_single_task(spark):
    names = [f"page-{k}.png" for k in range(1, 3001)]
    mixed = random.Random(2).sample(names, len(names))
    out = places(spark.createDataFrame([(n,) for n in [*mixed, None]], "name string").repartition(7), natural_key(F.col("name")), "place")
    assert {r["name"]: r["place"] for r in out.collect()} == {n: k for k, n in enumerate([None, *names], 1)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    tasks = out.groupBy(F.spark_partition_id().alias("p")).agg(F.max("place"), F.count("*").alias("n")).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) > 1 and max(r["n"] for r in tasks) < 2500
    few = spark.createDataFrame([("b",), ("a",), ("a",)], "name string")
    assert sorted((r["name"], r["place"]) for r in places(few, F.col("name"), "place").collect()) == [("a", 1), ("a", 2), ("b", 3)]
    assert places(few.where("name > 'x'"), F.col("name"), "place").count() == 0


def test_natural_order_ranks_in_several_tasks(spark):
    from tallyspark.plans.registry import QUERIES

    plan = QUERIES["natural_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_range" in plan


def test_places_bind_their_key_once(spark):
    # The key stood in the comparison with every bound and was computed for each of them.
    df = spark.range(300).selectExpr("id * 7 % 300 AS v")
    key = F.upper(F.lpad(F.col("v").cast("string"), 6, "0"))
    out = places(df, key, "place", 30)
    assert all(r.place == r.v + 1 for r in out.collect())
    assert "<= upper(" not in out._jdf.queryExecution().optimizedPlan().toString()
