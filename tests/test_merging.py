import random

from pyspark.sql import functions as F

from tallyspark.operators import merging as m


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_near_names_are_those_of_all_pairs(spark):
    pick = random.Random(5)
    names = {"".join(pick.choice("abé") for _ in range(pick.randint(1, 14))) for _ in range(250)} | {"x" * 300, "x" * 299 + "y", "z" + "x" * 299}
    for distance, percent in ((1, 50), (2, 80), (3, 70)):
        some = sorted(n for n in names if distance < 3 or len(n) < 20)
        df = spark.createDataFrame([(n,) for n in some + some[:9]] + [("",), (None,)], "name string")
        got = {tuple(r) for r in m.near_names(df, distance=distance, percent=percent).collect()}
        near = ((a, b, edits(a, b)) for i, a in enumerate(some) for b in some[i + 1:] if abs(len(a) - len(b)) <= distance)
        assert got == {(a, b, e) for a, b, e in near if e <= distance and 100 * e <= (100 - percent) * max(len(a), len(b))} and got


def test_no_pairs_of_a_shared_prefix_and_no_cross_join(spark):
    df = spark.range(300).select(F.concat(F.lit("SQ *THE SAME LONG PREFIX "), F.sha2(F.col("id").cast("string"), 256)).alias("name"))
    pairs = m.near_names(df)
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_near_misses_and_aliases(spark):
    memory = spark.createDataFrame([("APNA BAZAR CASH CARRY",), ("APNA BAZAR CASH CARTS",), ("FUEL",)], "v string")
    new = spark.createDataFrame([("APNA BAZAR CASH CARR",), ("APNA BAZAR CASH CARRY",), ("FUEI",), (None,), ("ELSE",)], "v string")
    assert [tuple(r) for r in m.near_misses(new, memory, "v").collect()] == [("APNA BAZAR CASH CARR", "APNA BAZAR CASH CARRY", 1, 1)]
    vendors = spark.createDataFrame([("b", 3), ("a", 2), ("c", 3), ("x", 1), ("y", 1)], "name string, n bigint")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "y"), ("y", "gone")], "a string, b string")
    aliases = m.alias_table(vendors, pairs)
    assert sorted(tuple(r) for r in aliases.collect()) == [("a", "b"), ("c", "b"), ("gone", "x"), ("y", "x")]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "q")], "k int, v string")
    assert sorted(tuple(r) for r in m.apply_aliases(rows, aliases, "v").collect()) == [(1, "b"), (2, "b"), (3, None), (4, "q")]
    none = spark.createDataFrame([], "a string, b string")
    assert m.alias_table(vendors, none).count() == 0 and m.near_names(spark.createDataFrame([], "name string")).count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    pick = random.Random(3)
    edges = [e if pick.random() < 0.5 else e[::-1] for e in path + star] + [(7, 7), (None, 3)] + path[:5]
    got = {r.node: r.root for r in m.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
