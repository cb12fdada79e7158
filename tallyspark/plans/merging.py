"""Queries of near names: near misses of a memory, pairs, aliases and merged vendor tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import merging as m
from tallyspark.operators import tagging as t
from tallyspark.plans.common import dbl, money, query, table


def _vendors(spark, sf):
    """Parts as transactions: every third part's vendor is misspelt, by a letter that is missing or one that is doubled."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("v"), money("p_retailprice").alias("amount"))
    at = (F.col("p_partkey") % F.length("v") + 1).cast("int")
    head = F.when(F.col("p_partkey") % 2 == 0, F.substring("v", F.lit(1), at - 1)).otherwise(F.substring("v", F.lit(1), at))
    tail = F.when(F.col("p_partkey") % 2 == 0, F.substring("v", at + 1, F.length("v"))).otherwise(F.substring("v", at, F.length("v")))
    return p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(head, tail)).otherwise(F.col("v")).alias("vendor"), "amount")


VENDORS = """p AS (SELECT p_partkey, p_name || ' ' || p_type AS v, CAST(p_retailprice AS DECIMAL(18,2)) AS amount FROM part),
d AS (SELECT p_partkey, amount, CASE WHEN p_partkey % 3 <> 0 THEN v WHEN p_partkey % 2 = 0 THEN left(v, CAST(p_partkey % length(v) AS BIGINT)) || substr(v, p_partkey % length(v) + 2)
 ELSE left(v, CAST(p_partkey % length(v) + 1 AS BIGINT)) || substr(v, p_partkey % length(v) + 1) END AS vendor FROM p),
n AS (SELECT vendor AS name, count(*) AS n FROM d GROUP BY 1)"""
PAIRS = VENDORS + """, pairs AS (SELECT x.name AS a, y.name AS b, levenshtein(x.name, y.name) AS edits FROM n x JOIN n y ON x.name < y.name AND levenshtein(x.name, y.name) <= 2
 AND 100 * levenshtein(x.name, y.name) <= 20 * greatest(length(x.name), length(y.name)))"""


@query(f"WITH {PAIRS} SELECT a, b, edits FROM pairs")
def vendor_pairs(spark, sf):
    """All pairs of vendor names within two edits and a similarity of 0.8."""
    return m.near_names(_vendors(spark, sf), name="vendor").withColumn("edits", F.col("edits").cast("bigint"))


@query(f"""WITH {VENDORS}, k AS (SELECT DISTINCT v AS known FROM p), c AS (SELECT name, known, levenshtein(name, known) AS e FROM n, k WHERE name NOT IN (SELECT known FROM k)
 AND levenshtein(name, known) <= 2 AND 100 * levenshtein(name, known) <= 20 * greatest(length(name), length(known))),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY e, known) AS i, count(*) OVER (PARTITION BY name) - 1 AS others FROM c)
SELECT name AS vendor, known, e AS edits, others FROM r WHERE i = 1""")
def vendor_near_misses(spark, sf):
    """Misspelt vendors that the memory of well-spelt ones doesn't have."""
    memory = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("vendor")).distinct()
    return m.near_misses(_vendors(spark, sf), memory, "vendor").withColumn("edits", F.col("edits").cast("bigint"))


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
r(name, other) AS (SELECT name, name FROM n UNION SELECT r.name, e.v FROM r JOIN e ON r.other = e.u),
w AS (SELECT r.name, o.name AS canonical, row_number() OVER (PARTITION BY r.name ORDER BY o.n DESC, o.name) AS i FROM r JOIN n o ON o.name = r.other)
SELECT canonical AS vendor, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount, min(p_partkey) AS first_seen FROM d JOIN w ON w.name = d.vendor AND i = 1 GROUP BY 1""")
def merged_vendors(spark, sf):
    """The vendor table after every near pair is confirmed: linked names count under the most frequent of them."""
    rows = _vendors(spark, sf)
    names = rows.groupBy(F.col("vendor").alias("name")).agg(F.count("*").alias("n"))
    merged = m.apply_aliases(rows, m.alias_table(names, m.near_names(names)), "vendor")
    return t.vendor_table(merged, "vendor", "amount", "p_partkey").withColumn("amount", dbl("amount"))
