"""Vendor names that are nearly the same: near misses for review, aliases with one canonical name, names merged by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.shared import written


def _edits(size: Column, distance: int, percent: int) -> Column:
    """So many edits the similarity allows between names of which the longer has `size` code points."""
    return F.least(F.lit(distance), F.floor((100 - percent) * size / 100).cast("int"))


def _keys(names: DataFrame, distance: int, percent: int) -> DataFrame:
    """(name, key): a hash of every text that the allowed deletions leave of a name; names within that many edits share one.

    Each round deletes at or behind the place of the one before, and of equal letters in a row only the first, so few texts come
    twice. A row holds one round's places of one text, so a long name is many rows and not one large one."""
    size = F.length("name")
    out = names.select("name", F.col("name").alias("_w"), F.lit(1).alias("_from"), _edits(size + distance, distance, percent).alias("_left")).where("_left > 0")
    for _ in range(distance):
        more = (F.col("_left") > 0) & (F.col("_from") <= F.length("_w"))
        at, w = F.col("_i"), F.col("_w")
        letter = lambda i: F.substring(F.col("_w"), i, F.lit(1))
        first = F.filter(F.sequence(F.col("_from"), F.length("_w")), lambda i: (i == F.col("_from")) | (letter(i) != letter(i - 1)))
        places = F.when(more, F.concat(F.array(F.lit(0)), first)).otherwise(F.array(F.lit(0)))
        cut = F.when(at == 0, w).otherwise(F.concat(F.substring(w, F.lit(1), at - 1), F.substring(w, at + 1, F.length(w))))
        out = out.select("name", "_w", "_from", "_left", F.explode(places).alias("_i"))
        out = out.select("name", cut.alias("_w"), F.col("_i").alias("_from"), F.when(at == 0, 0).otherwise(F.col("_left") - 1).alias("_left"))
    return out.select("name", F.xxhash64("_w").alias("key")).repartition("key").distinct()


def near_names(names: DataFrame, known: DataFrame | None = None, name: str = "name", distance: int = 2, percent: int = 80) -> DataFrame:
    """Pairs (a, b, edits) of different names within `distance` edits whose edits are at most (100 - percent) % of the longer's
    code points; a < b among `names`, or a from `names` and b from `known`.

    Null and empty names are near nothing, repeated ones count once, case and outer spaces count. Names meet by texts that deletions
    leave, and are verified. How many names can share such a text is bounded by the alphabet and its length, not by the table:
    a prefix that many names have makes no large group."""
    of = lambda df: df.select(F.col(name).alias("name")).where("name <> ''").distinct()
    left = of(names)
    a = _keys(left, distance, percent).withColumnRenamed("name", "a")
    b = _keys(left if known is None else of(known), distance, percent).withColumnRenamed("name", "b")
    edits = F.levenshtein("a", "b", distance)
    met = a.join(b, "key").where(F.col("a") < F.col("b") if known is None else F.col("a") != F.col("b")).select("a", "b", edits.alias("edits"))
    return met.where((F.col("edits") >= 0) & (100 * F.col("edits") <= (100 - percent) * F.greatest(F.length("a"), F.length("b")))).distinct()


def near_misses(vendors: DataFrame, memory: DataFrame, vendor: str, **near) -> DataFrame:
    """The review list (vendor, known, edits, others): vendors that the memory doesn't have, with the known name that takes the fewest
    edits (ties: the smaller) and the number of other known names that are near. Nothing is tagged by it."""
    new = vendors.select(vendor).distinct().join(memory.select(vendor).distinct(), vendor, "left_anti")
    pairs = near_names(new, memory, vendor, **near)
    best = pairs.groupBy("a").agg(F.min(F.struct("edits", "b")).alias("_m"), (F.count("*") - 1).alias("others"))
    return best.select(F.col("a").alias(vendor), F.col("_m.b").alias("known"), F.col("_m.edits").alias("edits"), "others")


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node that can be reached. Nodes may be of any type with
    an order; loops and repeated edges change nothing, a null is no node.

    Turns of large and small stars, each written, until a turn changes nothing: about the logarithm of the longest path. More than
    `most` turns are an error."""
    now = written(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(now)
    for _ in range(most):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = mark(now)
        if after == before:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = after
    raise ValueError(f"components are still changing after {most} turns")


def alias_table(vendors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(alias, canonical) for the confirmed pairs (a, b) of vendors (name, n): of names that are linked, the most frequent one is
    canonical (ties: the smaller). A name that the table lacks counts as seen 0 times; canonical names have no row."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    counts = vendors.groupBy("name").agg(F.sum("n").alias("n"))
    node = ends.join(counts, "name", "left").select("name", F.struct((-F.coalesce("n", F.lit(0))).alias("rank"), F.col("name").alias("name")).alias("node"))
    node = written(node, "nodes")
    a, b = node.select(F.col("name").alias("a"), F.col("node").alias("u")), node.select(F.col("name").alias("b"), F.col("node").alias("v"))
    found = components(pairs.select("a", "b").join(a, "a").join(b, "b"))
    return found.where("node <> root").select(F.col("node.name").alias("alias"), F.col("root.name").alias("canonical"))


def apply_aliases(rows: DataFrame, aliases: DataFrame, vendor: str) -> DataFrame:
    """Rows with the canonical name in place of a known alias; other names, null among them, stay."""
    known = aliases.select(F.col("alias").alias(vendor), F.col("canonical").alias("_c"))
    return rows.join(known, vendor, "left").withColumn(vendor, F.coalesce("_c", vendor)).select(*rows.columns)
