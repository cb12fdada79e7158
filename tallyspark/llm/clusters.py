"""Operator 12: centroid clustering by JVM-native expressions.

Vectors are arrays of integers, centroids are literal arrays in the plan. zip_with and aggregate make the integer distance from
each centroid, array_min of (distance, number) structs chooses one, and a round's centroids are column sums by cluster, combined
in each task before the shuffle: k rows of sums go to the driver, which divides them. Python touches no vector.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, materialize

#: Numbers in the literal centroids of a plan (k times the dimension) at most.
LITERALS = 1 << 17
#: Components up to which squared distances and their sums over a vector fit in a long, with 2 ** 6 components.
LONG_LIMIT = 1 << 27
#: Components beyond are taken as this; squared distances then fit in 38 digits.
LIMIT = 10**17
LONGEST = (1 << 63) - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x as double, within LIMIT."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))


def complete(vector: Column, size: int) -> Column:
    """Whether a vector has `size` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == size) & finite


def _literal(centroids: list[list[int]], kind: str) -> Column:
    number = "{}L" if kind == "bigint" else "CAST({}BD AS DECIMAL(18, 0))"
    return F.expr("array(" + ", ".join("array(" + ", ".join(number.format(x) for x in c) + ")" for c in centroids) + ")")


def nearest(vector: Column, centroids: list[list[int]], kind: str) -> Column:
    """The least (distance, cluster) struct; on ties the smaller number."""
    total = "bigint" if kind == "bigint" else "decimal(38, 0)"

    def distance(c: Column) -> Column:
        squares = F.zip_with(vector, c, lambda x, y: (x - y) * (x - y))
        return F.aggregate(squares, F.lit(0).cast(total), lambda s, x: (s + x).cast(total))

    return F.array_min(F.transform(_literal(centroids, kind), lambda c, k: F.struct(distance(c).alias("distance"), k.alias("cluster"))))


def centroid_clusters(vectors: DataFrame, k: int, rounds: int, seed_order: Column) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors (vec_id, vec: array of integers).

    The k vectors that come first in seed_order (ties: by their components) are the first centroids, numbered from 0. In each
    round every vector goes to the nearest one (squared distance; ties: the smaller number), which becomes the componentwise
    floor of its vectors' mean; one without vectors stays. Vectors are assigned once more at the end. All vectors have the
    same number of components, none null. A null vec_id is kept and clustered like any other; repeated rows are vectors of
    their own; with fewer than k vectors each is a centroid; an empty table gives no rows; other columns are ignored. All sums are exact.
    Components beyond 2 ** 27 (for up to 64 of them) are counted in decimals; distances and sums over a long's range come out as the
    largest long. Literals are k times the dimension: over LITERALS numbers raise an error.
    """
    spark = vectors.sparkSession
    result = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    vecs = materialize(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vec").cast("array<bigint>").alias("vec"), seed_order.alias("seed_order")), "vectors")
    seeds = [list(r["vec"]) for r in vecs.orderBy("seed_order", "vec").limit(k).select("vec").collect()]
    if not seeds:
        return spark.createDataFrame([], result)
    dim = len(seeds[0])
    if k * dim > LITERALS:
        raise ValueError(f"{k} centroids of {dim} components are more than {LITERALS} literals")
    most = F.array_max(F.transform("vec", lambda x: F.abs(x)))
    largest, n = vecs.agg(F.max(most), F.count("*")).first()
    kind = "bigint" if (largest or 0) <= LONG_LIMIT and dim <= 64 else "decimal(18, 0)"
    sums = "bigint" if (largest or 0) * n <= LONGEST else "decimal(38, 0)"
    held = vecs.select("vec_id", F.col("vec").cast(f"array<{kind}>").alias("vec"))
    centroids = seeds
    for _ in range(rounds):
        at = held.select(nearest(F.col("vec"), centroids, kind)["cluster"].alias("cluster"), "vec")
        columns = [F.sum(F.col("vec")[i].cast(sums)).alias(f"s{i}") for i in range(dim)]
        found = at.groupBy("cluster").agg(F.count("*").alias("n"), *columns).collect()
        centroids = list(centroids)
        for r in found:
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
    assigned = held.select("vec_id", nearest(F.col("vec"), centroids, kind).alias("near"))
    within = F.least(F.col("near.distance"), F.lit(LONGEST)).cast("bigint")
    assigned = materialize(assigned.select("vec_id", F.col("near.cluster").cast("int").alias("cluster"), within.alias("distance")), "clusters")
    discard(vecs)
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("s")).collect()}
    total = min(sum(inertia.values()), LONGEST)
    rows = [(c, min(s, LONGEST), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in inertia.items()]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
