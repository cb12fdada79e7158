import hashlib
import math

from pyspark.sql import functions as F

from tallyspark.llm.clusters import LIMIT, LONGEST, centroid_clusters, complete, quantised
from tallyspark.llm.queries import op12_centroid_clusters


def brute(rows, k, rounds, key):
    """rows: (vec_id, vec); every number is a Python integer."""
    centroids = [v for _, v in sorted(rows, key=lambda r: (key(r[0]), r[1]))[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((d(v, c), i) for i, c in enumerate(centroids)) for _, v in rows]
    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (_, a) in zip(rows, at) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    most = lambda x: min(x, LONGEST)
    inertia = {c: sum(most(s) for s, a in at if a == c) for _, c in at}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i or -1, a, most(s), most(inertia[a]), most(sum(inertia.values())), sha[a]) for (i, _), (s, a) in zip(rows, at))


def rows_of(df):
    return sorted((r.vec_id or -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def sha(i):
    return hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()


ORDER = "sha2(concat('2:', coalesce(cast(vec_id AS string), '')), 256)"


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [math.floor(256 * float(x)) for x in r.embedding]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r.embedding and len(r.embedding) == 64 and all(x is not None and math.isfinite(x) for x in r.embedding)]
    assert rows_of(op12_centroid_clusters(spark, d)) == brute(rows, 40, 5, sha)


def test_ties_repeats_and_empty_clusters(spark):
    rows = [(i, [i % 3 * 2, -(i % 3)]) for i in range(30)] + [(7, [2, -1])] * 5 + [(None, [3, 3]), (100, [-7, 1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, vec array<bigint>, cluster int").repartition(4)
    for k in (1, 2, 8, 100):  # with 8 and 100 some first centroids are equal, so that the later ones are never the nearest
        assert rows_of(centroid_clusters(df, k=k, rounds=3, seed_order=F.expr(ORDER))) == brute(rows, k, 3, sha)
    empty = spark.createDataFrame([], "vec_id bigint, vec array<bigint>")
    assert centroid_clusters(empty, k=3, rounds=2, seed_order=F.expr(ORDER)).count() == 0


def test_large_components(spark):
    rows = [(i, [(-1) ** i * (i + 1) * 10**e, 5 * i]) for i, e in enumerate([3, 8, 9, 12, 15, 16, 16, 0, 1, 14])] + [(20, [LIMIT, -LIMIT]), (21, [LIMIT - 1, 1 - LIMIT])]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<bigint>")
    assert rows_of(centroid_clusters(df, k=4, rounds=4, seed_order=F.expr(ORDER))) == brute(rows, 4, 4, sha)


def test_vectors_that_take_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [0.5, -0.001]), (1, None), (2, [1.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [1.0, -inf]), (6, [1e30, -1e30]), (7, [1.0, 2.0, 3.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, vec array<double>").where(complete(F.col("vec"), 2))
    assert {r.vec_id: r.v for r in df.select("vec_id", quantised(F.col("vec"), 256).alias("v")).collect()} == {0: [128, -1], 6: [LIMIT, -LIMIT]}
