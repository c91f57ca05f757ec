import hashlib
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkcorpus.llm import ball_kmeans
from tests import oracle


def brute(rows, k=8, rounds=10, dim=64, scale=1024, seed="3:"):
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    named = [(hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centroids = [v for _, v in sorted(named)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if mine := [v for (_, v), o in zip(kept, of) if o == j]:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    best = [nearest(v) for _, v in kept]
    per = Counter()
    for d, j in best:
        per[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, j, fits(d), fits(per[j]), fits(sum(per.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best)]


def same(got, want):
    assert Counter(tuple(r) for r in got) == Counter(want)


def test_embeddings_equal_the_sql_and_the_plain_version(spark, sf):
    assert oracle.compare(ball_kmeans.op12_ball_kmeans(spark, sf), oracle.connect(sf), ball_kmeans.SQL_OP12) is None
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(ball_kmeans.op12_ball_kmeans(spark, sf).collect(), brute(rows))


def test_balls_hold_what_they_say():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-1000, 1000, (500, 5)), np.tile([7, 7, 7, 7, 7], (300, 1))])
    order, balls = ball_kmeans.build(x)
    assert sorted(order) == list(range(800))
    for b, e, left, right, radius, sums in zip(*[balls[n] for n in ("begin", "end", "left", "right", "radius", "sums")]):
        own = x[order[b:e]]
        assert (own.sum(axis=0) == sums).all() and (np.sqrt(((own - sums // (e - b)) ** 2).sum(axis=1)) <= radius).all()
        if left >= 0:
            assert (balls["begin"][left], balls["end"][left], balls["end"][right]) == (b, balls["begin"][right], e)
    c = rng.integers(-1000, 1000, (6, 5)).astype(float)
    cluster, whole, _ = ball_kmeans.filtered(x[order].astype(float), balls, c)
    assert (cluster == ball_kmeans.squared(x[order].astype(float), c).argmin(axis=1)).all() and len(whole)


def test_whole_balls_go_where_vectors_lie_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 0.01 + (i % 3) * 10).tolist()) for i in range(900)]
    df, trace = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), []
    same(ball_kmeans.cluster(df, k=3, rounds=4, dim=4, trace=trace).collect(), brute(rows, 3, 4, 4))
    assert trace[-1] > 800


def test_odd_rows(spark):
    fine = [(i, [float(i % 5), 0.5, -1.25]) for i in range(40)] + [(3, [1.0, 2.0, 3.0])] * 30 + [(None, [0.1, 0.2, 0.3])]
    bad = [(100, None), (101, []), (102, [1.0, 2.0]), (103, [1.0, None, 2.0]), (104, [1.0, float("nan"), 2.0]), (105, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame(fine + bad, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).withColumn("key", F.lit(1))
    got = ball_kmeans.cluster(df.repartition(3), k=4, rounds=3, dim=3).collect()
    same(got, brute(fine, 4, 3, 3))
    assert ball_kmeans.cluster(df.filter("vec_id > 99"), dim=3).collect() == []
    assert ball_kmeans.cluster(df.limit(0), dim=3).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = [(1, [1.0, 1.0, 1.0]), (2, [1.0, 1.0, 1.0])]
    same(ball_kmeans.cluster(spark.createDataFrame(few, "vec_id long, embedding array<double>"), dim=3).collect(), brute(few, dim=3))


def test_huge_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 10.0 ** int(rng.integers(0, 30))).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    same(ball_kmeans.cluster(df, k=5, rounds=3, dim=3).collect(), brute(rows, 5, 3, 3))
    middle = [(i, (rng.normal(size=3) * 3e4).tolist()) for i in range(60)]
    df = spark.createDataFrame(middle, "vec_id long, embedding array<double>").repartition(2)
    same(ball_kmeans.cluster(df, k=5, rounds=3, dim=3).collect(), brute(middle, 5, 3, 3))


def test_result_does_not_depend_on_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    one = ball_kmeans.cluster(df.coalesce(1), rounds=3).collect()
    same(ball_kmeans.cluster(df.repartition(7), rounds=3).collect(), [tuple(r) for r in one])
