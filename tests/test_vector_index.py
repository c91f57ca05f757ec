import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcorpus.operators import cluster, retrieval as R, vector_index as VI


def cloud(n, d=8, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=d) + 4 * np.eye(d)[i % 3]).round(3).tolist()) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<double>")


def asked(rows):
    return rows.select(F.col("id").alias("query"), F.col("embedding").alias("vector"))


def listed(df):
    return sorted((r["query"], r["rank"], r["unit"], round(r["distance"], 9)) for r in df.collect())


def test_all_lists_give_the_full_scan(spark):
    rows = cloud(900) + [(2000 + i, cloud(1)[0][1]) for i in range(400)] + [(3000 + i, (np.array(cloud(2)[1][1]) * (i + 2)).tolist()) for i in range(5)] + [(4000, [0.0] * 8), (4001, [-0.0] * 8)]
    odd = [(5000, None), (5001, []), (5002, [1.0] * 3), (5003, [float("nan")] * 8), (5004, [1.0, None] * 4), (5005, [float("inf")] * 8)]
    units = frame(spark, rows + odd).withColumn("list", F.lit("clash")).withColumn("vid", F.lit(0))
    index = VI.build(units, lists=7)
    queries = asked(frame(spark, rows[:40] + rows[900:903] + rows[1300:1307] + odd))
    got = listed(VI.search(index, queries, 10))
    good = asked(frame(spark, rows[:40] + rows[900:903] + rows[1300:1307]))
    assert got == listed(R.vector_channel(good, frame(spark, rows), 10))
    assert index.vectors.count() == 900 + 5 + 1  # equal vectors are one row


def test_crowded_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(VI, "SLICE", 50)
    rows = cloud(500)
    index = VI.build(frame(spark, rows), lists=2)
    assert max(r["slices"] for r in index.slices.collect()) > 3
    queries = asked(frame(spark, rows[:130]))
    assert listed(VI.search(index, queries, 5)) == listed(R.vector_channel(queries, frame(spark, rows), 5))


def test_probed_lists_reach_their_recall(spark):
    rows = cloud(1500, seed=3)
    units = frame(spark, rows)
    index = VI.build(units, lists=20)
    probes = VI.probes_for(index, 10)
    queries = asked(frame(spark, rows[::15]))
    truth = R.vector_channel(queries, units, 10)
    measured = VI.recall(VI.search(index, queries, 10, probes), truth).first()
    assert probes < 20 and measured["queries"] == 100 and measured["recall"] >= 0.9
    assert VI.recall(VI.search(index, queries, 10, 1), truth).first()["recall"] <= measured["recall"]


def test_empty_index(spark):
    index = VI.build(frame(spark, [(1, None)]).limit(0))
    assert VI.search(index, asked(frame(spark, [(1, [1.0])])), 3).count() == 0


def sphere(rows, k, rounds, fine=cluster.FINE):
    """Spherical k-means in Python integers."""
    unit = {i: [round(x / np.linalg.norm(v) * fine) for x in v] for i, v in rows}
    return unit


@pytest.mark.parametrize("parts", [1, 5])
def test_spherical_tree_equals_plain_rounds(spark, parts):
    rows = cloud(200, d=4, seed=9)
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(parts)
    hashed = {r["id"]: (r["h"], str(r["id"])) for r in df.select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).collect()}
    unit = sphere(rows, 3, 4)
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))

    def fitted(ids, k):
        centres = [unit[i] for i in sorted(ids, key=hashed.get)[:k]]
        for _ in range(4):
            of = {i: max(range(len(centres)), key=lambda c: (dot(unit[i], centres[c]), -c)) for i in ids}
            for c in range(len(centres)):
                if mine := [unit[i] for i in ids if of[i] == c]:
                    centres[c] = cluster.renormalised([sum(x) for x in zip(*mine)])
        return {i: max(range(len(centres)), key=lambda c: (dot(unit[i], centres[c]), -c)) for i in ids}

    top = fitted(list(unit), 3)
    want = {(i, c, p) for g in set(top.values()) for i, p in fitted([i for i in unit if top[i] == g], 2).items() for c in [g]}
    assert {tuple(r) for r in cluster.spherical_tree(df, 3, 2, 4).collect()} == want
    assert cluster.spherical_tree(df.limit(0), 3, 2).count() == 0


def test_random_searches(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(300)]  # many ties
    index = VI.build(frame(spark, rows), lists=4)
    queries = asked(frame(spark, rows[:60]))
    assert listed(VI.search(index, queries, 7)) == listed(R.vector_channel(queries, frame(spark, rows), 7))


def test_a_shard_gives_each_query_k_vectors_however_many_lists_it_has(spark):
    rows = cloud(900)
    index = VI.build(frame(spark, rows), lists=30)
    assert len(set(index.shards.tolist())) == 1
    queries = asked(frame(spark, rows[:20]))
    assert listed(VI.search(index, queries, 10)) == listed(R.vector_channel(queries, frame(spark, rows), 10))
    found, routed = (spark.read.parquet(f"{index.steps.base}/{name}-*") for name in ("found", "routed"))
    assert found.count() < 20 * 10 * 5 and routed.count() == 20  # 20 * 30 rows, and 10 of each, if lists met queries one by one


def test_lists_are_packed_into_shards(monkeypatch):
    monkeypatch.setattr(VI, "SLICE", 10)
    assert VI.sharded([(0, 4), (1, 6), (3, 1), (4, 25), (7, 2), (8, 9)]) == [(0, 1, 0), (1, 1, 0), (3, 1, 1), (4, 3, 2), (7, 1, 3), (8, 1, 4)]
