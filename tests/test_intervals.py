import random

import pytest
from pyspark.sql import functions as F

from sparkcorpus.operators import evaluation as E, intervals as I


def spans(rng, n, wide):
    out = []
    for i in range(n):
        lo = rng.randrange(-50, 400)
        out.append((rng.choice(["a", "a", "b", None]), i, lo, lo + rng.choice([0, -3, 1, 2, rng.randrange(1, 9), rng.randrange(1, wide)])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    a, b = spans(rng, 120, 300), spans(rng, 120, 40)
    points = [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, rng.randrange(-60, 450)])) for i in range(200)]
    left, right = spark.createDataFrame(a, "k string, x long, alo long, ahi long"), spark.createDataFrame(b, "k string, y long, blo long, bhi long")
    got = sorted((r["x"], r["y"]) for r in I.overlapping(left, right, ["k"], "alo", "ahi", "blo", "bhi").collect())
    assert got == sorted((x, y) for k, x, l, h in a for m, y, p, q in b if k is not None and k == m and max(l, p) < min(h, q))
    found = I.containing(spark.createDataFrame(points, "k string, p long, at long"), right, ["k"], "at", "blo", "bhi")
    assert sorted((r["p"], r["y"]) for r in found.collect()) == sorted((p, y) for k, p, at in points for m, y, l, h in b if k is not None and k == m and at is not None and l <= at < h)
    assert I.containing(found.select("k", "at").limit(0), right.limit(0), ["k"], "at", "blo", "bhi").count() == 0


def test_one_key_with_a_hundred_thousand_spans(spark):
    """A nested loop over the key would look at 10**10 pairs."""
    a = spark.range(100_000).select(F.lit("hot").alias("k"), F.col("id").alias("x"), (F.col("id") * 10).alias("alo"), (F.col("id") * 10 + 4).alias("ahi"))
    b = spark.range(100_000).select(F.lit("hot").alias("k"), F.col("id").alias("y"), (F.col("id") * 10 + 3).alias("blo"), (F.col("id") * 10 + 12).alias("bhi"))
    pairs = I.overlapping(a, b, ["k"], "alo", "ahi", "blo", "bhi")
    assert pairs.count() == 199_999 and pairs.filter("x - y not in (0, 1)").count() == 0
    points = spark.range(100_000).select(F.lit("hot").alias("k"), (F.col("id") * 10 + 5).alias("at"))
    assert I.containing(points, b, ["k"], "at", "blo", "bhi").count() == 100_000


def test_recall_of_spans_and_cuts(spark):
    targets = spark.createDataFrame([(1, 1, 7, 0, 10), (1, 2, 7, 20, 30), (2, 1, 8, 0, 5)], "case int, target int, chunk_id int, lo int, hi int")
    chosen = spark.createDataFrame([(1, 7, 5, 25), (2, 9, 0, 5)], "case int, chunk_id int, char_start int, char_end int")
    got = {r["case"]: (r["all_hit"], r["retention"], r["kept"], r["chars"], r["precision"]) for r in E.sentence_recall(targets, chosen).collect()}
    assert got == {1: (True, 0.5, 10, 20, 0.5), 2: (False, 0.0, 0, 5, 0.0)}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    cuts = frame([("d", 3), ("d", 5), ("d", 9), ("d", 12)], "doc string, at long")
    out = E.segmentation(frame([("d", 4)], "doc string, at long"), frame([("d", 12)], "doc string, at long"), frame([("d", 5, 9)], "doc string, lo long, hi long"), cuts, frame([("d", 20)], "doc string, n long")).first()
    assert (out["must_recall"], out["wrong"], out["unmarked"], out["cuts"]) == (1.0, 1, 1, 4)
