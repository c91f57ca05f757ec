import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkcorpus.functions import vector as V
from sparkcorpus.operators import retrieval as R
from sparkcorpus.operators import vector_scan
from sparkcorpus.operators.relational import top_per_group


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3 or None, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(i, 1, [1.0, 2.0, 0.0, 0.0, 1.0, -1.0]) for i in range(60, 140)]  # copies
    rows += [(140, 2, [0.0] * 6), (141, 2, [-0.0] * 6), (142, 0, None), (143, 0, [1.0, 2.0]), (144, 0, [float("nan")] * 6), (145, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (146, 1, [1e200] * 6), (147, 2, [])]
    units = spark.createDataFrame(rows, "id long, label int, embedding array<float>").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return units.filter("id % 7 = 0 or id >= 139").select(F.col("id").alias("query"), F.col("embedding").alias("vector")), units


def every_pair(q, units):
    return units.filter("embedding is not null").join(q.filter("vector is not null")).select("query", "label", F.col("id").alias("unit"), V.cosine_distance(F.col("embedding"), F.col("vector")).alias("distance"))


def same(a, b):
    rows = lambda df: sorted(map(str, df.collect()))  # noqa: E731  (to the last bit)
    assert rows(a) == rows(b)


@pytest.mark.parametrize("sizes", [{}, {"slice_": 9, "block": 5}])
def test_nearest_equals_a_join_to_the_last_bit(tables, sizes):
    q, units = tables
    best = lambda d, g: top_per_group(d, g, 4, F.asc("distance"), F.asc("unit"))
    same(best(vector_scan.nearest(q, units, 4, **sizes), ["query"]).select("query", "unit", "distance", "rn"), best(every_pair(q, units), ["query"]).select("query", "unit", "distance", "rn"))
    cols = ["query", "label", "unit", "distance", "rn"]
    same(best(vector_scan.nearest(q, units, 4, group="label", **sizes), ["query", "label"]).select(cols), best(every_pair(q, units), ["query", "label"]).select(cols))


@pytest.mark.parametrize("sizes", [{}, {"slice_": 9, "block": 5}])
def test_counts_within_thresholds_equal_a_join(tables, sizes):
    q, units = tables
    at = (0.3, 1.0, 1.0 - 1 / 7**0.5)
    want = every_pair(q, units).filter("query <> unit").groupBy("query").agg(F.min("distance").alias("nearest"), *[F.count_if(F.col("distance") <= t).alias(f"c{i}") for i, t in enumerate(at)])
    same(vector_scan.within(q, units, at, **sizes), want)


def test_searches_make_no_row_for_each_pair(tables):
    """What leaves a slice is k rows a query, however many copies it has."""
    q, units = tables
    plain = units.filter("id < 140")
    found = vector_scan.nearest(q.filter("query < 139"), plain, 4)
    assert found.count() == 4 * q.filter("query < 139").count()
    plan = R.separation_of(q.filter("query < 139").withColumn("in_corpus", F.lit(True)), plain)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_usable_rows(spark):
    none = spark.createDataFrame([(1, [])], "id long, embedding array<double>")
    q = none.select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    assert vector_scan.nearest(q, none.limit(0), 3).count() == 0
    assert R.vector_channel(q, none, 3).count() == 1
