import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.functions import vector as V
from sparkcorpus.operators import evaluation as E
from sparkcorpus.operators import vector_scan
from sparkcorpus.queries.base import ORACLES, QUERIES
from tests import oracle
from tests.test_vector_scan import tables  # noqa: F401


def every_pair(q, units):
    d = units.select(F.col("id").alias("unit"), F.col("label").alias("own"), "embedding").join(q)
    return d.withColumn("distance", V.cosine_distance(F.col("embedding"), F.col("vector"))).drop("embedding", "vector")


def same(a, b):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(a) == rows(b)


def ordered(*by):
    return F.row_number().over(Window.partitionBy("query").orderBy(*by, F.isnull("distance"), "distance", "unit"))


@pytest.mark.parametrize("slice_,block", [(16_384, 16_384), (9, 5)])
def test_ranks_equal_a_full_ranking(tables, monkeypatch, slice_, block):  # noqa: F811
    monkeypatch.setattr(vector_scan, "SLICE", slice_)
    monkeypatch.setattr(vector_scan, "BLOCK", block)
    _, units = tables
    q = units.filter("id % 7 = 0 or id >= 139").select(F.col("id").alias("query"), F.col("embedding").alias("vector"), "label")
    everything = every_pair(q, units)
    ranked = everything.filter("query <> unit").withColumn("rank", ordered())
    best = ranked.filter("own = label").groupBy("query").agg(F.min("rank").alias("best"))
    want = q.select("query").join(best, "query", "left").select(F.col("query").alias("case"), F.col("best").cast("long"), F.coalesce(F.col("best") == 1, F.lit(False)).alias("first"), F.coalesce(F.col("best") <= 4, F.lit(False)).alias("in_k"))
    same(E.self_ranks(q, units, "label", 4), want)
    targets = q.select(F.col("query").alias("case"), F.explode(F.array(F.col("query") + 1, F.col("query") + 3, F.lit(61))).alias("unit"))
    aims = targets.withColumnRenamed("case", "query").withColumn("aim", F.lit(True)).distinct()
    want = everything.withColumn("rank", ordered()).join(aims, ["query", "unit"]).groupBy(F.col("query").alias("case")).agg(F.min("rank").cast("long").alias("rank"))
    same(E.target_rank(q.drop("label"), units, targets), want)


@pytest.mark.parametrize("name", ["self_hit", "target_rank"])
def test_queries_equal_their_sql_on_odd_rows(spark, tmp_path, name):
    """Vectors that are null, equal or zero; labels that are null, or that one row has: a case without a target is a row all the same."""
    rows = [(i, [float(i * 7 % 11 + 1), float(i * i % 5), 1.0], i % 3) for i in range(1, 420)]
    rows += [(0, [1.0, 2.0, 3.0], 77), (500, None, 1), (501, [1.0, 0.0, 0.0], 1), (600, [1.0, 1.0, 1.0], None), (700, [1.0, 2.0, 1.0], 5), (701, None, 5), (707, None, 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = oracle.duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert oracle.compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["self_hit", "target_rank"])
def test_no_row_for_each_pair(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
