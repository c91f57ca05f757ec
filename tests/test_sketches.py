import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkcorpus.operators import sketches as S

SCHEMA = "lang string, text string, size long"


def told(df):
    return {r[0]: r.asDict() for r in df.collect()}


def files_read(df):
    """How many files the scans of a plan that ran have opened."""
    out, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            out += metrics.apply("numFiles").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "texts")

    def add(rows, mode="append"):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)
        return spark.read.schema(SCHEMA).parquet(path)

    return add


def test_an_added_file_costs_only_itself(spark, folder, tmp_path):
    store = S.FileSketches(spark, str(tmp_path / "sketches"), ["lang"], F.col("text"), F.col("size"))
    first = [("en", f"t{i}", i) for i in range(500)] + [("de", "same", 7)] * 300
    table = folder(first)
    with pytest.raises(ValueError):
        store.statistics(table, ["lang"])
    assert len(store.refresh(table)) == 1 and store.refresh(table) == []
    added = [("en", f"t{i}", 1000 + i) for i in range(400, 600)] + [(None, None, None), ("de", "", None)]
    table = folder(added)
    new = store.refresh(table)
    assert len(new) == 1
    only = table.select("lang", "_metadata.file_path").filter(F.col("file_path").isin(new))
    assert only.count() == len(added)
    counted = only.groupBy("lang").count()
    counted.collect()
    assert files_read(counted) == 1  # the other file is not opened
    got = told(store.statistics(table, ["lang"]))
    assert (got["en"]["n"], got["en"]["low"], got["en"]["high"]) == (700, 0, 1599)
    assert abs(got["en"]["distinct"] - 600) <= 4 * S.distinct_error() * 600
    assert (got["de"]["n"], got["de"]["n_values"], got["de"]["distinct"], got["de"]["mean"], got["de"]["deviation"]) == (301, 300, 2, 7.0, 0.0)
    assert (got[None]["n"], got[None]["distinct"], got[None]["mean"], got[None]["quantiles"]) == (1, 0, None, None)
    whole = store.statistics(table, []).first()
    assert whole["n"] == 1002 and whole["total"] == sum(x[2] or 0 for x in first + added)


def test_files_that_are_gone_count_no_more(spark, folder, tmp_path):
    store = S.FileSketches(spark, str(tmp_path / "sketches"), ["lang"], F.col("text"), F.col("size"))
    folder([("en", "a", 1)])
    table = folder([("en", "b", 5)])
    assert len(store.refresh(table)) == 2
    gone = sorted(Path(tmp_path / "texts").glob("*.parquet"))[0]
    gone.unlink()
    table = spark.read.schema(SCHEMA).parquet(str(tmp_path / "texts"))
    assert store.refresh(table) == [] and store.statistics(table, []).first()["n"] == 1
    table = folder([("fr", "c", 9)], mode="overwrite")
    assert len(store.refresh(table)) == 1 and set(told(store.statistics(table, ["lang"]))) == {"fr"}


def test_a_file_sketched_twice_counts_once(spark, folder, tmp_path):
    table = folder([("en", "a", 1), ("en", "b", 2)])
    make = lambda p: S.FileSketches(spark, str(tmp_path / p), ["lang"], F.col("text"), F.col("size"))
    a, b = make("a"), make("b")
    a.refresh(table), b.refresh(table)
    b.stored().write.mode("append").parquet(a.path)  # as two runs at once would leave it
    assert a.statistics(table, []).first()["n"] == 2


@pytest.mark.parametrize("parts", [1, 7])
def test_merges_stay_within_the_stated_errors(spark, parts):
    rows = spark.range(200_000).select(F.pmod("id", F.lit(parts)).alias("part"), (F.col("id") % 60_000).cast("string").alias("text"), (F.col("id") * 7919 % 100_003).alias("size"))
    got = S.statistics(S.merged(S.sketched(rows, ["part"], F.col("text"), F.col("size")), []), []).first()
    assert abs(got["distinct"] - 60_000) <= 4 * S.distinct_error() * 60_000
    values = sorted(i * 7919 % 100_003 for i in range(200_000))
    for share, q in got["quantiles"].items():
        below, upto = (sum(map(f, values)) / len(values) for f in (lambda x: x < q, lambda x: x <= q))
        assert below - 2 * S.rank_error() <= share <= upto + 2 * S.rank_error()
    mean = sum(values) / len(values)
    assert math.isclose(got["mean"], mean) and math.isclose(got["deviation"], math.sqrt(sum((x - mean) ** 2 for x in values) / len(values)))


def test_values_far_from_zero_keep_their_digits(spark):
    rows = spark.createDataFrame([("x", 10**15 + i) for i in (1, 2, 4)], "text string, size long")
    got = S.statistics(S.sketched(rows, [], F.col("text"), F.col("size")), []).first()
    assert math.isclose(got["deviation"], math.sqrt(14) / 3, rel_tol=1e-9)
    longest = spark.createDataFrame([("x", 2**63 - 1)] * 5, "text string, size long")
    got = S.statistics(S.merged(S.sketched(longest, ["text"], F.col("text"), F.col("size")), []), []).first()
    assert got["total"] == 5 * (2**63 - 1) and got["deviation"] is None  # squares have over 38 digits


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    got = S.sketched(none, ["lang"], F.col("text"), F.col("size"))
    assert S.statistics(S.merged(got, ["lang"]), ["lang"]).count() == 0
