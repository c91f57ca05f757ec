from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkcorpus.operators import versions as V

SCHEMA = "doc_id string, seq int, content string"


def files(path):
    return {p.parent.name: p.name for p in Path(path).glob("*/*.parquet")}


def test_other_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [(f"d{i}", k, f"text {i} {k}") for i in range(60) for k in range(2)] + [(None, 0, "of no document")]
    table = V.Bucketed(spark, path, buckets=16).create(spark.createDataFrame(rows, SCHEMA))
    before = files(path)
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(rows, key=str)
    touched = table.replace(spark.createDataFrame([("d3", 0, "new"), ("d999", 0, "first")], SCHEMA), spark.createDataFrame([("d7",), (None,)], "doc_id string"))
    want = [r for r in rows if r[0] not in ("d3", "d7", None)] + [("d3", 0, "new"), ("d999", 0, "first")]
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted(want, key=str)
    after = files(path)
    assert 0 < len(touched) < 5 and {b for b in before if before[b] != after.get(b)} <= {f"__bucket={b}" for b in touched}
    assert sum(before[b] == after.get(b) for b in before) >= len(before) - len(touched)


def test_a_bucket_may_become_empty(spark, tmp_path):
    table = V.Bucketed(spark, str(tmp_path / "t"), buckets=4).create(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], SCHEMA))
    table.replace(spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a",), ("b",)], "doc_id string"))
    assert table.read().count() == 0
    assert table.replace(spark.createDataFrame([], SCHEMA)) == []
    table.replace(spark.createDataFrame([("a", 2, "z")] * 2, SCHEMA))
    assert [tuple(r) for r in table.read().collect()] == [("a", 2, "z")] * 2


@pytest.mark.parametrize("parts", [1, 6])
def test_changed_documents_are_named(spark, tmp_path, parts):
    rows = [(f"d{i}", k, f"text {i} {k}") for i in range(300) for k in range(2)] + [("null", 0, None), (None, 0, "x"), ("copies", 0, "y"), ("copies", 0, "y")]
    new = [r for r in rows if r[0] != "d5"] + [("fresh", 0, "z"), ("copies", 0, "y")]
    new = [("d9", 0, "other") if r[:2] == ("d9", 0) else ("null", 0, "") if r[0] == "null" else r for r in new]
    stamped = lambda name, r: V.Stamped(spark, str(tmp_path / name)).write(spark.createDataFrame(r, SCHEMA).repartition(parts))
    a, b = stamped("a", rows), stamped("b", new)
    assert {tuple(r) for r in V.changes(a, b).collect()} == {("d5", "removed"), ("fresh", "added"), ("copies", "changed"), ("d9", "changed"), ("null", "changed")}
    assert 0 < len(V.differing(a, b)) <= 5 and V.differing(a, stamped("c", rows[::-1])) == []
    assert {tuple(r) for r in V.changes(stamped("d", [(None, 0, "x")]), stamped("e", [(None, 0, "w")])).collect()} == {(None, "changed")}
