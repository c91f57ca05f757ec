import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkcorpus.operators import chains
from sparkcorpus.streaming import guards as G

START = datetime(2024, 1, 1)
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def climbed(parent, node):
    seen = set()
    while parent.get(node) is not None:
        if node in seen:
            return None
        seen.add(node)
        node = parent[node]
    return len(seen)


def cycle_nodes(parent):
    out = set()
    for n in parent:
        cur, k = parent[n], 1
        while cur is not None and cur != n and k <= len(parent):
            cur, k = parent.get(cur), k + 1
        if cur == n:
            out.add(n)
    return out


def test_chain_of_ten_thousand_and_cycles(spark):
    parent = {i: i - 1 for i in range(1, 10_000)} | {20_000: 20_001, 20_001: 20_002, 20_002: 20_000, 20_005: 20_000, 30_000: 30_000, 40_000: None}
    edges = spark.createDataFrame([(c, p, "x") for c, p in parent.items()] + [(None, 7, "x")], "child long, parent long, depth string")
    got = {r["node"]: (r["depth"], r["on_cycle"]) for r in chains.depths_of_tree(edges).collect()}
    rings = {20_000, 20_001, 20_002, 30_000}
    assert got == {n: (n if n < 10_000 else 0 if n == 40_000 else None, n in rings) for n in {0, *parent}}


def test_random_forests(spark):
    rng = random.Random(3)
    parent = {i: rng.choice([None, rng.randrange(0, 60), rng.randrange(0, max(1, i))]) for i in range(80)}
    edges = spark.createDataFrame(list(parent.items()), "child long, parent long")
    got = {r["node"]: (r["depth"], r["on_cycle"]) for r in chains.depths_of_tree(edges).collect()}
    assert got == {n: (climbed(parent, n), n in cycle_nodes(parent)) for n in parent}
    assert chains.depths_of_tree(edges.limit(0)).count() == 0


def passed(events, seconds):
    """Ids of events that pass, one after the other."""
    last, out = {}, set()
    for i, nonce, t in sorted((e for e in events if e[1] is not None and e[2] is not None), key=lambda e: (e[2], e[0])):
        if nonce not in last or t > last[nonce] + timedelta(seconds=seconds):
            last[nonce] = t
            out.add(i)
    return out


def some_events(n=400):
    rng = random.Random(5)
    at = lambda: START + timedelta(seconds=rng.choice([rng.randrange(0, 9000), 600 * rng.randrange(0, 15)]))
    rows = [(i, rng.choice(["hot", "hot", "a", "b", f"n{i % 40}"]), at()) for i in range(n)]
    return rows + [(n + i, "verdict", START + timedelta(seconds=s)) for i, s in enumerate([0, 400, 700, 1000, 1400])] + [(9001, "edge", START), (9002, "edge", START + timedelta(seconds=600)), (9003, "edge", START + timedelta(seconds=600, microseconds=1))]


def test_refused_events_do_not_prolong_the_time_to_live(spark):
    rows = some_events() + [(7000, None, START), (7001, "a", None), (7002, "far", START), (7003, "far", START + timedelta(days=400))]
    df = spark.createDataFrame(rows, "event_id long, nonce string, ts timestamp").withColumn("t", F.lit("clash"))
    got = {r["event_id"] for r in G.replay_guard_batch(df, "nonce", "ts", "event_id", 600).collect()}
    assert got == passed(rows, 600)
    assert {r[0] for r in rows if r[1] == "verdict"} & got == {400, 402, 404}
    assert G.replay_guard_batch(df.limit(0), "nonce", "ts", "event_id", 600).count() == 0


def test_one_nonce_with_a_long_history(spark):
    """Far more buckets of time than one window orders, all of one nonce."""
    df = spark.range(6000).select(F.lit("n").alias("nonce"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.col("id").alias("event_id"))
    got = sorted(r["event_id"] for r in G.replay_guard_batch(df, "nonce", "ts", "event_id", 10).collect())
    assert got == list(range(0, 6000, 2))


def started(spark, source, schema, plan, sink, checkpoint, **trigger):
    q = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)).writeStream.foreachBatch(G.once(sink)).option("checkpointLocation", checkpoint).outputMode("append")
    return q.trigger(**trigger).start()


def test_stream_lets_pass_what_the_table_does(spark, tmp_path):
    spark.conf.set(*ROCKS)
    rows = sorted(some_events(200), key=lambda r: (r[2], r[0]))
    source = str(tmp_path / "events")
    for k in range(0, len(rows), 70):  # files in the order of time
        spark.createDataFrame(rows[k : k + 70], "event_id long, nonce string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    started(spark, source, "event_id long, nonce string, ts timestamp", lambda s: G.replay_guard(s, seconds=600), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert {r["event_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == passed(rows, 600)


def wait_for(spark, path, n):
    for _ in range(120):
        try:
            rows = spark.read.schema("conv_id long, id long, text string, batch long").parquet(path).collect()
            if len(rows) >= n:
                return rows
        except Exception as error:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
        time.sleep(0.5)
    pytest.fail(f"{path} has fewer than {n} rows")


def test_batches_survive_a_restart_and_time_out(spark, tmp_path):
    spark.conf.set(*ROCKS)
    source, sink, checkpoint, schema = *(str(tmp_path / x) for x in ("in", "out", "cp")), "conv_id long, id long, text string"
    add = lambda ids: spark.createDataFrame([(1, i, f"m{i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(source)
    plan = lambda s: G.in_batches(s, 4, 20.0)
    add([3, 1, 2])
    time.sleep(1.1)
    add([4, 5, 6])
    q = started(spark, source, schema, plan, sink, checkpoint, processingTime="300 milliseconds")
    assert sorted((r["batch"], r["id"]) for r in wait_for(spark, sink, 4)) == [(1, 1), (1, 2), (1, 3), (1, 4)]
    q.stop()
    add([7, 8, 9, 10])
    q = started(spark, source, schema, plan, sink, checkpoint, processingTime="300 milliseconds")
    rows = wait_for(spark, sink, 10)
    q.stop()
    assert sorted((r["batch"], r["id"], r["text"]) for r in rows) == [(1 + (i - 1) // 4, i, f"m{i}") for i in range(1, 11)]
