"""Chains of rows that point at the next one, followed by pointer doubling.

After the i-th join a pointer spans 2**i links, so a chain of n rows takes log2(n) joins, and no chain, long as it
may be, is the work of one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkcorpus.store import Steps

#: Buckets of time whose order is found in one window.
COARSE = 1024


def depths_of_tree(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, depth, on_cycle) over rows of a child and its parent: how many parents are above each node.

    A child without parent, or a parent that is no child, has depth 0.  Depth is null for nodes on a cycle, which
    on_cycle tells, and for those below one.  Of several parents of a child the smallest counts.  Null children are left out.
    """
    steps = Steps(edges.sparkSession, "tree-depths")
    one = edges.filter(F.col(child).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("up"))
    tops = edges.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("node")).distinct().join(one.select("node"), "node", "left_anti")
    nodes = one.unionByName(tops.withColumn("up", F.lit(None).cast(one.schema["up"].dataType)))
    now = steps.keep(nodes.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "0")
    total, spanned, i = now.count(), 1, 0
    while spanned <= total and not now.filter("up is not null").isEmpty():
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = now.filter("up is not null").join(above, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        i, spanned = i + 1, spanned * 2
        now = steps.keep(now.filter("up is null").unionByName(moved), str(i))
        steps.drop(str(i - 1))
    # pointers that span more links than there are nodes end on cycles, and reach each node of one
    cycles = now.filter("up is not null").select(F.col("up").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    return now.join(cycles, "node", "left").select("node", F.when(F.col("up").isNull(), F.col("depth")).cast("int").alias("depth"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def following(buckets: DataFrame, group: str) -> DataFrame:
    """`buckets` (group, b, first) with `then`: the next larger b of the group, null at the end.

    Order is found within stretches of COARSE buckets, and among stretches, so a long history is many windows.
    """
    parts = buckets.withColumn("c", F.floor(F.col("b") / COARSE))
    ends = parts.groupBy(group, "c").agg(F.min("b").alias("least"))
    ends = ends.withColumn("after", F.lead("least").over(Window.partitionBy(group).orderBy("c"))).select(group, "c", "after")
    inside = F.lead("b").over(Window.partitionBy(group, "c").orderBy("b"))
    return parts.withColumn("then", inside).join(ends, [group, "c"]).select(group, "b", "first", F.coalesce("then", "after").alias("then"))


def next_beyond(times: DataFrame, group: str, t: str, span: int) -> DataFrame:
    """`times` (group, t; distinct) with `next`: the least time of the group above t + span.

    Time falls into buckets of `span`, so that time lies in the next bucket, where an as-of join finds it, or is
    the first of the first bucket after that one.
    """
    rows = times.select(group, F.col(t).alias("t")).withColumn("b", F.floor(F.col("t") / span))
    events = rows.select(group, "b", F.col("t").alias("at"), F.lit(0).alias("probe"), F.col("t").alias("own"))
    probes = rows.select(group, F.col("b") + 1, F.col("t") + span, F.lit(1), F.col("t")).toDF(group, "b", "at", "probe", "own")
    # from late to early, a probe sees last the event that comes first above it
    later = Window.partitionBy(group, "b").orderBy(F.desc("at"), F.desc("probe")).rowsBetween(Window.unboundedPreceding, -1)
    near = events.unionByName(probes).withColumn("next", F.last(F.when(F.col("probe") == 0, F.col("at")), ignorenulls=True).over(later)).filter("probe = 1").select(group, F.col("own").alias("t"), "next")
    buckets = following(rows.groupBy(group, "b").agg(F.min("t").alias("first")), group)
    one = buckets.select(group, F.col("b").alias("then"), F.col("first").alias("f1"), F.col("then").alias("then2"))
    two = buckets.select(group, F.col("b").alias("then2"), F.col("first").alias("f2"))
    far = buckets.join(one, [group, "then"]).join(two, [group, "then2"], "left").select(group, "b", F.when(F.col("then") > F.col("b") + 1, F.col("f1")).otherwise(F.col("f2")).alias("far"))
    out = near.withColumn("b", F.floor(F.col("t") / span)).join(far, [group, "b"], "left")
    return out.select(group, F.col("t").alias(t), F.coalesce("next", "far").alias("next"))


def spaced(times: DataFrame, group: str, t: str, span: int) -> DataFrame:
    """Of `times` (group, t; distinct), the first of each group, and always the first one more than `span` after the last taken.

    Pointers to the next time that is far enough are doubled; the times taken double with them.
    """
    steps = Steps(times.sparkSession, "spaced")
    jumps = steps.keep(next_beyond(times, group, t, span).filter("next is not null"), "jumps-0")
    taken = steps.keep(times.groupBy(group).agg(F.min(t).alias(t)), "taken-0")
    i = 0
    while True:
        more = taken.join(jumps, [group, t]).select(group, F.col("next").alias(t))
        more = steps.keep(more, f"more-{i}")
        if more.isEmpty():
            return taken
        twice = jumps.join(jumps.select(group, F.col(t).alias("next"), F.col("next").alias("next2")), [group, "next"]).select(group, t, F.col("next2").alias("next"))
        i += 1
        jumps, taken = steps.keep(twice, f"jumps-{i}"), steps.keep(taken.unionByName(more), f"taken-{i}")
        steps.drop(f"jumps-{i - 1}", f"taken-{i - 1}", f"more-{i - 1}")


def first_within(events: DataFrame, group: str, ts: Column, key: str, seconds: float) -> DataFrame:
    """Events that find no event of their group taken at most `seconds` before them; one that is not taken does not
    prolong that time.

    At one time the smallest key is taken.  Events without group or time are never taken.
    """
    rows = events.withColumn("__t", F.unix_micros(ts.cast("timestamp")))
    times = rows.filter(F.col(group).isNotNull() & F.col("__t").isNotNull()).groupBy(group, "__t").agg(F.min(key).alias(key))
    kept = spaced(times.select(group, "__t"), group, "__t", int(seconds * 1_000_000))
    return rows.join(times.join(kept, [group, "__t"]), [group, "__t", key], "left_semi").select(*events.columns)
