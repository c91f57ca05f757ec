"""Choosing passages of each query under a budget.

The sequential choices see one query's candidates (a pool of some dozens), so they run as grouped Arrow
functions; the others are windows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def skip_greedy_of(costs: list[int], budget: int) -> list[int]:
    """Items in order; one that does not fit is passed over."""
    out, used = [], 0
    for i, c in enumerate(costs):
        if used + c <= budget:
            out.append(i)
            used += c
    return out


def knapsack_of(costs: list[int], values: list[float], budget: int) -> list[int]:
    """The items of greatest value within the budget; of equal ones, those found first."""
    best: list[tuple[float, tuple]] = [(0.0, ())] * (budget + 1)
    for i, (c, v) in enumerate(zip(costs, values, strict=True)):
        for room in range(budget, c - 1, -1):
            with_ = best[room - c][0] + v
            if with_ > best[room][0] + 1e-12:
                best[room] = (with_, (*best[room - c][1], i))
    return list(best[budget][1])


def progressive_of(sources: list, costs: list[int], budget: int, most: int = 20) -> list[int]:
    """At most 1, then 2, ... items of a source, in order, while they fit."""
    taken: list[int] = []
    used = 0
    for cap in range(1, most + 1):
        before = len(taken)
        for i, (s, c) in enumerate(zip(sources, costs, strict=True)):
            if i not in taken and sum(sources[j] == s for j in taken) < cap and used + c <= budget:
                taken.append(i)
                used += c
        if len(taken) == before:
            break
    return taken


def distinct_of(vectors: list, k: int, most: float) -> list[int]:
    """Items in order that are no more similar (cosine) than `most` to any taken before."""
    import numpy as np

    taken: list[int] = []
    unit = [np.asarray(v, float) / max(float(np.linalg.norm(v)), 1e-9) for v in vectors]
    for i in range(len(unit)):
        if len(taken) == k:
            break
        if all(float(unit[i] @ unit[j]) <= most for j in taken):
            taken.append(i)
    return taken


def grouped(df: DataFrame, group: str, order: list[str], pick) -> DataFrame:
    """Rows that `pick` chooses of each group, which it gets in order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order, kind="stable").reset_index(drop=True)
        return frame.iloc[pick(frame)]

    return df.groupBy(group).applyInPandas(run, df.schema)


def skip_greedy(df: DataFrame, budget: int, group: str = "query", cost: str = "tokens", order: list[str] = ("rank", "unit")) -> DataFrame:
    return grouped(df, group, list(order), lambda f: skip_greedy_of(f[cost].tolist(), budget))


def knapsack(df: DataFrame, budget: int, group: str = "query", cost: str = "tokens", value: str = "value", order: list[str] = ("rank", "unit")) -> DataFrame:
    return grouped(df, group, list(order), lambda f: knapsack_of(f[cost].tolist(), f[value].tolist(), budget))


def progressive(df: DataFrame, budget: int, group: str = "query", cost: str = "tokens", source: str = "source", order: list[str] = ("rank", "unit")) -> DataFrame:
    return grouped(df, group, list(order), lambda f: progressive_of(f[source].tolist(), f[cost].tolist(), budget))


def mmr(df: DataFrame, k: int, most: float = 0.9, group: str = "query", vector: str = "embedding", order: list[str] = ("rank", "unit")) -> DataFrame:
    return grouped(df, group, list(order), lambda f: distinct_of(f[vector].tolist(), k, most))


def mmr_text(df: DataFrame, k: int, most: float = 0.6, group: str = "query", text: str = "text", order: list[str] = ("rank", "unit")) -> DataFrame:
    """The same by the Jaccard similarity of character pairs."""

    def pick(frame: pd.DataFrame) -> list[int]:
        sets = [{t[i : i + 2] for i in range(len(t) - 1)} for t in frame[text]]
        taken: list[int] = []
        for i, s in enumerate(sets):
            if len(taken) < k and all(len(s & sets[j]) <= most * max(1, len(s | sets[j])) for j in taken):
                taken.append(i)
        return taken

    return grouped(df, group, list(order), pick)


def cap_per_source(df: DataFrame, most: int, group: str = "query", source: str = "source") -> DataFrame:
    w = Window.partitionBy(group, source).orderBy("rank", "unit")
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def lift_parents(segments: DataFrame, parent: str = "chunk_id", similarity: str = "similarity") -> DataFrame:
    """Chunks in the order of their best segment."""
    best = segments.groupBy("query", parent).agg(F.max(similarity).alias(similarity))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(similarity), parent)))


def expand_seeds(units: DataFrame, seeds: DataFrame, threshold: float, doc: str = "doc_id", order: str = "seq", depth: str = "depth") -> DataFrame:
    """Units of a document in one island with a seed: no boundary of at least this depth lies between."""
    w = Window.partitionBy(doc).orderBy(order)
    placed = units.withColumn("island", F.sum((F.coalesce(F.col(depth), F.lit(0.0)) >= threshold).cast("int")).over(w))
    chosen = placed.join(seeds.select(doc, order), [doc, order], "left_semi").select(doc, "island").distinct()
    return placed.join(chosen, [doc, "island"], "left_semi")


def pack(tiers: DataFrame, material: DataFrame, window: int, reserve: int = 0) -> DataFrame:
    """Material of each case that fits beside its fixed tiers, at least one passage.

    tiers: (case, fixed, recent, summary, excerpt) in tokens.  If all of it is too much, summary and excerpt go
    together before any material is cut; recent turns stay.
    """
    room = F.lit(window - reserve) - F.col("fixed") - F.col("recent")
    all_ = material.groupBy("case").agg(F.sum("tokens").alias("__all"))
    t = tiers.join(all_, "case", "left").withColumn("__all", F.coalesce("__all", F.lit(0)))
    t = t.withColumn("keeps_summary", room - F.col("summary") - F.col("excerpt") >= F.col("__all"))
    t = t.withColumn("room", F.when(F.col("keeps_summary"), room - F.col("summary") - F.col("excerpt")).otherwise(room))
    w = Window.partitionBy("case").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = material.withColumn("used", F.sum("tokens").over(w)).withColumn("__n", F.row_number().over(Window.partitionBy("case").orderBy("rank")))
    return rows.join(t.select("case", "room", "keeps_summary"), "case").filter((F.col("used") <= F.col("room")) | (F.col("__n") == 1)).drop("__n")
