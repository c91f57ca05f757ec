"""Topics: k-means, centroids, representatives, labels, and boundaries within documents."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.config import Topics
from sparkcorpus.functions import vector as V
from sparkcorpus.functions.text import clip, usable_label
from sparkcorpus.operators.relational import lines_within, top_per_group
from sparkcorpus.store import Steps


def kmeans(df: DataFrame, k: int, vector: str = "embedding", cosine: bool = False, conf: Topics = Topics()) -> DataFrame:
    """`df` with a cluster for each row that has a vector."""
    rows = df.filter(F.col(vector).isNotNull()).withColumn("__v", array_to_vector(V.doubles(F.col(vector))))
    model = KMeans(k=k, seed=conf.seed, maxIter=conf.iterations, featuresCol="__v", predictionCol="cluster", distanceMeasure="cosine" if cosine else "euclidean").fit(rows)
    return model.transform(rows).drop("__v")


#: Components of unit vectors and centres become whole numbers of this size, so that sums and products are exact in any order.
FINE = 1 << 15


def whole_units(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in whole numbers of 1 / FINE."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1))
    return np.rint(x / np.where(size > 0, size, 1.0)[:, None] * FINE)


def renormalised(sums: list[int]) -> list[int]:
    size = math.sqrt(sum(x * x for x in sums))
    return [round(x / size * FINE) for x in sums] if size else sums


def spherical_rounds(df: DataFrame, centres: dict[int, np.ndarray], rounds: int, vector: str, group: str | None = None) -> dict[int, np.ndarray]:
    """Centres (rows of whole numbers) of each group after rounds of spherical k-means, all groups in one aggregation a round.

    A vector goes to the centre of its group with the largest product, of equals the first; a centre becomes the sum of its
    unit vectors, made a unit again, and stays if it has none.  All of it is in whole numbers, so the result
    is the same however rows are dealt.  The centres of all groups are held by each task.
    """
    source = df.select((F.col(group) if group else F.lit(0)).cast("int").alias("g"), F.col(vector).cast("array<double>").alias("v"))

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        counts: Counter = Counter()
        for batch in batches:
            x, of = whole_units(batch.column(1)), batch.column(0).to_numpy()
            for g in np.unique(of).tolist():
                if g in centres:
                    own = x[of == g]
                    near = (own @ centres[g].T).argmax(axis=1)
                    for c in np.unique(near).tolist():
                        part = own[near == c].sum(axis=0).astype(np.int64)
                        sums[g, c] = sums[g, c] + part if (g, c) in sums else part
                        counts[g, c] += int((near == c).sum())
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.int64()))], ["g", "c", "n", "sums"])

    for _ in range(rounds):
        parts = source.mapInArrow(add, "g int, c int, n long, sums array<long>").select("g", "c", F.posexplode("sums").alias("pos", "x"))
        found: dict[tuple[int, int], list[int]] = {}
        for r in parts.groupBy("g", "c", "pos").agg(F.sum("x").alias("x")).collect():  # groups x centres x components
            found.setdefault((r["g"], r["c"]), [0] * centres[r["g"]].shape[1])[r["pos"]] = r["x"]
        centres = {g: np.array([renormalised(found[g, c]) if (g, c) in found else old.tolist() for c, old in enumerate(own)], dtype=np.float64) for g, own in centres.items()}
    return centres


def first_units(df: DataFrame, k: int, key: str, vector: str, group: str | None = None) -> dict[int, np.ndarray]:
    """The k rows of each group with the smallest hashes of their keys, as whole unit vectors."""
    rows = df.select((F.col(group) if group else F.lit(0)).cast("int").alias("g"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    out: dict[int, list] = {}
    for r in top_per_group(rows, ["g"], k, F.asc("h"), F.asc("key")).orderBy("g", "rn").collect():
        out.setdefault(r["g"], []).append(r["v"])
    return {g: whole_units(pa.array(v, pa.list_(pa.float64()))) for g, v in out.items()}


def spherical_centres(df: DataFrame, k: int, rounds: int = 8, key: str = "id", vector: str = "embedding") -> np.ndarray:
    """Unit vectors, k or as many as there are rows."""
    return spherical_rounds(df, first_units(df, k, key, vector), rounds, vector)[0] / FINE


def spherical_tree(df: DataFrame, k: int, below: int, rounds: int = 8, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, part): spherical k-means into k clusters, and of each cluster into `below` parts, clusters and their parts
    numbered from 0.  All clusters are divided together, in one aggregation a round.

    Rows whose vector is null are left out; vectors have one length and finite components.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["key"].dataType.simpleString()

    def placed(source: DataFrame, name: str, centres: dict[int, np.ndarray]) -> DataFrame:
        def place(batches):
            for batch in batches:
                x, of = whole_units(batch.column(1)), batch.column(2).to_numpy()
                near = np.zeros(len(x), dtype=np.int32)
                for g in np.unique(of).tolist():
                    near[of == g] = (x[of == g] @ centres[g].T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], [*batch.schema.names, name])

        return source.mapInArrow(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema) + f", {name} int")

    rows = rows.withColumn("g", F.lit(0))
    if rows.isEmpty():
        return rows.selectExpr(f"key AS {key}", "g AS cluster", "g AS part")
    top = spherical_rounds(rows, first_units(rows, k, "key", "v"), rounds, "v")
    steps = Steps(df.sparkSession, "spherical")
    first = steps.keep(placed(rows, "cluster", top).select("key", "v", "cluster"), "clusters")
    low = spherical_rounds(first, first_units(first, below, "key", "v", "cluster"), rounds, "v", "cluster")
    out = placed(first.select("key", "v", "cluster"), "part", low)
    return out.selectExpr(f"key AS {key}", "cluster", "part")


def assign(df: DataFrame, centres: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance): the nearest centre (cluster, centroid) of each vector; ties to the smaller cluster."""
    rows = df.filter(F.col(vector).isNotNull()).select(key, F.col(vector).alias("__v")).join(centres.select("cluster", "centroid"))
    d = V.squared_distance(F.col("__v"), F.col("centroid"))
    return rows.groupBy(key).agg(F.min(F.struct(d.alias("d"), "cluster")).alias("b")).select(key, F.col("b.cluster").alias("cluster"), F.col("b.d").alias("distance"))


def lloyd_step(df: DataFrame, centres: DataFrame, key: str = "id", vector: str = "embedding") -> DataFrame:
    """New centres (cluster, size, centroid); one that lost all its members stays where it was."""
    members = df.join(assign(df, centres, key, vector), key)
    new = V.centroids(members, ["cluster"], vector)
    kept = centres.join(new.select("cluster", F.col("size").alias("__n"), F.col("centroid").alias("__c")), "cluster", "left")
    return kept.select("cluster", F.coalesce("__n", F.lit(0)).alias("size"), F.coalesce("__c", V.doubles(F.col("centroid"))).alias("centroid"))


def tightness(members: DataFrame, vector: str = "embedding") -> DataFrame:
    """Mean cosine of members with their own centroid."""
    both = members.join(V.centroids(members, ["cluster"], vector), "cluster")
    return both.groupBy("cluster").agg(F.avg(1 - V.cosine_distance(F.col(vector), F.col("centroid"))).alias("tightness"))


def representatives(members: DataFrame, key: str = "id", text: str = "content", vector: str = "embedding", conf: Topics = Topics()) -> DataFrame:
    """Texts of the members nearest their centroid, clipped."""
    both = members.join(V.centroids(members, ["cluster"], vector), "cluster")
    near = both.select("cluster", key, text, V.squared_distance(F.col(vector), F.col("centroid")).alias("d"))
    return top_per_group(near, ["cluster"], conf.representatives, F.asc("d"), F.asc(key)).withColumn(text, clip(F.col(text), conf.clip))


def labelled(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Nodes with a usable label, or a text that names up to three of their documents."""
    names = F.array_join(F.slice(F.array_sort("doc_names"), 1, 3), "、")
    return nodes.withColumn("label", F.when(usable_label(F.col("label"), least), F.trim("label")).otherwise(F.concat(F.lit("《"), names, F.lit("》相关"))))


def merge_labels(nodes: DataFrame, weighted: bool = False) -> DataFrame:
    """Nodes with one label become one; its centroid is the mean of theirs, by size if `weighted`."""
    rows = nodes.withColumn("label", F.trim("label"))
    w = F.col("size") if weighted else F.lit(1)
    parts = rows.select("label", w.alias("w"), F.posexplode("centroid").alias("pos", "x")).groupBy("label", "pos").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))
    centre = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))
    rest = rows.groupBy("label").agg(F.sum("size").alias("size"), F.array_sort(F.flatten(F.collect_list("chunk_ids"))).alias("chunk_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_ids")))).alias("doc_ids"))
    return rest.join(centre, "label")


def distinctive_terms(members: DataFrame, text: str = "content", k: int = 3) -> DataFrame:
    """A label of each cluster from words that it has much more often than the others."""
    words = members.select("cluster", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}]{3,})"), 1))).alias("w"))
    inside = words.groupBy("cluster", "w").agg(F.count("*").alias("n"))
    total = words.groupBy("w").agg(F.count("*").alias("all"))
    best = top_per_group(inside.join(total, "w").withColumn("s", F.col("n") * F.col("n") / F.col("all")), ["cluster"], k, F.desc("s"), F.asc("w"))
    return best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "w"))), lambda x: x["w"]), " ").alias("label"))


def overview(nodes: DataFrame, budget: int = Topics().overview_chars) -> DataFrame:
    """Lines about the topics, largest first, that fit the budget."""
    line = F.concat(F.lit("- "), F.col("label"), F.lit("（"), F.col("size").cast("string"), F.lit("）"), F.when(F.trim("summary") != "", F.concat(F.lit("："), F.col("summary"))).otherwise(F.lit("")))
    rows = nodes.withColumns({"line": line, "__g": F.lit(1)})
    return lines_within(rows, ["__g"], [F.desc("size"), F.asc("label")], "line", budget).select("label", "size", "line")


def is_stale(meta: DataFrame, chunks_now: int, most: int = 20, share: float = 0.2) -> DataFrame:
    change = F.abs(F.lit(chunks_now) - F.col("chunk_count"))
    return meta.select("chunk_count", F.lit(chunks_now).alias("now"), ((change > most) | (change > share * F.col("chunk_count"))).alias("stale"))


def depth_signal(units: DataFrame, doc: str = "doc_id", order: str = "seq", vector: str = "embedding", width: int = 2) -> DataFrame:
    """Before each unit: 1 - mean cosine between the `width` units on either side.  The first has none."""
    n = units.select(doc, F.col(order).alias("i"), F.col(vector).alias("v"))
    edges = n.select(doc, F.col("i").alias("edge"))
    a = n.select(F.col(doc).alias("da"), F.col("i").alias("ia"), F.col("v").alias("va"))
    b = n.select(F.col(doc).alias("db"), F.col("i").alias("ib"), F.col("v").alias("vb"))
    # a unit is on the left of at most `width` edges and on the right of as many, so joins go by equal keys
    left = a.select("da", "va", F.explode(F.sequence(F.col("ia") + 1, F.col("ia") + width)).alias("edge"))
    right = b.select("db", "vb", F.explode(F.sequence(F.col("ib") - width + 1, F.col("ib"))).alias("e2"))
    pairs = left.join(right, (F.col("da") == F.col("db")) & (F.col("edge") == F.col("e2")))
    depth = pairs.groupBy(F.col("da").alias(doc), "edge").agg(F.avg(V.cosine_distance(F.col("va"), F.col("vb"))).alias("depth"))
    return edges.join(depth, [doc, "edge"], "left").withColumnRenamed("edge", order)


def peaks(depths: DataFrame, doc: str = "doc_id", order: str = "seq", sigmas: float = 0.5, near: int = 2) -> DataFrame:
    """Boundaries: local maxima (two on either side) above mean + sigmas * deviation; of near ones, the deepest."""
    stat = depths.groupBy(doc).agg((F.avg("depth") + F.lit(sigmas) * F.stddev_pop("depth")).alias("__cut"))
    w = Window.partitionBy(doc).orderBy(order)
    high = depths.join(stat, doc).withColumn("__top", F.max("depth").over(w.rowsBetween(-2, 2))).filter((F.col("depth") >= F.col("__top")) & (F.col("depth") > F.col("__cut")))
    grouped = high.withColumn("__g", F.sum(F.coalesce((F.col(order) - F.lag(order).over(w) > near).cast("int"), F.lit(1))).over(w))
    return top_per_group(grouped, [doc, "__g"], 1, F.desc("depth"), F.asc(order), name="__n").select(doc, order, "depth")


def segments(units: DataFrame, bounds: DataFrame, doc: str = "doc_id", order: str = "seq") -> DataFrame:
    """Units with the number of their segment: how many boundaries lie at or before them."""
    marked = units.join(bounds.select(doc, order, F.lit(1).alias("__b")), [doc, order], "left")
    return marked.withColumn("segment", F.sum(F.coalesce("__b", F.lit(0))).over(Window.partitionBy(doc).orderBy(order))).drop("__b")


def repair_ends(ends, n):
    """Segment ends as a model gives them: in range, sorted, distinct, the last one forced."""
    inside = F.filter(ends, lambda x: x.isNotNull() & (x >= 1) & (x < n))
    return F.array_append(F.array_sort(F.array_distinct(inside)), n)


def legal_bounds(frame_bounds: list[int], weak: set[int], n: int, shift: int = 3) -> list[int]:
    """Boundaries moved, by at most `shift` places, off positions that may not be cut; else dropped."""
    out: set[int] = set()
    for b in frame_bounds:
        spots = [b + s * d for d in range(shift + 1) for s in ((1, -1) if d else (1,))]
        hit = next((x for x in spots if 0 < x < n and x not in weak and x not in out), None)
        if hit is not None:
            out.add(hit)
    return sorted(out)


def bisect(lo: int, hi: int, choose, least: int = 2) -> list[tuple[int, int, int]]:
    """(level, lo, hi) of a binary tree of segments; `choose(lo, hi)` gives a cut or None."""
    out, todo = [], [(0, lo, hi)]
    while todo:
        level, a, b = todo.pop()
        out.append((level, a, b))
        cut = choose(a, b) if b - a >= 2 * least else None
        if cut is not None and a < cut < b:
            todo += [(level + 1, cut, b), (level + 1, a, cut)]
    return out
