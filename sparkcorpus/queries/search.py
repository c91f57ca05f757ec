"""Search, fusion and vectors.  Queries are the rows whose id is divisible by 100, against all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparkcorpus.functions import vector as V
from sparkcorpus.operators import cluster, retrieval as R, selection, vector_index, vector_scan
from sparkcorpus.operators.relational import top_per_group
from sparkcorpus.queries.base import query



def vectors(t):
    e = t("embeddings")
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), e.withColumn("id", F.col("vec_id"))


def texts(t):
    """Documents as units, the vectors of those that have one (the embedding of the same id), and the queries among them."""
    units = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    e = t("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = units.filter("id % 100 = 0").join(e.filter("id % 100 = 0"), "id", "left")
    return q.select(F.col("id").alias("query"), F.col("content").alias("text"), F.col("embedding").alias("vector")), units, e


#: DuckDB: distinct ASCII terms of a text in order, 24 at most.
SQL_TERMS = """
 t0 AS (SELECT doc_id AS query, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{2,}')) AS term, unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9_]{2,}')))) AS place
        FROM documents WHERE doc_id % 100 = 0),
 t1 AS (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY min(place)) AS n FROM t0 GROUP BY query, term),
 terms AS (SELECT query, term, greatest(2, ceil(count(*) OVER (PARTITION BY query) * 0.25))::INTEGER AS least FROM t1 WHERE n <= 24),
 hits AS (SELECT query, d.doc_id AS unit, count(*)::INTEGER AS hits, any_value(least) AS least FROM terms JOIN documents d
          ON CASE WHEN contains(term, '_') THEN d.text ILIKE '%' || term || '%' ELSE contains(lower(d.text), lower(term)) END
          GROUP BY query, d.doc_id)"""
SQL_KEYWORD = """
 keyword AS (SELECT * FROM (SELECT query, unit, hits, least, row_number() OVER (PARTITION BY query ORDER BY hits DESC, unit)::INTEGER AS rank FROM hits) WHERE rank <= 30 AND hits >= least)"""


@query(
    f"""WITH {SQL_TERMS}, {SQL_KEYWORD},
 near AS (SELECT q.vec_id AS query, a.vec_id AS unit, list_cosine_distance(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
          FROM embeddings a JOIN embeddings q ON q.vec_id % 100 = 0 WHERE a.vec_id IN (SELECT doc_id FROM documents) AND q.vec_id IN (SELECT doc_id FROM documents)),
 vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, unit)::INTEGER AS rank FROM near) WHERE rank <= 30),
 both_ AS (SELECT query, unit, 0 AS channel, rank, distance, NULL::INTEGER AS hits FROM vec UNION ALL SELECT query, unit, 1, rank, NULL, hits FROM keyword),
 fused AS (SELECT query, unit, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(distance) AS distance, max(hits) AS hits, min(channel * 1000 + rank) AS first FROM both_ GROUP BY query, unit),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 12) DESC, first, unit)::INTEGER AS rank FROM fused WHERE distance IS NULL OR distance <= 0.6)
SELECT query, unit, round(rrf, 9) AS rrf, round(distance, 6) AS distance, hits, rank FROM ranked WHERE rank <= 8"""
)
def hybrid_search(spark, t):
    """Vector and keyword channels fused by rank."""
    q, units, e = texts(t)
    return R.search(q, units, vectors=e).select("query", "unit", F.round("rrf", 9).alias("rrf"), F.round("distance", 6).alias("distance"), "hits", "rank")


@query(f"WITH {SQL_TERMS}, {SQL_KEYWORD} SELECT query, unit, hits, rank FROM keyword WHERE rank <= 8")
def keyword_search(spark, t):
    """Distinct terms of each query that a text has."""
    units = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    q = units.filter("id % 100 = 0").select(F.col("id").alias("query"), F.col("content").alias("text"))
    return R.search(q, units, mode="keyword").select("query", "unit", "hits", "rank")


SQL_NEAR = """near AS (SELECT q.vec_id AS query, a.vec_id AS unit, a.label, list_cosine_distance(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS distance
          FROM embeddings a JOIN embeddings q ON q.vec_id % 100 = 0)"""


@query(f"WITH {SQL_NEAR} SELECT query, unit, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, unit)::INTEGER AS rank FROM near) WHERE rank <= 10")
def vector_topk(spark, t):
    """R2, O1: the ten nearest vectors."""
    q, units = vectors(t)
    return R.vector_channel(q, units, 10).select("query", "unit", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {SQL_NEAR} SELECT query, unit, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, unit)::INTEGER AS rank FROM near) WHERE rank <= 10")
def indexed_topk(spark, t):
    """R2, O1: the ten nearest vectors by the inverted file, all lists probed."""
    q, units = vectors(t)
    return vector_index.search(vector_index.build(units), q, 10).select("query", "unit", F.round("distance", 6).alias("distance"), "rank")


@query("SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def index_recall(spark, t):
    """R2, O1: whether the nearest ten are found at 0.9 or more in the lists that the index's own vectors ask for, against a full scan."""
    q, units = vectors(t)
    index = vector_index.build(units)
    found = vector_index.search(index, q, 10, probes=vector_index.probes_for(index, 10))
    return vector_index.recall(found, R.vector_channel(q, units, 10)).select("queries", (F.col("recall") >= 0.9).alias("reached"))


@query(f"WITH {SQL_NEAR} SELECT query, unit, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, unit)::INTEGER AS rank FROM near) WHERE rank <= 8 AND distance <= 0.6")
def vector_threshold(spark, t):
    """Nearest vectors within the distance threshold."""
    q, units = vectors(t)
    return R.search(q, units, mode="vector").select("query", "unit", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {SQL_NEAR} SELECT query, label, unit, round(distance, 6) AS distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY distance, unit)::INTEGER AS rn FROM near) WHERE rn <= 3")
def topk_per_group(spark, t):
    """Of each label, the three vectors nearest each query."""
    q, units = vectors(t)
    d = vector_scan.nearest(q, units, 3, group="label")
    return top_per_group(d, ["query", "label"], 3, F.asc("distance"), F.asc("unit")).select("query", "label", "unit", F.round("distance", 6).alias("distance"), "rn")


SQL_CASES = f"""WITH {SQL_NEAR}, r AS (SELECT *, (query // 500) AS "case", row_number() OVER (PARTITION BY query ORDER BY distance, unit) AS rank FROM near)"""


def cases(t):
    q, units = vectors(t)
    return R.vector_channel(q, units, 20).withColumn("case", F.floor(F.col("query") / 500).cast("long"))


@query(SQL_CASES + """ SELECT "case", unit, round(sum(1.0::DOUBLE / (60 + rank - 1)), 9) AS rrf, round(min(distance), 6) AS distance FROM r WHERE rank <= 20 GROUP BY "case", unit""")
def multi_query_rrf(spark, t):
    """A10: ranks summed and distances taken at their least over the queries of a case."""
    return R.min_distance_rrf(cases(t)).select("case", "unit", F.round("rrf", 9).alias("rrf"), F.round("distance", 6).alias("distance"))


@query(SQL_CASES + """, f AS (SELECT "case", unit, query, round(distance, 9) AS distance, row_number() OVER (PARTITION BY "case", unit ORDER BY query, rank) AS k FROM r WHERE rank <= 20)
SELECT "case", unit, round(distance, 6) AS distance, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY distance, unit)::INTEGER AS n FROM f WHERE k = 1) WHERE n <= 24""")
def rank_contexts(spark, t):
    """First finding of each unit, ranked by distance."""
    hits = cases(t).withColumns({"query_no": F.col("query"), "hits": F.lit(None).cast("int"), "distance": F.round("distance", 9)})
    return R.rank_contexts(hits).select("case", "unit", F.round("distance", 6).alias("distance"), "rank")


@query(f"""WITH {SQL_NEAR}, n AS (SELECT query, min(distance) AS nearest, count(*) FILTER (distance <= 0.3) AS within_30, count(*) FILTER (distance <= 0.4) AS within_40, count(*) FILTER (distance <= 0.5) AS within_50, count(*) FILTER (distance <= 0.6) AS within_60 FROM near WHERE query <> unit GROUP BY query)
SELECT query, query % 200 = 0 AS in_corpus, round(nearest, 6) AS nearest, within_30, within_40, within_50, within_60 FROM n""")
def threshold_counts(spark, t):
    """Least distance and counts at several thresholds in one pass."""
    q, units = vectors(t)
    return R.separation_of(q.withColumn("in_corpus", F.col("query") % 200 == 0), units).withColumn("nearest", F.round("nearest", 6))


@query(f"""WITH {SQL_NEAR}, n AS (SELECT query, min(distance) AS nearest FROM near WHERE query <> unit GROUP BY query), e AS (SELECT max(nearest) FILTER (query % 200 = 0) AS a, min(nearest) FILTER (query % 200 <> 0) AS b FROM n)
SELECT round(a, 6) AS inside_max, round(b, 6) AS outside_min, round(b - a, 6) AS gap, a < b AS separable FROM e""")
def separation_band(spark, t):
    """The gap between queries inside and outside the corpus."""
    q, units = vectors(t)
    return R.band(R.separation_of(q.withColumn("in_corpus", F.col("query") % 200 == 0), units)).select(*[F.round(c, 6).alias(c) for c in ("inside_max", "outside_min", "gap")], "separable")


SQL_MEANS = """x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
 m AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM x GROUP BY label, pos),
 c AS (SELECT label, max(n) AS size, list(m ORDER BY pos) AS centroid FROM m GROUP BY label)"""


@query(f"WITH {SQL_MEANS} SELECT label, pos::INTEGER AS pos, n AS size, round(m, 6) AS mean FROM m")
def cluster_centroids(spark, t):
    """Mean vectors by label, a row a component."""
    c = V.centroids(t("embeddings"), ["label"])
    return c.select("label", "size", F.posexplode("centroid").alias("pos", "mean")).select("label", "pos", "size", F.round("mean", 6).alias("mean"))


@query(f"""WITH {SQL_MEANS}, d AS (SELECT vec_id, c.label AS cluster, list_sum(list_transform(list_zip(e.embedding::DOUBLE[], c.centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings e, c)
SELECT vec_id, arg_min(cluster, d) AS cluster, round(min(d), 6) AS distance FROM d GROUP BY vec_id""")
def nearest_centroid(spark, t):
    """Each vector's nearest centre."""
    c = V.centroids(t("embeddings"), ["label"]).select(F.col("label").alias("cluster"), "centroid")
    return cluster.assign(t("embeddings"), c, "vec_id").withColumn("distance", F.round("distance", 6))


@query("""WITH s AS (SELECT label AS cluster, arg_min(embedding, vec_id)::DOUBLE[] AS centroid FROM embeddings GROUP BY label),
 d AS (SELECT vec_id, embedding, cluster, list_sum(list_transform(list_zip(embedding::DOUBLE[], centroid), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings, s),
 a AS (SELECT vec_id, any_value(embedding) AS embedding, arg_min(cluster, d) AS cluster FROM d GROUP BY vec_id),
 x AS (SELECT cluster, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM a)
SELECT cluster, pos::INTEGER AS pos, count(*) AS size, round(avg(x), 6) AS mean FROM x GROUP BY cluster, pos""")
def lloyd_step(spark, t):
    """One exact step of k-means from fixed seeds."""
    e = t("embeddings")
    seeds = e.groupBy(F.col("label").alias("cluster")).agg(F.min_by("embedding", "vec_id").alias("centroid"))
    out = cluster.lloyd_step(e, seeds, "vec_id")
    return out.select("cluster", "size", F.posexplode("centroid").alias("pos", "mean")).select("cluster", "pos", "size", F.round("mean", 6).alias("mean"))


@query()
def topic_tree(spark, t):
    """Spherical k-means into clusters, and of each cluster into parts, in whole numbers."""
    e = t("embeddings").filter(vector_index.usable(F.col("embedding"), 64))
    return cluster.spherical_tree(e, 6, 3, 5, "vec_id")


@query("""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 x AS (SELECT vec_id, label, sqrt(list_sum(list_transform(v, lambda a: a * a))) AS size, unnest(v) AS x, unnest(range(len(v))) AS pos FROM k),
 w AS (SELECT vec_id, label, pos, round(x / size * 32768) AS w FROM x), s AS (SELECT label, pos, sum(w) AS s, count(*) AS n FROM w GROUP BY label, pos),
 r AS (SELECT label, sqrt(sum(s * s)) AS size FROM s GROUP BY label)
SELECT s.label AS cluster, pos::INTEGER AS pos, n AS size, round(round(s.s / r.size * 32768) / 32768, 4) AS x FROM s JOIN r USING (label)""")
def spherical_step(spark, t):
    """Renormalised centres of labelled vectors, one step."""
    e = t("embeddings").filter("label is not null")
    sizes = e.groupBy(F.col("label").alias("cluster")).agg(F.count("*").alias("size"))
    labels = [r["label"] for r in e.select("label").distinct().collect()]
    centres = cluster.spherical_rounds(e, {g: np.ones((1, 64)) for g in labels}, 1, "embedding", "label")
    rows = [(g, i, float(x)) for g, own in centres.items() for i, x in enumerate(own[0] / cluster.FINE)]
    made = spark.createDataFrame(rows, "cluster int, pos int, x double")
    return made.join(sizes, "cluster").select("cluster", "pos", "size", F.round("x", 4).alias("x"))


@query(f"""WITH {SQL_MEANS}, d AS (SELECT q.vec_id AS query, c.label, list_cosine_distance(c.centroid, q.embedding::DOUBLE[]) AS d FROM embeddings q, c WHERE q.vec_id % 100 = 0),
 p AS (SELECT query, label FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, label) AS k FROM d) WHERE k <= 2)
SELECT query, e.vec_id AS unit FROM p JOIN embeddings e USING (label)""")
def narrow_scope(spark, t):
    """Members of the two clusters nearest each query."""
    q, _ = vectors(t)
    nodes = V.centroids(t("embeddings"), ["label"]).withColumn("id", F.col("label"))
    return R.narrow(q, nodes, 2, t("embeddings").select(F.col("label").alias("id"), F.col("vec_id").alias("unit")))


@query(f"""WITH {SQL_NEAR}, k AS (SELECT query, unit, distance FROM near WHERE unit % 2 = 1)
SELECT query, unit, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, unit)::INTEGER AS rank FROM k) WHERE rank <= 5""")
def exclude_then_topk(spark, t):
    """Exclusion below the ranking (here, even ids are excluded), so that five are found all the same."""
    q, units = vectors(t)
    gone = units.filter("id % 2 = 0").select("id")
    return R.vector_channel(q, units.join(gone, "id", "left_anti"), 5).select("query", "unit", F.round("distance", 6).alias("distance"), "rank")


@query("""WITH u AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INTEGER AS seq FROM embeddings),
 d AS (SELECT u.label, u.seq AS edge, list_cosine_distance(a.e, b.e) AS d FROM u JOIN u a ON a.label = u.label AND a.seq BETWEEN u.seq - 2 AND u.seq - 1 JOIN u b ON b.label = u.label AND b.seq BETWEEN u.seq AND u.seq + 1)
SELECT u.label, u.seq, round(avg(d.d), 6) AS depth FROM u LEFT JOIN d ON d.label = u.label AND d.edge = u.seq GROUP BY u.label, u.seq""")
def boundary_depth(spark, t):
    """Dissimilarity across each position."""
    from pyspark.sql.window import Window

    u = t("embeddings").withColumn("seq", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return cluster.depth_signal(u, "label").withColumn("depth", F.round("depth", 6)).select("label", "seq", "depth")


@query("""WITH u AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INTEGER AS seq FROM embeddings),
 d AS (SELECT u.label, u.seq, avg(list_cosine_distance(a.e, b.e)) AS depth FROM u JOIN u a ON a.label = u.label AND a.seq BETWEEN u.seq - 2 AND u.seq - 1 JOIN u b ON b.label = u.label AND b.seq BETWEEN u.seq AND u.seq + 1 GROUP BY u.label, u.seq),
 s AS (SELECT label, avg(depth) + 0.5 * stddev_pop(depth) AS cut FROM d GROUP BY label),
 h AS (SELECT d.*, cut, max(depth) OVER (PARTITION BY d.label ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM d JOIN s USING (label)), k AS (SELECT label, seq, depth FROM h WHERE depth >= top AND depth > cut),
 j AS (SELECT *, CASE WHEN seq - lag(seq) OVER (PARTITION BY label ORDER BY seq) <= 2 THEN 0 ELSE 1 END AS new FROM k), g AS (SELECT *, sum(new) OVER (PARTITION BY label ORDER BY seq) AS g FROM j)
SELECT label, seq, round(depth, 6) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY label, g ORDER BY depth DESC, seq) AS n FROM g) WHERE n = 1""")
def boundary_peaks(spark, t):
    """Boundaries at local maxima of the depth."""
    from pyspark.sql.window import Window

    u = t("embeddings").withColumn("seq", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    return cluster.peaks(cluster.depth_signal(u, "label"), "label").withColumn("depth", F.round("depth", 6))


def pool(t):
    q, units = vectors(t)
    hits = R.vector_channel(q, units, 40).join(units.select(F.col("id").alias("unit"), "embedding", F.col("label").alias("source")), "unit")
    return hits.withColumns({"tokens": (F.col("unit") % 97 + 5).cast("int"), "value": 1 - F.col("distance")})


@query()
def knapsack_pack(spark, t):
    """The most valuable passages within a budget."""
    return selection.knapsack(pool(t), 300).select("query", "unit", "tokens", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE {SQL_NEAR}, p AS (SELECT *, (unit % 97 + 5)::INTEGER AS tokens, row_number() OVER (PARTITION BY query ORDER BY distance, unit)::INTEGER AS rank FROM near), c AS (SELECT * FROM p WHERE rank <= 40),
 w AS (SELECT query, unit, tokens, rank, tokens <= 300 AS ok, CASE WHEN tokens <= 300 THEN tokens ELSE 0 END AS used FROM c WHERE rank = 1
   UNION ALL SELECT c.query, c.unit, c.tokens, c.rank, w.used + c.tokens <= 300, CASE WHEN w.used + c.tokens <= 300 THEN w.used + c.tokens ELSE w.used END FROM w JOIN c ON c.query = w.query AND c.rank = w.rank + 1)
SELECT query, unit, tokens, rank FROM w WHERE ok""")
def skip_greedy_pack(spark, t):
    """In order, passing over what does not fit."""
    return selection.skip_greedy(pool(t), 300).select("query", "unit", "tokens", "rank")


@query()
def progressive_pack(spark, t):
    """One passage of each source, then two, while they fit."""
    return selection.progressive(pool(t), 300).select("query", "unit", "source", "tokens")


@query()
def mmr_filter(spark, t):
    """No passage too similar to one before it."""
    return selection.mmr(pool(t), 8, 0.6).select("query", "unit", "rank")


@query()
def kmeans_topics(spark, t):
    """K-means of all vectors."""
    return cluster.kmeans(t("embeddings"), 8).groupBy("cluster").agg(F.count("*").alias("size"))


@query(f"""WITH {SQL_NEAR}, p AS (SELECT *, (unit % 97 + 5)::INTEGER AS tokens, row_number() OVER (PARTITION BY query ORDER BY distance, unit)::INTEGER AS rank FROM near),
 s AS (SELECT *, sum(tokens) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM p WHERE rank <= 40)
SELECT query, unit, rank, used FROM s WHERE used <= 300""")
def prefix_pack(spark, t):
    """Passages up to the first that would exceed the budget."""
    from sparkcorpus.operators.relational import prefix_within

    return prefix_within(pool(t), ["query"], [F.asc("rank")], F.col("tokens"), 300).select("query", "unit", "rank", "used")
