"""Evaluation over the test tables: benchmark passages in documents, judges on conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.functions import text as X
from sparkcorpus.operators import evaluation as E
from sparkcorpus.operators import judges as J
from sparkcorpus.queries.base import query

SQL_FOUND = """b AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS k FROM benchmark), d AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS body FROM documents),
 found AS (SELECT item_id // 4 AS "case", item_id AS target, doc_id AS unit FROM b JOIN d ON body <> '' AND k <> '' AND (contains(body, k) OR contains(k, body)))"""


def found(t):
    targets = t("benchmark").select(F.floor(F.col("item_id") / 4).cast("long").alias("case"), F.col("item_id").alias("target"), F.col("text").alias("excerpt"))
    units = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return targets, E.find_excerpts(targets, units)


@query(f'WITH {SQL_FOUND} SELECT "case", target, unit FROM found')
def excerpt_find(spark, t):
    """Documents that hold a passage of the benchmark."""
    return found(t)[1]


@query("WITH " + SQL_FOUND + """, h AS (SELECT item_id // 4 AS "case", item_id AS target, count(f.unit) FILTER (f.unit % 2 = 0) > 0 AS hit FROM b LEFT JOIN found f ON f.target = item_id GROUP BY item_id)
SELECT "case", bool_and(hit) AS all_hit, round(avg(hit::INTEGER), 6) AS recall FROM h GROUP BY "case" """)
def all_hit(spark, t):
    """Whether even documents hold all passages of a case."""
    targets, hits = found(t)
    base = targets.select("case", "target").join(hits, ["case", "target"], "left")
    picked = t("documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("unit")).join(hits.select("case", "unit"), "unit")
    return E.all_hit(base, picked).withColumn("recall", F.round("recall", 6))


@query("""WITH q AS (SELECT vec_id AS "case", embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT "case", vec_id AS unit, list_cosine_distance(q.e, x.embedding::DOUBLE[]) AS d, x.label = q.label AS target FROM q JOIN embeddings x ON x.vec_id <> q."case"),
 r AS (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY d, unit) AS rank FROM d) SELECT "case", min(rank) FILTER (target)::INTEGER AS best, coalesce(min(rank) FILTER (target) = 1, false) AS first, coalesce(min(rank) FILTER (target) <= 10, false) AS in_k FROM r GROUP BY "case" """)
def self_hit(spark, t):
    """Rank of the nearest vector of a query's own label."""
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), "label")
    units = e.select(F.col("vec_id").alias("id"), "embedding", "label")
    if units.limit(2).count() < 2:
        q = q.limit(0)  # a case without any other vector has no row
    return E.self_ranks(q, units, "label", 10).withColumn("best", F.col("best").cast("int"))


SQL_PARAGRAPHS = """p AS (SELECT doc_id AS doc, unnest(split(text, chr(10))) AS p, unnest(range(1, len(split(text, chr(10))) + 1)) AS place FROM documents), s AS (SELECT doc, count(*) AS n FROM p GROUP BY doc)"""


def cuts(t):
    """Lines as units; boundaries after each third line, and after each line with less than 200 characters."""
    p = t("documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("at", "p")).withColumn("at", F.col("at") + 1)
    sizes = p.groupBy("doc").agg(F.count("*").cast("int").alias("n"))
    inside = p.join(sizes, "doc").filter(F.col("at") < F.col("n"))
    return inside.filter("at % 3 = 0").select("doc", "at"), inside.filter(F.length("p") < 200).select("doc", "at"), sizes


@query("WITH " + SQL_PARAGRAPHS + """, i AS (SELECT p.*, n FROM p JOIN s USING (doc) WHERE place < n), r AS (SELECT doc, place FROM i WHERE place % 3 = 0), h AS (SELECT doc, place FROM i WHERE length(p) < 200),
 w AS (SELECT doc, n, unnest(range(1, n - 5 + 1)) AS i FROM s WHERE n > 5),
 rr AS (SELECT w.doc, w.i, count(*) AS c FROM w JOIN r ON r.doc = w.doc AND r.place > w.i AND r.place <= w.i + 5 GROUP BY ALL), hh AS (SELECT w.doc, w.i, count(*) AS c FROM w JOIN h ON h.doc = w.doc AND h.place > w.i AND h.place <= w.i + 5 GROUP BY ALL),
 f AS (SELECT w.doc, sum((coalesce(rr.c, 0) <> coalesce(hh.c, 0))::INTEGER) / any_value(n - 5) AS d FROM w LEFT JOIN rr USING (doc, i) LEFT JOIN hh USING (doc, i) GROUP BY w.doc)
SELECT s.doc, round(coalesce(f.d, 0.0), 6) AS windowdiff FROM s LEFT JOIN f USING (doc)""")
def windowdiff(spark, t):
    """Disagreement of two segmentations."""
    ref, hyp, sizes = cuts(t)
    return E.window_diff(ref, hyp, sizes).withColumn("windowdiff", F.round("windowdiff", 6))


@query("""SELECT count(*) FILTER (s AND q) AS tp, count(*) FILTER (s AND NOT q) AS fp, count(*) FILTER (NOT s AND q) AS fn, count(*) FILTER (NOT s AND NOT q) AS tn FROM (SELECT n_chars >= 500 AS s, quality = 1 AS q FROM documents JOIN labels USING (doc_id))""")
def contingency(spark, t):
    """Long documents against labels."""
    d = t("documents").join(t("labels"), "doc_id")
    return E.contingency(d, F.col("n_chars") >= 500, F.col("quality") == 1)


@query("""WITH h AS (SELECT CASE WHEN n_chars <= 100 THEN 0 WHEN n_chars <= 1000 THEN 1 WHEN n_chars <= 10000 THEN 2 ELSE 3 END AS bucket, toxic FROM documents JOIN labels USING (doc_id)) SELECT bucket, count(*) AS n, count(*) FILTER (toxic = 1) AS reached FROM h GROUP BY bucket""")
def length_histogram(spark, t):
    """Buckets with how many of each reach a condition."""
    return E.histogram(t("documents").join(t("labels"), "doc_id"), F.col("n_chars"), F.col("toxic") == 1, [100, 1000, 10_000])


SQL_ARMS = """a AS (SELECT user_id AS "case", round(avg(value) FILTER (event_id % 2 = 0), 1) AS x, round(avg(value) FILTER (event_id % 2 = 1), 1) AS y FROM events GROUP BY user_id)"""


@query("WITH " + SQL_ARMS + " SELECT count(*) FILTER (x > y) AS win, count(*) FILTER (x < y) AS lose, count(*) FILTER (x = y) AS tie FROM a WHERE x IS NOT NULL AND y IS NOT NULL")
def paired_counts(spark, t):
    """Wins, losses and ties of two arms."""
    return sign_test(t).drop("p")


def sign_test(t):
    """Means are rounded to nine digits first: a mean halfway between two scores goes up, in whatever order it was summed."""
    arm = lambda k: t("events").filter(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("case")).agg(F.round(F.round(F.avg("value"), 9), 1).alias("score"))
    return E.paired(arm(0), arm(1))


@query()
def paired_sign_test(spark, t):
    """The same with the p of the sign test."""
    return sign_test(t)


SQL_ANSWERS = """a AS (SELECT conv_id * 1000 + turn AS id, text AS answer, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations)"""


def answers(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"), F.lag("text").over(w).alias("source"))


@query("WITH " + SQL_ANSWERS + """, n AS (SELECT id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(answer, '\\[(\\d{1,2})\\]', ' ', 'g'), '\\s+', '', 'g'), '\\d+(?:\\.\\d+)?'), lambda x: length(x) >= 2) AS n, regexp_replace(coalesce(source, ''), '\\s+', '', 'g') AS s FROM a)
SELECT id, len(n)::INTEGER AS numbers, len(list_filter(n, lambda x: NOT contains(s, x)))::INTEGER AS ungrounded FROM n""")
def number_grounding(spark, t):
    """Numbers of a message that the one before it does not have."""
    a = answers(t)
    return a.select("id", F.size(J.numbers(F.col("answer"))).alias("numbers"), F.size(J.ungrounded(F.col("answer"), F.coalesce("source", F.lit("")))).alias("ungrounded"))


@query("WITH " + SQL_ANSWERS + """, c AS (SELECT id, list_transform(regexp_extract_all(answer, '\\[(\\d{1,2})\\]', 1), lambda x: x::INTEGER) AS c FROM a)
SELECT id, len(c) > 0 AS has_cite, CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda n: n < 1 OR n > 9)) = 0 END AS cites_valid FROM c""")
def citation_valid(spark, t):
    """Whether citations name sources that exist (nine, here)."""
    c = F.col("answer")
    return answers(t).select("id", (F.size(J.cites(c)) > 0).alias("has_cite"), J.cites_valid(c, F.lit(9)).alias("cites_valid"))


@query("WITH " + SQL_ANSWERS + """, x AS (SELECT id, regexp_replace(answer, '\\s+', '', 'g') AS p, regexp_replace(coalesce(source, ''), '\\s+', '', 'g') AS q FROM a),
 ip AS (SELECT id, p, unnest(range(1, length(p) - 10)) AS i FROM x), iq AS (SELECT id, q, unnest(range(1, length(q) - 10)) AS i FROM x),
 gp AS (SELECT DISTINCT id, substr(p, i::INTEGER, 12) AS g FROM ip), gq AS (SELECT DISTINCT id, substr(q, i::INTEGER, 12) AS g FROM iq),
 np AS (SELECT id, count(*) AS n FROM gp GROUP BY id), nq AS (SELECT id, count(*) AS n FROM gq GROUP BY id), c AS (SELECT id, count(*) AS n FROM gp JOIN gq USING (id, g) GROUP BY id)
SELECT x.id, CASE WHEN np.n > 0 AND nq.n > 0 THEN round(coalesce(c.n, 0) / np.n, 6) END AS verbatim FROM x LEFT JOIN np USING (id) LEFT JOIN nq USING (id) LEFT JOIN c USING (id)""")
def verbatim_ratio(spark, t):
    """Share of a message's 12-character shingles that the one before it has."""
    return answers(t).select("id", F.round(J.verbatim_share(F.col("answer"), F.coalesce("source", F.lit(""))), 6).alias("verbatim"))


@query()
def longest_copies(spark, t):
    """The longest stretch that a message copies from the one before it."""
    return answers(t).select("id", X.longest_copy(F.col("answer"), F.coalesce("source", F.lit(""))).alias("copied"))


@query()
def judged_answers(spark, t):
    """All flags and the verdict of each message."""
    a = answers(t).select("id", F.lit("grounded").alias("kind"), F.lit("").alias("question"), "answer", F.coalesce("source", F.lit("")).alias("sources"), F.lit(9).alias("n_sources"))
    return J.passes(J.judge(a)).select("id", "has_cite", "cites_valid", "no_label", "no_echo", "copied", "pass")
