"""Pieces of the flows, each over whole tables: evidence, history, judges, topics, keys, bulk loads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.config import Conversation
from sparkcorpus.functions import text as X
from sparkcorpus.functions import vector as V
from sparkcorpus.operators import cache, chunker, cluster, conversation as C, evaluation as E, judges as J
from sparkcorpus.operators import relational as REL
from sparkcorpus.operators import retrieval as R
from sparkcorpus.operators import selection
from sparkcorpus.operators.chains import depths_of_tree
from sparkcorpus.queries.base import query
from sparkcorpus.queries.search import SQL_NEAR, vectors
from sparkcorpus.queries.talk import MESSAGES, messages
from sparkcorpus.sources import files, web
from sparkcorpus.streaming import guards as G

#: White space as Java's \s has it, for DuckDB.
SPACE = r"[\t\n\x0B\f\r ]"
SQL_TOP = f"{SQL_NEAR}, hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, unit)::INTEGER AS rank FROM near) WHERE rank <= 20)"


def hits(t, k: int = 20):
    q, units = vectors(t)
    return R.vector_channel(q, units, k)


# -- evidence ---------------------------------------------------------------------------------------------------------

SQL_SENTENCES = f"""{SQL_NEAR}, chunk_hits AS (SELECT query, unit // 10 AS chunk_id, row_number() OVER (PARTITION BY query ORDER BY distance, unit) AS k FROM near),
 picked AS (SELECT DISTINCT query, chunk_id FROM chunk_hits WHERE k <= 20), s AS (SELECT p.query, p.chunk_id, n.unit AS id, n.distance FROM picked p JOIN near n ON n.query = p.query AND n.unit // 10 = p.chunk_id)"""


def sentence_rows(t):
    """Vectors as sentences of chunks of ten; the chunks of the nearest twenty are picked."""
    q, units = vectors(t)
    s = units.select("id", F.floor(F.col("id") / 10).alias("chunk_id"), (F.col("id") % 10).alias("seq"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("text"), "embedding")
    return q, hits(t).select("query", F.floor(F.col("unit") / 10).alias("unit")).distinct(), s


@query(f"WITH {SQL_SENTENCES} SELECT query, chunk_id, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query, chunk_id ORDER BY distance, id) AS k FROM s) WHERE k <= 3")
def sentences_per_chunk(spark, t):
    """The best sentences of each picked chunk."""
    return R.top_sentences(*sentence_rows(t), per_chunk=3).select("query", "chunk_id", "id", F.round("distance", 6).alias("distance"))


@query(f"WITH {SQL_SENTENCES} SELECT query, chunk_id, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS k FROM s) WHERE k <= 12")
def sentences_overall(spark, t):
    """The best sentences of all picked chunks of a query."""
    return R.top_sentences(*sentence_rows(t), overall=12).select("query", "chunk_id", "id", F.round("distance", 6).alias("distance"))


@query(f"""WITH {SQL_SENTENCES}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS k FROM s) WHERE k <= 12),
 x AS (SELECT query, chunk_id, string_agg('s' || id, chr(10) ORDER BY id) AS text FROM c GROUP BY query, chunk_id)
SELECT p.query, p.chunk_id AS unit, coalesce(x.text, 'c' || p.chunk_id) AS text FROM picked p LEFT JOIN x USING (query, chunk_id)""")
def evidence_texts(spark, t):
    """Chosen sentences of each picked chunk in order, or the whole chunk."""
    q, picked, s = sentence_rows(t)
    chunks = s.select(F.col("chunk_id").alias("id")).distinct().withColumn("content", F.concat(F.lit("c"), F.col("id").cast("string")))
    return R.chunk_texts(picked, chunks, R.top_sentences(q, picked, s, overall=12)).select("query", "unit", "text")


@query(f"WITH {SQL_TOP}, b AS (SELECT query, unit // 10 AS chunk_id, max(1 - distance) AS s FROM hits GROUP BY query, unit // 10) SELECT query, chunk_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s DESC, chunk_id)::INTEGER AS rank FROM b")
def lift_parents(spark, t):
    """Chunks in the order of their best segment."""
    s = hits(t).select("query", F.floor(F.col("unit") / 10).alias("chunk_id"), (1 - F.col("distance")).alias("similarity"))
    return selection.lift_parents(s).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {SQL_TOP} SELECT query AS "case", CASE WHEN bool_or(1 - distance > 0.9 AND unit <> query) THEN 'a' WHEN bool_or(unit % 7 > 3) THEN 'b' ELSE 'c' END AS category FROM hits WHERE rank <= 4 GROUP BY query""")
def answer_category(spark, t):
    """Whether any block answers a case, whether it asks for knowledge at all."""
    h = hits(t, 4).select(F.col("query").alias("case"), F.when(F.col("unit") != F.col("query"), F.when(1 - F.col("distance") > 0.9, 1.0).otherwise(0.0)).otherwise(0.0).alias("answers"), ((F.col("unit") % 7) / 7.0).alias("knowledge"))
    return R.category(h)


@query(f"""WITH {SQL_TOP}, b AS (SELECT query, arg_max(unit, round(1 - distance, 9) * 1000 - rank / 1e6) AS unit, max(1 - distance) AS share FROM hits WHERE rank BETWEEN 2 AND 9 GROUP BY query)
SELECT query AS "case", CASE WHEN share >= 0.7 THEN unit END AS unit, round(share, 6) AS share FROM b""")
def best_passage(spark, t):
    """The passage with the largest share of nine, if it reaches the gate."""
    h = hits(t).filter("rank > 1").select(F.col("query").alias("case"), "unit", "rank", F.round(1 - F.col("distance"), 9).alias("share"))
    return R.best_passage(h).withColumn("share", F.round("share", 6))


@query(f"""WITH {SQL_TOP}, p AS (SELECT query, unit, CASE WHEN unit % 3 <> 0 THEN (unit % 11) / 11.0::DOUBLE END AS probability FROM hits)
SELECT query, unit, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY probability DESC NULLS LAST, unit)::INTEGER AS rank FROM p) WHERE rank <= 6""")
def rerank(spark, t):
    """Hits in the order of a judge's probability."""
    h = hits(t)
    return R.rerank(h, h.filter("unit % 3 <> 0").select("query", "unit", ((F.col("unit") % 11) / 11.0).alias("probability")), 6).select("query", "unit", "rank")


@query(f"""WITH {SQL_TOP}, a AS (SELECT query, unit, rank, 'small' AS arm, 20 + unit % 9 AS chars FROM hits UNION ALL SELECT query, unit, rank, 'large', 100 + unit % 9 FROM hits),
 u AS (SELECT *, sum(chars) OVER (PARTITION BY arm, query ORDER BY rank)::BIGINT AS used FROM a) SELECT arm, query, unit, used FROM u WHERE used <= 350""")
def equal_budget_arms(spark, t):
    """Arms over units of different sizes at one budget."""
    h = hits(t)
    arms = {name: h.withColumn("chars", F.lit(n) + F.col("unit") % 9) for name, n in (("small", 20), ("large", 100))}
    return R.multi_granularity(arms, 350).select("arm", "query", "unit", "used")


@query("""WITH u AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INTEGER AS seq, (vec_id * 37 % 100) / 100.0::DOUBLE AS depth FROM embeddings),
 i AS (SELECT *, sum((depth >= 0.9)::INTEGER) OVER (PARTITION BY label ORDER BY seq)::BIGINT AS island FROM u), s AS (SELECT DISTINCT label, island FROM i WHERE vec_id % 50 = 0)
SELECT i.label, i.seq, i.island FROM i SEMI JOIN s ON i.label = s.label AND i.island = s.island""")
def seed_islands(spark, t):
    """Units in one island with a seed, no deep boundary between."""
    u = t("embeddings").select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("seq"), ((F.col("vec_id") * 37 % 100) / 100.0).alias("depth"))
    return selection.expand_seeds(u, u.filter("vec_id % 50 = 0"), 0.9, doc="label").select("label", "seq", "island")


@query("""WITH x AS (SELECT vec_id // 20 AS doc_id, (vec_id % 20)::INTEGER AS seq, embedding::DOUBLE[] AS e, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i::INTEGER, 2))) AS g FROM (SELECT vec_id, embedding, md5(vec_id::VARCHAR) AS s FROM embeddings)),
 p AS (SELECT a.doc_id, a.seq AS i, b.seq AS j, list_cosine_similarity(a.e, b.e) AS cosine, len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) AS overlap FROM x a JOIN x b ON a.doc_id = b.doc_id AND b.seq - a.seq >= 8)
SELECT doc_id, i, j, round(cosine, 6) AS cosine, round(overlap, 6) AS overlap FROM p WHERE cosine >= 0.1 AND overlap <= 0.35""")
def similar_pairs(spark, t):
    """Pairs of units of one document, far apart, close in meaning and not in wording."""
    u = t("embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc_id"), (F.col("vec_id") % 20).cast("int").alias("seq"), "embedding", F.md5(F.col("vec_id").cast("string")).alias("content"))
    return E.similar_pairs(u, near=0.1).select("doc_id", "i", "j", *[F.round(c, 6).alias(c) for c in ("cosine", "overlap")])


@query(f"""WITH {SQL_NEAR}, d AS (SELECT query, min((distance, unit)) AS d FROM near WHERE unit = query + 1 OR unit = query + 7 GROUP BY query)
SELECT near.query AS "case", count(*) FILTER ((distance, unit) < d) + 1 AS rank FROM near JOIN d USING (query) GROUP BY near.query""")
def target_rank(spark, t):
    """How many units are nearer than the nearest target."""
    q, units = vectors(t)
    targets = q.select(F.col("query").alias("case"), F.explode(F.array(F.col("query") + 1, F.col("query") + 7)).alias("unit"))
    return E.target_rank(q, units, targets)


SQL_SPANS = """b AS (SELECT item_id, length(text) AS n FROM benchmark), tg AS (SELECT item_id AS "case", k AS target, item_id AS chunk_id, (k * n // 4)::INTEGER AS tl, (k * n // 4 + n // 8)::INTEGER AS th FROM b, (VALUES (0), (2)) x(k)),
 ch AS (SELECT item_id AS "case", item_id AS chunk_id, (k * n // 8)::INTEGER AS cl, ((k + 1) * n // 8)::INTEGER AS ch FROM b, (VALUES (0), (3), (5)) x(k) WHERE k <> 5 OR item_id % 2 = 0)"""


@query(f"""WITH {SQL_SPANS}, k AS (SELECT tg."case", target, tl, th, coalesce(sum(least(ch, th) - greatest(cl, tl)) FILTER (cl IS NOT NULL), 0)::BIGINT AS kept FROM tg LEFT JOIN ch ON tg."case" = ch."case" AND tg.chunk_id = ch.chunk_id AND cl < th AND ch > tl GROUP BY ALL),
 z AS (SELECT "case", sum(ch - cl)::BIGINT AS chars FROM ch GROUP BY "case")
SELECT "case", bool_and(kept > 0) AS all_hit, round(sum(kept) / sum(th - tl), 6) AS retention, sum(kept)::BIGINT AS kept, any_value(chars) AS chars, round(sum(kept) / any_value(chars), 6) AS precision FROM k JOIN z USING ("case") GROUP BY "case" """)
def sentence_recall(spark, t):
    """Characters of target spans that chosen spans keep."""
    b = t("benchmark").select("item_id", F.length("text").alias("n"))
    part = lambda x, d: F.floor(x / d).cast("int")
    tg = b.select("item_id", "n", F.explode(F.array(F.lit(0), F.lit(2))).alias("k"))
    tg = tg.select(F.col("item_id").alias("case"), F.col("k").alias("target"), F.col("item_id").alias("chunk_id"), part(F.col("k") * F.col("n"), 4).alias("lo"), (part(F.col("k") * F.col("n"), 4) + part(F.col("n"), 8)).alias("hi"))
    ch = b.select("item_id", "n", F.explode(F.array(F.lit(0), F.lit(3), F.lit(5))).alias("k")).filter("k <> 5 or item_id % 2 = 0")
    ch = ch.select(F.col("item_id").alias("case"), F.col("item_id").alias("chunk_id"), part(F.col("k") * F.col("n"), 8).alias("char_start"), part((F.col("k") + 1) * F.col("n"), 8).alias("char_end"))
    return E.sentence_recall(tg, ch).select("case", "all_hit", F.round("retention", 6).alias("retention"), "kept", "chars", F.round("precision", 6).alias("precision"))


@query("""WITH f AS (SELECT role AS arm, 'asks' AS judge, contains(text, '?') AS ok FROM conversations UNION ALL SELECT role, 'long', length(text) > 60 FROM conversations UNION ALL SELECT role, 'odd', CASE WHEN turn % 2 = 0 THEN contains(text, 'a') END FROM conversations)
SELECT arm, judge, count(ok) AS n, round(avg(ok::INTEGER), 6) AS rate FROM f GROUP BY arm, judge""")
def judge_rates(spark, t):
    """Pass rate of each judge; null is not applicable."""
    c = F.col("text")
    flags = F.create_map(F.lit("asks"), F.contains(c, F.lit("?")), F.lit("long"), F.length(c) > 60, F.lit("odd"), F.when(F.col("turn") % 2 == 0, F.contains(c, F.lit("a"))))
    return E.judge_rates(t("conversations").select(F.col("role").alias("arm"), flags.alias("flags"))).withColumn("rate", F.round("rate", 6))


SQL_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i::INTEGER, 2)))"


@query(f"""WITH {MESSAGES}, r AS (SELECT conv_id, id, regexp_replace(content, '{SPACE}', '', 'g') AS x, regexp_replace(coalesce(first_value(content) OVER (PARTITION BY conv_id ORDER BY id), ''), '{SPACE}', '', 'g') AS q,
  regexp_replace(coalesce(lead(content) OVER (PARTITION BY conv_id ORDER BY id), ''), '{SPACE}', '', 'g') AS s FROM m),
 g AS (SELECT conv_id, id, {SQL_GRAMS.format('x')} AS g, {SQL_GRAMS.format('q')} AS q, {SQL_GRAMS.format('s')} AS s FROM r),
 b AS (SELECT *, coalesce(flatten(list(g) OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), []) AS b FROM g),
 c AS (SELECT conv_id, id, CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, s)) / len(g) END AS fs, CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, q)) / len(g) END AS fq, CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, list_distinct(b))) / len(g) END AS fb FROM b)
SELECT conv_id, id, CASE WHEN fs >= 0.6 THEN 'sources' WHEN fq >= 0.5 THEN 'question' WHEN fb >= 0.7 THEN 'repeats' ELSE 'own' END AS move, round(fs, 6) AS from_sources, round(fb, 6) AS from_before FROM c""")
def thinking_moves(spark, t):
    """Each message by what it repeats: the next one (as sources), the first one (as question), or those before."""
    m = messages(t)
    w = Window.partitionBy("conv_id").orderBy("id")
    steps = m.select(F.col("conv_id").alias("id"), F.col("id").alias("seq"), F.col("content").alias("text"), F.coalesce(F.lead("content").over(w), F.lit("")).alias("sources"), F.coalesce(F.first("content").over(w), F.lit("")).alias("question"), F.lit("").alias("rules"))
    return J.thinking_moves(steps).select(F.col("id").alias("conv_id"), F.col("seq").alias("id"), "move", F.round("from_sources", 6).alias("from_sources"), F.round("from_before", 6).alias("from_before"))


@query("""WITH a AS (SELECT doc_id, doc_id % 12 AS n, doc_id % 7 AS m FROM documents), c AS (SELECT doc_id, n, m FROM a UNION ALL SELECT doc_id, 3, 5 FROM a) SELECT doc_id AS id, count(*) AS cited, count(*) FILTER (n <= 5 AND m <= 5) AS valid FROM c GROUP BY doc_id""")
def check_addresses(spark, t):
    """Citations of sentences that exist (of five sources with sentences 0 to 5)."""
    d = t("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("so ["), (F.col("doc_id") % 12).cast("string"), F.lit("."), (F.col("doc_id") % 7).cast("string"), F.lit("] and [3.5]")).alias("answer"))
    six = F.array(*map(F.lit, range(6)))
    return J.check_addresses(d, d.select("id", F.explode(six).alias("n")).select("id", "n", F.explode(six).alias("m")))


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1")
def most_frequent(spark, t):
    """Each user's most frequent kind of event, ties to the smaller."""
    return REL.mode(t("events"), ["user_id"], "event_type")


@query(f"WITH {MESSAGES} SELECT role, count(*) AS runs, count(DISTINCT content) AS outputs, round(count(DISTINCT content) / count(*), 6) AS share FROM m GROUP BY role")
def distinct_outputs(spark, t):
    """How many different outputs repeated runs gave."""
    return E.distinct_outputs(messages(t).select(F.col("role").alias("case"), F.col("content").alias("output"))).select(F.col("case").alias("role"), "runs", "outputs", F.round("share", 6).alias("share"))


@query("""SELECT user_id AS run, event_type AS arm, count(*) AS cases, count(*) FILTER (value IS NULL OR value < 1) AS errors, floor(epoch(min(ts)))::BIGINT AS from_s, floor(epoch(max(ts)))::BIGINT AS to_s FROM events GROUP BY user_id, event_type""")
def run_listing(spark, t):
    """Recorded runs with their cases, errors and times."""
    e = t("events").select(F.col("user_id").alias("run"), F.col("event_type").alias("arm"), F.col("ts").cast("timestamp").alias("at"), F.coalesce(F.col("value") < 1, F.lit(True)).alias("failed"))
    return E.run_listing(e).select("run", "arm", "cases", "errors", F.unix_seconds("started").alias("from_s"), F.unix_seconds("ended").alias("to_s"))


@query("""WITH RECURSIVE r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 w AS (SELECT user_id, k, event_id, true AS ok, epoch_us(ts) + 200000000000 AS until FROM r WHERE k = 1
   UNION ALL SELECT r.user_id, r.k, r.event_id, epoch_us(r.ts) >= w.until, CASE WHEN epoch_us(r.ts) >= w.until THEN epoch_us(r.ts) + 200000000000 ELSE w.until END FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
SELECT user_id, event_id FROM w WHERE ok""")
def single_flight(spark, t):
    """Jobs that may start: of one key, none starts while another runs (each runs for 200,000 seconds)."""
    jobs = t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    return G.single_flight(jobs.withColumn("end", F.col("start") + 200_000_000_000), "user_id", "event_id")


# -- history and topics -----------------------------------------------------------------------------------------------


@query(f"""WITH {MESSAGES}, b AS (SELECT conv_id, max(id) FILTER (k = 3) AS boundary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM m) GROUP BY conv_id),
 q AS (SELECT m.*, last_value(CASE WHEN role = 'user' THEN id END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question_id FROM m),
 r AS (SELECT q.conv_id, q.id, question_id, row_number() OVER (PARTITION BY q.conv_id ORDER BY q.id) AS k FROM q JOIN b USING (conv_id) WHERE role = 'assistant' AND id % 4 <> 0 AND id <= boundary) SELECT conv_id, id, question_id FROM r WHERE k <= 2""")
def note_candidates(spark, t):
    """Answers outside the window without a note (here, one in four has one), a batch of each conversation."""
    m = messages(t).withColumn("index_text", F.when(F.col("id") % 4 == 0, F.lit("a note")))
    return C.note_candidates(m, Conversation(window=2, note_batch=2)).select("conv_id", "id", "question_id")


@query(f"""WITH {MESSAGES}, e AS (SELECT m.*, v.embedding::DOUBLE[] AS e FROM m LEFT JOIN embeddings v ON v.vec_id = (m.conv_id * 13 + m.turn) % 499),
 q AS (SELECT conv_id, id AS query, e AS v, count(*) OVER (PARTITION BY conv_id) AS n FROM e WHERE role = 'user'),
 p AS (SELECT e.* FROM e WHERE turn <> 0), d AS (SELECT q.conv_id, q.query, n, p.id, row_number() OVER (PARTITION BY q.query ORDER BY list_cosine_distance(p.e, q.v), p.id) AS k FROM q JOIN p USING (conv_id) WHERE p.e IS NOT NULL AND q.v IS NOT NULL),
 f AS (SELECT DISTINCT conv_id, unnest([id - 1, id, id + 1]) AS id FROM d WHERE k <= greatest(1, 4 // n) + 1 AND k <= 5),
 l AS (SELECT e.conv_id, e.id, length(CASE WHEN role = 'user' THEN '用户：' ELSE '助手：' END || content) AS n FROM e SEMI JOIN f ON e.conv_id = f.conv_id AND e.id = f.id),
 s AS (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n AS z FROM l), u AS (SELECT *, max(z) OVER (PARTITION BY conv_id ORDER BY id) AS most FROM s)
SELECT conv_id, id FROM u WHERE most <= 500""")
def recall_history(spark, t):
    """Messages near a conversation's questions, with their neighbours, within a budget; first turns are excluded."""
    v = t("embeddings").select(F.col("vec_id").alias("__v"), "embedding")
    m = messages(t).withColumn("__v", (F.col("conv_id") * 13 + F.col("turn")) % 499).join(v, "__v", "left").drop("__v").withColumn("index_text", F.lit(""))
    q = m.filter("role = 'user'").select(F.col("id").alias("query"), "conv_id", F.col("embedding").alias("vector"))
    return R.recall_history(q, m, m.filter("turn = 0"), 4, 500).select("conv_id", "id")


@query("SELECT topic, item FROM (SELECT user_id AS topic, arg_max(event_type, event_id) AS item, max(event_id) AS newest FROM events GROUP BY user_id) ORDER BY newest DESC, topic LIMIT 30")
def render_memory(spark, t):
    """The newest items of memory."""
    e = t("events").groupBy(F.col("user_id").alias("topic")).agg(F.max_by("event_type", "event_id").alias("item"), F.max("event_id").alias("updated_at"))
    return C.render_memory(e, 30).select("topic", "item")


@query("""WITH n AS (SELECT source AS label, count(*)::INTEGER AS size, CASE WHEN source > 'src3' THEN 'about ' || source ELSE '' END AS summary FROM documents GROUP BY source), l AS (SELECT *, '- ' || label || '（' || size || '）' || CASE WHEN summary <> '' THEN '：' || summary ELSE '' END AS line FROM n),
 s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (ORDER BY size DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) AS z FROM l), u AS (SELECT *, max(z) OVER (ORDER BY size DESC, label) AS most FROM s) SELECT label, size, line FROM u WHERE most <= 200""")
def topic_overview(spark, t):
    """Lines about the largest topics that fit a budget."""
    n = t("documents").groupBy(F.col("source").alias("label")).agg(F.count("*").cast("int").alias("size")).withColumn("summary", F.when(F.col("label") > "src3", F.concat(F.lit("about "), F.col("label"))).otherwise(F.lit("")))
    return cluster.overview(n, 200)


@query("SELECT lang, n AS chunk_count, 250 AS now, abs(250 - n) > 20 OR abs(250 - n) > 0.2 * n AS stale FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def topics_stale(spark, t):
    """Topics built over a number of chunks that is far from today's."""
    n = t("documents").groupBy("lang").agg(F.count("*").alias("chunk_count"))
    return n.join(cluster.is_stale(n, 250).distinct(), "chunk_count").select("lang", "chunk_count", "now", "stale")


@query("""WITH d AS (SELECT doc_id, [(doc_id % 9)::INTEGER, (doc_id % 5)::INTEGER, NULL, (doc_id % 13)::INTEGER, -1] AS ends, (6 + doc_id % 4)::INTEGER AS n FROM documents)
SELECT doc_id, array_to_string(list_append(list_sort(list_distinct(list_filter(ends, lambda x: x IS NOT NULL AND x >= 1 AND x < n))), n), ' ') AS ends FROM d""")
def repaired_ends(spark, t):
    """Segment ends as a model gives them, repaired."""
    d = F.col("doc_id")
    ends = F.array(*[(d % k).cast("int") for k in (9, 5)], F.lit(None).cast("int"), (d % 13).cast("int"), F.lit(-1))
    return t("documents").select("doc_id", F.array_join(cluster.repair_ends(ends, (6 + d % 4).cast("int")).cast("array<string>"), " ").alias("ends"))


@query("""WITH d AS (SELECT doc_id, text, (doc_id * 31 % 200)::INTEGER AS a FROM documents) SELECT doc_id, a = 0 OR regexp_matches(substr(text, a, 1), '[\\n。！？；：，、.!?;:,]') AS clean FROM d""")
def clean_starts(spark, t):
    """Whether a chunk that begins at a place begins cleanly."""
    return t("documents").select("doc_id", chunker.starts_clean(F.col("text"), (F.col("doc_id") * 31 % 200).cast("int")).alias("clean"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 <> 0 THEN 'About ' || source || chr(10) || text ELSE text END) AS md5 FROM documents")
def context_lines(spark, t):
    """X11: the text that is embedded, with its context line."""
    ctx = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("About "), F.col("source"))).otherwise(F.lit(" "))
    return t("documents").select("doc_id", F.md5(chunker.with_context(F.col("text"), ctx)).alias("md5"))


@query("""SELECT event_id, '{"a": ' || props || ', "s": "}{"}' AS object FROM events""")
def first_json(spark, t):
    """The first balanced object in a text; braces in strings do not count."""
    text = F.concat(F.lit('so {not: closed ... {"a": '), F.col("props"), F.lit(', "s": "}{"} and {"b": 1}'))
    text = F.replace(text, F.lit("{not: closed ... "), F.lit("then "))
    return t("events").select("event_id", X.first_json_object(text).alias("object"))


# -- texts, keys, bulk loads ------------------------------------------------------------------------------------------


@query(f"""WITH d AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}]')) AS c FROM documents)
SELECT doc_id, length(text) >= 150 AND c / length(text) >= 0.45 AS block, c / length(text) < 0.35 OR regexp_matches(text, '\\b(?:public|private|static|void|class|def|import|return|const|function)\\b') AS code,
 md5(regexp_replace(regexp_replace(text, '{SPACE}+', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')) AS collapsed, round(c / length(text), 6) AS cjk, length(regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g')) >= 2 AND regexp_matches(text, '[\\p{{L}}\\p{{Nd}}]') AS usable FROM d WHERE text <> ''""")
def text_flags(spark, t):
    """Kinds of texts, and texts with single spaces."""
    c = F.col("text")
    return t("documents").filter("text <> ''").select("doc_id", X.is_content_block(c).alias("block"), X.looks_like_code(c).alias("code"), F.md5(X.collapse(c)).alias("collapsed"), F.round(X.cjk_share(c), 6).alias("cjk"), X.usable_label(c).alias("usable"))


@query("""SELECT page_id, substr(sha256(url || chr(0) || page_id), 1, 12) AS id, sha256(md5(html) || chr(0) || 'v2' || chr(0)) AS parse_key,
 sha256(url || chr(0) || sha256(sha256('a') || ',' || sha256(url) || chr(0)) || chr(0) || sha256(chr(0)) || chr(0) || 'p' || chr(0) || 'm' || chr(0) || '0.1' || chr(0) || sha256('do') || chr(0)) AS answer_key, CASE WHEN page_id % 4 > 0 THEN round(page_id * 1000.0::DOUBLE / (page_id % 4), 6) ELSE 0 END AS rate FROM pages""")
def identity_keys(spark, t):
    """Keys of documents, parses and answers; tokens a second."""
    u = F.col("url")
    p = F.col("page_id").cast("string")
    answer = cache.answer_key(u, F.array(F.lit("a"), u), F.array().cast("array<string>"), F.lit("p"), F.lit("m"), F.lit(0.1), F.lit("do"))
    rate = F.round(X.tokens_per_second(F.col("page_id"), F.col("page_id") % 4), 6)
    return t("pages").select("page_id", X.document_id(u, p).alias("id"), cache.parse_key(F.md5("html"), "v2").alias("parse_key"), answer.alias("answer_key"), rate.alias("rate"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (1, 2, 3, 5, 8, 13, 21)")
def keyed_rows(spark, t):
    """Rows whose key is in a table and not in a list."""
    rows = REL.in_keys(t("documents"), "doc_id", t("labels").filter("quality = 1").select("doc_id"))
    return REL.without_ids(rows, "doc_id", [1, 2, 3, 5, 8, 13, 21]).select("doc_id", "lang")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND source IS NOT NULL")
def optional_filters(spark, t):
    """Equality filters; one without a value asks for nothing."""
    return REL.optional(t("documents"), lang="de", source=None).filter("source is not null").select("doc_id", "lang", "source")


@query("SELECT d.doc_id, v.embedding IS NULL AS missing, round(v.embedding[1]::DOUBLE, 6) AS first FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id")
def attached_vectors(spark, t):
    """Rows with the vectors of a bulk load."""
    d = t("documents").select("doc_id", F.lit(1).alias("seq"))
    v = t("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("seq"), "embedding")
    return files.attach_vectors(d, v, ["doc_id", "seq"]).select("doc_id", F.col("embedding").isNull().alias("missing"), F.round(F.try_element_at("embedding", F.lit(1)).cast("double"), 6).alias("first"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / greatest(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 1e-18), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def normalised(spark, t):
    """F16: vectors of length one."""
    n = t("embeddings").select("vec_id", V.normalise(F.col("embedding")).alias("u"))
    return n.select("vec_id", F.round(V.norm(F.col("u")), 6).alias("norm"), F.round(F.get("u", 0), 6).alias("first"))


@query("""SELECT doc_id, greatest(exp(-(doc_id % 5)), exp(-(doc_id % 7) - 0.5)) AS yes, CASE WHEN doc_id % 3 = 0 THEN exp(-1.0) END AS no FROM (SELECT doc_id FROM documents)""")
def token_shares(spark, t):
    """the largest probability of each token, spaces aside."""
    d = F.col("doc_id")
    one = lambda tok, lp: F.struct(F.lit(tok).alias("token"), lp.cast("double").alias("logprob"))
    entries = F.array(one("yes", -(d % 5)), one(" yes", -(d % 7) - 0.5), F.when(d % 3 == 0, one("no ", F.lit(-1.0))).otherwise(one("maybe", F.lit(-2.0))))
    p = X.token_probabilities(entries)
    return t("documents").select("doc_id", F.try_element_at(p, F.lit("yes")).alias("yes"), F.try_element_at(p, F.lit("no")).alias("no"))


@query("SELECT event_id FROM events WHERE abs(epoch_ms(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-15 00:00:00') // 1000) <= 86400")
def on_time(spark, t):
    """Events within the allowed skew of a clock."""
    return G.on_time(t("events"), F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 86_400).select("event_id")


@query("""WITH u AS (SELECT doc_id AS k, lang AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'label' FROM labels) SELECT k, v FROM u""")
def upsert(spark, t):
    """Rows of a key are replaced by new ones."""
    old = t("documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("v"))
    return REL.upsert(old, t("labels").select(F.col("doc_id").alias("k"), F.lit("label").alias("v")), ["k"])


@query("""SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, 0, 'new' FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 = 0)""")
def replaced_documents(spark, t):
    """What a new version has of a document replaces all that the old one had."""
    c = t("conversations").select("conv_id", "turn", "role")
    new = c.filter("conv_id % 3 = 0").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("new").alias("role")).distinct()
    return REL.replace_documents(c, new, "conv_id")


@query("""WITH h AS (SELECT url, source AS topic, row_number() OVER (PARTITION BY source ORDER BY page_id)::INTEGER AS rank FROM (SELECT url, page_id, 'q' || page_id % 5 AS source FROM pages UNION ALL SELECT url, page_id, 'q' || page_id % 3 FROM pages)),
 f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY topic, rank) AS k FROM h), g AS (SELECT topic, url, row_number() OVER (PARTITION BY topic ORDER BY rank, url) AS n FROM f WHERE k = 1) SELECT topic, url FROM g WHERE n <= 6""")
def corpus_growth(spark, t):
    """The first pages of each topic that no earlier topic has."""
    p = t("pages")
    h = p.select("url", "page_id", (F.col("page_id") % 5).alias("q")).unionByName(p.select("url", "page_id", (F.col("page_id") % 3).alias("q")))
    h = h.select("url", F.concat(F.lit("q"), F.col("q").cast("string")).alias("query"), F.row_number().over(Window.partitionBy("q").orderBy("page_id")).alias("rank"))
    return web.grow(h.select("query", F.col("query").alias("topic")).distinct(), h, 6).select("topic", "url")


@query("""WITH d AS (SELECT DISTINCT lang FROM documents), m AS (SELECT lang || '/' || 'model:' || length(lang) AS x FROM d UNION ALL SELECT '/bare' UNION ALL SELECT 'plain')
SELECT x, CASE WHEN strpos(x, '/') > 1 THEN split_part(x, '/', 1) END AS provider, CASE WHEN strpos(x, '/') > 1 THEN substr(x, strpos(x, '/') + 1) ELSE x END AS model FROM m""")
def model_refs(spark, t):
    """providers and models of references."""
    x = t("documents").select(F.concat("lang", F.lit("/model:"), F.length("lang").cast("string")).alias("x")).distinct()
    x = x.unionByName(spark.createDataFrame([("/bare",), ("plain",)], "x string"))
    return x.select("x", X.model_ref(F.col("x")).alias("r")).select("x", "r.provider", "r.model")


@query("""WITH f AS (SELECT user_id AS run, epoch_us(ts) AS t, (event_id % 9 + 1)::BIGINT AS len, event_id FROM events), c AS (SELECT *, sum(len) OVER (PARTITION BY run ORDER BY t, event_id) AS c1, sum(len) OVER (PARTITION BY run) * 0.5 AS goal, lag(t) OVER (PARTITION BY run ORDER BY t, event_id) AS t0 FROM f)
SELECT run, round((coalesce(t0, t) + (t - coalesce(t0, t)) * (goal - (c1 - len)) / len) / 1000.0)::BIGINT AS ms FROM c WHERE c1 - len < goal AND c1 >= goal""")
def half_time(spark, t):
    """When each run had sent half of its characters, by interpolation."""
    f = t("events").select(F.col("user_id").alias("run"), F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id").alias("at"), (F.col("event_id") % 9 + 1).alias("len"))
    # runs whose events share a time are told apart by id
    f = f.select("run", F.col("at.t").alias("t"), "len", F.col("at.event_id").alias("event_id")).orderBy("event_id")
    return G.time_at_share(f, 0.5).select("run", F.round(F.col("t") / 1000.0).cast("long").alias("ms"))


# -- small statements -------------------------------------------------------------------------------------------------


@query(f"""WITH {SQL_TOP}, tg AS (SELECT DISTINCT query FROM hits), g AS (SELECT query, k AS target, query + k AS unit FROM tg, (VALUES (0), (5)) x(k)), h AS (SELECT g.query, target, bool_or(hits.unit IS NOT NULL) AS hit FROM g LEFT JOIN hits ON hits.query = g.query AND hits.unit = g.unit GROUP BY ALL)
SELECT query AS "case", bool_and(hit) AS all_hit, round(avg(hit::INTEGER), 6) AS recall FROM h GROUP BY query""")
def ceiling(spark, t):
    """Whether the pool has all targets at all."""
    pool = hits(t).select(F.col("query").alias("case"), "unit")
    targets = pool.select("case").distinct().withColumn("target", F.explode(F.array(F.lit(0), F.lit(5)))).withColumn("unit", F.col("case") + F.col("target"))
    return E.all_hit(targets, pool).withColumn("recall", F.round("recall", 6))


@query(f"WITH {MESSAGES} SELECT u.user_id AS conv_id, coalesce(max(m.id), 0) AS newest FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN m ON m.conv_id = u.user_id GROUP BY u.user_id")
def newest_ids(spark, t):
    """A2: the newest id of each conversation, 0 where there is none."""
    users = t("events").select(F.col("user_id").alias("conv_id")).distinct()
    return users.join(messages(t), "conv_id", "left").groupBy("conv_id").agg(F.coalesce(F.max("id"), F.lit(0)).alias("newest"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 1")
def largest_source(spark, t):
    """The source with most documents."""
    return REL.top(t("documents").groupBy("source").agg(F.count("*").alias("n")), 1, F.desc("n"), F.asc("source"))


@query("""WITH b AS (SELECT item_id, length(text) AS n FROM benchmark), s AS (SELECT item_id, k AS span, k * n // 10 AS lo, (k + 1) * n // 10 AS hi FROM b, range(10) x(k)), p AS (SELECT item_id, j AS point, (j * 37) % n AS pos FROM b, range(4) y(j))
SELECT p.item_id, point, span FROM p JOIN s ON s.item_id = p.item_id AND pos >= lo AND pos < hi""")
def spans_of_points(spark, t):
    """The span that an offset lies in."""
    b = t("benchmark").select("item_id", F.length("text").alias("n"))
    s = b.select("item_id", "n", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("span")).withColumns({"lo": F.floor(F.col("span") * F.col("n") / 10), "hi": F.floor((F.col("span") + 1) * F.col("n") / 10)})
    p = b.select("item_id", "n", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("point")).withColumn("at", F.col("point") * 37 % F.col("n"))
    return E.contained(p.drop("n"), s.drop("n"), "item_id").select("item_id", F.col("point").cast("long").alias("point"), F.col("span").cast("long").alias("span"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations), f AS (SELECT conv_id, w, min(turn) AS t FROM w GROUP BY ALL), g AS (SELECT conv_id, t, count(*) AS n FROM f GROUP BY ALL),
 c AS (SELECT conv_id, t, sum(n) OVER (PARTITION BY conv_id ORDER BY t) AS seen, sum(n) OVER (PARTITION BY conv_id) AS whole FROM g)
SELECT conv_id, share, min(t) AS turn FROM c, (VALUES (0.5::DOUBLE), (0.8), (0.95)) x(share) WHERE seen >= share * whole GROUP BY conv_id, share""")
def coverage_crossings(spark, t):
    """The turn by which a conversation has had these shares of its words."""
    words = t("conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("w"))
    return E.first_crossings(words, "conv_id", "turn", "w", [0.5, 0.8, 0.95]).select("conv_id", "share", "turn")


@query(f"""WITH {SQL_TOP}, a AS (SELECT query, unit, distance, label, row_number() OVER (PARTITION BY query, label ORDER BY distance, unit) AS n FROM hits WHERE distance <= 0.9)
SELECT query, unit, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, unit)::INTEGER AS rank FROM a WHERE n <= 2) WHERE rank <= 6""")
def capped_arm(spark, t):
    """An evaluation arm: a pool within a distance, at most two of a source, the nearest six."""
    h = hits(t).join(t("embeddings").select(F.col("vec_id").alias("unit"), F.col("label").alias("source")), "unit")
    return E.arm(h, 6, cap=2, threshold=0.9).select("query", "unit", "rank")


@query("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_reverse(embedding::DOUBLE[]) AS r FROM embeddings), q AS (SELECT * FROM x WHERE vec_id % 100 = 0),
 a AS (SELECT q.vec_id AS query, x.vec_id AS unit, list_cosine_distance(x.e, q.e) AS d, list_cosine_distance(x.r[1:32], q.r[1:32]) AS d2 FROM q, x),
 v AS (SELECT query, unit, 0 AS channel, row_number() OVER (PARTITION BY query ORDER BY d, unit)::INTEGER AS rank, d FROM a), w AS (SELECT query, unit, 1 AS channel, row_number() OVER (PARTITION BY query ORDER BY d2, unit)::INTEGER AS rank, d2 AS d FROM a),
 u AS (SELECT * FROM v WHERE rank <= 30 UNION ALL SELECT * FROM w WHERE rank <= 30), f AS (SELECT query, unit, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(d) AS d, min(channel * 1000 + rank) AS first FROM u GROUP BY query, unit)
SELECT query, unit, round(rrf, 9) AS rrf, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(rrf, 12) DESC, first, unit)::INTEGER AS rank FROM f WHERE d <= 0.6) WHERE rank <= 8""")
def two_index_fusion(spark, t):
    """Two indexes over the same units (all of a vector; its last half, reversed) fused by rank."""
    q, units = vectors(t)
    half = lambda df, c: df.withColumn(c, F.slice(F.reverse(c), 1, 32))
    channels = [R.vector_channel(q, units, 30), R.vector_channel(half(q, "vector"), half(units, "embedding"), 30)]
    return R.rrf(channels, 8).select("query", "unit", F.round("rrf", 9).alias("rrf"), "rank")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label, list(m ORDER BY pos) AS c FROM m GROUP BY label)
SELECT e.label AS cluster, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], c.c)), 6) AS tightness FROM embeddings e JOIN c USING (label) GROUP BY e.label""")
def cluster_tightness(spark, t):
    """Mean cosine of members with their centroid."""
    return cluster.tightness(t("embeddings").withColumnRenamed("label", "cluster")).withColumn("tightness", F.round("tightness", 6))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL), d AS (SELECT x.label, x.vec_id, sum((x - m) * (x - m)) AS d FROM x JOIN m USING (label, pos) GROUP BY ALL)
SELECT label AS cluster, vec_id AS id, 'text of ' || vec_id AS content, round(d, 5) AS d FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k FROM d) WHERE k <= 5""")
def representatives(spark, t):
    """The members nearest each centroid, whose texts a label is made of."""
    m = t("embeddings").select(F.col("label").alias("cluster"), F.col("vec_id").alias("id"), F.concat(F.lit("text of "), F.col("vec_id").cast("string")).alias("content"), "embedding")
    return cluster.representatives(m).select("cluster", "id", "content", F.round("d", 5).alias("d"))


@query("""WITH RECURSIVE e AS (SELECT doc_id AS child, doc_id // 7 AS parent FROM documents WHERE doc_id > 0), w AS (SELECT DISTINCT parent AS node, 0 AS depth FROM e WHERE parent NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node)
SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY node""")
def tree_depths(spark, t):
    """Depths of the nodes of a tree."""
    return depths_of_tree(t("documents").filter("doc_id > 0").select(F.col("doc_id").alias("child"), F.floor(F.col("doc_id") / 7).alias("parent"))).select("node", "depth")


@query("""WITH u AS (SELECT conv_id AS doc_id, turn AS seq FROM conversations), b AS (SELECT conv_id AS doc_id, turn AS seq FROM conversations WHERE role = 'system' OR turn % 3 = 2) SELECT u.doc_id, u.seq, sum((b.seq IS NOT NULL)::INTEGER) OVER (PARTITION BY u.doc_id ORDER BY u.seq)::BIGINT AS segment FROM u LEFT JOIN b USING (doc_id, seq)""")
def segments(spark, t):
    """Units with the number of their segment."""
    u = t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), "role")
    return cluster.segments(u, u.filter("role = 'system' or seq % 3 = 2")).select("doc_id", "seq", "segment")


@query("SELECT vec_id, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first, round(1 - list_cosine_distance(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS same FROM embeddings")
def vector_literals(spark, t):
    """Vectors to literals and back."""
    v = V.decode(V.encode(F.col("embedding")))
    return t("embeddings").select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.get(v, 0).cast("double"), 6).alias("first"), F.round(V.score(V.cosine_distance(v, F.col("embedding"))), 6).alias("same"))


@query("SELECT lang, n, greatest(2, least(round(sqrt(n / 2.0)), 10, n))::INTEGER AS k FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def cluster_numbers(spark, t):
    """how many clusters for so many vectors."""
    n = t("documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.select("lang", "n", V.choose_k(F.col("n"), 10).alias("k"))


@query("""SELECT event_id, event_type AS topic, (event_id % 5)::VARCHAR AS old, (event_id % 3)::VARCHAR AS new, CASE WHEN event_id % 2 = 0 THEN '12' ELSE '' END AS lost FROM events""")
def summary_items(spark, t):
    """Items `topic：old → new`, and numbers that a list cut short."""
    e = F.col("event_id")
    item = F.concat("event_type", F.lit("： "), (e % 5).cast("string"), F.lit(" → "), (e % 3).cast("string"))
    cut = F.when(e % 2 == 0, "limit 12: 345").otherwise("limit 12345: x")
    p = X.split_item(item)
    return t("events").select("event_id", p["topic"].alias("topic"), p["old"].alias("old"), p["new"].alias("new"), F.array_join(X.lost_digits(cut, F.lit("limit 12345")), " ").alias("lost"))


@query("SELECT user_id AS key, (count(*) FILTER (event_type = (SELECT min(event_type) FROM events)) + user_id % 3)::BIGINT AS hits, floor(epoch(max(ts) FILTER (event_type = (SELECT min(event_type) FROM events))))::BIGINT AS last_s FROM events GROUP BY user_id")
def touched_cache(spark, t):
    """D3: hits and last use summed from a log (of the first kind of event)."""
    e = t("events")
    first = e.agg(F.min("event_type").alias("k"))
    log = e.join(F.broadcast(first), F.col("event_type") == F.col("k")).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"))  # one row
    entries = e.select(F.col("user_id").alias("key")).distinct().withColumns({"hits": F.col("key") % 3, "last_hit_at": F.lit(None).cast("timestamp")})
    return cache.touched(entries, log).select("key", "hits", F.unix_seconds("last_hit_at").alias("last_s"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'error' ELSE event_type END AS status, CASE WHEN event_id % 3 = 0 THEN 'interrupted by a restart' ELSE '' END AS message FROM events")
def interrupted_tasks(spark, t):
    """Tasks that ran when the service stopped."""
    log = t("events").select("event_id", F.when(F.col("event_id") % 3 == 0, "running").otherwise(F.col("event_type")).alias("status"), F.lit("").alias("message"))
    return cache.interrupted(log)


@query("""SELECT 'documents' AS "table", count(*) AS left_ FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr') UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'fr'))""")
def cascade(spark, t):
    """Deleting documents with what refers to them."""
    from sparkcorpus.schemas import cascade_delete

    docs = t("documents").withColumnRenamed("doc_id", "id")
    out = cascade_delete(docs, docs.filter("lang = 'fr'"), [("labels", t("labels"), "doc_id", "doc_id"), ("conversations", t("conversations"), "conv_id", "conv_id")])
    rows = [df.agg(F.count("*").alias("left_")).select(F.lit(name or "documents").alias("table"), "left_") for name, df in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def duplicate_keys(spark, t):
    """Violations of a unique key."""
    from sparkcorpus.schemas import duplicate_keys as violations

    return violations(t("documents").select(F.md5("text").alias("md5")), ["md5"])


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN coalesce(CASE WHEN conv_id % 2 = 0 THEN 'new' END, role) ELSE role END AS role FROM conversations""")
def updated_rows(spark, t):
    """An update that keeps what is there where the new value is null."""
    c = t("conversations").select("conv_id", "turn", "role")
    new = F.when(F.col("conv_id") % 2 == 0, F.lit("new"))
    return REL.update(c, F.col("turn") % 3 == 1, role=F.coalesce(new, F.col("role")))


@query(f"""WITH {MESSAGES}, l AS (SELECT conv_id, id, trim(regexp_replace(unnest(split(content, chr(10))), '{SPACE}+', ' ', 'g')) AS line FROM m), h AS (SELECT DISTINCT l.conv_id, line FROM l JOIN m USING (id) WHERE m.turn <= 1)
SELECT l.conv_id, l.id, l.line FROM l JOIN m USING (id) WHERE m.turn > 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = l.conv_id AND h.line = l.line)""")
def stripped_repeats(spark, t):
    """U4: lines of an excerpt that the kept turns (the first two) do not have."""
    m = messages(t)
    lines = m.filter("turn > 1").select("conv_id", "id", F.explode(F.split("content", "\n")).alias("line")).withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " ")))
    return C.strip_repeats(lines, m.filter("turn <= 1")).select("conv_id", "id", "line")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace('Head' || chr(13) || chr(10) || text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^[\t\n\x0B\f\r ]+|[\t\n\x0B\f\r ]+$', '', 'g')) AS md5 FROM documents""")
def uploaded_texts(spark, t):
    """Uploaded text files: what may be stored, and its text."""
    d = t("documents").select("doc_id", F.concat(F.lit("a"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.encode(F.concat(F.lit("Head\r\n"), "text"), "UTF-8").alias("content"))
    return files.uploads(d).select("doc_id", F.md5(files.text_column()("content", "suffix")["text"]).alias("md5"))


@query(r"""SELECT doc_id, md5(concat_ws(chr(9), doc_id::VARCHAR, replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t'), '\N')) AS md5, true AS same FROM documents""")
def copy_round_trip(spark, t):
    """Rows in the interchange text format, and back."""
    line = files.copy_line(F.array(F.col("doc_id").cast("string"), F.col("text"), F.lit(None).cast("string")))
    d = t("documents").select("doc_id", "text", line.alias("line"))
    back = files.copy_row(F.col("line"))
    return d.select("doc_id", F.md5("line").alias("md5"), ((F.get(back, 1) == F.col("text")) & F.get(back, 2).isNull()).alias("same"))


@query("""WITH mat AS (SELECT conv_id AS "case", turn::INTEGER AS rank, (length(text) // 3)::BIGINT AS tokens FROM conversations), a AS (SELECT "case", sum(tokens)::BIGINT AS whole FROM mat GROUP BY "case"),
 t AS (SELECT "case", 150 - 20 - ("case" % 7) AS room, whole FROM a), k AS (SELECT "case", CASE WHEN room - 15 - 5 >= whole THEN room - 20 ELSE room END AS room, room - 20 >= whole AS keeps FROM t),
 u AS (SELECT *, sum(tokens) OVER (PARTITION BY "case" ORDER BY rank)::BIGINT AS used, row_number() OVER (PARTITION BY "case" ORDER BY rank) AS n FROM mat)
SELECT u."case", u.rank, u.used, k.keeps AS keeps_summary FROM u JOIN k USING ("case") WHERE used <= room OR n = 1""")
def packed_material(spark, t):
    """Material that fits beside the fixed tiers of a prompt."""
    m = t("conversations").select(F.col("conv_id").alias("case"), F.col("turn").cast("int").alias("rank"), F.floor(F.length("text") / 3).alias("tokens"))
    tiers = m.select("case").distinct().select("case", F.lit(20).alias("fixed"), (F.col("case") % 7).alias("recent"), F.lit(15).alias("summary"), F.lit(5).alias("excerpt"))
    return selection.pack(tiers, m, 150).select("case", "rank", "used", "keeps_summary")


@query("""WITH v AS (SELECT label, vec_id % 3 AS part, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings),
 p AS (SELECT label, part, pos, avg(x) AS x FROM v GROUP BY ALL), m AS (SELECT label % 4 AS topic, pos, avg(x) AS x FROM p GROUP BY ALL),
 c AS (SELECT topic, sum(x * x) AS s FROM m GROUP BY topic), r AS (SELECT label % 4 AS topic, count(*) AS size, count(DISTINCT vec_id % 10) AS documents, sum(vec_id)::BIGINT AS ids FROM embeddings GROUP BY label % 4)
SELECT 'topic ' || topic AS label, size, size AS chunks, documents, ids, round(s, 6) AS length FROM r JOIN c USING (topic)""")
def merged_labels(spark, t):
    """Topics (a third of a label's vectors each) whose labels agree become one, with the mean of their centroids."""
    e = t("embeddings").withColumn("cluster", F.struct("label", F.pmod("vec_id", F.lit(3)).alias("part")))
    rest = e.groupBy("cluster").agg(F.collect_set("vec_id").alias("chunk_ids"), F.collect_set(F.pmod("vec_id", F.lit(10))).alias("doc_ids"))
    nodes = V.centroids(e, ["cluster"]).join(rest, "cluster").withColumn("label", F.concat(F.lit("  topic "), F.pmod("cluster.label", F.lit(4)).cast("string"), F.lit(" ")))
    out = cluster.merge_labels(nodes.select("label", "size", "centroid", "chunk_ids", "doc_ids"))
    add = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return out.select("label", "size", F.size("chunk_ids").cast("long").alias("chunks"), F.size("doc_ids").cast("long").alias("documents"), add("chunk_ids", F.lit(0).cast("long")).alias("ids"), F.round(add(F.transform("centroid", lambda x: x * x), F.lit(0.0)), 6).alias("length"))


@query("""WITH t AS (SELECT DISTINCT conv_id AS doc, turn AS pos, role, length(text) AS size, contains(text, '?') AS asks FROM conversations), n AS (SELECT doc, count(*) AS n FROM t GROUP BY doc),
 c AS (SELECT DISTINCT doc, pos FROM t WHERE pos % 5 = 0 OR asks), must AS (SELECT DISTINCT doc, pos FROM t WHERE pos % 3 = 0), opt AS (SELECT DISTINCT doc, pos FROM t WHERE pos % 7 = 0), bad AS (SELECT doc, pos AS lo, pos + 2 AS hi FROM t WHERE size > 80),
 r AS (SELECT doc, avg(EXISTS (FROM c WHERE c.doc = must.doc AND abs(c.pos - must.pos) <= 1)::INTEGER) AS must_recall FROM must GROUP BY doc),
 w AS (SELECT c.doc, count(*) FILTER (EXISTS (FROM bad WHERE bad.doc = c.doc AND c.pos > lo AND c.pos <= hi)) AS wrong,
  count(*) FILTER (NOT EXISTS (FROM (FROM must UNION ALL FROM opt) a WHERE a.doc = c.doc AND abs(a.pos - c.pos) <= 1)) AS unmarked, count(*) AS cuts FROM c GROUP BY c.doc)
SELECT doc, n, round(must_recall, 6) AS must_recall, coalesce(wrong, 0) AS wrong, coalesce(unmarked, 0) AS unmarked, coalesce(cuts, 0) AS cuts, round(coalesce(cuts, 0) / n, 6) AS density FROM n LEFT JOIN r USING (doc) LEFT JOIN w USING (doc)""")
def segmentation_ruler(spark, t):
    """E5: cuts of conversations against boundaries that must or may be there and stretches that may not be cut."""
    c = t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("at"), "role", F.length("text").alias("size"), F.contains("text", F.lit("?")).alias("asks")).distinct()
    at = lambda kept: c.filter(kept).select("doc", "at").distinct()
    bad = c.filter("size > 80").select("doc", F.col("at").alias("lo"), (F.col("at") + 2).alias("hi"))
    sizes = c.groupBy("doc").agg(F.count("*").alias("n"))
    out = E.segmentation(at("at % 3 = 0"), at("at % 7 = 0"), bad, at("at % 5 = 0 or asks"), sizes)
    return out.select("doc", "n", F.round("must_recall", 6).alias("must_recall"), "wrong", "unmarked", "cuts", F.round("density", 6).alias("density"))
