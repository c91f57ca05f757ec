"""Conversations, memory, event streams and their windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.operators import cache, conversation as C
from sparkcorpus.operators import relational as REL
from sparkcorpus.queries.base import query
from sparkcorpus.streaming import guards as G

#: Message ids: the place of (conversation, turn) in order.
MESSAGES = "m AS (SELECT conv_id, turn, role, text AS content, conv_id * 1000 + turn AS id FROM conversations)"


def messages(t):
    return t("conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"))


@query(f"WITH {MESSAGES} SELECT conv_id, id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM m) WHERE k <= 4")
def recent_window(spark, t):
    """The last four messages of each conversation."""
    return C.recent(messages(t), 4).select("conv_id", "id")


@query(f"WITH {MESSAGES} SELECT conv_id, max(id) FILTER (k = 4) AS boundary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM m) GROUP BY conv_id")
def id_at_offset(spark, t):
    """The id three messages before the newest; null if there is none."""
    return C.id_at_offset(messages(t), 3)


@query(f"""WITH {MESSAGES} SELECT conv_id, id, question_id, question FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN id END IGNORE NULLS) OVER w AS question_id, last_value(CASE WHEN role = 'user' THEN content END IGNORE NULLS) OVER w AS question
 FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant'""")
def question_before_answer(spark, t):
    """Each answer with the nearest question before it."""
    return C.question_before(messages(t)).select("conv_id", "id", "question_id", "question")


@query(f"WITH {MESSAGES}, p AS (SELECT conv_id, id FROM m WHERE role = 'system'), n AS (SELECT DISTINCT conv_id, unnest([id - 1, id, id + 1]) AS id FROM p) SELECT m.conv_id, m.id FROM m SEMI JOIN n ON n.conv_id = m.conv_id AND n.id = m.id")
def with_neighbours(spark, t):
    """System messages and the messages beside them, by id."""
    m = messages(t)
    return C.with_neighbours(m, m.filter("role = 'system'")).select("conv_id", "id")


@query(f"WITH {MESSAGES}, p AS (SELECT *, role = 'system' AS s FROM m), n AS (SELECT conv_id, id, s OR coalesce(lag(s) OVER w, false) OR coalesce(lead(s) OVER w, false) AS k FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY id)) SELECT conv_id, id FROM n WHERE k")
def with_neighbour_turns(spark, t):
    """The same by turn."""
    m = messages(t)
    return C.with_neighbours(m, m.filter("role = 'system'"), mode="turn").select("conv_id", "id")


@query("WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT c.conv_id, (SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'system') AS turns FROM c")
def turn_counts(spark, t):
    """Messages of a kind in each conversation, zero included."""
    m = messages(t)
    return C.turn_counts(m.select("conv_id").distinct(), m.filter("role = 'system'"))


@query(f"WITH {MESSAGES} SELECT conv_id, substr(regexp_replace(arg_min(content, id), '^\\s+|\\s+$', '', 'g'), 1, 30) AS title FROM m WHERE role = 'user' GROUP BY conv_id")
def titles(spark, t):
    """Titles from first questions."""
    return C.titles(messages(t))


@query(f"WITH {MESSAGES}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS k FROM m WHERE role = 'user' AND content <> '') SELECT conv_id, id FROM k WHERE k <= 2")
def pending_messages(spark, t):
    """M2: messages without a vector, a batch of each conversation (here, the questions have none)."""
    m = messages(t).withColumn("embedding", F.when(F.col("role") == "user", F.lit(None)).otherwise(F.array(F.lit(0.0))).cast("array<float>"))
    return C.pending_vectors(m, 2).select("conv_id", "id")


@query(f"""WITH {MESSAGES}, b AS (SELECT conv_id, max(id) FILTER (k = 3) AS boundary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS k FROM m) GROUP BY conv_id),
 r AS (SELECT m.conv_id, m.id, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.id) AS k FROM m JOIN b USING (conv_id) WHERE m.id > m.conv_id * 1000 AND m.id <= b.boundary), f AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM r WHERE k <= 2)
SELECT conv_id, id FROM f WHERE n = 2""")
def summary_range(spark, t):
    """The next full batch after the summarised part and outside the window."""
    from sparkcorpus.config import Conversation

    m = messages(t)
    upto = m.select("conv_id").distinct().withColumn("summary_upto", F.col("conv_id") * 1000)
    return C.summary_batches(m, upto, Conversation(window=2, summary_batch=2)).select("conv_id", "id")


@query(f"""WITH {MESSAGES}, s AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY conv_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(content) AS size FROM m),
 k AS (SELECT *, max(size) OVER (PARTITION BY conv_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS most FROM s) SELECT conv_id, id FROM k WHERE most <= 700""")
def history_budget(spark, t):
    """Lines while they fit a budget of characters."""
    return REL.lines_within(messages(t), ["conv_id"], [F.asc("id")], "content", 700).select("conv_id", "id")


@query("""WITH w AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events), c AS (SELECT * FROM w WHERE was IS NULL OR was <> event_type)
SELECT user_id, arg_max(event_type, event_id) AS now, arg_max(coalesce(was, '-'), event_id) AS was, count(*) AS writes FROM c GROUP BY user_id""")
def memory_last_value(spark, t):
    """M9 for exact topics: the last value of each topic, the one before it, and how often it was written."""
    return C.last_values(t("events"), "user_id", "event_type", "event_id").select("user_id", "now", F.coalesce("was", F.lit("-")).alias("was"), "writes")


@query()
def memory_absorb(spark, t):
    """M9: each user's memory after all lines (topic: kind of event; value: its number)."""
    lines = t("events").select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), F.concat(F.col("event_type"), F.lit("：— → "), F.get_json_object("props", "$.k")).alias("line"))
    memory = lines.limit(0).select("owner", F.col("line").alias("topic"), F.col("line").alias("item"))
    return C.absorb(memory, lines).select("owner", "topic", "item")


@query()
def memory_topics(spark, t):
    """Memory from what is said: the owner is a conversation, a topic the first words of a message, its value the number of characters; topics alike are one."""
    said = t("conversations").select(F.col("conv_id").alias("owner"), F.col("turn").alias("seq"), F.substring("text", 1, 14).alias("begin"), F.length("text").cast("string").alias("n"))
    lines = said.select("owner", "seq", F.concat("begin", F.lit("：— → "), "n").alias("line"))
    memory = lines.limit(0).select("owner", F.col("line").alias("topic"), F.col("line").alias("item"))
    return C.absorb(memory, lines).select("owner", "topic", "item")


SQL_SESSIONS = """e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events WHERE {where}),
 s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap >= INTERVAL {seconds} SECOND) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM e),
 w AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL {seconds} SECOND AS b, count(*) AS n FROM s GROUP BY user_id, s)"""


@query("WITH " + SQL_SESSIONS.format(where="event_type = (SELECT min(event_type) FROM events)", seconds=86400) + " SELECT user_id, floor(epoch(a))::BIGINT AS from_s, floor(epoch(b))::BIGINT AS to_s, n FROM w WHERE n >= 3")
def session_lockout(spark, t):
    """Runs of failures (the first kind of event), each within a day of the one before, of three or more."""
    e = t("events")
    kind = e.agg(F.min("event_type").alias("k"))
    fails = e.join(F.broadcast(kind), F.col("event_type") == F.col("k"))  # one row
    return G.lockouts(fails, "user_id", most=3, seconds=86_400).select("user_id", F.unix_seconds("start").alias("from_s"), F.unix_seconds("end").alias("to_s"), "n")


@query("WITH " + SQL_SESSIONS.format(where="true", seconds=20000) + " SELECT user_id, floor(epoch(a))::BIGINT AS from_s, floor(epoch(b))::BIGINT AS quiet_s, n FROM w")
def quiet_windows(spark, t):
    """T5: busy stretches of each user and when they fell quiet."""
    return G.quiet_gaps(t("events"), "user_id", seconds=20_000).select("user_id", F.unix_seconds("start").alias("from_s"), F.unix_seconds("quiet_from").alias("quiet_s"), "n")


@query("""WITH RECURSIVE passed AS (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type
   UNION ALL SELECT p.user_id, p.event_type, min(e.ts) FROM passed p JOIN events e ON e.user_id = p.user_id AND e.event_type = p.event_type AND e.ts > p.ts + INTERVAL 86400 SECOND GROUP BY p.user_id, p.event_type, p.ts)
SELECT min(event_id) AS event_id FROM passed JOIN events USING (user_id, event_type, ts) GROUP BY user_id, event_type, ts""")
def nonce_dedup(spark, t):
    """Events of a nonce (user and kind) that find none that passed in the time to live before them."""
    e = t("events").withColumn("nonce", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return G.replay_guard_batch(e, "nonce", "ts", "event_id", 86_400).select("event_id")


@query("""SELECT event_id, event_type, round(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) - ts) / 1000.0, 3) AS ms FROM events""")
def stage_latency(spark, t):
    """Time from each event to the next of its run."""
    return G.stage_latency(t("events"), "user_id").select("event_id", "event_type", F.round("ms", 3).alias("ms"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, coalesce((props->>'$.k')::BIGINT, 0) AS len FROM events), b AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS lo, max(t) OVER (PARTITION BY user_id) AS hi FROM e)
SELECT user_id, least(floor((t - lo) * 20 / greatest(hi - lo, 1)), 19)::INTEGER AS bin, sum(len)::BIGINT AS chars FROM b GROUP BY ALL""")
def throughput_bins(spark, t):
    """Sizes in twenty bins of each run's time."""
    f = t("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("len"))
    return G.throughput_bins(f, "user_id").select("user_id", "bin", "chars")


@query("""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM e GROUP BY user_id, event_type, g""")
def label_runs(spark, t):
    """Runs of equal kinds of event."""
    return REL.runs(t("events"), ["user_id"], "event_id", "event_type").select("user_id", "event_type", "first", "last", "n")


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS id FROM events GROUP BY user_id")
def latest_task(spark, t):
    """The last state in an append-only log."""
    log = t("events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), F.col("event_id").alias("updated_at"), F.col("event_type").alias("status"), *[F.lit(0).alias(c) for c in ("progress", "total")], *[F.lit("").alias(c) for c in ("kind", "message")])
    return cache.latest_tasks(log).select(F.col("doc_id").alias("user_id"), "status", "id")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type""")
def value_statistics(spark, t):
    """Means, deviations, quantiles."""
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), *[F.round(x, 6).alias(n) for x, n in ((F.avg("value"), "mean"), (F.stddev_pop("value"), "deviation"), (F.percentile("value", F.lit(0.5)), "median"), (F.percentile("value", F.lit(0.9)), "p90"))])


@query("""WITH d AS (SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT day, event_type, n, sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS week FROM d""")
def rolling_week(spark, t):
    """Counts of each day with the sum of the seven days up to it."""
    d = t("events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return d.withColumn("week", F.sum("n").over(Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)))
