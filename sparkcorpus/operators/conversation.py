"""Conversations: windows of recent turns, neighbours, incremental summaries, long-term memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.config import Conversation
from sparkcorpus.functions.text import ARROW, COLON, NO_HISTORY, split_item, strip, title_of, usable_label
from sparkcorpus.store import Steps


def by_id():
    return Window.partitionBy("conv_id").orderBy("id")


def newest():
    return Window.partitionBy("conv_id").orderBy(F.desc("id"))


def recent(messages: DataFrame, n: int = Conversation().window) -> DataFrame:
    """The last n messages of each conversation."""
    return messages.withColumn("__n", F.row_number().over(newest())).filter(F.col("__n") <= n).drop("__n")


def id_at_offset(messages: DataFrame, n: int) -> DataFrame:
    """The id with n newer ones in its conversation; null where there are too few."""
    at = messages.withColumn("__n", F.row_number().over(newest()))
    return at.groupBy("conv_id").agg(F.max(F.when(F.col("__n") == n + 1, F.col("id"))).alias("boundary"))


def with_neighbours(messages: DataFrame, picked: DataFrame, mode: str = "id") -> DataFrame:
    """Picked messages and those beside them: by id (global numbers) or by turn within the conversation."""
    if mode == "id":
        near = picked.select("conv_id", F.explode(F.array(F.col("id") - 1, F.col("id"), F.col("id") + 1)).alias("id")).distinct()
        return messages.join(near, ["conv_id", "id"], "left_semi")
    marked = messages.join(picked.select("conv_id", "id", F.lit(1).alias("__p")).distinct(), ["conv_id", "id"], "left")
    hit = lambda c: F.coalesce(c, F.lit(0)) == 1
    near = hit(F.col("__p")) | hit(F.lag("__p").over(by_id())) | hit(F.lead("__p").over(by_id()))
    return marked.withColumn("__near", near).filter("__near").drop("__p", "__near")


def question_before(messages: DataFrame) -> DataFrame:
    """Assistant messages with the nearest user message before them."""
    before = by_id().rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.struct("id", "content")), ignorenulls=True).over(before)
    rows = messages.withColumn("__q", asked).filter(F.col("role") == "assistant")
    return rows.withColumns({"question_id": F.col("__q.id"), "question": F.col("__q.content")}).drop("__q")


def turn_counts(conversations: DataFrame, messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Conversations with their number of messages, zero included."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("turns")).withColumnRenamed("conv_id", key)
    return conversations.join(n, key, "left").withColumn("turns", F.coalesce("turns", F.lit(0)))


def list_conversations(conversations: DataFrame, messages: DataFrame, limit: int) -> DataFrame:
    return turn_counts(conversations, messages).orderBy(F.desc("updated_at"), "conv_id").limit(min(max(limit, 1), 200))


def titles(messages: DataFrame) -> DataFrame:
    first = messages.filter(F.col("role") == "user").groupBy("conv_id").agg(F.min(F.struct("id", "content")).alias("m"))
    return first.select("conv_id", title_of(F.col("m.content")).alias("title"))


def pending_vectors(messages: DataFrame, batch: int = Conversation().vector_batch) -> DataFrame:
    rows = messages.filter(F.col("embedding").isNull() & (F.coalesce(F.col("content"), F.lit("")) != ""))
    return rows.withColumn("__n", F.row_number().over(by_id())).filter(F.col("__n") <= batch).drop("__n")


def summary_batches(messages: DataFrame, upto: DataFrame, conf: Conversation = Conversation()) -> DataFrame:
    """The next messages to summarise: after what is summarised, outside the window, a full batch at a time."""
    edge = id_at_offset(messages, conf.window)
    rows = messages.join(edge, "conv_id").join(upto.select("conv_id", "summary_upto"), "conv_id", "left")
    rows = rows.filter((F.col("id") > F.coalesce("summary_upto", F.lit(0))) & (F.col("id") <= F.col("boundary")))
    rows = rows.withColumn("__n", F.row_number().over(by_id())).filter(F.col("__n") <= conf.summary_batch)
    full = F.count("*").over(Window.partitionBy("conv_id")) == conf.summary_batch
    return rows.withColumn("__full", full).filter("__full").drop("__n", "__full", "boundary", "summary_upto")


def note_candidates(messages: DataFrame, conf: Conversation = Conversation()) -> DataFrame:
    """Assistant messages outside the window that have no note yet, with their questions, a batch at a time."""
    rows = question_before(messages).join(id_at_offset(messages, conf.window), "conv_id")
    rows = rows.filter(F.col("index_text").isNull() & (F.col("id") <= F.col("boundary"))).drop("boundary")
    return rows.withColumn("__n", F.row_number().over(by_id())).filter(F.col("__n") <= conf.note_batch).drop("__n")


def normal_item(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"[{ARROW}—]", " "), r"\s+", "")


def has_counterpart(old: Column, new: Column) -> Column:
    """Whether an item shares a stretch with another that is long enough for its length."""
    x, y = normal_item(old), normal_item(new)
    need = F.least(F.lit(6), F.greatest(F.lit(2), F.floor(F.length(x) / 2).cast("int")))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - need + 1, F.lit(1))), lambda i: F.substr(x, i, need))
    return (F.length(x) >= need) & F.exists(grams, lambda g: F.contains(y, g))


def missing_items(old: Column, new: Column) -> Column:
    """Items of a list that have no counterpart in the other."""
    return F.filter(old, lambda o: ~F.exists(new, lambda n: has_counterpart(o, n)))


def coverage_edges(old: Column, new: Column) -> Column:
    """Items that name no former value get the former list's value of their topic."""

    def mend(item: Column) -> Column:
        p = split_item(item)
        was = F.try_element_at(F.transform(F.filter(old, lambda o: split_item(o)["topic"] == p["topic"]), lambda o: split_item(o)["new"]), F.lit(-1))
        fits = p.isNotNull() & p["old"].isin(*NO_HISTORY) & was.isNotNull() & (strip(was) != "") & (was != p["new"])
        return F.when(fits, F.concat(p["topic"], F.lit(COLON), was, F.lit(f" {ARROW} "), p["new"])).otherwise(item)

    return F.transform(new, mend)


def merge_summary(attempts: DataFrame, most: int = Conversation().summary_items) -> DataFrame:
    """Of the attempts (conv_id, attempt, old, items) the best, mended, with lost items put back.

    The best leaves fewest old items without counterpart, then has most items, then came first.
    `frozen` marks a result that equals the old list.
    """
    scored = attempts.withColumn("lost", F.size(missing_items(F.col("old"), F.col("items"))))
    best = scored.filter(F.size("items") > 0).groupBy("conv_id").agg(F.max(F.struct(-F.col("lost"), F.size("items"), -F.col("attempt"), "old", "items")).alias("b")).select("conv_id", "b.old", "b.items")
    best = best.withColumn("items", coverage_edges(F.col("old"), F.col("items")))
    room = F.greatest(F.lit(most) - F.size("items"), F.lit(0))
    back = F.slice(missing_items(F.col("old"), F.col("items")), F.lit(1), room)
    return best.withColumn("items", F.concat("items", back)).withColumn("frozen", (F.size("old") > 0) & (F.col("old") == F.col("items")))


def current_value(item: Column) -> Column:
    """The value of a memory line `topic：value` or `topic：old → new`; of a line without value, its text."""
    at = F.locate(COLON, item)
    return strip(F.when(at > 0, F.element_at(F.split(F.substr(item, at + 1), ARROW), -1)).otherwise(item))


def topic_keys(topics: DataFrame) -> DataFrame:
    """(o, place, key, side): what makes topics (o, place, topic) alike, white space and arrows aside.

    Two topics are alike if one contains the other or if they have four characters in a row in common.  So alike ones share a
    4-gram (side 2), or the whole of a shorter one (1) is an n-gram of the other (0).
    """
    rows = topics.select("o", "place", normal_item(F.col("topic")).alias("x"))
    cut = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("x") - n + 1), lambda i: F.substr("x", i, F.lit(n))))
    out = rows.filter(F.length("x").between(1, 3)).select("o", "place", F.col("x").alias("key"), F.lit(1).alias("side"))
    for n in (1, 2, 3, 4):
        out = out.unionByName(rows.filter(F.length("x") >= n).select("o", "place", F.explode(cut(n)).alias("key"), F.lit(2 if n == 4 else 0).alias("side")))
    return out


def leading_topics(topics: DataFrame, steps: Steps) -> DataFrame:
    """(o, place, leader) of topics (o, place, topic, known), places in order: known topics lead themselves, so does a topic to which
    no leader before it is alike; others follow the first such leader.

    A round decides every topic of which no undecided one or leader before it is alike, and all that are alike to those.  It takes the
    least place of each key, never pairs, so keys that many topics share cost a row each.  Rounds are as many as the
    longest chain of topics that depend on one another.
    """
    keys = steps.keep(topic_keys(topics), "keys")
    opposite = F.when(F.col("side") == 2, 2).otherwise(1 - F.col("side")).alias("side")
    undecided = steps.keep(topics.filter("not known").select("o", "place"), "undecided-0")
    leaders = steps.keep(topics.filter("known").select("o", "place"), "leaders-0")

    def least(places: DataFrame) -> DataFrame:
        """(o, place, first): for each topic with keys, the least of the places that are alike to it."""
        firsts = keys.join(places, ["o", "place"], "left_semi").groupBy("o", "key", opposite).agg(F.min("place").alias("first"))
        return keys.join(firsts, ["o", "key", "side"]).groupBy("o", "place").agg(F.min("first").alias("first"))

    i = 0
    while not undecided.isEmpty():
        i += 1
        near = least(undecided.unionByName(leaders))
        new = undecided.join(near, ["o", "place"], "left").filter("first is null or first >= place").select("o", "place")
        leaders = steps.keep(leaders.unionByName(new), f"leaders-{i}")
        beaten = least(leaders).filter("first <= place").select("o", "place")
        left = undecided.join(leaders, ["o", "place"], "left_anti").join(beaten, ["o", "place"], "left_anti")
        undecided = steps.keep(left, f"undecided-{i}")
        steps.drop(f"leaders-{i - 1}", f"undecided-{i - 1}")
    own = leaders.select("o", "place", F.col("place").alias("leader"))
    rest = topics.select("o", "place").join(leaders, ["o", "place"], "left_anti")
    return own.unionByName(rest.join(least(leaders), ["o", "place"]).select("o", "place", F.col("first").alias("leader")))


#: Numbers of lines whose changes are found in one window.
STRETCH = 10_000


def absorb(memory: DataFrame, lines: DataFrame, owner: str = "owner") -> DataFrame:
    """(owner, topic, item, written): each owner's memory (topic, item) after its lines (seq, line), in the order of `seq`, then of the lines.

    A line `topic：old → new` goes to the topic of its name, else to the first topic alike, else it begins one; an item
    names the topic of the line that changed it last, and keeps the value before.  Lines of other shapes are passed over.  Of several items of a known topic the largest
    counts; known topics come in their order.  An owner may be null.
    """
    steps = Steps(memory.sparkSession, "memory")
    o = F.coalesce(F.concat(F.lit("."), F.col(owner).cast("string")), F.lit("")).alias("o")
    known = memory.filter("topic is not null").select(o, owner, "topic", "item").groupBy("o", "topic").agg(F.max("item").alias("item"), F.first(owner).alias(owner))
    parsed = lines.select(o, owner, F.col("seq").cast("long").alias("seq"), "line", split_item(F.col("line")).alias("p")).filter("p is not null")
    parsed = steps.keep(parsed.select("o", owner, "seq", "line", F.col("p.topic").alias("topic"), F.col("p.new").alias("now")), "lines")
    known = steps.keep(known, "known")
    # a topic's place: known ones by name, new ones by their first line
    named = known.select("o", "topic", F.struct(F.lit(0).alias("new"), F.lit(0).cast("long").alias("seq"), F.col("topic").alias("line"), "topic").alias("place"))
    named = named.unionByName(parsed.groupBy("o", "topic").agg(F.min(F.struct(F.lit(1).alias("new"), "seq", "line", "topic")).alias("place")))
    topics = steps.keep(named.groupBy("o", "topic").agg(F.min("place").alias("place")).withColumn("known", F.col("place.new") == 0), "topics")
    led = leading_topics(topics, steps).select("o", F.col("place.topic").alias("topic"), F.col("leader.topic").alias("leader"))
    rows = parsed.join(led, ["o", "topic"]).withColumns({"then": strip(F.element_at(F.split("now", ARROW), -1)), "stretch": F.floor(F.col("seq") / STRETCH)})
    # after a line the current value is the one it gives, so a change is seen from the line before; stretches of lines are summed up first
    before = F.lag("then").over(Window.partitionBy("o", "leader", "stretch").orderBy("seq", "line"))
    rows = rows.withColumn("was", before)
    change = F.when(F.col("was").isNotNull() & (F.col("was") != F.col("now")), F.struct("seq", "line", "topic", "was", "now"))
    order = F.struct("seq", "line")
    parts = rows.groupBy("o", "leader", "stretch").agg(F.first(owner).alias(owner), F.min(F.struct("seq", "line", "topic", "now")).alias("begin"), F.max_by("then", order).alias("then"), F.max(change).alias("change"))
    parts = parts.join(known.select("o", F.col("topic").alias("leader"), current_value(F.col("item")).alias("at_first")), ["o", "leader"], "left")
    was = F.coalesce(F.lag("then").over(Window.partitionBy("o", "leader").orderBy("stretch")), "at_first")
    parts = parts.withColumn("was", was)
    entered = F.when(F.col("was").isNull() | (F.col("was") != F.col("begin.now")), F.struct(F.col("begin.seq").alias("seq"), F.col("begin.line").alias("line"), F.col("begin.topic").alias("topic"), "was", F.col("begin.now").alias("now")))
    last = parts.groupBy("o", "leader").agg(F.first(owner).alias(owner), F.max(F.coalesce("change", entered)).alias("c")).filter("c is not null")
    text = F.concat("c.topic", F.lit(COLON), F.coalesce(F.concat("c.was", F.lit(f" {ARROW} ")), F.lit("")), "c.now")
    written = last.select("o", owner, F.col("leader").alias("topic"), text.alias("item"), F.lit(True).alias("written"))
    kept = known.join(written.select("o", "topic"), ["o", "topic"], "left_anti").select("o", owner, "topic", "item", F.lit(False).alias("written"))
    return written.unionByName(kept).select(owner, "topic", "item", "written")


def last_values(events: DataFrame, topic: str, value: str, order: str) -> DataFrame:
    """The exact-topic part of `absorb` as windows: each topic's last value and the one before it that differs."""
    w = Window.partitionBy(topic).orderBy(order)
    changes = events.withColumn("__was", F.lag(value).over(w)).filter(F.col("__was").isNull() | (F.col("__was") != F.col(value)))
    return changes.groupBy(topic).agg(F.max_by(value, order).alias("now"), F.max_by("__was", order).alias("was"), F.count("*").alias("writes"))


def render_memory(memory: DataFrame, most: int = Conversation().memory_items) -> DataFrame:
    return memory.orderBy(F.desc("updated_at"), "topic").limit(most)


def strip_repeats(excerpt: DataFrame, recent_turns: DataFrame) -> DataFrame:
    """Lines of an excerpt that the retained turns do not have, white space aside."""
    key = lambda c: strip(F.regexp_replace(c, r"\s+", " "))
    have = recent_turns.select("conv_id", F.explode(F.split("content", "\n")).alias("l")).select("conv_id", key(F.col("l")).alias("__k")).distinct()
    return excerpt.withColumn("__k", key(F.col("line"))).join(have, ["conv_id", "__k"], "left_anti").drop("__k")


def usable_notes(notes: DataFrame, least: int = 2) -> DataFrame:
    """Notes to store: a text that is no label at all becomes the empty text, which means skipped."""
    return notes.withColumn("index_text", F.when(usable_label(F.col("index_text"), least), F.col("index_text")).otherwise(F.lit("")))
