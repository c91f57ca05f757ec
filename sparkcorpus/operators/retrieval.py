"""Search: vector and keyword channels, rank fusion, and what is built from them.

Queries come as a table (query, text, vector), so one job answers all of them.  A query table is
small next to the corpus and is broadcast if Spark finds its size below the threshold; ranks are
windows by query, which keep only k rows of each task (window group limit) before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.config import Retrieval
from sparkcorpus.functions import vector as V
from sparkcorpus.functions.text import extract_terms
from sparkcorpus.operators import gram_index, term_scan, vector_scan
from sparkcorpus.operators.gram_index import GramIndex
from sparkcorpus.operators.relational import first_wins, top_per_group
from sparkcorpus.store import Steps

def term_hits(content: Column, terms: Column, escape: bool = False) -> Column:
    """How many distinct terms a text has, cases apart; `_` in a term stands for any character unless escaped."""
    low = F.lower(content)
    like = lambda t: F.call_function("ilike", content, F.concat(F.lit("%"), F.replace(t, F.lit("_"), F.lit("\\_")) if escape else t, F.lit("%")))
    # only a wildcard needs a pattern; other terms are found as plain substrings
    return F.size(F.filter(terms, lambda t: F.when(F.contains(t, F.lit("_")), like(t)).otherwise(F.contains(low, F.lower(t)))))


def min_hits(terms: Column, conf: Retrieval = Retrieval()) -> Column:
    return F.greatest(F.lit(conf.min_hits), F.ceil(F.size(terms) * F.lit(conf.min_hit_share))).cast("int")


def vector_channel(queries: DataFrame, units: DataFrame, k: int, unit: str = "id", vector: str = "embedding", on: list[str] = ()) -> DataFrame:
    """(query, unit, distance, rank) of the k nearest units of each query; null vectors never rank."""
    if not on:
        found = vector_scan.nearest(queries, units, k, unit, vector)
        return Steps(units.sparkSession, "nearest").keep(top_per_group(found, ["query"], k, F.asc("distance"), F.asc("unit"), name="rank"), "hits")
    q = queries.filter(F.col("vector").isNotNull()).select("query", *on, F.col("vector").alias("__q"))
    u = units.filter(F.col(vector).isNotNull()).select(F.col(unit).alias("unit"), *on, F.col(vector).alias("__v"))
    near = u.join(q, list(on)).select("query", "unit", V.cosine_distance(F.col("__v"), F.col("__q")).alias("distance"))
    return top_per_group(near, ["query"], k, F.asc("distance"), F.asc("unit"), name="rank")


def keyword_channel(queries: DataFrame, units: DataFrame | GramIndex, k: int, unit: str = "id", content: str = "content", conf: Retrieval = Retrieval()) -> DataFrame:
    """(query, unit, hits, rank): the k units with most terms of each query, of which those with enough stay.

    A term is a run of word characters (or a pair of CJK ones), so a text has it only within one of its own such
    runs.  Texts of a single search are read once, see `term_scan`; hits are counted in blocks, without a row for each candidate.  Ids of units are unique.
    An index that was written before may stand for the units, see `gram_index`: there, a term with a wildcard is looked for by its longest part
    without one, and candidates' texts are then matched.
    """
    index = isinstance(units, GramIndex)
    asked = queries.select("query", extract_terms(F.col("text"), conf.max_terms).alias("__t"))  # written, or each column would extract them again
    asked = (units.steps if index else Steps(units.sparkSession, "term-scan")).keep(asked, f"terms-{next(gram_index.COUNT)}").filter(F.size("__t") > 0)
    if not index:
        wild = lambda t: F.lit(False) if conf.escape_wildcards else F.contains(t, F.lit("_"))
        keys = F.transform("__t", lambda t: F.concat(F.when(wild(t), "w").otherwise("p"), F.lower(t)))
        asked = asked.select("query", min_hits(F.col("__t"), conf).alias("least"), keys.alias("keys"))
        best = term_scan.best_texts(units.select(F.col(unit).alias("unit"), F.col(content).alias("content")), asked, k)
        return top_per_group(best, ["query"], k, F.desc("hits"), F.asc("unit"), name="rank")
    asked = asked.select("query", min_hits(F.col("__t"), conf).alias("least"), F.explode("__t").alias("term"))
    wild = F.lit(False) if conf.escape_wildcards else F.contains("term", F.lit("_"))
    longest = F.array_max(F.transform(F.split(F.lower("term"), "_"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    asked = asked.withColumn("wild", wild).withColumn("part", F.when(F.col("wild"), longest).otherwise(F.lower("term")))
    return gram_index.count_hits(units, asked, k)


def rrf(channels: list[DataFrame], k: int, conf: Retrieval = Retrieval()) -> DataFrame:
    """Reciprocal rank fusion of channels (query, unit, rank, distance or hits).

    Ties go to the unit that an earlier channel, then an earlier rank, has.  Units farther than the
    threshold are dropped after ranking, and the list is filled up to k.
    """
    shape = lambda i, c: c.select("query", "unit", F.lit(i).alias("channel"), "rank", *[(F.col(x) if x in c.columns else F.lit(None)).cast(t).alias(x) for x, t in (("distance", "double"), ("hits", "int"))])
    rows = shape(0, channels[0])
    for i, c in enumerate(channels[1:], 1):
        rows = rows.unionByName(shape(i, c))
    part = 1.0 / (F.lit(conf.rrf_k) + F.col("rank") + F.lit(conf.rank_base - 1))
    fused = rows.groupBy("query", "unit").agg(F.sum(part).alias("rrf"), F.min("distance").alias("distance"), F.max("hits").alias("hits"), F.min(F.struct("channel", "rank")).alias("__first"))
    fused = fused.filter(F.col("distance").isNull() | (F.col("distance") <= conf.max_distance))
    return top_per_group(fused, ["query"], k, F.desc(F.round("rrf", 12)), F.asc("__first"), F.asc("unit"), name="rank").drop("__first")


def within_distance(hits: DataFrame, k: int, conf: Retrieval = Retrieval()) -> DataFrame:
    return top_per_group(hits.drop("rank").filter(F.col("distance") <= conf.max_distance), ["query"], k, F.asc("distance"), F.asc("unit"), name="rank")


def search(queries: DataFrame, units: DataFrame, conf: Retrieval = Retrieval(), mode: str | None = None, k: int | None = None, unit: str = "id", content: str = "content", vector: str = "embedding", model: str | None = None, doc: str | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """The k best units of each query by vector, by keywords, or by both; of one model and document, if named.  Vectors of units may be in a table of
    their own (with the same names of columns), so that texts need not be joined to them."""
    mode, k = mode or conf.mode, k or conf.top_k
    pool = max(conf.pool, k)
    if model is not None:
        units = units.filter(F.col("embed_model") == model)
    if doc is not None:
        units = units.filter(F.col("doc_id") == doc)
    vectors = units if vectors is None else vectors.join(units.select(unit), unit, "left_semi")
    if mode == "vector":
        return within_distance(vector_channel(queries, vectors, pool, unit, vector), k, conf)
    keyword = keyword_channel(queries, units, pool, unit, content, conf)
    if mode == "keyword":
        return keyword.filter(F.col("rank") <= k)
    if mode != "hybrid":
        raise ValueError(f"no such mode: {mode}")
    return rrf([vector_channel(queries, vectors, pool, unit, vector), keyword], k, conf)


def rank_contexts(hits: DataFrame, case: str = "case", most: int = Retrieval().max_contexts) -> DataFrame:
    """Units found by several queries of a case: the first finding stays, then by distance (null last) and hits."""
    first = first_wins(hits, [case, "unit"], F.asc("query_no"), F.asc("rank"))
    return top_per_group(first.drop("rank"), [case], most, F.asc_nulls_last("distance"), F.desc_nulls_last("hits"), F.asc("unit"), name="rank")


def min_distance_rrf(hits: DataFrame, case: str = "case", k: int = 60, base: int = 0) -> DataFrame:
    """Over the queries of a case: summed reciprocal ranks (from `base`) and the least distance of each unit."""
    return hits.groupBy(case, "unit").agg(F.sum(1.0 / (k + F.col("rank") - 1 + base)).alias("rrf"), F.min("distance").alias("distance"))


def narrow(queries: DataFrame, nodes: DataFrame, clusters: int, members: DataFrame | None = None) -> DataFrame:
    """(query, unit): members of the clusters whose centroids are nearest: of a table (id, unit), or else of the
    arrays that the nodes hold."""
    near = nodes.join(queries.select("query", F.col("vector").alias("__q")))
    near = near.select("query", "id", V.cosine_distance(F.col("centroid"), F.col("__q")).alias("d"), *["chunk_ids"] * (members is None))
    best = top_per_group(near, ["query"], clusters, F.asc("d"), F.asc("id"))
    if members is None:
        return best.select("query", F.explode("chunk_ids").alias("unit")).distinct()
    return best.select("query", "id").join(members.select("id", "unit"), "id").select("query", "unit").distinct()


def top_sentences(queries: DataFrame, picked: DataFrame, sentences: DataFrame, per_chunk: int | None = None, overall: int | None = None) -> DataFrame:
    """Sentences of picked chunks: all, the best of each chunk, or the best of all of a query."""
    rows = picked.select("query", F.col("unit").alias("chunk_id")).join(sentences, "chunk_id")
    if per_chunk is None and overall is None:
        return rows.withColumn("distance", F.lit(None).cast("double"))
    rows = rows.filter(F.col("embedding").isNotNull()).join(queries.select("query", F.col("vector").alias("__q")), "query")
    rows = rows.withColumn("distance", V.cosine_distance(F.col("embedding"), F.col("__q"))).drop("__q")
    group, k = (["query", "chunk_id"], per_chunk) if per_chunk else (["query"], overall)
    return top_per_group(rows, group, k, F.asc("distance"), F.asc("id"))


def chunk_texts(picked: DataFrame, chunks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Text of each picked chunk: its chosen sentences in order, or all of it if none was chosen."""
    text = chosen.groupBy("query", F.col("chunk_id").alias("unit")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n").alias("__t"))
    return picked.join(chunks.select(F.col("id").alias("unit"), "content"), "unit").join(text, ["query", "unit"], "left").withColumn("text", F.coalesce("__t", "content")).drop("__t", "content")


def category(blocks: DataFrame, case: str = "case", threshold: float = 0.5) -> DataFrame:
    """a: some block answers the case; b: none does though it asks for knowledge; c: it does not; null: unknown."""
    some = F.bool_or(F.col("answers") > threshold)
    asks = F.bool_or(F.col("knowledge") > threshold)
    return blocks.groupBy(case).agg(F.when(some, "a").when(F.max("knowledge").isNull(), None).when(asks, "b").otherwise("c").alias("category"))


def best_passage(shares: DataFrame, case: str = "case", among: int = 9, gate: float = 0.7) -> DataFrame:
    """The passage with the largest share among the first ones, if it reaches the gate."""
    kept = shares.filter(F.col("rank") <= among)
    best = kept.groupBy(case).agg(F.max(F.struct("share", -F.col("rank"), "unit")).alias("b"))
    return best.select(case, F.when(F.col("b.share") >= gate, F.col("b.unit")).alias("unit"), F.col("b.share").alias("share"))


def rerank(hits: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Hits in the order of a judge's probability; what it did not judge comes last."""
    rows = hits.drop("rank").join(judged, ["query", "unit"], "left")
    return top_per_group(rows, ["query"], k, F.desc_nulls_last("probability"), F.asc("unit"), name="rank")


def separation(near: DataFrame, inside: str = "in_corpus", thresholds: tuple = (0.3, 0.4, 0.5, 0.6)) -> DataFrame:
    """Per query: the least distance, and how many units lie within each threshold."""
    return near.groupBy("query", inside).agg(F.min("distance").alias("nearest"), *[F.count_if(F.col("distance") <= t).alias(f"within_{int(t * 100)}") for t in thresholds])


def separation_of(queries: DataFrame, units: DataFrame, inside: str = "in_corpus", thresholds: tuple = (0.3, 0.4, 0.5, 0.6), unit: str = "id", vector: str = "embedding") -> DataFrame:
    """`separation` of each query (query, vector, inside) from all units but its own, without a row for each pair."""
    counts = {f"c{i}": F.col(f"c{i}").alias(f"within_{int(t * 100)}") for i, t in enumerate(thresholds)}
    found = vector_scan.within(queries, units, thresholds, unit, vector)
    return queries.select("query", inside).join(found, "query").select("query", inside, "nearest", *counts.values())


def band(nearest: DataFrame, inside: str = "in_corpus") -> DataFrame:
    """Whether queries inside the corpus are nearer than all outside: the two edges and the gap."""
    a, b = F.max(F.when(F.col(inside), F.col("nearest"))), F.min(F.when(~F.col(inside), F.col("nearest")))
    return nearest.agg(a.alias("inside_max"), b.alias("outside_min"), (b - a).alias("gap"), (a < b).alias("separable"))


def multi_granularity(arms: dict[str, DataFrame], budget: int, cost: str = "chars") -> DataFrame:
    """Arms over different units at an equal budget: what fits of each, in order of rank."""
    from sparkcorpus.operators.relational import prefix_within

    out = None
    for name, hits in arms.items():
        kept = prefix_within(hits, ["query"], [F.asc("rank")], F.col(cost), budget).withColumn("arm", F.lit(name))
        out = kept if out is None else out.unionByName(kept, allowMissingColumns=True)
    return out


def recall_history(queries: DataFrame, messages: DataFrame, excluded: DataFrame, top_k: int, budget: int) -> DataFrame:
    """Messages of a conversation near any of its queries, with their neighbours, notes before raw texts,
    in order and within a budget of characters.  Excluded ids go before the search, not after."""
    from sparkcorpus.operators.conversation import with_neighbours
    from sparkcorpus.operators.relational import lines_within

    n = F.count("*").over(Window.partitionBy("conv_id"))
    q = queries.withColumn("limit", F.greatest(F.lit(1), F.floor(F.lit(top_k) / n)) + 1)
    pool = messages.join(excluded.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
    found = vector_channel(q, pool, top_k + 1, on=["conv_id"]).join(q.select("query", "conv_id", "limit"), "query").filter(F.col("rank") <= F.col("limit"))
    picked = with_neighbours(messages, found.select("conv_id", F.col("unit").alias("id")).distinct())
    text = F.when(F.trim("index_text") != "", F.col("index_text")).otherwise(F.col("content"))
    lines = picked.withColumn("line", F.concat(F.when(F.col("role") == "user", "用户：").otherwise("助手："), text))
    return lines_within(lines, ["conv_id"], [F.asc("id")], "line", budget)
