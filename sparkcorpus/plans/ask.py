"""Questions to answers, many at a time: plan, search, rank, choose sentences, pack, answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcorpus.config import Settings
from sparkcorpus.functions.text import estimate_tokens
from sparkcorpus.operators import retrieval as R
from sparkcorpus.operators import selection
from sparkcorpus.providers.base import Provider, chat_column, embed_column, messages_column
from sparkcorpus.streaming.citations import fix_citations


def plan_queries(questions: DataFrame, planned: DataFrame | None = None, most: int = 3) -> DataFrame:
    """(case, query_no, query, text): a question's planned queries, or the question itself."""
    own = questions.select("case", F.lit(0).alias("query_no"), F.col("question").alias("text"))
    if planned is not None:
        more = planned.filter(F.trim("text") != "").withColumn("query_no", F.col("query_no").cast("int")).filter(F.col("query_no").between(1, most)).select("case", "query_no", "text")
        own = own.join(more.select("case").distinct(), "case", "left_anti").unionByName(more)
    return own.withColumn("query", F.concat_ws("#", F.col("case").cast("string"), "query_no"))


def contexts(questions: DataFrame, chunks: DataFrame, provider: Provider, planned: DataFrame | None = None, conf: Settings = Settings()) -> DataFrame:
    """Ranked chunks of each case."""
    queries = embed_column(plan_queries(questions, planned), provider, "text", "vector")
    hits = R.search(queries, chunks, conf.retrieval).join(queries.select("query", "case", "query_no"), "query")
    return R.rank_contexts(hits, most=conf.retrieval.max_contexts)


def ask(questions: DataFrame, chunks: DataFrame, provider: Provider, sentences: DataFrame | None = None, planned: DataFrame | None = None, conf: Settings = Settings()) -> DataFrame:
    """(case, question, answer, sources) for a table of questions (case, question).

    Material is numbered in its order; with a sentence index only chosen sentences of a chunk are shown, the
    whole chunk where none was chosen.
    """
    ranked = contexts(questions, chunks, provider, planned, conf)
    picked = ranked.withColumn("query", F.col("case").cast("string"))
    if sentences is not None:
        vectors = embed_column(questions.select(F.col("case").cast("string").alias("query"), "question"), provider, "question", "vector")
        chosen = R.top_sentences(vectors, picked, sentences, overall=conf.sentences.top_m)
        texts = R.chunk_texts(picked, chunks, chosen)
    else:
        texts = picked.join(chunks.select(F.col("id").alias("unit"), F.col("content").alias("text")), "unit")
    tiers = questions.select("case", estimate_tokens(F.col("question")).alias("fixed"), *[F.lit(0).alias(x) for x in ("recent", "summary", "excerpt")])
    packed = selection.pack(tiers, texts.withColumn("tokens", estimate_tokens(F.col("text"))), conf.prompt.window_tokens)
    shown = packed.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("rank", "unit", "text"))).alias("m"))
    shown = shown.withColumn("material", F.array_join(F.transform("m", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"])), "\n\n"))
    rows = questions.join(shown, "case", "left").withColumn("prompt", messages_column(F.coalesce("material", F.lit("")), F.col("question")))
    rows = rows.withColumn("sources", F.transform("m", lambda x: x["unit"])).select("case", "question", "sources", "prompt")
    answered = chat_column(rows, provider, "prompt", "raw").withColumn("fixed", fix_citations("raw"))
    return answered.select("case", "question", F.col("fixed.text").alias("answer"), F.col("fixed.cites").alias("cites"), "sources")
