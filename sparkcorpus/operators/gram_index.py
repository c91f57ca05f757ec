"""An inverted index of texts for terms that are found as substrings.

Texts are cut into distinct runs of word characters.  The index has the runs of each text (postings), the distinct runs with
the number of their texts (vocabulary), and the character n-grams of the vocabulary in buckets.  A term is looked
up by the rarest of its n-grams, so the texts themselves are not read for it.

A query asks for at least `least` of its n terms.  Whatever has as many has one of the n - least + 1 terms
that are rarest.  Where terms have wildcards, only texts with one of these are candidates, and only candidates are counted in full;
other queries are counted in blocks of texts, without a row for each candidate, as common words make nearly every text one.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcorpus.operators.relational import top_per_group
from sparkcorpus.store import Steps

#: Runs of characters that terms are made of, in lowered texts.
RUN = r"[a-z0-9_]+|[一-鿿]+"
#: Longest n-grams, and folders that they are dealt to.
LONGEST, BUCKETS = 3, 16
#: Share of the vocabulary beyond which an n-gram's words are not listed.
DENSE = 0.005
#: Texts of a slice and queries of a block whose terms are counted in one task, texts of the smallest slices, and bytes of a slice's matrix.
SLICE, BLOCK, LEAST_SLICE, MATRIX = 32_768, 65_536, 4_096, 1 << 27
#: Numbers of the tables that searches write.
COUNT = count()


@dataclass
class GramIndex:
    """postings (word, unit), vocabulary (word, df), grams (gram, word, bucket), texts (unit, content)."""

    steps: Steps
    postings: DataFrame
    vocabulary: DataFrame
    grams: DataFrame
    texts: DataFrame
    words: int


def grams_of(text: Column, n: int) -> Column:
    """Distinct n-grams of a text of at least n characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))


def build(units: DataFrame, unit: str = "id", content: str = "content", write_grams: bool = True) -> GramIndex:
    """Index the texts of units, whose ids are unique; null texts have no words.  Without `write_grams` they are made as they are
    looked for, which pays for a single search."""
    steps = Steps(units.sparkSession, "gram-index")
    texts = units.select(F.col(unit).alias("unit"), F.col(content).alias("content"))
    postings = steps.keep(texts.select("unit", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(RUN), 0))).alias("word")), "postings")
    vocabulary = steps.keep(postings.groupBy("word").agg(F.count("*").alias("df")), "vocabulary")
    sizes = [vocabulary.filter(F.length("word") >= n).select(F.explode(grams_of(F.col("word"), n)).alias("gram"), "word") for n in range(1, LONGEST + 1)]
    grams = sizes[0]
    for more in sizes[1:]:
        grams = grams.unionByName(more)
    grams = grams.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
    return GramIndex(steps, postings, vocabulary, steps.keep(grams.repartition("bucket", "word"), "grams", by=["bucket"]) if write_grams else grams, texts, vocabulary.count())


def looked_up(index: GramIndex, parts: DataFrame, run: int) -> tuple[DataFrame, list]:
    """(part_id, word): the words of the vocabulary that have a part (part_id, part; lowered, not empty) as a substring; and the parts that are
    in so many words that their texts are better found by reading: those of which each n-gram is in over a DENSE share of words.

    There are at most as many such n-grams as a word has n-grams, divided by that share, however many parts are asked for.
    """
    size = F.least(F.length("part"), F.lit(LONGEST))
    asked = parts.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("part") - size + 1), lambda i: F.substr("part", i, size)))))
    wanted = asked.select("gram", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int").alias("bucket")).distinct()
    found = index.steps.keep(index.grams.join(wanted, ["bucket", "gram"]).select("gram", "word"), f"grams-{run}")
    often = found.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "gram", "left").groupBy("part_id", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = index.steps.keep(rarest.select("part_id", "part", "r.gram", (F.col("r.n") > index.words * DENSE).alias("dense")), f"rarest-{run}")
    dense = rarest.filter(F.col("dense") & (F.length("part") <= LONGEST)).select("part_id", "part").collect()
    sparse = rarest.filter(~F.col("dense") | (F.length("part") > LONGEST))
    return sparse.join(found, "gram").filter(F.contains("word", F.col("part"))).select("part_id", "word"), dense


def count_hits(index: GramIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query, unit, hits, rank): of the units with enough of a query's terms, the k with most, ties by unit.

    `asked` has a row for each term: query, term, least (of the query), part (a lowered string that every text with
    the term has; empty if there is none), wild (`_` in the term stands for any character).
    """
    steps, run = index.steps, next(COUNT)
    asked = steps.keep(asked, f"asked-{run}")
    parts = steps.keep(asked.filter("part <> ''").select("part").distinct().withColumn("part_id", F.monotonically_increasing_id()), f"parts-{run}")
    lexicon, dense = looked_up(index, parts, run)
    # words carry all parts they have, so a text's parts meet once
    by_word = index.postings.join(lexicon.groupBy("word").agg(F.collect_list("part_id").alias("ids")), "word")
    has = by_word.select("unit", F.explode("ids").alias("part_id")).distinct().groupBy("unit").agg(F.collect_list("part_id").alias("has"))
    if dense:
        ids, names = F.lit([r["part_id"] for r in dense]), F.lit([r["part"] for r in dense])
        here = lambda low: F.transform(F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: F.contains(low, F.element_at(names, i))), lambda i: F.element_at(ids, i))
        read = index.texts.select("unit", F.get(F.transform(F.array(F.lower("content")), here), 0).alias("also"))  # the text is lowered once
        has = read.join(has, "unit", "left").select("unit", F.concat("also", F.coalesce("has", F.array().cast("array<bigint>"))).alias("has"))
    has = steps.keep(has, f"has-{run}")
    found = has.select("unit", F.explode("has").alias("part_id"))
    often = found.groupBy("part_id").agg(F.count("*").alias("df"))
    terms = asked.join(parts, "part", "left").join(often, "part_id", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    # terms of wildcards alone only ask for a length
    bare = F.col("part") == ""
    lists = terms.groupBy("query").agg(
        F.max("least").alias("least"),
        F.sort_array(F.collect_list(F.when(~bare, F.struct("df", "term", "part_id", "wild")))).alias("by_df"),
        F.collect_list(F.when(bare, F.length("term"))).alias("lengths"),
    )
    need = F.greatest(F.col("least") - F.size("lengths"), F.lit(1))
    lists = lists.withColumn("rare", F.slice("by_df", F.lit(1), F.greatest(F.size("by_df") - need + 1, F.lit(0))))
    rest = F.slice("by_df", F.greatest(F.size("by_df") - need + 2, F.lit(1)), F.size("by_df"))
    ids = lambda c: F.transform(F.filter(c, lambda x: ~x["wild"]), lambda x: x["part_id"])
    wild = F.transform(F.filter("by_df", lambda x: x["wild"]), lambda x: x["term"])
    rare = F.transform("rare", lambda x: F.struct(x["part_id"].alias("part_id"), (~x["wild"]).cast("int").alias("sure")))
    every = steps.keep(lists.select("query", "least", F.transform(F.filter("by_df", lambda x: ~x["wild"]), lambda x: x["part_id"]).alias("ids"), ((F.size(wild) > 0) | (F.size("lengths") > 0)).alias("odd")), f"every-{run}")
    simple = counted(has, every.filter("not odd").drop("odd"), k)
    if every.filter("odd").isEmpty():
        return top_per_group(simple, ["query"], k, F.desc("hits"), F.asc("unit"), name="rank")
    # queries with wildcards ask for texts: a row for each text with a rare term; hits of terms without wildcards are counted on the way
    lists = steps.keep(lists.filter((F.size(wild) > 0) | (F.size("lengths") > 0)).select("query", "least", rare.alias("rare"), ids(rest).alias("common"), wild.alias("wild"), "lengths"), f"lists-{run}")
    asked_for = lists.select("query", F.explode("rare").alias("r")).select("query", "r.part_id", "r.sure").groupBy("query", "part_id").agg(F.sum("sure").alias("sure"))
    candidates = found.join(asked_for, "part_id").groupBy("query", "unit").agg(F.sum("sure").alias("sure"))
    lengths = sorted({r["n"] for r in lists.filter(F.size("lengths") >= F.col("least")).select(F.explode("lengths").alias("n")).distinct().collect()})
    if lengths:  # queries that such terms alone satisfy: besides, the first k units of each length
        long_ = index.texts.select("unit", F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: F.length("content") >= n)).alias("n"))
        first = top_per_group(long_, ["n"], k, F.asc("unit")).select("n", "unit")
        easy = lists.filter(F.size("lengths") >= F.col("least")).select("query", F.explode(F.array_distinct("lengths")).alias("n"))
        candidates = candidates.unionByName(easy.join(first, "n").select("query", "unit", F.lit(0).cast("long").alias("sure"))).groupBy("query", "unit").agg(F.max("sure").alias("sure"))
    candidates = candidates.join(lists.drop("rare"), "query").filter(F.col("sure") + F.size("common") + F.size("wild") + F.size("lengths") >= F.col("least"))
    # of the common terms, only what some query has among its own is carried along
    often_asked = lists.select(F.explode("common").alias("part_id")).distinct()
    shared = found.join(often_asked, "part_id").groupBy("unit").agg(F.collect_list("part_id").alias("shared"))
    rows = candidates.join(shared, "unit", "left")
    hits = F.col("sure") + F.size(F.filter("common", lambda p: F.coalesce(F.array_contains("shared", p), F.lit(False))))
    texts = rows.join(index.texts, "unit")
    like = F.size(F.filter("wild", lambda t: F.call_function("ilike", F.col("content"), F.concat(F.lit("%"), t, F.lit("%")))))
    reach = F.size(F.filter("lengths", lambda n: F.length("content") >= n))
    enough = texts.select("query", "unit", "least", (hits + like + reach).cast("int").alias("hits")).filter("hits >= least").select("query", "unit", "hits")
    return top_per_group(simple.unionByName(enough), ["query"], k, F.desc("hits"), F.asc("unit"), name="rank")


def counted(has: DataFrame, wanted: DataFrame, k: int, slice_: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query, unit, hits): of each slice of units (unit, has), the k that have most of a query's parts (query, least, ids), if they have
    enough; ties by unit.  A superset of the k best of all; slices of units meet blocks of queries, each in one task."""
    units, blocks = has.count(), -(-wanted.count() // block) or 1
    slices = -(-units // (slice_ or SLICE)) or 1
    if slice_ is None:  # few texts are still work for all cores
        slices = max(slices, min(2 * has.sparkSession.sparkContext.defaultParallelism, units // LEAST_SLICE))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    u = has.withColumn("slice", F.pmod(F.xxhash64("unit"), F.lit(slices)).cast("int")).withColumn("block", each(blocks))
    q = wanted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("slice", each(slices))
    kinds = {f.name: f.dataType.simpleString() for f in [*has.schema, *wanted.schema]}

    def count_block(key, rows, asked):
        found = [np.zeros(0, np.int64)] * 3
        if rows.num_rows and asked.num_rows:
            rows = rows.sort_by("unit")
            (sizes, flat), (many, ids) = lists_of(rows.column("has")), lists_of(asked.column("ids"))
            parts, ids = np.unique(ids, return_inverse=True)
            at = np.minimum(np.searchsorted(parts, flat), max(len(parts) - 1, 0))
            known = parts[at] == flat if len(parts) else np.zeros(len(flat), bool)
            found = best_of_slice(rows.num_rows, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[known], at[known], len(parts), many, ids, asked.column("least").to_numpy(), k)
        return pa.table({"query": asked.column("query").take(pa.array(found[0])), "unit": rows.column("unit").take(pa.array(found[1])), "hits": found[2].astype(np.int32)})

    return u.groupBy("slice", "block").cogroup(q.groupBy("slice", "block")).applyInArrow(count_block, f"query {kinds['query']}, unit {kinds['unit']}, hits int")


def lists_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and elements of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def best_of_slice(texts: int, owner: np.ndarray, part: np.ndarray, parts: int, many: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, text, hits): the k texts with most parts of each query, if they have enough; ties to the first.

    Texts are numbers below `texts`, parts below `parts`; texts have the parts of the pairs (owner, part), each once; a query asks for `many` of the ids, and `least` of them."""
    of_query, of_text, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends, least = np.cumsum(many), np.maximum(least, 1)
    pairs = part.astype(np.int64) << 32
    pairs |= owner
    pairs.sort()
    bounds = np.searchsorted(pairs, np.arange(parts + 1, dtype=np.int64) << 32)
    owner = (pairs & 0xFFFFFFFF).astype(np.int32)
    del pairs
    # parts of many texts are rows of a matrix, which has at most 16 times as many bytes as the texts have parts, and at most MATRIX
    df = np.diff(bounds)
    often = np.flatnonzero(df * 16 > texts)
    often = often[np.argsort(-df[often], kind="stable")][: max(MATRIX // texts, 1)]
    row, total = np.full(parts, -1), np.uint8 if many.max() < 256 else np.uint32
    row[often] = np.arange(len(often))
    matrix = np.zeros((len(often), texts), dtype=np.uint8)
    for r, p in enumerate(often):
        matrix[r, owner[bounds[p] : bounds[p + 1]]] = 1
    for i, (begin, end) in enumerate(zip(ends - many, ends, strict=True)):
        mine = ids[begin:end]
        dense = row[mine]
        hits = matrix[dense[dense >= 0]].sum(axis=0, dtype=total)
        for p in mine[dense < 0]:
            hits[owner[bounds[p] : bounds[p + 1]]] += 1
        above = np.cumsum(np.bincount(hits, minlength=least[i] + 1)[: least[i] - 1 : -1])  # texts with the most hits, with one less, ...
        if above[-1] > k:
            place = int(np.searchsorted(above, k))
            last = len(above) - 1 - place + least[i]
            enough = np.sort(np.concatenate([np.flatnonzero(hits > last), np.flatnonzero(hits == last)[: k - (above[place - 1] if place else 0)]]))
        else:
            enough = np.flatnonzero(hits >= least[i])
        of_query.append(np.full(len(enough), i))
        of_text.append(enough)
        n.append(hits[enough].astype(np.int64))
    return np.concatenate(of_query), np.concatenate(of_text), np.concatenate(n)
