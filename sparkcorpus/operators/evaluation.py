"""Retrieval and segmentation quality, compared between arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkcorpus.functions import vector as V
from sparkcorpus.functions.text import ngrams, normal_tail, squash
from sparkcorpus.operators import term_scan, vector_scan
from sparkcorpus.operators.intervals import containing, overlapping
from sparkcorpus.store import Steps


def target_hits(targets: DataFrame, picked: DataFrame, case: str = "case") -> DataFrame:
    """(case, target, hit): targets (case, target, unit) name units of which any will do."""
    have = picked.select(case, "unit", F.lit(True).alias("__h")).distinct()
    return targets.join(have, [case, "unit"], "left").groupBy(case, "target").agg(F.bool_or(F.coalesce("__h", F.lit(False))).alias("hit"))


def all_hit(targets: DataFrame, picked: DataFrame, case: str = "case") -> DataFrame:
    return target_hits(targets, picked, case).groupBy(case).agg(F.bool_and("hit").alias("all_hit"), F.avg(F.col("hit").cast("double")).alias("recall"))


def self_hits(ranked: DataFrame, targets: DataFrame, k: int, case: str = "case") -> DataFrame:
    """Best rank of any target of a case, whether it is the first, and whether it is among k."""
    best = ranked.join(targets.select(case, "unit").distinct(), [case, "unit"]).groupBy(case).agg(F.min("rank").alias("best"))
    return targets.select(case).distinct().join(best, case, "left").select(case, "best", F.coalesce(F.col("best") == 1, F.lit(False)).alias("first"), F.coalesce(F.col("best") <= k, F.lit(False)).alias("in_k"))


def by_distance(distance: str = "distance", unit: str = "unit") -> Column:
    """The order of units: by distance, those without one last, then by id."""
    return F.struct(F.isnull(distance).alias("none"), F.col(distance).alias("distance"), F.col(unit).alias("unit"))


def best_target(distances: DataFrame, case: str = "case") -> DataFrame:
    """(case, best, best_unit): of rows (case, unit, distance) the first of each case."""
    first = distances.groupBy(case).agg(F.min(by_distance()).alias("b"))
    return first.select(case, F.col("b.distance").alias("best"), F.col("b.unit").alias("best_unit"))


def ranks(best: DataFrame, queries: DataFrame, units: DataFrame, others: bool = False, case: str = "case") -> DataFrame:
    """(case, rank) of the best targets (case, best, best_unit) of queries (query, vector) among all units (id, embedding): how many units come before
    them by (distance, unit), and one; with `others`, a query itself does not count.  There is no row for each pair, but for queries whose best has no distance."""
    best = Steps(units.sparkSession, "ranks").keep(queries.join(best.withColumnRenamed(case, "query"), "query"), "best")
    known = best.filter("best is not null")
    out = known.select("query").join(vector_scan.before(known, units, others=others), "query", "left").select(F.col("query").alias(case), (F.coalesce("n", F.lit(0)) + 1).alias("rank"))
    lost = best.filter("best is null")
    if lost.isEmpty():
        return out
    rows = units.select(F.col("id").alias("unit"), F.col("embedding").alias("__v")).join(lost).withColumn("distance", V.cosine_distance(F.col("__v"), F.col("vector")))
    ahead = (by_distance() < by_distance("best", "best_unit")) & (F.col("query") != F.col("unit") if others else F.lit(True))
    return out.unionByName(rows.groupBy(F.col("query").alias(case)).agg((F.count_if(ahead) + 1).alias("rank")))


def target_rank(queries: DataFrame, units: DataFrame, targets: DataFrame, case: str = "case") -> DataFrame:
    """(case, rank): rank of the best target (case, unit) of each query (query, vector) among all units (id, embedding)."""
    own = targets.select(F.col(case).alias("query"), "unit").distinct().join(queries, "query").join(units.select(F.col("id").alias("unit"), F.col("embedding").alias("__v")), "unit")
    best = best_target(own.select(F.col("query").alias(case), "unit", V.cosine_distance(F.col("__v"), F.col("vector")).alias("distance")), case)
    return ranks(best, queries, units, case=case)


def self_ranks(queries: DataFrame, units: DataFrame, like: str, k: int, case: str = "case") -> DataFrame:
    """`self_hits` of queries (query, vector, like) whose targets are the other units (id, embedding, like) with the query's own value of `like`, without ranking all units.
    A query without any target has no best."""
    found = Steps(units.sparkSession, "alike").keep(best_target(vector_scan.nearest_alike(queries, units, like).filter("distance is not null").withColumnRenamed("query", case), case), "best")
    lacking = queries.select(F.col("query").alias(case), like).join(found, case, "left_anti")  # all their targets are without a distance
    rest = lacking.join(units.select(F.col("id").alias("unit"), like), like).filter(F.col(case) != F.col("unit"))
    best = found.unionByName(best_target(rest.select(case, "unit", F.lit(None).cast("double").alias("distance")), case))
    ranked = ranks(best, queries.select("query", "vector"), units, others=True, case=case).withColumnRenamed("rank", "best")
    out = queries.select(F.col("query").alias(case)).join(ranked, case, "left")
    return out.select(case, "best", F.coalesce(F.col("best") == 1, F.lit(False)).alias("first"), F.coalesce(F.col("best") <= k, F.lit(False)).alias("in_k"))


#: Characters of a text's beginning by which it is looked for in others.
ANCHOR = 16


def holding(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(i, o): which texts of `inner` (i, text) those of `outer` (o, text) contain; no text is empty.

    An inner text is known by its first ANCHOR characters, or by all of it: outer texts are cut into n-grams of the lengths
    that these have, which meet them by equality; only what meets is compared in full.
    """
    anchored = inner.withColumn("n", F.least(F.length("text"), F.lit(ANCHOR)).cast("int")).withColumn("gram", F.substr("text", F.lit(1), F.col("n")))
    sizes = sorted(r["n"] for r in anchored.select("n").distinct().collect())  # ANCHOR numbers at most
    known, met = anchored.select("n", "gram").distinct(), None
    for n in sizes:
        cut = outer.select("o", F.explode(ngrams(F.col("text"), n)).alias("gram"))
        part = cut.join(known.filter(F.col("n") == n), "gram").select("o", "n", "gram")
        met = part if met is None else met.unionByName(part)
    if met is None:
        return inner.join(outer.select("o"), inner["i"] == outer["o"]).select("i", "o").limit(0)
    pairs = met.join(anchored.select("i", "n", "gram"), ["n", "gram"]).select("i", "o").distinct()
    full = pairs.join(inner.select("i", F.col("text").alias("a")), "i").join(outer.select("o", F.col("text").alias("b")), "o")
    return full.filter(F.contains("b", F.col("a"))).select("i", "o")


def find_excerpts(targets: DataFrame, units: DataFrame, unit: str = "id", content: str = "content", scope: str | None = None) -> DataFrame:
    """(case, target, unit): units that contain an excerpt, or lie within it, white space aside.

    Excerpts go to all tasks, which look through the units by windows; units that are short enough to lie within an excerpt meet
    the excerpts' n-grams.
    With `scope`, a target's own document, else its case's, limits the search.  Ids of units are unique.
    """
    steps = Steps(units.sparkSession, "excerpts")
    t = targets.withColumn("text", squash(F.col("excerpt"))).filter("text <> ''")
    doc = F.coalesce("target_doc", "case_doc") if scope else F.lit(None).cast("string")
    t = steps.keep(t.select("case", "target", doc.alias("doc"), "text"), "targets")
    excerpts = t.select("text").distinct().withColumn("i", F.sha2("text", 256))
    size = excerpts.agg(F.sum(F.octet_length("text")).alias("bytes"), F.max(F.length("text")).alias("longest")).first()
    bodies = units.select(F.col(unit).alias("o"), F.coalesce(squash(F.col(content)), F.lit("")).alias("text"))
    # only texts that are no longer than the longest excerpt can lie within one; most are longer by their beginning
    longest = size["longest"] or 0
    begins = units.filter(F.length(squash(F.substring(F.col(content), 1, 2 * longest))) <= longest)
    short = steps.keep(begins.select(F.col(unit).alias("o"), squash(F.col(content)).alias("text")).filter(F.length("text").between(1, longest)), "short")
    within = holding(short.select(F.col("o").alias("i"), "text"), excerpts.select(F.col("i").alias("o"), "text")).select(F.col("o").alias("i"), F.col("i").alias("o"))
    found = steps.keep(term_scan.holders(excerpts, bodies, size["bytes"] or 0).unionByName(within).distinct(), "found")
    out = t.withColumn("i", F.sha2("text", 256)).join(found, "i").select("case", "target", "doc", F.col("o").alias("unit"))
    if scope:
        own = units.select(F.col(unit).alias("unit"), F.col(scope).alias("__own"))
        out = out.join(own, "unit").filter(F.col("doc").isNull() | (F.col("doc") == F.col("__own")))
    return out.select("case", "target", "unit").distinct()


def audit(targets: DataFrame, found: DataFrame) -> DataFrame:
    """Targets that no unit answers; a case set with any is refused."""
    return targets.select("case", "target").distinct().join(found.select("case", "target"), ["case", "target"], "left_anti")


def window_diff(ref: DataFrame, hyp: DataFrame, sizes: DataFrame, k: int = 5) -> DataFrame:
    """(doc, windowdiff): share of windows (i, i + k], i from 1 to n - k, in which the numbers of
    boundaries differ; 0 where n <= k."""
    windows = sizes.filter(F.col("n") > k).select("doc", "n", F.explode(F.sequence(F.lit(1), F.col("n") - k)).alias("i"))

    def counted(bounds: DataFrame, name: str) -> DataFrame:
        # a boundary b lies in the windows b - k .. b - 1
        hit = bounds.select("doc", "at").distinct().select("doc", F.explode(F.sequence(F.col("at") - k, F.col("at") - 1)).alias("i"))
        return hit.groupBy("doc", "i").agg(F.count("*").alias(name))

    both = windows.join(counted(ref, "r"), ["doc", "i"], "left").join(counted(hyp, "h"), ["doc", "i"], "left")
    differ = (F.coalesce("r", F.lit(0)) != F.coalesce("h", F.lit(0))).cast("double")
    found = both.groupBy("doc").agg((F.sum(differ) / F.first(F.col("n") - k)).alias("windowdiff"))
    return sizes.select("doc").join(found, "doc", "left").withColumn("windowdiff", F.coalesce("windowdiff", F.lit(0.0)))


def segmentation(must: DataFrame, optional: DataFrame, forbidden: DataFrame, cuts: DataFrame, sizes: DataFrame, slack: int = 1) -> DataFrame:
    """Per document: recall of the boundaries that must be (within slack), cuts inside forbidden ranges, cuts
    that no annotation allows, and their density."""
    c = cuts.select("doc", "at").distinct()
    around = c.select("doc", F.explode(F.sequence(F.col("at") - slack, F.col("at") + slack)).alias("at")).distinct().withColumn("__h", F.lit(1))
    recall = must.join(around, ["doc", "at"], "left").groupBy("doc").agg(F.avg(F.coalesce("__h", F.lit(0))).alias("must_recall"))
    inside = forbidden.select("doc", (F.col("lo") + 1).alias("lo"), (F.col("hi") + 1).alias("hi"))  # a cut at lo is allowed, one at hi is not
    wrong = containing(c, inside, ["doc"], "at", "lo", "hi").select("doc", "at").distinct().groupBy("doc").agg(F.count("*").alias("wrong"))
    allowed = must.select("doc", "at").unionByName(optional.select("doc", "at")).select("doc", F.explode(F.sequence(F.col("at") - slack, F.col("at") + slack)).alias("at")).distinct()
    unmarked = c.join(allowed, ["doc", "at"], "left_anti").groupBy("doc").agg(F.count("*").alias("unmarked"))
    n = c.groupBy("doc").agg(F.count("*").alias("cuts"))
    out = sizes.join(recall, "doc", "left").join(wrong, "doc", "left").join(unmarked, "doc", "left").join(n, "doc", "left").fillna(0, ["wrong", "unmarked", "cuts"])
    return out.withColumn("density", F.col("cuts") / F.col("n"))


def paired(a: DataFrame, b: DataFrame, case: str = "case", value: str = "score") -> DataFrame:
    """Wins, losses and ties of arm a against arm b, with the sign test's p (normal approximation)."""
    both = a.select(case, F.col(value).cast("double").alias("x")).join(b.select(case, F.col(value).cast("double").alias("y")), case)
    n = both.agg(F.count_if(F.col("x") > F.col("y")).alias("win"), F.count_if(F.col("x") < F.col("y")).alias("lose"), F.count_if(F.col("x") == F.col("y")).alias("tie"))
    z = (F.greatest(F.abs(F.col("win") - F.col("lose")) - 1, F.lit(0))) / F.sqrt(F.greatest(F.col("win") + F.col("lose"), F.lit(1)))
    return n.withColumn("p", F.when(F.col("win") + F.col("lose") > 0, normal_tail(z)).otherwise(1.0))


def histogram(df: DataFrame, value: Column, reached: Column, edges: list[float]) -> DataFrame:
    """(bucket, n, reached) by the upper edges; the last bucket is open."""
    bucket = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        bucket = F.when(value <= e, i).otherwise(bucket)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(reached).alias("reached"))


def contingency(df: DataFrame, said: Column, true: Column) -> DataFrame:
    return df.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"))


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The reference's median: the element at n // 2 of the sorted values."""
    w = Window.partitionBy(*group).orderBy(value)
    rows = df.filter(F.col(value).isNotNull()).withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy(*group))})
    return rows.filter(F.col("__i") == F.floor(F.col("__n") / 2)).select(*group, F.col(value).alias("median"))


def judge_rates(judged: DataFrame, group: list[str] = ("arm",)) -> DataFrame:
    """Pass rate of each judge over runs (flags: map of judge to verdict); null is not applicable."""
    rows = judged.select(*group, F.explode("flags").alias("judge", "ok"))
    return rows.groupBy(*group, "judge").agg(F.count("ok").alias("n"), F.avg(F.col("ok").cast("double")).alias("rate"))


def similar_pairs(units: DataFrame, gap: int = 8, near: float = 0.55, most_overlap: float = 0.35) -> DataFrame:
    """Pairs of units of one document, at least `gap` apart, close in meaning and not in wording."""
    from sparkcorpus.functions.text import overlap

    a = units.select("doc_id", F.col("seq").alias("i"), F.col("embedding").alias("va"), ngrams(squash(F.col("content")), 2).alias("ga"))
    b = units.select(F.col("doc_id").alias("d2"), F.col("seq").alias("j"), F.col("embedding").alias("vb"), ngrams(squash(F.col("content")), 2).alias("gb"))
    rows = a.join(b, (F.col("doc_id") == F.col("d2")) & (F.col("j") - F.col("i") >= gap))
    rows = rows.withColumns({"cosine": 1 - V.cosine_distance(F.col("va"), F.col("vb")), "overlap": overlap(F.col("ga"), F.col("gb"))})
    return rows.filter((F.col("cosine") >= near) & (F.col("overlap") <= most_overlap)).select("doc_id", "i", "j", "cosine", "overlap").orderBy(F.desc(F.col("cosine") - F.col("overlap")), "doc_id", "i", "j")


def sentence_recall(targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per case: whether all target spans are touched, share of their characters kept, and precision of what was kept."""
    t = targets.select("case", "target", "chunk_id", F.col("lo").alias("tl"), F.col("hi").alias("th"))
    c = chosen.select("case", "chunk_id", F.col("char_start").alias("cl"), F.col("char_end").alias("ch"))
    shared = overlapping(t, c, ["case", "chunk_id"], "tl", "th", "cl", "ch").groupBy("case", "target", "chunk_id", "tl", "th").agg(F.sum(F.least("ch", "th") - F.greatest("cl", "tl")).alias("kept"))
    every = t.groupBy("case", "target", "chunk_id", "tl", "th").agg(F.count("*").alias("times")).join(shared, ["case", "target", "chunk_id", "tl", "th"], "left")
    per = every.groupBy("case", "target", "tl", "th").agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("kept"))
    size = chosen.groupBy("case").agg(F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))
    out = per.groupBy("case").agg(F.bool_and(F.col("kept") > 0).alias("all_hit"), (F.sum("kept") / F.sum(F.col("th") - F.col("tl"))).alias("retention"), F.sum("kept").alias("kept"))
    return out.join(size, "case", "left").withColumn("precision", F.when(F.col("chars") > 0, F.col("kept") / F.col("chars")))


def distinct_outputs(runs: DataFrame, case: str = "case", output: str = "output") -> DataFrame:
    """How many different outputs the runs of each case gave, and their share of the runs."""
    n = runs.groupBy(case).agg(F.count("*").alias("runs"), F.countDistinct(output).alias("outputs"))
    return n.withColumn("share", F.col("outputs") / F.col("runs"))


def run_listing(rows: DataFrame, keys: list[str] = ("run", "arm"), at: str = "at", failed: str = "failed") -> DataFrame:
    """Recorded runs: cases, errors, and when they began and ended."""
    return rows.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(failed).alias("errors"), F.min(at).alias("started"), F.max(at).alias("ended"))


def contained(points: DataFrame, spans: DataFrame, key: str, at: str = "at", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Points of a key with the spans [lo, hi) of that key that they lie in."""
    return containing(points, spans, [key], at, lo, hi)


def first_crossings(rows: DataFrame, run: str, at: str, item: str, shares: list[float]) -> DataFrame:
    """(run, share, at): when each run had first seen these shares of its distinct items."""
    first = rows.groupBy(run, item).agg(F.min(at).alias("__t")).groupBy(run, "__t").agg(F.count("*").alias("__n"))
    seen = F.sum("__n").over(Window.partitionBy(run).orderBy("__t").rowsBetween(Window.unboundedPreceding, 0))
    grown = first.withColumns({"__seen": seen, "__all": F.sum("__n").over(Window.partitionBy(run))})
    each = grown.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).filter(F.col("__seen") >= F.col("share") * F.col("__all"))
    return each.groupBy(run, "share").agg(F.min("__t").alias(at))


def arm(hits: DataFrame, k: int, cap: int | None = None, threshold: float | None = None, source: str = "source") -> DataFrame:
    """An arm over a pool (query, unit, distance, source): within a distance, at most `cap` of a source, the k nearest."""
    rows = hits if threshold is None else hits.filter(F.col("distance") <= threshold)
    near = [F.asc("distance"), F.asc("unit")]
    if cap is not None:
        rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("query", source).orderBy(*near))).filter(F.col("__n") <= cap).drop("__n")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*near))).filter(F.col("rank") <= k)
