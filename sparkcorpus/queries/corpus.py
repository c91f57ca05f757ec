"""Texts: terms, hashes, paragraphs, chunks, sentences, pages, deduplication, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkcorpus.functions import text as X
from sparkcorpus.operators import cache, chunker, sketches
from sparkcorpus.operators import relational as REL
from sparkcorpus.operators import versions
from sparkcorpus.queries.base import query
from sparkcorpus.store import Steps
from sparkcorpus.sources.html import html_to_text, page_to_text
from sparkcorpus.sources.web import ingest, may_fetch


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{2,}')) AS term, unnest(range(len(regexp_extract_all(text, '[A-Za-z0-9_]{2,}')))) AS place FROM documents),
 u AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY min(place))::INTEGER AS n FROM t GROUP BY doc_id, term)
SELECT doc_id, n AS pos, term FROM u WHERE n <= 24""")
def extract_terms(spark, t):
    """the search terms of each text."""
    return t("documents").select("doc_id", F.posexplode(X.extract_terms(F.col("text"))).alias("pos", "term")).withColumn("pos", F.col("pos") + 1)


@query("""WITH t AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-.]{2,}|\\d{2,}'))) AS term FROM documents)
SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) <= 3""")
def rare_terms(spark, t):
    """Identifiers of at most three documents."""
    words = t("documents").select("doc_id", F.explode(X.identifiers(F.col("text"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df")).filter("df <= 3")


@query("""WITH d AS (SELECT source, regexp_replace(text, '\\s+', '', 'g') AS x FROM documents), i AS (SELECT source, x, unnest(range(1, length(x) - 2)) AS i FROM d), g AS (SELECT source, substr(x, i::INTEGER, 4) AS gram FROM i),
 c AS MATERIALIZED (SELECT source, gram, count(*) AS n FROM g GROUP BY source, gram), a AS (SELECT gram, sum(n) AS total FROM c GROUP BY gram),
 d2 AS (SELECT c.source, c.gram, c.n FROM c JOIN a USING (gram) WHERE c.n >= 2 AND a.total - c.n <= 1)
SELECT source, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, gram) AS k FROM d2) WHERE k <= 40""")
def distinctive_grams(spark, t):
    """character 4-grams that a source has twice or more and others once at most, 40 of each."""
    s = t("documents").select("source", X.squash(F.col("text")).alias("text")).filter(F.length("text") >= 4)
    g = s.select("source", F.explode(X.all_ngrams(F.col("text"), 4)).alias("gram"))
    c = g.groupBy("source", "gram").agg(F.count("*").alias("n"))
    total = c.groupBy("gram").agg(F.sum("n").alias("total"))
    d = c.join(total, "gram").filter((F.col("n") >= 2) & (F.col("total") - F.col("n") <= 1))
    return REL.top_per_group(d, ["source"], 40, F.desc("n"), F.asc("gram")).select("source", "gram", "n")


@query("""WITH d AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS x FROM documents), i AS (SELECT doc_id, x, unnest(range(1, length(x))) AS i FROM d),
 g AS MATERIALIZED (SELECT DISTINCT doc_id, substr(x, i::INTEGER, 2) AS g FROM i), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
 c AS (SELECT a.doc_id, count(*) AS c FROM g a JOIN g b ON b.doc_id = a.doc_id + 1 AND a.g = b.g GROUP BY a.doc_id),
 p AS (SELECT a.doc_id, a.n AS na, b.n AS nb, coalesce(c.c, 0) AS c FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 LEFT JOIN c ON c.doc_id = a.doc_id)
SELECT doc_id, round(c / (na + nb - c), 6) AS jaccard, round(c / na, 6) AS coverage, round(c / least(na, nb), 6) AS overlap FROM p""")
def bigram_similarity(spark, t):
    """Similarities of each text to the next by character pairs, which meet as rows."""
    g = t("documents").select("doc_id", F.explode(X.ngrams(X.squash(F.col("text")), 2)).alias("g"))
    n = g.groupBy("doc_id").agg(F.count("*").alias("n"))
    b = g.select((F.col("doc_id") - 1).alias("doc_id"), "g")
    c = g.join(b, ["doc_id", "g"]).groupBy("doc_id").agg(F.count("*").alias("c"))
    p = n.join(n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("m")), "doc_id").join(c, "doc_id", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    ratio = lambda below, name: F.round(F.col("c") / below, 6).alias(name)
    return p.select("doc_id", ratio(F.col("n") + F.col("m") - F.col("c"), "jaccard"), ratio(F.col("n"), "coverage"), ratio(F.least("n", "m"), "overlap"))


@query("""WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS p FROM documents)
SELECT doc_id, count(*) AS n, max(length(p))::INTEGER AS longest FROM p GROUP BY doc_id""")
def paragraph_stats(spark, t):
    """Paragraphs of each text (none has headings)."""
    breaks = F.regexp_replace("text", r"(?m)^(#{1,6}\s+)", "\n\n$1")
    p = t("documents").select("doc_id", F.explode(F.split(breaks, r"\n\s*\n")).alias("p")).withColumn("p", X.strip(F.col("p"))).filter("p <> ''")
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("p")).alias("longest"))


@query()
def chunk_stats(spark, t):
    """Chunks of each text."""
    return chunker.chunks(t("documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("content")).alias("longest"), F.sum(F.length("content")).alias("chars"))


@query()
def sentence_index(spark, t):
    """Sentences of each text, by kind, with their characters; none may be unfaithful."""
    docs = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return chunker.sentences(docs, ends=chunker.LATIN_ENDS).groupBy("chunk_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("char_end") - F.col("char_start")).alias("chars"))


@query()
def html_text(spark, t):
    """Pages as structured text."""
    return t("pages").select("page_id", html_to_text("html").alias("text")).select("page_id", F.length("text").alias("chars"), F.size(F.filter(F.split("text", "\n"), lambda x: x.startswith("# "))).alias("headings"), F.md5("text").alias("md5"))


@query()
def page_content(spark, t):
    """The content part of pages."""
    return t("pages").select("page_id", page_to_text("html").alias("text")).select("page_id", F.length("text").alias("chars"), F.md5("text").alias("md5"))


@query("""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a\\s'))::INTEGER AS links FROM pages""")
def page_titles(spark, t):
    """Titles and numbers of links."""
    return t("pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_count("html", F.lit(r"(?i)<a\s")).alias("links"))


@query()
def web_ingest(spark, t):
    """Pages with enough content as documents."""
    return ingest(t("pages"), "2024-01-01").select("url", "name", F.md5("text").alias("md5"))


@query("""SELECT page_id, regexp_matches(url, '^https?://[^/]+') AS allowed FROM pages""")
def url_guard(spark, t):
    """URLs that may be fetched (all hosts of the table are public names)."""
    return t("pages").select("page_id", may_fetch(F.col("url")).alias("allowed"))


@query("""WITH l AS (SELECT substr(sha1(doc_id::VARCHAR), 1, 2) AS bucket, ('0x' || substr(sha1(doc_id || ':1:' || sha1(text)), 1, 15))::BIGINT::HUGEINT AS h FROM documents),
 b AS (SELECT bucket || ':' || count(*) || ':' || sum(h) AS line, count(*) AS n FROM l GROUP BY bucket)
SELECT substr(sha1(sum(n) || '|' || string_agg(line, '|' ORDER BY line)), 1, 12) AS stamp, sum(n)::BIGINT AS n FROM b""")
def corpus_stamp(spark, t):
    """K9: a stamp of the whole corpus."""
    docs = t("documents").select("doc_id", F.lit(1).alias("seq"), F.col("text").alias("content"))
    return cache.stamp(docs)


@query("""SELECT doc_id, sha256(text || chr(0) || 'offline:hash' || chr(0)) AS key, md5(text) AS md5, substr(sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), 1, 12) AS sent_hash FROM documents""")
def content_hash(spark, t):
    """Keys from content."""
    return t("documents").select("doc_id", cache.embedding_key(F.col("text"), F.lit("offline:hash")).alias("key"), F.md5("text").alias("md5"), X.short_sha1(F.col("text")).alias("sent_hash"))


@query("""SELECT doc_id, CASE WHEN length(x) > 40 THEN substr(x, 1, 40) || '…' ELSE x END AS clipped, CASE WHEN text = '' THEN 0 ELSE ceil(length(text) / 1.5) END::INTEGER AS tokens, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 30) AS title, length(regexp_replace(text, '\\s+', '', 'g'))::INTEGER AS solid
FROM (SELECT doc_id, text, regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS x FROM documents)""")
def text_measures(spark, t):
    """Clips, token estimates, titles."""
    c = F.col("text")
    return t("documents").select("doc_id", X.clip(c, 40).alias("clipped"), X.estimate_tokens(c).alias("tokens"), X.title_of(c).alias("title"), F.length(X.squash(c)).alias("solid"))


@query("SELECT doc_id, md5 FROM (SELECT doc_id, md5(text) AS md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def exact_dedup(spark, t):
    """The first document of each content; ids are all that meets, as minima."""
    return t("documents").groupBy(F.md5("text").alias("md5")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "md5")


@query("SELECT count(DISTINCT md5(text)) AS distinct_texts, count(*) AS texts FROM documents")
def distinct_content(spark, t):
    """A5, A4: distinct contents."""
    return t("documents").agg(F.countDistinct(F.md5("text")).alias("distinct_texts"), F.count("*").alias("texts"))


@query()
def approx_distinct(spark, t):
    """A5 at scale: distinct contents by a sketch of fixed size."""
    return t("documents").groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("distinct_texts"))


@query("""WITH d AS (SELECT lang, text, length(text)::BIGINT AS size FROM documents)
SELECT lang, count(*) AS n, min(size) AS low, max(size) AS high, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS deviation, count(DISTINCT text) AS texts, TRUE AS distinct_close, TRUE AS quantiles_close FROM d GROUP BY lang""")
def merged_sketches(spark, t):
    """Lengths and distinct texts of languages by sketches of 16 parts each, merged; and whether they are as
    close to the exact numbers as stated."""
    d = t("documents").select("lang", "text", F.length("text").cast("long").alias("size"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(16)).alias("part"))
    parts = Steps(spark, "sketches").keep(sketches.sketched(d, ["part", "lang"], F.col("text"), F.col("size")), "parts")
    told = sketches.statistics(sketches.merged(parts, ["lang"]), ["lang"]).withColumnRenamed("lang", "l")
    exact = d.groupBy("lang").agg(F.countDistinct("text").alias("texts"))
    asked = told.select("l", F.explode("quantiles").alias("share", "q"))
    ranks = d.join(asked, d["lang"].eqNullSafe(asked["l"])).groupBy("lang", "share").agg(F.avg((F.col("size") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("size") <= F.col("q")).cast("double")).alias("upto"))
    off = 2 * sketches.rank_error()
    close = ranks.groupBy(F.col("lang").alias("k")).agg(F.bool_and((F.col("below") - off <= F.col("share")) & (F.col("share") <= F.col("upto") + off)).alias("quantiles_close"))
    near = F.abs(F.col("distinct") - F.col("texts")) <= 4 * sketches.distinct_error() * F.col("texts")
    out = exact.join(told, F.col("lang").eqNullSafe(F.col("l"))).join(close, F.col("lang").eqNullSafe(F.col("k")))
    return out.select("lang", "n", "low", "high", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "texts", near.alias("distinct_close"), "quantiles_close")


@query("""WITH d AS (SELECT page_id AS id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(html) AS chunk_count FROM pages)
SELECT id, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY chunk_count DESC, id) AS k FROM d) WHERE k = 1""")
def same_source_dedup(spark, t):
    """Of pages with one source the largest, then the first."""
    d = t("pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("source_url"), F.lit("").alias("name"), F.length("html").alias("chunk_count"), F.col("page_id").alias("uploaded_at"))
    return REL.same_source(d).select("id", F.col("source_url").alias("host"))


@query("""WITH c AS (SELECT DISTINCT md5(text) AS key FROM documents WHERE lang = 'en')
SELECT lang, count(*) FILTER (c.key IS NOT NULL) AS hits, count(*) FILTER (c.key IS NULL) AS misses FROM documents LEFT JOIN c ON c.key = md5(text) GROUP BY lang""")
def cache_hit_miss(spark, t):
    """Documents whose content a cache (that of the English ones) has."""
    d = t("documents").select("lang", F.md5("text").alias("key"))
    hits, misses = cache.lookup(d, d.filter("lang = 'en'").select("key").distinct())
    both = hits.select("lang", F.lit(1).alias("h")).unionByName(misses.select("lang", F.lit(0).alias("h")))
    return both.groupBy("lang").agg(F.sum("h").alias("hits"), F.sum(1 - F.col("h")).alias("misses"))


@query("""SELECT 'documents' AS cache, count(*) AS entries, coalesce(sum(n_chars), 0)::BIGINT AS hits FROM documents UNION ALL SELECT 'labels', count(*), coalesce(sum(quality), 0)::BIGINT FROM labels UNION ALL SELECT 'pages', count(*), 0 FROM pages""")
def cache_stats(spark, t):
    """Entries and hits of several caches."""
    none = F.lit(None).cast("timestamp").alias("last_hit_at")
    return cache.stats(documents=t("documents").select(F.col("n_chars").alias("hits"), none), labels=t("labels").select(F.col("quality").cast("long").alias("hits"), none), pages=t("pages").select(F.lit(0).cast("long").alias("hits"), none)).drop("last_hit_at")


@query("""SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents WHERE lang <> 'en' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en') GROUP BY md5(text)""")
def upsert_ignore(spark, t):
    """The rows that an insert with ON CONFLICT DO NOTHING would add."""
    d = t("documents").select(F.md5("text").alias("key"), "doc_id", "lang")
    new = d.filter("lang <> 'en'").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return REL.upsert_ignore(d.filter("lang = 'en'").select("key"), new, ["key"])


@query("""SELECT d.doc_id, d.n_chars FROM documents d JOIN labels l USING (doc_id) WHERE d.n_chars > 0 AND l.quality <> 1""")
def stale_docs(spark, t):
    """Documents whose model (here, the label) is not the current one."""
    d = t("documents").join(t("labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("chunk_count"), F.col("quality").cast("string").alias("embed_model"), F.col("doc_id").alias("uploaded_at"))
    return cache.stale(d, "1").select(F.col("id").alias("doc_id"), F.col("chunk_count").alias("n_chars"))


@query("""SELECT doc_id, seq, kind FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS seq, lang AS kind FROM documents) WHERE seq BETWEEN 2 AND 5""")
def middle_slice(spark, t):
    """Rows two to five of each source."""
    return REL.middle_slice(t("documents"), ["source"], "doc_id", 2, 5).select("doc_id", F.col("rn").alias("seq"), F.col("lang").alias("kind"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 50")
def hash_sample(spark, t):
    """A sample of 50 that any run repeats."""
    return REL.sample_by_hash(t("documents").select("doc_id"), "doc_id", 50)


@query("""SELECT doc_id, CASE WHEN regexp_matches(x, '[?？]|^(?i:why|how|what|when|who)\\b') THEN 'question' WHEN regexp_matches(x, '(?i)\\bif\\b|\\bunless\\b') THEN 'condition' WHEN regexp_matches(x, '(?i)\\bbecause\\b|\\btherefore\\b|\\bhence\\b') THEN 'cause'
 WHEN regexp_matches(x, '(?i)\\bbut\\b|\\bhowever\\b|\\bwhereas\\b') THEN 'contrast' WHEN regexp_matches(x, '(?i)\\bfor example\\b|\\be\\.g\\.') THEN 'example' ELSE 'plain' END AS kind FROM (SELECT doc_id, text AS x FROM documents)""")
def sentence_types(spark, t):
    """kinds of texts by their words."""
    return t("documents").select("doc_id", X.sentence_type(F.col("text")).alias("kind"))


@query("""WITH o AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0), n AS (SELECT doc_id, text FROM documents WHERE doc_id % 19 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text IS DISTINCT FROM n.text""")
def changed_documents(spark, t):
    """K3, K9: documents that differ between two versions of the corpus (one lacks some ids, has longer texts for others), by stamps of buckets, then of documents."""
    d = t("documents").select("doc_id", "text")
    old = d.filter("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    base = Steps(spark, "stamps").base
    a, b = (versions.Stamped(spark, f"{base}/{name}").write(x, columns=["text"]) for name, x in (("old", old), ("new", d.filter("doc_id % 19 <> 0"))))
    return versions.changes(a, b)
