"""URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into every (host suffix, path prefix) pair that a rule could name: the
host and what follows each of its dots, and the path up to and with each of its slashes, with as many labels and
slashes as the rules have at most.  So the number of expressions has a bound, however long the URL.
Expressions meet rules in an equi-join on the first bytes of their SHA-256; the full
digest confirms the match, and of all rules that fit a URL the longest wins.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules of the query, (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Hex digits of the digest that the join compares; the rest is confirmed after it.
PREFIX = 8


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table; a rule's path must begin and end with a slash, as expressions do."""
    rows = []
    for verdict, host, path in rules:
        if not (path.startswith("/") and path.endswith("/")):
            raise ValueError(f"the path of a rule begins and ends with a slash: {host}{path}")
        if verdict not in ("allow", "block"):
            raise ValueError(f"not a verdict: {verdict}")
        digest = hashlib.sha256(f"{host}{path}".encode()).hexdigest()
        rows.append((digest[:PREFIX], digest, f"{host}{path}", len(host) + len(path), len(path), host.count(".") + 1, path.count("/"), verdict))
    return spark.createDataFrame(rows, "rule_prefix string, rule_digest string, rule string, rule_length int, rule_path_length int, rule_labels int, rule_slashes int, rule_verdict string")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL as the filter reads them; both empty without a `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def expressions(host: Column, path: Column, most_labels: int, most_slashes: int) -> Column:
    """The host-suffix / path-prefix expressions of a URL with no more labels and slashes than these, as strings."""
    labels = F.split(host, r"\.", -1)
    labels = F.slice(labels, F.greatest(F.size(labels) - F.lit(most_labels - 1), F.lit(1)), F.lit(most_labels))
    parts = F.split(path, "/", most_slashes + 1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return F.when((host == "") | ~path.startswith("/"), F.array().cast("array<string>")).otherwise(pairs)


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`df` with host, path, rule and verdict for each row.

    A null URL, or one without `://`, has an empty host and path and no rule.  Repeated rows
    stay repeated.  Columns of `df` named host, path, rule or verdict are replaced.  An empty
    table gives an empty table.  Rules of one length go by the longer path, then block
    before allow, then by their text.
    """
    made = ("host", "path", "rule", "verdict")
    base = df.drop(*made)
    host, path = url_parts(base[url])
    most = rules.agg(F.coalesce(F.max("rule_labels"), F.lit(1)), F.coalesce(F.max("rule_slashes"), F.lit(1))).first()
    keyed = base.withColumns({"host": host, "path": path}).withColumn("__row", F.monotonically_increasing_id())
    # the columns of the row travel as one struct, so none can clash with those of the rules
    whole = keyed.select("__row", F.struct(*[keyed[c] for c in keyed.columns if c != "__row"]).alias("__doc"), expressions(F.col("host"), F.col("path"), *most).alias("__all"))
    each = whole.select("__row", "__doc", F.explode_outer("__all").alias("__expression"))
    each = each.withColumn("__digest", F.sha2("__expression", 256)).withColumn("__prefix", F.substring("__digest", 1, PREFIX))
    met = each.join(rules, each["__prefix"] == rules["rule_prefix"], "left")
    fits = F.col("__digest") == F.col("rule_digest")
    rank = F.when(fits, F.struct("rule_length", "rule_path_length", (F.col("rule_verdict") == "block").alias("blocks"), "rule", "rule_verdict"))
    best = met.groupBy("__row").agg(F.any_value("__doc").alias("__doc"), F.max(rank).alias("__best"))
    return best.select("__doc.*", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.rule_verdict"), F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rules_table(spark)).select("page_id", "host", "path", "rule", "verdict")


SQL_OP5 = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
 split AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
 rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
   ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
 fits AS (
  SELECT s.n, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.n ORDER BY length(r.host || r.path) DESC, length(r.path) DESC, r.verdict DESC) AS k
  FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.n = s.n AND f.k = 1
"""
