"""Web pages as documents: which URLs may be read, result lists, and ingestion."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sparkcorpus.functions.arrow import arrow

from sparkcorpus.sources.html import page_to_text

CARRIER = ipaddress.ip_network("100.64.0.0/10")
LOCAL_V6 = ipaddress.ip_network("fc00::/7")


def forbidden(host: str | None) -> bool:
    """Hosts that name this machine or a private network.  Names are not resolved."""
    if not host:
        return True
    h = host.strip("[]").lower().rstrip(".")
    if h == "localhost" or h.endswith((".localhost", ".local", ".internal")):
        return True
    try:
        ip = ipaddress.ip_address(h)
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_unspecified or ip.is_reserved or (ip.version == 4 and ip in CARRIER) or (ip.version == 6 and ip in LOCAL_V6)


@arrow("boolean")
def forbidden_host(host: pd.Series) -> pd.Series:
    return host.map(forbidden)


def may_fetch(url: Column) -> Column:
    """Only http and https URLs of public hosts."""
    scheme, host = F.try_parse_url(url, F.lit("PROTOCOL")), F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(F.lower(scheme).isin("http", "https") & host.isNotNull() & ~forbidden_host(host), F.lit(False))


def first_results(*hits: Column) -> Column:
    """Hits of the first backend that has any."""
    return F.coalesce(*[F.when(F.size(h) > 0, h) for h in hits], F.array().cast("array<struct<title:string,url:string,snippet:string>>"))


def safe_name(title: Column, url: Column, n: int = 60) -> Column:
    """A file name of a title, or of the URL's host, without characters that file systems refuse."""
    tidy = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r'[\\/:*?"<>|\r\n\t]+', " "), r"\s+", " "))
    name = F.when(tidy == "", F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("page"))).otherwise(tidy)
    return F.concat(F.trim(F.substring(name, 1, n)), F.lit(".md"))


def ingest(pages: DataFrame, as_of: str, url: str = "url", html: str = "html", least: int = 200) -> DataFrame:
    """(url, name, text) of pages with enough content, each with a header that says where it is from."""
    rows = pages.filter(may_fetch(F.col(url))).withColumn("__body", page_to_text(F.col(html))).filter(F.length("__body") >= least)
    title = F.trim(F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))
    head = F.concat(F.lit("# "), title, F.lit("\n\n> 来源："), F.col(url), F.lit(f"\n> 抓取时间：{as_of}\n\n"))
    return rows.select(F.col(url).alias("url"), safe_name(title, F.col(url)).alias("name"), F.concat(head, F.col("__body")).alias("text"))


def grow(queries: DataFrame, hits: DataFrame, per_topic: int) -> DataFrame:
    """The first `per_topic` URLs of each topic that no earlier (topic, rank) has."""
    from pyspark.sql.window import Window

    rows = hits.join(queries, "query")
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("url").orderBy("topic", "rank"))).filter("__n = 1").drop("__n")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy("rank", "url"))).filter(F.col("n") <= per_topic)
