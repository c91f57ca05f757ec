import base64
import hashlib

import duckdb
import pytest

from sparkcorpus.llm import quality_rules, url_filter, warc
from sparkcorpus.llm.scratch import Scratch
from tests.llm import brute

TEXTS = [None, "", "  \n\n\t", "One two.", "a b c d e f g h " * 6, "x\ny\nx\nx", "Ça va bien, très bien.\nHome | About | Contact\n" + "Le mot juste est ici, dans la phrase. " * 3, "word " * 30_000, "ABC!! DEF!! " * 30, "end\n", "\nend", "same line here\n\nsame line here\n"]


def test_rules_match_brute_force(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(3, "One two.", "s")]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        want = brute.base_rules(t) | brute.line_rules(t)
        assert {k: by[i][k] for k in want} == want, (i, t)


def test_rules_on_the_test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, cleaned="clean").collect()}
    for r in docs.collect():
        want = brute.base_rules(r["text"]) | brute.line_rules(r["text"])
        assert {k: got[r["doc_id"]][k] for k in want} == want
        assert len(brute.words(got[r["doc_id"]]["clean"])) == want["n_words"] - got[r["doc_id"]]["n_words_removed"]


def test_lines_go_before_documents(spark):
    prose = "The quick brown fox jumps over the lazy dog near the old river bank today."
    other = "Nobody there knew why seven small boats had left so early in spring."
    text = f"Home | News | Sport | Weather\n{prose}\nThis work is licensed under the GNU General Public License, version 3.\n{other}\nread more"
    r = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), cleaned="clean").first()
    assert r["kept"] and r["n_lines"] == 5 and r["n_lines_removed"] == 3
    assert r["clean"].split("\n") == [prose, other]
    junk = "\n".join(f"item{i} | thing{i} | other{i} | {i}" for i in range(20))
    assert not quality_rules.judge(spark.createDataFrame([(1, junk)], "doc_id long, text string")).first()["kept"]


def test_rules_of_no_rows(spark):
    assert quality_rules.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []


URLS = [None, "", "nonsense", "http://", "http://example.com", "http://example.com/", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en", "https://a.b.example.com/en/x/y", "ftp://shop.net/es/?q", "http://net/fr/", "http://xnet/fr/", "http://example.com?x=/en/", "http://a://b.net/fr/", "http://..net/es//", "http://foo.com:80/en/", "http://é.com/ü/", "http://" + "a." * 3000 + "example.com/en/" + "x/" * 3000, "http://example.com/en//", "http://a.net/es" + "/" * 500]


def test_url_filter_matches_sql(spark):
    rows = [(i, u, 7) for i, u in enumerate(URLS)] + [(4, URLS[4], 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = sorted(map(str, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rules_table(spark)).collect()]))
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url").toPandas())
    assert got == sorted(map(str, con.sql(url_filter.SQL_OP5).fetchall()))
    assert url_filter.filter_urls(df.limit(0), url_filter.rules_table(spark)).collect() == []
    with pytest.raises(ValueError):
        url_filter.rules_table(spark, [("block", "x", "no-slash")])


def test_longer_rules_than_the_usual(spark):
    rules = url_filter.rules_table(spark, [("block", "a.b.c.d", "/x/y/z/"), ("allow", "d", "/")])
    df = spark.createDataFrame([(1, "http://w.a.b.c.d/x/y/z/q"), (2, "http://b.c.d/x/y/z/"), (3, "http://a.b.c.d/x/y/")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.rule) for r in url_filter.filter_urls(df, rules, default="block").collect()) == [(1, "block", "a.b.c.d/x/y/z/"), (2, "allow", "d/"), (3, "allow", "d/")]


def test_warc_repeated_keys_and_other_columns(spark):
    rows = [(1, "u", "same", 5), (1, "u", "same", 6), (0, "u", "same", 7), (None, "u", "same", 8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2)
    scratch = Scratch(spark, "test-warc-keys")
    index = scratch.keep(warc.write(df, scratch.path("archives")), "index")
    got = sorted(((r.record_key, r.record_type, r.refers_to) for r in warc.read(index).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (0, "revisit", 1), (None, "response", None)], key=str)
    assert warc.read(index.unionByName(index)).count() == 8
    scratch.drop()


def test_warc_readers_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK", 5_000)
    df = spark.createDataFrame([(i, f"http://h/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 9) for i in range(200)], "page_id long, url string, html string").repartition(4)
    scratch = Scratch(spark, "test-warc-size")
    index = scratch.keep(warc.write(df, scratch.path("archives")), "index")
    records = warc.read(index)
    assert records.rdd.getNumPartitions() > 5 and records.count() == 200
    scratch.drop()


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/\r\nX: y", None), (4, "http://d/", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 5000), (6, "u", "same"), (None, "n", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    scratch = Scratch(spark, "test-warc")
    index = scratch.keep(warc.write(df, scratch.path("archives")), "index")
    assert index.count() == len(pages)
    got = {r["record_key"]: r for r in warc.read(index).collect()}
    top = {"same": 6, "": 4}
    for key, url, html in pages:
        data, r = (html or "").encode(), got[key]
        assert r["payload_bytes"] == len(data)
        assert r["digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        refers = top.get(html or "")
        want = None if refers in (None, key) else refers
        assert r["refers_to"] == want and r["record_type"] == ("response" if want is None else "revisit")
        assert r["payload"] == (data if want is None else None)
        assert r["url"] == (None if url is None else warc.header_safe(url))
    one = warc.read(index.filter("record_key = 5")).collect()
    assert len(one) == 1 and one[0]["payload"] == pages[4][2].encode()
    empty = scratch.keep(warc.write(df.limit(0), scratch.path("none")), "none-index")
    assert warc.read(empty).collect() == []
    scratch.drop()


def test_ranges_join_neighbours():
    assert warc.ranges([0, 10, 500], [10, 5, 5], gap=100, most=1000) == [(0, 15, [0, 1]), (500, 5, [2])]
    assert warc.ranges([0, 10], [10, 50], gap=100, most=20) == [(0, 10, [0]), (10, 50, [1])]


def test_warc_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op1_warc(spark, sf).collect())
    assert got == sorted(con.sql(warc.SQL_OP1).fetchall())
