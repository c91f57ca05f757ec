import math
import random
import re

import pytest

from sparkcorpus.config import Retrieval
from sparkcorpus.operators import gram_index as GI, retrieval as R


def terms_of(text):
    words = re.findall("[A-Za-z0-9_]{2,}", text or "")
    cjk = re.findall("[一-鿿]", text or "")
    pairs = [a + b for a, b in zip(cjk, cjk[1:])] if len(cjk) > 1 else cjk
    return list(dict.fromkeys(words + pairs))[:24]


def has(text, term, escape):
    if "_" in term and not escape:
        return re.search("".join("." if c == "_" else re.escape(c) for c in term.lower()), text.lower(), re.S) is not None
    return term.lower() in text.lower()


def brute(queries, units, k, escape):
    out = []
    for q, text in queries:
        terms = terms_of(text)
        least = max(2, math.ceil(len(terms) * 0.25))
        scored = sorted((-n, u) for u, t in units if t is not None and (n := sum(has(t, x, escape) for x in terms)) >= least) if terms else []
        out += [(q, u, -n, i) for i, (n, u) in enumerate(scored[:k], 1)]
    return sorted(out)


def some_texts(n, seed):
    rng = random.Random(seed)
    words = ["redis", "Redis", "RDB", "aof", "an", "is", "__", "___", "a_f", "_x", "x_", "k8s", "中文", "中文检索", "检", "snapshot", "snap", "The", "tha", "9", "10"]
    return [(i, rng.choice([None, "", "_"]) if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for i in range(n)]


@pytest.mark.parametrize("escape,dense,written", [(False, 0.005, False), (False, 0.3, True), (True, 0.005, True), (True, 2.0, False)])
def test_counts_equal_a_plain_scan(spark, monkeypatch, escape, dense, written):
    monkeypatch.setattr(GI, "DENSE", dense)
    units, queries = some_texts(150, 1), some_texts(40, 2) + [(90, "__ ___ ____"), (91, "__ ___"), (92, "_ a"), (93, None), (94, "an an an"), (95, "检")]
    schema = "id long, content string"
    table = spark.createDataFrame(units, schema)
    asked = spark.createDataFrame(queries, "query long, text string")
    source = GI.build(table) if written else table
    got = R.keyword_channel(asked, source, 6, conf=Retrieval(escape_wildcards=escape)).collect()
    assert sorted((r["query"], r["unit"], r["hits"], r["rank"]) for r in got) == brute(queries, units, 6, escape)


def test_one_index_serves_many_searches(spark):
    units = some_texts(80, 5)
    index = GI.build(spark.createDataFrame(units, "id long, content string"))
    for seed in (6, 7):
        queries = some_texts(10, seed)
        got = R.keyword_channel(spark.createDataFrame(queries, "query long, text string"), index, 4).collect()
        assert sorted((r["query"], r["unit"], r["hits"], r["rank"]) for r in got) == brute(queries, units, 4, Retrieval().escape_wildcards)


def test_no_texts_and_no_queries(spark):
    table, asked = spark.createDataFrame(some_texts(5, 1), "id long, content string"), spark.createDataFrame(some_texts(5, 2), "query long, text string")
    assert R.keyword_channel(asked, table.limit(0), 3).count() == 0 and R.keyword_channel(asked.limit(0), table, 3).count() == 0


def test_common_terms_make_no_candidates(spark):
    """Of 400 texts with a common word all would meet the query by it; the count filter leaves those with a rarer one."""
    units = [(i, f"common word{i}") for i in range(400)]
    asked = spark.createDataFrame([(1, "common word7 word8")], "query long, text string")
    index = GI.build(spark.createDataFrame(units, "id long, content string"))
    got = R.keyword_channel(asked, index, 500).collect()
    assert sorted(r["unit"] for r in got) == sorted(i for i in range(400) if sum(x in f"common word{i}" for x in ("common", "word7", "word8")) >= 2)


def test_blocks_of_texts_and_queries_count_what_a_plain_scan_counts(spark):
    """Every text is a candidate of every query; no slice gives more than k of them for a query."""
    rng = random.Random(3)
    has = [(u, sorted(rng.sample(range(40), rng.randrange(0, 30)))) for u in range(60)]
    asked = [(q, 2, [rng.randrange(45) for _ in range(12)]) for q in range(20)]
    units, wanted = spark.createDataFrame(has, "unit long, has array<long>"), spark.createDataFrame(asked, "query long, least int, ids array<long>")
    for sizes in ({}, {"slice_": 25, "block": 8}):
        got = GI.counted(units, wanted, 5, **sizes).collect()
        assert len(got) <= 5 * 20 * (3 if sizes else 1)
        for q, least, ids in asked:
            want = sorted((-n, u) for u, parts in has if (n := sum(i in parts for i in ids)) >= least)[:5]
            assert sorted((-r["hits"], r["unit"]) for r in got if r["query"] == q)[:5] == want
