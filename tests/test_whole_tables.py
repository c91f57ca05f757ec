"""Queries that SQL does not express, against plain versions over whole tables."""

import itertools
import math
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest

import __spark_entry__  # noqa: F401  (registers all queries)
from sparkcorpus.operators import chunker
from sparkcorpus.queries.base import QUERIES
from sparkcorpus.queries.search import pool
from sparkcorpus.sources.html import html_to_text, page_to_text
from tests.test_memory import fold


@pytest.fixture(scope="module")
def table(spark, sf):
    return lambda name: spark.read.parquet(f"{sf}/{name}.parquet")


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def solid(text):
    return "".join(text.split())


def test_chunk_stats(spark, sf, table):
    texts = {r["doc_id"]: r["text"] for r in table("documents").collect()}
    found = defaultdict(list)
    for r in chunker.chunks(table("documents")).orderBy("doc_id", "seq").collect():
        found[r["doc_id"]].append(r["content"])
    for k, parts in found.items():
        begin, whole = 0, solid(texts[k])
        for p in parts:  # chunks are stretches of the text, in order; they may overlap, and short paragraphs are left out
            here = whole.find(solid(p), begin)
            assert here >= 0, (k, p[:80])
            begin = here + 1
    want = {(k, len(p), max(map(len, p)), sum(map(len, p))) for k, p in found.items()}
    assert {tuple(r) for r in rows(spark, sf, "chunk_stats")} == want


def test_sentence_index(spark, sf, table):
    docs = table("documents").selectExpr("doc_id AS chunk_id", "text AS content")
    sentences = chunker.sentences(docs, ends=chunker.LATIN_ENDS).collect()
    texts = {r["chunk_id"]: r["content"] for r in docs.collect()}
    by, count = defaultdict(list), defaultdict(lambda: [0, 0])
    for s in sentences:
        assert texts[s["chunk_id"]][s["char_start"] : s["char_end"]] == s["text"]
        by[s["chunk_id"]].append(s)
        count[s["chunk_id"], s["kind"]][0] += 1
        count[s["chunk_id"], s["kind"]][1] += s["char_end"] - s["char_start"]
    for k, parts in by.items():  # every character but white space lies in one sentence
        assert "".join(solid(s["text"]) for s in sorted(parts, key=lambda s: s["seq"])) == solid(texts[k])
    assert {(r["chunk_id"], r["kind"]): [r["n"], r["chars"]] for r in rows(spark, sf, "sentence_index")} == dict(count)


class Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.words += re.findall(r"\w+", data)


def test_html_text(spark, sf, table):
    got = {r["page_id"]: r for r in rows(spark, sf, "html_text")}
    for r in table("pages").select("page_id", "html", html_to_text("html").alias("text")).collect():
        plain = Visible()
        plain.feed(r["html"])
        words = re.findall(r"\w+", r["text"])
        assert not Counter(words) - Counter(plain.words), r["page_id"]  # nothing that the page does not show
        article = re.search(r"(?is)<article.*?>(.*)</article>", r["html"])
        inside = Visible()
        inside.feed(article.group(1) if article else "")
        assert not Counter(inside.words) - Counter(words), r["page_id"]  # all that its article shows
        assert got[r["page_id"]]["chars"] == len(r["text"])


def test_page_content(spark, sf, table):
    got = {r["page_id"]: r["chars"] for r in rows(spark, sf, "page_content")}
    for r in table("pages").select("page_id", "html", page_to_text("html").alias("text")).collect():
        article = re.search(r"(?is)<article.*?>(.*)</article>", r["html"])
        if article:
            inside = Visible()
            inside.feed(article.group(1))
            assert Counter(re.findall(r"\w+", r["text"])) == Counter(inside.words)
        assert got[r["page_id"]] == len(r["text"])


def test_web_ingest(spark, sf, table):
    long_enough = {r["page_id"] for r in table("pages").select("page_id", page_to_text("html").alias("text")).collect() if len(r["text"]) >= 200}
    urls = {r["url"] for r in table("pages").collect() if r["page_id"] in long_enough}
    got = rows(spark, sf, "web_ingest")
    assert {r["url"] for r in got} == urls and all(r["name"].endswith(".md") and len(r["name"]) <= 63 for r in got)


def test_approx_distinct(spark, sf, table):
    exact = defaultdict(set)
    for r in table("documents").collect():
        exact[r["lang"]].add(r["text"])
    got = {r["lang"]: r["distinct_texts"] for r in rows(spark, sf, "approx_distinct")}
    assert set(got) == set(exact) and all(abs(n - len(exact[k])) <= 0.08 * len(exact[k]) + 1 for k, n in got.items())


def test_paired_sign_test(spark, sf):
    r = rows(spark, sf, "paired_sign_test")[0]
    n = r["win"] + r["lose"]
    z = max(abs(r["win"] - r["lose"]) - 1, 0) / math.sqrt(n)
    assert abs(r["p"] - math.erfc(z / math.sqrt(2))) < 1e-9


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, *row)
    return best


def messages(table):
    out = {}
    for _, group in itertools.groupby(table("conversations").orderBy("conv_id", "turn").collect(), key=lambda r: r["conv_id"]):
        before = ""
        for r in group:
            out[r["conv_id"] * 1000 + r["turn"]] = (r["text"], before)
            before = r["text"]
    return out


def test_longest_copies(spark, sf, table):
    pairs = messages(table)
    for r in rows(spark, sf, "longest_copies"):
        a, s = map(solid, pairs[r["id"]])
        n = longest(a, s) if a and s else None
        assert r["copied"] == (n if n is None or n >= 12 else 0)


def test_judged_answers(spark, sf, table):
    pairs = messages(table)
    got = rows(spark, sf, "judged_answers")
    assert len(got) == len(pairs)
    for r in got:
        answer, source = pairs[r["id"]]
        cited = [int(x) for x in re.findall(r"\[(\d{1,2})\]", answer)]
        assert r["has_cite"] == bool(cited) and r["cites_valid"] == (all(1 <= x <= 9 for x in cited) if cited else None)
        numbers = [x for x in re.findall(r"\d+(?:\.\d+)?", solid(re.sub(r"\[\d{1,2}\]", " ", answer))) if len(x) >= 2]
        grounded = not numbers or sum(x in solid(source) for x in numbers) >= len(numbers) / 2
        ok = bool(cited) and r["cites_valid"] is not False and grounded and r["no_label"] and r["no_echo"] and (r["copied"] is None or r["copied"] < 100)
        assert r["pass"] == ok


def test_memory_absorb(spark, sf, table):
    now = defaultdict(dict)
    for r in table("events").orderBy("event_id").collect():
        k = re.search(r'"k":\s*(-?\d+)', r["props"] or "")
        if k is None:
            continue
        topic, value = r["event_type"], k.group(1)
        mine = now[r["user_id"]]
        if topic not in mine:
            mine[topic] = (f"{topic}：{value}", value)
        elif mine[topic][1] != value:
            mine[topic] = (f"{topic}：{mine[topic][1]} → {value}", value)
    want = {(u, t, i) for u, m in now.items() for t, (i, _) in m.items()}
    assert {(r["owner"], r["topic"], r["item"]) for r in rows(spark, sf, "memory_absorb")} == want


def test_memory_topics(spark, sf, table):
    lines = defaultdict(list)
    for r in table("conversations").orderBy("conv_id", "turn").collect():
        if r["text"] is not None:
            lines[r["conv_id"]].append(f"{r['text'][:14]}：— → {len(r['text'])}")
    want = {(o, t, i) for o, own in lines.items() for t, i, _ in fold([], own)}
    assert {(r["owner"], r["topic"], r["item"]) for r in rows(spark, sf, "memory_topics")} == want


def pools(spark, sf):
    out = defaultdict(list)
    for r in pool(lambda name: spark.read.parquet(f"{sf}/{name}.parquet")).orderBy("query", "rank").collect():
        out[r["query"]].append(r)
    return out


def test_knapsack_pack(spark, sf):
    got = defaultdict(list)
    for r in rows(spark, sf, "knapsack_pack"):
        got[r["query"]].append(r["unit"])
    for q, items in pools(spark, sf).items():
        best = np.zeros((len(items) + 1, 301))  # the greatest value of the first i items in so much room
        for i, r in enumerate(items, 1):
            best[i] = best[i - 1]
            best[i, r["tokens"] :] = np.maximum(best[i, r["tokens"] :], best[i - 1, : 301 - r["tokens"]] + r["value"])
        chosen = [r for r in items if r["unit"] in got[q]]
        assert len(chosen) == len(got[q]) and sum(r["tokens"] for r in chosen) <= 300
        assert abs(sum(r["value"] for r in chosen) - best[-1, 300]) < 1e-9


def test_progressive_pack(spark, sf):
    got = {(r["query"], r["unit"]) for r in rows(spark, sf, "progressive_pack")}
    for q, items in pools(spark, sf).items():
        room, taken, count = 300, set(), Counter()
        for most in range(1, len(items) + 1):
            for r in items:
                if r["unit"] not in taken and count[r["source"]] < most and r["tokens"] <= room:
                    taken.add(r["unit"])
                    count[r["source"]] += 1
                    room -= r["tokens"]
        assert {u for k, u in got if k == q} == taken


def test_mmr_filter(spark, sf):
    got = {(r["query"], r["unit"]) for r in rows(spark, sf, "mmr_filter")}
    for q, items in pools(spark, sf).items():
        taken = []
        for r in items:
            v = np.array(r["embedding"], float)
            v /= np.linalg.norm(v)
            if len(taken) < 8 and all(v @ w <= 0.6 for _, w in taken):
                taken.append((r["unit"], v))
        assert {u for k, u in got if k == q} == {u for u, _ in taken}


def test_kmeans_topics(spark, sf, table):
    got = {r["cluster"]: r["size"] for r in rows(spark, sf, "kmeans_topics")}
    assert len(got) == 8 and sum(got.values()) == table("embeddings").count()
    from sparkcorpus.operators import cluster

    members = cluster.kmeans(table("embeddings"), 8).select("embedding", "cluster").collect()
    x, c = np.array([r["embedding"] for r in members]), np.array([r["cluster"] for r in members])
    means = np.stack([x[c == k].mean(0) for k in range(8)])
    near = ((x[:, None, :] - means[None]) ** 2).sum(2)
    # nearly all lie with the nearest mean: the fit has converged
    assert (near.argmin(1) == c).mean() > 0.9


def test_topic_tree(spark, sf, table):
    """Every vector is placed, and both levels are used; tests/test_vector_index.py follows the rounds themselves."""
    got = rows(spark, sf, "topic_tree")
    assert {r["vec_id"] for r in got} == {r["vec_id"] for r in table("embeddings").collect()}
    assert {r["cluster"] for r in got} <= set(range(6)) and {r["part"] for r in got} <= set(range(3)) and len({(r["cluster"], r["part"]) for r in got}) > 6
