import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from sparkcorpus.llm import jaccard_join as j
from sparkcorpus.llm.components import connected_components
from sparkcorpus.llm.scratch import Scratch
from tests.llm import brute


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.classes(df).collect())
    assert got == sorted(brute.jaccard_groups(rows))


@pytest.mark.parametrize("heavy", [32, 4])
def test_random_families(spark, monkeypatch, heavy):
    rng = random.Random(heavy)
    monkeypatch.setattr(j, "LEAST_HEAVY", heavy)
    monkeypatch.setattr(j, "BLOCK", heavy)
    texts = [None, "", " \n", "one", "One", "a b c d", "A B C D", "a b c d e", "x y " * 300]
    texts += family(rng, 60, 120, 9) + family(rng, 40, 60, 4) + family(rng, 12, 30, 2) + family(rng, 5, 900, 40)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(40)) for _ in range(50)]
    texts += [texts[9]] * 7
    rng.shuffle(texts)
    check(spark, [(i, t) for i, t in enumerate(texts)])


def test_chains_across_leaders(spark):
    # each text is near the next one only, so leaders alone would not connect the chain
    words = [f"c{i}" for i in range(400)]
    check(spark, [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(40)])


def test_repeated_rows_and_null_keys(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text), (3, text), (None, text), (5, text + " more"), (None, None)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, component_id int")
    got = sorted(map(str, [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.classes(df).collect()]))
    assert got == sorted(map(str, [(3, 26, 3), (3, 26, 3), (None, 26, None), (5, 27, 3), (None, 0, None)]))
    assert j.classes(df.limit(0)).collect() == []


def test_prefixes_of_linked_sets_share_enough():
    rng = np.random.default_rng(0)
    heavy = np.arange(0, 4000, 7, dtype=np.uint64)
    order = j.Order(heavy, rng.integers(32, 5000, len(heavy)))
    for _ in range(300):
        base = rng.choice(4000, int(rng.integers(5, 200)), replace=False).astype(np.uint64)
        a, b = np.unique(base), np.unique(np.concatenate([base[int(rng.integers(0, 1 + len(base) // 5)) :], rng.choice(4000, int(rng.integers(0, 1 + len(base) // 6))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        x, y = (order.prefix(s, order.find(s), 80) for s in (a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common):
            assert len(np.intersect1d(x[0][: x[2]], y[0][: y[2]])) >= min(x[3], y[3])


def test_common_items():
    rng = np.random.default_rng(1)
    x, y = ([rng.choice(50, int(rng.integers(0, 30)), replace=False) - 25 for _ in range(200)] for _ in range(2))
    lists = [pa.array([list(map(int, z)) for z in side], pa.list_(pa.int64())) for side in (x, y)]
    assert j.common_items(*lists).tolist() == [len(set(a) & set(b)) for a, b in zip(x, y, strict=True)]


def test_longer_prefixes_leave_fewer_candidates(spark, monkeypatch):
    """Texts of three words, whose shingles are all common: with l = 1 each that two prefixes share makes a candidate."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(60))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(j, "LEAST_HEAVY", 4)
    monkeypatch.setattr(j, "FEW", 1000)  # all candidates as rows, none in blocks that sketches thin out
    left, kept = {}, j.shared
    for most in (1, 8):
        monkeypatch.setattr(j, "MOST_SHARED", most)
        seen = []
        monkeypatch.setattr(j, "shared", lambda pairs, owned: (out := kept(pairs, owned), seen.append(out.count()))[0])  # noqa: B023
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.classes(df).collect())
        assert got == sorted(brute.jaccard_groups(rows))
        left[most] = sum(seen)
    assert left[8] < left[1]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)] + [(7, 7)]
    scratch = Scratch(spark, "test-components")
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    want = brute.components(linked, [x for x in links if x[0] != x[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), scratch, "none").collect() == []


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.op8_jaccard_join(spark, sf).collect())
    assert got == sorted(con.sql(j.SQL_OP8).fetchall())
