import random

import duckdb
import numpy as np

from sparkcorpus.llm import substring_dedup as s
from sparkcorpus.llm.kernels import Runs, Words
from tests.llm import brute


def check(spark, texts, **kw):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(4)
    got = {r["doc_id"]: r for r in s.remove_repeats(df, output="left", **kw).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(brute.repeats(texts, kw.get("width", 35))):
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want, i
        assert len(brute.words(r["left"])) == want[0] - want[1]


def sample(rng, n, vocabulary):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_random_passages(spark):
    rng = random.Random(3)
    passages = [sample(rng, n, 3000) for n in (34, 35, 36, 50, 60, 120, 400)]
    texts = [None, "", "\t\n", "short text", "same " * 100, "a b " * 90]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(4)):
            words += sample(rng, rng.randrange(80), 10**6)
            p = rng.choice(passages)
            a = rng.randrange(10)
            words += p[a : len(p) - rng.randrange(10)]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [" ".join(passages[5])] * 5 + [texts[-3], "é " * 40, "\n".join(passages[3])]
    check(spark, texts)


def test_small_windows_of_few_words(spark):
    rng = random.Random(4)
    check(spark, [" ".join(sample(rng, rng.randrange(60), 4)) for _ in range(80)], width=6, anchor=3)
    check(spark, [" ".join(sample(rng, rng.randrange(60), 3)) for _ in range(40)], width=5, anchor=5)


def test_seeds_cover_each_window_once():
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (0, 34, 35, 36, 200, 1000)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    w = Words(raw, off)
    runs = Runs(w.hashes())
    first, many, chosen = s.seeds(runs, w.bounds, 35, 12)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(first, many, strict=True)])
    assert sorted(starts) == [b + i for b, n in zip(w.bounds, w.counts, strict=False) for i in range(max(0, n - 34))]
    for a, n, c in zip(first, many, chosen, strict=True):
        for i in range(a, a + n):
            h = [int(x) for x in runs.of(np.arange(i, i + 24), np.arange(i, i + 24) + 12)]
            assert c == i + h.index(min(h))


def test_repeated_rows_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in s.remove_repeats(df).collect())
    assert got == [("1", 40, 40), ("1", 40, 40), ("None", 0, 0)]
    assert s.remove_repeats(df.limit(0)).collect() == []


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in s.op10_substring_dedup(spark, sf).collect())
    assert got == sorted(con.sql(s.SQL_OP10).fetchall())
