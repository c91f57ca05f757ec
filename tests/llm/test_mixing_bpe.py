import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkcorpus.llm import bpe, mixing
from tests.llm import brute


def test_targets_share_the_excess():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    got = mixing.targets([1, 100, 100], [5, 2, 1])
    assert got[0] == 3 and abs(sum(got) - 201) < 1e-9 and abs(got[1] - 2 * got[2]) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]


def test_tree_keeps_quotas():
    quotas = np.array([1000, 3, 0, 77])
    share = mixing.split_quotas(quotas, 7, 1)
    assert (share.sum(axis=0) == quotas).all() and (share >= 0).all()
    assert (share == mixing.split_quotas(quotas, 7, 1)).all()
    assert abs(share.sum(axis=1) - quotas.sum() / 7).max() <= 3


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, ["b", "a", None, "ä", "z"][min(4, int(rng.exponential(1.2)))], "w " * int(rng.integers(0, 60))) for i in range(3000)]
    rows += [(None, "a", None), (5, rows[5][1], rows[5][2]), (7, "tiny", "one")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = [r.asDict() for r in mixing.mix(df.withColumn("size", df["doc_id"])).collect()]
    assert len(got) == len(rows)
    names = sorted({r[1] for r in rows if r[1] is not None}) + [None]
    sizes = [sum(len(brute.words(t)) for _, s, t in rows if s == n) for n in names]
    goal = dict(zip(names, brute.mixing_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    for n, size in zip(names, sizes, strict=True):
        mine = [r for r in got if r["source"] == n]
        assert all(r["source_size"] == size and abs(r["target"] - goal[n]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - goal[n]) <= 30.5
        assert all(r["taken"] == r["size"] * r["times"] and r["times"] <= 3 and len(r["shards"]) == r["times"] for r in mine)
    again = mixing.mix(df.repartition(2)).collect()
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["taken"], r["shards"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    narrow = mixing.mix(df, keep_text=False)
    assert "text" not in narrow.columns
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in narrow.collect()) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got)


@pytest.mark.parametrize("parts,keep_text", [(1, True), (5, True), (5, False)])
def test_targets_are_met_between_equal_rows(spark, parts, keep_text):
    """Half of a source, and a third of all rows, are copies of one row."""
    rows = [(7, "s2", "w " * 60)] * 3000 + [(100 + i, "s2", "w " * 60) for i in range(3000)] + [(10_000 + i, f"s{i % 2}", "w " * 20) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("more", F.lit("x")).repartition(parts)
    got = mixing.mix(df, keep_text=keep_text).collect()
    assert len(got) == len(rows)
    for name in ("s0", "s1", "s2"):
        mine = [r for r in got if r["source"] == name]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 31
        assert all(r["taken"] == r["size"] * r["times"] and r["times"] <= 3 and len(r["shards"]) == r["times"] for r in mine)
    again = mixing.mix(df.repartition(3), keep_text=keep_text).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_shards_are_disjoint_and_proportional(spark):
    rows = [(i, f"s{i % 3}", "w " * (i % 40 + 1)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    mixed = mixing.mix(df, shards=4)
    want = Counter((r["doc_id"], k, s) for r in mixed.collect() for k, s in enumerate(r["shards"]))
    drawn = mixing.materialise(mixed)
    parts = drawn.withColumn("p", F.spark_partition_id()).collect()
    assert Counter((r["doc_id"], r["draw"], r["shard"]) for r in parts) == want and max(want.values()) == 1
    assert all(r["p"] // mixing.SLICES == r["shard"] for r in parts)  # a shard is a row of partitions
    sizes = Counter(r["p"] for r in parts)
    assert len(sizes) == 4 * mixing.SLICES and max(sizes.values()) < 3 * len(parts) / len(sizes)
    for source in ("s0", "s1", "s2"):
        mine = Counter(r["shard"] for r in parts if r["source"] == source)
        assert set(mine) == {0, 1, 2, 3} and max(mine.values()) < 2 * min(mine.values())
    assert mixing.shard_count(mixing.keyed(df, "doc_id", "source", "text", 1)) == 1


def test_repeated_and_very_long_rows(spark):
    df = spark.createDataFrame([(1, "a", "w " * 200_000)] * 2 + [(2, "b", "x y")] * 3 + [(3, None, "")], "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    assert len(got) == 6 and len({(r["doc_id"], r["taken"]) for r in got}) == 3
    assert all(r["taken"] == 6 for r in got if r["doc_id"] == 2)  # three times all that the source has


def test_mix_of_no_rows(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []


def reference(path=None):
    with open(path or public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, sf):
    enc = reference()
    rng = np.random.default_rng(1)
    letters = ["a", "the", " ", "  ", "\n", "'s", "é", "日本", "🙂", "12", "!?", "\t", "<|endoftext|>"]
    texts = [None, "", " ", "   x", "a" * 700, "don't " * 200, " " * 500, "x" + " " * 400 + "y", "<|endoftext|>"]
    texts += ["".join(rng.choice(letters, 600)) for _ in range(30)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for chunk, overlap in ((64, 16), (50, 7), (100_000, 100)):
        got = bpe.encode(df, chunk=chunk, overlap=overlap).collect()
        assert len(got) == len(rows)
        for r in got:
            text = texts[r["doc_id"]] or ""
            ids = enc.encode_ordinary(text)
            assert r["ids"] == ids and r["n_tokens"] == len(ids)
            assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
            assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.encode(spark.read.parquet(f"{sf}/documents.parquet"), chunk=2000, overlap=100, digest_only=True).collect():
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, enc.encode_ordinary(docs[r["doc_id"]]))).encode()).hexdigest()
    assert bpe.encode(df.limit(0)).collect() == []


def test_long_texts_take_the_stitched_path(spark):
    """With production parameters, and columns of types that have no order."""
    enc = reference()
    rng = np.random.default_rng(2)
    texts = ["x" * 90_000, "".join(rng.choice(["word ", "\u65e5\u672c", "1234", "\n\n", "don't "], 30_000)), "short", "  " * 40_000 + "end"]
    df = spark.createDataFrame([(i, t, {"k": i}) for i, t in enumerate(texts)], "doc_id long, text string, extra map<string,int>")
    got = {r["doc_id"]: r for r in bpe.encode(df).collect()}
    assert len(got) == 4
    for i, t in enumerate(texts):
        assert got[i]["ids"] == enc.encode_ordinary(t) and got[i]["extra"] == {"k": i}
