import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_mixing_bpe import reference


def test_stages_match_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns, seen = docs.columns, {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
        assert name == "tokens" or now.columns == columns
    assert list(stages) == ["quality", "jaccard", "substrings", "mixing", "tokens"]

    kept = {r["doc_id"] for r in seen["quality"]}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [k for k, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(k in kept for k in good) >= 0.97 * len(good)
    assert not any(k in kept for k, r in labels.items() if r["quality"] == 0)

    groups = brute.jaccard_groups([(r["doc_id"], r["text"]) for r in seen["quality"]])
    assert sorted(r["doc_id"] for r in seen["jaccard"]) == sorted(k for k, _, c in groups if k == c)

    want = brute.repeats([r["text"] for r in seen["jaccard"]])
    left = {r["doc_id"]: r for r in seen["substrings"]}
    assert len(left) == len(want)
    for r, (_, _, digest) in zip(seen["jaccard"], want, strict=True):
        text = left[r["doc_id"]]["text"]
        assert hashlib.sha256(" ".join(brute.words(text)).encode()).hexdigest() == digest
        assert left[r["doc_id"]]["n_chars"] == len(text)

    times = Counter(r["doc_id"] for r in seen["mixing"])
    assert max(times.values()) <= 3 and set(times) <= set(left)
    assert all(left[r["doc_id"]]["text"] == r["text"] for r in seen["mixing"])
    sizes = {k: len(brute.words(r["text"])) for k, r in left.items()}
    total, taken = sum(sizes.values()), sum(sizes[k] * n for k, n in times.items())
    assert abs(taken - total) < 0.2 * total

    enc = reference()
    assert Counter(r["doc_id"] for r in seen["tokens"]) == times
    for r in seen["tokens"]:
        assert r["ids"] == enc.encode_ordinary(left[r["doc_id"]]["text"])


def test_run_gives_the_last_stage(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and got.count() > 0


def test_near_duplicates_are_decided_by_row(spark, sf):
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("a")), (None, text("a") + " more"), (None, text("b")), (7, text("c")), (7, text("c"))]
    rows += [(1, text("d")), (9, text("d")), (9, text("e")), (9, text("f")), (None, text("f")), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.jaccard(spark, docs, sf).collect()]
    a = [x for x in got if x[1] and x[1].startswith("a0 ")]
    assert len(a) == 1 and a[0][0] is None
    want = [(None, text("b")), (7, text("c")), (1, text("d")), (9, text("e")), (9, text("f")), (9, ""), (9, ""), (None, None)]
    assert sorted(map(str, got)) == sorted(map(str, [*a, *want]))


def odd_rows(spark, sf):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = ["size", "kept", "component_id", "shard", "n_tokens", "block", "__x"]
    docs = docs.select("*", *[F.lit(7).alias(c) for c in extra])
    first = docs.first().asDict()
    rows = [first | change for change in ({"text": None}, {"text": ""}, {"text": " \n "}, {"doc_id": None}, {"doc_id": None, "text": None}, {"source": None}, {"lang": None, "n_chars": None}, {"text": first["text"] + " " + "long words here. " * 20_000}, {}, {})]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(3)


def test_stages_bear_odd_rows(spark, sf):
    docs = odd_rows(spark, sf).cache()
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        left = got.collect()
        assert len(left) <= 3 * n and (name == "tokens" or got.dtypes == docs.dtypes and all(r["kept"] == r["size"] == 7 for r in left)), name
        if name in ("substrings", "tokens"):
            assert len(left) == n, name
        if name == "jaccard":
            have = {r["text"] for r in left if r["text"]}
            assert all(any(brute.shingles(t) and len(brute.shingles(t) & brute.shingles(h)) >= 0.8 * len(brute.shingles(t) | brute.shingles(h)) for h in have) or not brute.shingles(t) for t in {r["text"] for r in docs.collect()} - have)
            assert len({(r["doc_id"], r["text"]) for r in left if r["text"] and r["text"].strip()}) == sum(bool(r["text"] and r["text"].strip()) for r in left)
        if name == "quality":
            assert all(r["text"] and r["text"].strip() for r in left)
        assert stage(spark, docs.limit(0), sf).collect() == [], name
