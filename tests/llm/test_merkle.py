import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkcorpus.llm import merkle
from tests import oracle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(leaves, f):
    """The top, and the siblings of each leaf as (left, right) by level."""
    paths, owners, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        runs = [range(i, min(i + f, len(nodes))) for i in range(0, len(nodes), f)]
        for run in runs:
            for j in run:
                for i in owners[j]:
                    paths[i].append(("".join(nodes[x] for x in run if x < j), "".join(nodes[x] for x in run if x > j)))
        owners = [[i for j in run for i in owners[j]] for run in runs]
        nodes = [sha("".join(nodes[j] for j in run)) for run in runs]
    return nodes[0], paths


def brute(rows, f=2):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops[g] = climb([leaf(r) for r in groups[g]], f)
    root, above = climb([tops[g][0] for g in names], f)
    out = []
    for g, upper in zip(names, above):
        for r, own in zip(groups[g], tops[g][1]):
            node = leaf(r)
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            for a, b in own + upper:
                node = sha(a + node + b)
            out.append((r[0], leaf(r), tops[g][0], root, sha("".join(a + b for a, b in own + upper)), node, node == root))
    return out


def made(df, **more):
    fields = [F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    own, other = merkle.leaf_hash(*fields), merkle.leaf_hash(*fields[:3], (F.col("n_chars") + 1), fields[4])
    out = merkle.manifest(df, own, F.when(hit, other).otherwise(own), **more)
    return [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def test_documents_equal_the_sql_and_the_plain_version(spark, sf):
    assert oracle.compare(merkle.op11_merkle_manifest(spark, sf), oracle.connect(sf), merkle.SQL_OP11) is None
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*FIELDS).collect()]
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, sf).collect()]
    assert Counter(got) == Counter(brute(rows)) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("fanout,block", [(2, 4), (3, 9), (5, 5), (2, 512)])
def test_fanouts_blocks_ties_and_nulls(spark, fanout, block):
    rng = random.Random(fanout)
    rows = [(rng.choice([None, -5, 7, 1 << 40, rng.randrange(-(1 << 62), 1 << 62)]), rng.choice(["a", None]), rng.choice(["en", "en", "é", None, "e", "zz"]), rng.choice([1, None]), rng.choice(["x", "", None, "wörd"])) for _ in range(220)]
    rows += [(3, "s", "one", 1, "alone")] + [(9, "s", "en", 2, "copy")] * 70
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit("clash")).withColumn("rank", F.lit(1))
    assert Counter(made(df, fanout=fanout, block=block)) == Counter(brute(rows, fanout))


def test_crowded_prefixes_get_more_digits(spark):
    """A third of all rows has one id, another third one text besides; few rows are put in order together."""
    rows = [(5, "s", "en", i, f"t{i}") for i in range(150)] + [(i, "s", "en", 1, "same") for i in range(150)] + [(8, "s", "en", 1, "copy")] * 150
    assert Counter(made(spark.createDataFrame(rows, SCHEMA), block=16, together=10)) == Counter(brute(rows))


def test_many_groups(spark):
    rows = [(i, None, f"g{i % 60}" + "x" * (i % 3), 1, "t") for i in range(300)]
    assert Counter(made(spark.createDataFrame(rows, SCHEMA), block=4, together=10)) == Counter(brute(rows))


def test_small_tables_and_paths(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert made(empty) == []
    one = spark.createDataFrame([(1, "s", None, 3, "x " * 500_000)], SCHEMA)
    assert made(one) == brute([tuple(one.first())])
    rows = [(i, "s", "en", 1, "t") for i in range(11)]
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA), merkle.leaf_hash(F.col("doc_id")), with_path=True, block=4)
    for r in out.collect():
        node = r["leaf"]
        for step in r["path"]:
            node = sha(step["left"] + node + step["right"])
        assert node == r["root"] == r["folded_root"] and r["verified"]
    text_ids = spark.createDataFrame([("b", "x"), ("ab", "x"), (None, "x"), ("a", "x")], "doc_id string, lang string")
    got = merkle.manifest(text_ids, merkle.leaf_hash(F.col("doc_id"))).collect()
    assert got[0]["root"] == climb([sha(x) for x in ("-", "1:a", "2:ab", "1:b")], 2)[0]
