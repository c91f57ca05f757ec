import duckdb
import numpy as np

from sparkcorpus.llm import hnsw
from tests.llm import brute


def clusters(rng, n, d=16):
    base = rng.normal(size=(n // 8 + 1, d))
    return np.concatenate([base[i % len(base)] + rng.normal(scale=rng.choice([0.02, 0.06, 0.1]), size=d) for i in range(n)]).reshape(n, d).astype(np.float32)


def exact(x, least=0.98):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    return s >= least


def test_graph_finds_what_brute_force_finds():
    rng = np.random.default_rng(0)
    x = clusters(rng, 900)
    x[100:400] = x[100] + rng.normal(scale=0.01, size=(300, 16))
    g = hnsw.Graph(hnsw.unit64(x).astype(np.float32))
    assert len(g.layers) > 1
    ids, ones = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
    want = exact(x)
    found = hnsw.Searched(g, x, ones, x, True, 0.98, ids, ids)
    assert found.brute == 0 and found.true_links == found.found_links > 0
    assert found.links.tolist() == want.sum(1).tolist()
    roots = [hnsw.forest(*pairs, len(x)) for pairs in (np.nonzero(want), found.meets.T)]
    assert (roots[0] == roots[1]).all()
    y = x[:300] + rng.normal(scale=0.01, size=(300, 16)).astype(np.float32)
    across = hnsw.Searched(g, x, ones, y, False, 0.98, ids, ids[:300])
    u, w = hnsw.unit64(x), hnsw.unit64(y)
    assert across.links.tolist() == (w @ u.T >= 0.98).sum(1).tolist()


def test_audit_notices_a_crippled_graph():
    """Few links between two shards, and a graph whose nodes lead nowhere: beams widen, then brute force finds them."""
    rng = np.random.default_rng(2)
    x, y = (rng.normal(size=(600, 32)).astype(np.float32) for _ in range(2))
    y[:5] = x[100:105] + rng.normal(scale=0.005, size=(5, 32))
    g = hnsw.Graph(hnsw.unit64(x).astype(np.float32))
    g.layers = [np.full_like(g.layers[0], -1)]
    ids, ones = np.arange(600), np.ones(600, dtype=np.int64)
    found = hnsw.Searched(g, x, ones, y, False, 0.98, ids, ids + 600)
    assert found.brute == 600 and found.rounds > 1
    assert found.links.nonzero()[0].tolist() == [0, 1, 2, 3, 4]


def test_audit_is_returned(spark):
    rng = np.random.default_rng(3)
    x = clusters(rng, 300)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 1) for i in range(300)] * 2, "vec_id long, embedding array<float>, label int")
    out, audit = hnsw.near_duplicates(df, shard=100, with_audit=True)
    seen = audit.first()
    assert seen["audited"] > 0 and seen["found_links"] == seen["true_links"] > 0
    want = exact(x)
    assert {(r["vec_id"], r["n_links"]) for r in out.collect()} == {(i, 2 * int(want[i].sum()) + 1) for i in range(300)}


def test_near_duplicates_over_shards(spark):
    rng = np.random.default_rng(1)
    x = clusters(rng, 400)
    label = rng.integers(0, 3, 400)
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(400)]
    odd = [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0] * 15 + [None], 1), (504, rows[0][1], None), (505, [], 1), (506, [float("inf")] + [1.0] * 15, 2), (507, [1e30] * 16, 0), (508, [1e-30] * 16, 0), (509, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    links = [(a, b) for a, b in zip(*np.nonzero(exact(x)), strict=True) if label[a] == label[b]]
    near_ones = [i for i in range(400) if label[i] == 0 and x[i].astype(float).sum() / np.linalg.norm(x[i].astype(float)) / 4 >= 0.98]
    assert not near_ones
    group = brute.components(range(400), links) | {507: 507, 508: 507}
    for shard in (60, 8192):
        got = {r["vec_id"]: r for r in hnsw.near_duplicates(df, shard=shard).collect()}
        assert len(got) == len(rows) + len(odd)
        for i in [*range(400), 507, 508]:
            n = sum(a == i for a, _ in links) if i < 400 else 1
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, group[i], group[i] == i), i
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (500, 501, 502, 503, 504, 505, 506, 509))


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in hnsw.near_duplicates(df).collect()]
    assert sorted(got, key=str) == [(1, 2, 1), (1, 2, 1), (None, 2, 1)]
    assert hnsw.near_duplicates(df.limit(0)).collect() == []


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in hnsw.op2_embedding_dedup(spark, sf).collect())
    assert got == sorted(con.sql(hnsw.SQL_OP2).fetchall())
