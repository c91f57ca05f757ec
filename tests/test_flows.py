from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparkcorpus import schemas
from sparkcorpus.operators import cache, cluster, conversation as C, evaluation as E, judges as J, retrieval as R, selection as S
from sparkcorpus.plans.ask import ask
from sparkcorpus.plans.index import build_topics, index_documents, index_sentences
from sparkcorpus.providers.base import ExtractiveChat, Registry
from sparkcorpus.streaming import guards as G
from sparkcorpus.streaming.citations import fix_stream


def test_index_ask_and_topics(spark):
    texts = {"a": "Redis keeps an append only file. It is rewritten in the background.", "b": "Kafka brokers store partitions. Consumers commit offsets to a topic.", "c": "Trees balance themselves by rotation. Red black trees bound the height."}
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, text string")
    p = ExtractiveChat()
    chunks, fresh = index_documents(docs, p, "offline:hash")
    chunks = chunks.cache()
    assert chunks.count() == 3 and fresh.count() == 3
    again, none = index_documents(docs, p, "offline:hash", cached=fresh)
    assert none.count() == 0 and again.count() == 3
    sentences = index_sentences(chunks, p)
    from sparkcorpus.operators.chunker import unfaithful

    assert unfaithful(sentences, chunks.select(F.col("id").alias("chunk_id"), "content")).count() == 0
    questions = spark.createDataFrame([(1, "How do consumers commit offsets in Kafka brokers?"), (2, "What keeps an append only file in Redis?")], "case long, question string")
    for s in (None, sentences):
        got = {r["case"]: r for r in ask(questions, chunks, p, s).collect()}
        assert "offsets" in got[1]["answer"] and "append" in got[2]["answer"] and got[1]["sources"]
    nodes = build_topics(chunks, docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("name")))
    assert sum(len(r["chunk_ids"]) for r in nodes.collect()) == 3
    assert Registry().resolve("offline/extractive")[1] == "extractive"


def test_rrf_ties_thresholds_and_order(spark):
    vec = spark.createDataFrame([(1, 10, 1, 0.1), (1, 11, 2, 0.9), (1, 12, 3, 0.2)], "query int, unit int, rank int, distance double")
    key = spark.createDataFrame([(1, 13, 1, 5), (1, 12, 2, 4), (1, 11, 3, 3)], "query int, unit int, rank int, hits int")
    got = [(r["unit"], r["distance"], r["hits"]) for r in R.rrf([vec, key], 3).orderBy("rank").collect()]
    assert got == [(12, 0.2, 4), (10, 0.1, None), (13, None, 5)]  # 11 is too far; 10 and 13 tie, the vector channel first


def test_keyword_channel_needs_two_terms(spark):
    units = spark.createDataFrame([(1, "alpha beta"), (2, "ALPHA"), (3, "a_b axb beta alpha")], "id int, content string")
    ask_ = lambda t: [(r["unit"], r["hits"]) for r in R.keyword_channel(spark.createDataFrame([(1, t)], "query int, text string"), units, 5).orderBy("rank").collect()]
    assert ask_("alpha") == [] and ask_("alpha beta") == [(1, 2), (3, 2)] and ask_("a_b beta") == [(1, 2), (3, 2)]  # the wildcard stands for the space


def test_summary_merge(spark):
    attempts = spark.createDataFrame([(1, 1, ["端口：— → 80", "库：— → pg"], ["端口：— → 81"]), (1, 2, ["端口：— → 80", "库：— → pg"], [])], "conv_id int, attempt int, old array<string>, items array<string>")
    r = C.merge_summary(attempts).first()
    assert r["items"] == ["端口：80 → 81", "库：— → pg"] and not r["frozen"]


def test_strip_repeats_and_notes(spark):
    lines = spark.createDataFrame([(1, "a  b"), (1, "c")], "conv_id int, line string")
    turns = spark.createDataFrame([(1, "x\na b")], "conv_id int, content string")
    assert [r["line"] for r in C.strip_repeats(lines, turns).collect()] == ["c"]


def test_window_diff_properties(spark):
    sizes = spark.createDataFrame([(1, 20), (2, 3)], "doc int, n int")
    ref = spark.createDataFrame([(1, 5), (1, 12), (2, 1)], "doc int, at int")
    every = spark.createDataFrame([(1, i) for i in range(1, 20)], "doc int, at int")
    value = lambda a, b: {r["doc"]: r["windowdiff"] for r in E.window_diff(a, b, sizes).collect()}
    assert value(ref, ref) == {1: 0, 2: 0}
    plain = lambda r, h, n=20, k=5: sum(sum(i < x <= i + k for x in r) != sum(i < x <= i + k for x in h) for i in range(1, n - k + 1)) / (n - k)
    assert abs(value(ref, every)[1] - plain([5, 12], range(1, 20))) < 1e-12
    assert abs(value(ref, ref.limit(0))[1] - plain([5, 12], [])) < 1e-12


def test_paired_and_segmentation(spark):
    a = spark.createDataFrame([(i, float(i > 2)) for i in range(10)], "case int, score double")
    b = spark.createDataFrame([(i, 0.0) for i in range(10)], "case int, score double")
    r = E.paired(a, b).first()
    assert (r["win"], r["lose"], r["tie"]) == (7, 0, 3) and 0 < r["p"] < 0.05
    df = lambda rows, names: spark.createDataFrame(rows, names)
    s = E.segmentation(df([(1, 5), (1, 9)], "doc int, at int"), df([(1, 3)], "doc int, at int"), df([(1, 6, 8)], "doc int, lo int, hi int"), df([(1, 4), (1, 7)], "doc int, at int"), df([(1, 12)], "doc int, n int")).first()
    assert (s["must_recall"], s["wrong"], s["unmarked"], s["cuts"]) == (0.5, 1, 1, 2)


def test_judges(spark):
    rows = [(1, "grounded", "q", "值是 128 [1]。", "文档说 值是 128 兆", 2), (2, "grounded", "q", "值是 999 [7]。", "无", 2), (3, "ungrounded", "q", "【参考资料】\n属于通用知识", "x", 0)]
    got = {r["id"]: r for r in J.passes(J.judge(spark.createDataFrame(rows, "id int, kind string, question string, answer string, sources string, n_sources int"))).collect()}
    assert got[1]["pass"] and got[1]["ungrounded"] == [] and not got[2]["pass"] and got[2]["ungrounded"] == ["999"]
    assert got[3]["marks_general"] and not got[3]["no_echo"] and not got[3]["pass"]
    bad = J.misplaced(spark.createDataFrame([(1, "延迟 5秒 [1]，容量 64mb [2]。")], "id int, answer string"), spark.createDataFrame([(1, 1, "延迟是 5 秒"), (1, 2, "没有数字")], "id int, n int, content string")).collect()
    assert [r["value"] for r in bad] == ["64mb"] or {r["value"] for r in bad} == {"64mb"}


def test_selection_frames(spark):
    rows = [(1, i, i, 10 * i, float(i), "s" if i % 2 else "t", [1.0, i / 10]) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "query int, unit int, rank int, tokens int, value double, source string, embedding array<double>")
    ids = lambda x: sorted(r["unit"] for r in x.collect())
    assert ids(S.skip_greedy(df, 40)) == [1, 2] and sum(10 * i for i in ids(S.knapsack(df, 60))) == 60
    assert ids(S.cap_per_source(df, 1)) == [1, 2] and len(ids(S.mmr(df, 2, 0.999))) <= 2
    tiers = spark.createDataFrame([(1, 10, 5, 20, 20)], "case int, fixed int, recent int, summary int, excerpt int")
    material = spark.createDataFrame([(1, i, 30) for i in range(1, 5)], "case int, rank int, tokens int")
    assert S.pack(tiers, material, 80).count() == 2 and S.pack(tiers, material, 20).count() == 1 and S.pack(tiers, material, 500).count() == 4


def test_boundaries_and_trees(spark):
    assert cluster.legal_bounds([3, 6], {3}, 10) == [4, 6] and cluster.legal_bounds([5], set(range(1, 10)), 10) == []
    assert cluster.bisect(0, 8, lambda a, b: (a + b) // 2) == [(0, 0, 8), (1, 0, 4), (2, 0, 2), (2, 2, 4), (1, 4, 8), (2, 4, 6), (2, 6, 8)]


def test_tables_keys_and_cascade(spark):
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).columns
    docs = spark.createDataFrame([("d1",), ("d2",)], "id string")
    chunks = spark.createDataFrame([(1, "d1"), (2, "d2"), (3, "zz")], "id long, doc_id string")
    sents = spark.createDataFrame([(10, 1), (11, 2)], "id long, chunk_id long")
    assert [r["id"] for r in schemas.orphans(chunks, "doc_id", docs, "id").collect()] == [3]
    left = schemas.cascade_delete(docs, docs.filter("id = 'd1'"), [("chunks", chunks, "doc_id", "id"), ("sentences", sents, "chunk_id", "id")])
    assert left[""].count() == 1 and left["chunks"].count() == 2 and [r["id"] for r in left["sentences"].collect()] == [11]
    assert schemas.duplicate_keys(chunks.union(chunks.limit(1)), ["id"]).count() == 1


def test_cache_tables(spark):
    c = spark.createDataFrame([("k1", 1, datetime(2024, 1, 1))], "key string, hits long, last_hit_at timestamp")
    log = spark.createDataFrame([("k1", datetime(2024, 1, 2)), ("k1", datetime(2024, 1, 3))], "key string, at timestamp")
    r = cache.touched(c, log).first()
    assert (r["hits"], r["last_hit_at"]) == (3, datetime(2024, 1, 3))
    assert cache.read_or_none(spark, "/nowhere/at/all", "key string") is None
    t = spark.createDataFrame([("a", "running", ""), ("b", "done", "")], "id string, status string, message string")
    assert {r["id"]: r["status"] for r in cache.interrupted(t).collect()} == {"a": "error", "b": "done"}


def stream(spark, tmp_path, rows, schema, plan, name):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    q = plan(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_stateful_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = datetime(2024, 1, 1)
    rows = [("u", t + timedelta(seconds=i), i == 2) for i in range(6)] + [("v", t, False)]
    got = stream(spark, tmp_path, rows, "who string, ts timestamp, ok boolean", lambda s: G.count_failures(s, most=3), "locks")
    assert [(r["who"], r["n"]) for r in got] == [("u", 3)]
    rows = [("r", 1, "see [1", False), ("r", 2, ".2] end [", True), ("q", 1, "[3.4]", True)]
    got = stream(spark, tmp_path, rows, "run string, seq long, text string, last boolean", fix_stream, "cites")
    assert {(r["run"], r["seq"]): r["text"] for r in got} == {("r", 1): "see ", ("r", 2): "[1] end [", ("q", 1): "[3]"}
    acts = [("u", t, "issue", "t1", None), ("u", t + timedelta(seconds=1), "rotate", "t1", "t2"), ("u", t + timedelta(seconds=2), "rotate", "t1", "t3"), ("u", t + timedelta(seconds=3), "rotate", "t2", "t4")]
    got = stream(spark, tmp_path, acts, "who string, ts timestamp, action string, token string, new_token string", lambda s: G.sessions(s, 60), "acts")
    assert [r["ok"] for r in sorted(got, key=lambda r: r["ts"])] == [True, True, False, True]


def test_token_stream(spark):
    df = spark.createDataFrame([("r", i, "x" * 25) for i in range(6)], "run string, seq int, text string")
    assert [len(r["text"]) for r in G.flushes(df).orderBy("piece").collect()] == [75, 75]
    frames = spark.createDataFrame([("r", 0.0, 10), ("r", 10.0, 10), ("r", 20.0, 20)], "run string, t double, len int")
    assert G.time_at_share(frames, 0.75).first()["t"] == 15.0


def test_case_sets_are_read(spark, tmp_path):
    import json

    from sparkcorpus.sources.files import read_cases

    one = {"schema": "x", "name": "a", "judge": "self-hit", "cases": [{"id": "1", "doc": "d", "q": "why?", "targets": [{"excerpt": "because", "seq_hint": 3}, {"excerpt": "so", "doc": "e"}]}, {"id": "2", "q": "none"}]}
    two = {"name": "b", "kind": "topic", "note": "n", "cases": [{"id": "1", "q": "who?", "topic": "t", "targets": [{"doc_names": ["x", "y"]}]}]}
    for n, data in (("a", one), ("b", two)):
        (tmp_path / f"{n}.json").write_text(json.dumps(data, indent=1))
    got = {(r["set"], r["case"], r["target"]): r for r in read_cases(spark, str(tmp_path / "*.json")).collect()}
    assert set(got) == {("a", "1", 0), ("a", "1", 1), ("a", "2", None), ("b", "1", 0)}
    assert got["a", "1", 1]["target_doc"] == "e" and got["a", "1", 0]["case_doc"] == "d" and got["b", "1", 0]["doc_names"] == ["x", "y"]
    assert (got["a", "1", 0]["judge"], got["b", "1", 0]["judge"], got["a", "1", 0]["kind"], got["b", "1", 0]["kind"]) == ("self-hit", "all-hit", "retrieval", "topic")


def test_tables_are_created_twice(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS flows_ddl")
    spark.sql("CREATE TABLE IF NOT EXISTS flows_ddl.tree_meta (id int) USING parquet")
    schemas.create_all(spark, "flows_ddl")
    schemas.create_all(spark, "flows_ddl")
    for name in schemas.TABLES:
        assert {f.name for f in spark.table(f"flows_ddl.{name}").schema} == {f.name for f in schemas.empty(spark, name).schema}
    spark.sql("DROP DATABASE flows_ddl CASCADE")


def test_verdicts_by_kind(spark):
    rows = [
        (1, "grounded-partial", "q", "值是 128 [1]。", "值是 128", 2),
        (2, "grounded-partial", "q", "知识库中没有这个值；以下是通用知识。", "值是 128", 2),
        (3, "grounded-partial", "q", "是 7 吧", "值是 128", 2),
        (4, "ungrounded", "q", "未找到相关内容，以下属于通用知识", "", 0),
        (5, "ungrounded", "q", "以下属于通用知识", "", 0),
        (6, "chitchat", "q", "你好", "", 0),
        (7, "chitchat", "q", "资料里没有", "", 0),
        (8, "grounded", "q", "值是 12、34、56 [1]。", "值是 12", 2),
    ]
    judged = J.judge(spark.createDataFrame(rows, "id int, kind string, question string, answer string, sources string, n_sources int"))
    got = {r["id"]: r["pass"] for r in J.passes(judged).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: False}
    wrong = {r["id"]: r["pass"] for r in J.passes(judged.selectExpr("*", "1 AS n_misplaced")).collect()}
    assert not wrong[1] and wrong[2]
