import random

import pytest
from pyspark.sql import functions as F

from sparkcorpus.operators import conversation as C


def alike(a, b):
    x, y = ("".join(s.replace("→", " ").replace("—", " ").split()) for s in (a, b))
    shared = any(x[i : i + 4] in y for i in range(len(x) - 3))
    return bool(x and y) and (x in y or y in x or shared)


def value_of(item):
    head, colon, rest = item.partition("：")
    return rest.rpartition("→")[2].strip() if colon else head.strip()


def fold(known, lines):
    """(topic, item, written) after the lines, one after the other."""
    items = {t: (i, False) for t, i in sorted(known)}
    for line in lines:
        a, b = line.find("："), line.find("→")
        if a <= 0 or b <= a:
            continue
        topic, now = line[:a].strip(), line[b + 1 :].strip()
        hit = topic if topic in items else next((t for t in items if alike(t, topic)), None)
        if hit is None:
            items[topic] = (f"{topic}：{now}", True)
        elif value_of(items[hit][0]) != now:
            items[hit] = (f"{topic}：{value_of(items[hit][0])} → {now}", True)
    return {(t, i, w) for t, (i, w) in items.items()}


def absorbed(spark, known, lines):
    memory = spark.createDataFrame([(o, t, i) for o, pairs in known.items() for t, i in pairs], "owner string, topic string, item string")
    rows = spark.createDataFrame([(o, k, x) for o, own in lines.items() for k, x in enumerate(own)], "owner string, seq long, line string")
    got = C.absorb(memory.withColumn("key", F.lit("clash")), rows.repartition(3)).collect()
    out = {o: set() for o in {*known, *lines}}
    for r in got:
        out[r["owner"]].add((r["topic"], r["item"], r["written"]))
    return out


@pytest.mark.parametrize("stretch", [3, 10_000])
def test_tables_equal_the_fold(spark, monkeypatch, stretch):
    monkeypatch.setattr(C, "STRETCH", stretch)
    rng = random.Random(stretch)
    names = ["端口", "服务端口", "库", "数据库", "port", "port number", "number", "the timeout", "timeout", "a", "ab", "xabx", "time", "retry count", "count of retries", "— →", " ", "z z"]
    values = ["80", "81", "pg", "x → y", "", "80"]
    some = lambda n: [f"{rng.choice(names)}：{rng.choice(values)} → {rng.choice(values)}" if rng.random() < 0.9 else rng.choice(["noise", "：a → b", "a → b：c", "k：v"]) for _ in range(n)]
    known = {o: [(t, f"{t}：{rng.choice(values)}") for t in rng.sample(names[:15], rng.randrange(0, 5))] for o in ("u", "v", "w")}
    lines = {o: some(n) for o, n in (("u", 60), ("v", 25), ("x", 12), (None, 30))}
    assert absorbed(spark, known, lines) == {o: fold(known.get(o, []), lines.get(o, [])) for o in {*known, *lines}}


def test_known_cases(spark):
    got = absorbed(spark, {"b": [("端口", "端口：80")], "c": [("端口", "端口：80")], "d": [("服务端口", "服务端口：80")]}, {"a": ["端口：— → 80", "noise"], "b": ["端口：80 → 80"], "c": ["端口：x → 81", "端口：81 → 82"], "d": ["端口：80 → 81"]})
    assert got == {"a": {("端口", "端口：80", True)}, "b": {("端口", "端口：80", False)}, "c": {("端口", "端口：81 → 82", True)}, "d": {("服务端口", "端口：80 → 81", True)}}


def test_many_topics_that_share_a_key(spark):
    """All topics have four characters in common: the first leads all, and no pair of them is made."""
    lines = {"u": [f"timeout {i}：— → {i}" for i in range(400)]}
    assert absorbed(spark, {}, lines) == {"u": fold([], lines["u"])}


def test_nothing_to_absorb(spark):
    assert absorbed(spark, {}, {"u": ["noise"]}) == {"u": set()}
    assert absorbed(spark, {"u": [("a", "a：1")]}, {}) == {"u": {("a", "a：1", False)}}
