import random

import pytest

from sparkcorpus.operators import evaluation as E


@pytest.mark.parametrize("anchor,scope", [(16, None), (3, "doc"), (5, None)])
def test_excerpts_equal_a_nested_loop(spark, monkeypatch, anchor, scope):
    monkeypatch.setattr(E, "ANCHOR", anchor)
    rng = random.Random(anchor)
    text = lambda n: "".join(rng.choice("ab \n") for _ in range(n))
    units = [(i, rng.choice(["d1", "d2", None]), rng.choice([None, "", " ", text(3), text(20), text(60)])) for i in range(80)]
    targets = [(c, k, rng.choice([None, "", text(2), text(8), text(25), units[c][2]]), rng.choice(["d1", None]), rng.choice(["d2", None])) for c in range(30) for k in range(2)]
    solid = lambda x: "".join((x or "").split())
    want = set()
    for c, k, excerpt, own, case in targets:
        for u, doc, content in units:
            a, b = solid(excerpt), solid(content)
            limit = own if own is not None else case
            if a and b and (a in b or b in a) and (scope is None or limit is None or limit == doc):
                want.add((c, k, u))
    df = spark.createDataFrame(targets, "case int, target int, excerpt string, target_doc string, case_doc string")
    table = spark.createDataFrame(units, "id long, doc string, content string")
    got = [tuple(r) for r in E.find_excerpts(df, table, scope=scope).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert E.find_excerpts(df.limit(0), table).count() == 0 and E.find_excerpts(df, table.limit(0)).count() == 0
