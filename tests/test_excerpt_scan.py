import random

import pytest

from sparkcorpus.operators import evaluation as E, term_scan
from sparkcorpus.queries.base import QUERIES


@pytest.mark.parametrize("sizes", [{"PLACES": 7, "PIECE": 30, "HELD": 150}, {}])
def test_pieces_and_passes_equal_a_nested_loop(spark, monkeypatch, sizes):
    for name, n in sizes.items():
        monkeypatch.setattr(term_scan, name, n)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("aé中 \n") for _ in range(n))
    units = [(i, rng.choice([None, "", "  ", text(4), text(30), text(90), " " * 200 + text(5)])) for i in range(60)]
    inside = [u[1][k : k + rng.choice([2, 9, 25])] for u in units if u[1] and len(u[1]) > 40 for k in (3, 11)]
    targets = [(i, 0, x) for i, x in enumerate([None, "", " ", text(50), *inside])]
    solid = lambda x: "".join((x or "").split())
    want = {(c, 0, u) for c, _, x in targets for u, y in units if solid(x) and solid(y) and (solid(x) in solid(y) or solid(y) in solid(x))}
    got = E.find_excerpts(spark.createDataFrame(targets, "case int, target int, excerpt string"), spark.createDataFrame(units, "id long, content string").repartition(3))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 100


@pytest.mark.parametrize("name", ["excerpt_find", "all_hit"])
def test_no_row_for_each_place_of_a_text(spark, sf, name):
    assert "explode" not in QUERIES[name](spark, sf)._jdf.queryExecution().toString()
