import random

import pytest

from sparkcorpus import store
from sparkcorpus.config import Retrieval
from sparkcorpus.operators import gram_index, retrieval as R, term_scan
from sparkcorpus.queries.base import QUERIES
from tests.test_gram_index import brute, some_texts

LONG = ["a" * 16, "a" * 17, "a" * 40, "snapshot_of_a_long_name", "snapshot_of_a_long_game", "snapshot_of_a_l", "été", "ÉTÉ_x", "x中文y", "İa", "0123456789abcdefX"]


@pytest.mark.parametrize("escape", [False, True])
def test_slices_passes_and_long_terms_equal_a_plain_scan(spark, monkeypatch, escape):
    rng = random.Random(4)
    more = [(i, " ".join(rng.choice(LONG) for _ in range(rng.randrange(1, 6)))) for i in range(200, 260)]
    units, queries = some_texts(100, 1) + more, some_texts(20, 2) + more[:15] + [(90, "__ ___ ____"), (91, "_ a"), (93, None), (94, LONG[2] + " " + LONG[3])]
    table, asked = spark.createDataFrame(units, "id long, content string").repartition(3), spark.createDataFrame(queries, "query long, text string")
    for sizes in ({"SLICE": 7, "PIECE": 60, "MOST": 40}, {"PAIRS": 5}):
        for name, n in sizes.items():
            monkeypatch.setattr(term_scan, name, n)
        monkeypatch.setattr(gram_index, "MATRIX", 50)
        got = R.keyword_channel(asked, table, 6, conf=Retrieval(escape_wildcards=escape)).collect()
        assert sorted((r["query"], r["unit"], r["hits"], r["rank"]) for r in got) == brute(queries, units, 6, escape)


@pytest.mark.parametrize("name", ["keyword_search", "hybrid_search"])
def test_texts_are_neither_written_nor_shuffled(spark, sf, monkeypatch, name):
    """A search writes its queries' terms and its vectors' hits, and what is shuffled for it has no texts."""
    written, keep = [], store.Steps.keep
    monkeypatch.setattr(store.Steps, "keep", lambda self, df, name, by=(): (written.append(name.split("-")[0]), keep(self, df, name, by))[1])
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    assert set(written) <= {"terms", "hits"}
    assert "SortMergeJoin" not in plan.split("== Physical Plan ==")[1] and "content" not in plan.split("== Physical Plan ==")[1].split("MapInArrow")[0]
