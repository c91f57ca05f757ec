import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkcorpus.llm import rank_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*" \n\t\r\x0b\x1c\x85\xa0　''sstmdrevel19½²é中文ab.,!<|>", "'re", "'ll", " '", "  ", "<|endoftext|>", "<|endoftext|"]


LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture
def library():
    return LIBRARY


def ids(text):
    return np.frombuffer(b"".join(rank_bpe.vocabulary(PATH).encode([text])[0]), "<u4").tolist()


def wanted(library, text):
    found = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(found, skip_special_tokens=False)
    return len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=20).map("".join) | st.text(max_size=30))
def test_any_text_gets_the_ids_of_the_library(text):
    assert ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_code_point_falls_into_the_class_of_the_library(library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    words = rank_bpe.vocabulary(PATH)
    for begin in range(0, len(points), 65_536):
        texts = [f"a{chr(c)} {chr(c)}1{chr(c)}." for c in points[begin : begin + 65_536]]
        assert [b"".join(x) for x in words.encode(texts)] == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_words_merge_alike(library, monkeypatch):
    words, rng = rank_bpe.vocabulary(PATH), random.Random(0)
    for n in (0, 1, 2, 127, 129, 700, 20_000):
        word = "".join(rng.choice("abcdefg") for _ in range(n))
        heap = words.merge_long(word.encode())
        assert heap[0] == library.encode(word, add_special_tokens=False).ids
        assert [word.encode()[a:b] for a, b in zip(heap[1], heap[1][1:])] == [words.raw[i] for i in heap[0]]
        if n < 1000:
            monkeypatch.setattr(rank_bpe, "LONG", 10_000)
            assert words.merge(word.encode()) == heap
            monkeypatch.undo()


def test_parts_of_long_texts_join(library, monkeypatch):
    monkeypatch.setattr(rank_bpe, "GROUP", 50)
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice(ODD) for _ in range(600))
        assert ids(text) == library.encode(text, add_special_tokens=False).ids
    assert len(list(rank_bpe.windows("ab cd " * 100, 50))) > 5


def test_documents_and_odd_rows(spark, sf, library):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in rank_bpe.op13_rank_bpe(spark, sf).collect():
        assert tuple(r)[1:] == wanted(library, text.pop(r["doc_id"]))
    assert not text
    long_ = "wörd, " * 300_000 + "x" * 3000
    rows = [(1, None, "k"), (2, "", "k"), (None, "a <|endoftext|>b", None), (4, long_, "k"), (4, long_, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumn("more", F.struct(F.lit(1).alias("x")))
    got = rank_bpe.encode(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=key) == sorted(((i, *wanted(library, t)) for i, t, _ in rows), key=key)
    assert got[0]["more"]["x"] == 1 and "text" not in got[0].asDict()
    assert rank_bpe.encode(df.limit(0)).count() == 0
    back = rank_bpe.decode(rank_bpe.encode(df)).collect()
    assert {(r["doc_id"], r["text"]) for r in back} == {(i, t or "") for i, t, _ in rows}


def test_decoding_of_broken_ids(spark, library):
    cut = library.encode("中", add_special_tokens=False).ids[:1]
    df = spark.createDataFrame([(None,), ([],), (cut,), ([50256, None, 60000, -1],)], "ids array<int>")
    assert [r["text"] for r in rank_bpe.decode(df).collect()] == [None, "", library.decode(cut, skip_special_tokens=False), "<|endoftext|>"]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        rank_bpe.Ranks(public_tokenizers.path("word_bpe_49k.json"))
