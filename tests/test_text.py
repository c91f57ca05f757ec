import itertools
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkcorpus.config import Chunking
from sparkcorpus.functions import text as X
from sparkcorpus.functions import vector as V
from sparkcorpus.operators import chunker as C
from sparkcorpus.operators import selection as S
from sparkcorpus.sources import files, html, web
from sparkcorpus.streaming.citations import Transducer, fix

ALPHABET = st.text(st.sampled_from("abc 。！？;\n#中文-|`.…"), max_size=400)


@given(ALPHABET)
@settings(max_examples=300, deadline=None)
def test_sentences_concatenate_to_their_block(block):
    assert "".join(C.scan_sentences(block)) == block


@given(ALPHABET)
@settings(max_examples=300, deadline=None)
def test_spans_lie_in_order_and_cover_all_words(text):
    found = C.spans(text)
    assert all(a < b for a, b, _ in found) and all(x[1] <= y[0] for x, y in itertools.pairwise(found))
    outside = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b, _ in found))
    assert not "".join(c for c in outside if c not in "。！？；\n").strip()


@given(ALPHABET)
@settings(max_examples=200, deadline=None)
def test_chunk_lengths(text):
    conf = Chunking(60, 20, 5)
    assert all(0 < len(c) <= 2 * 60 + 20 for c in C.split_text(text, conf))


def test_chunks_of_known_texts():
    assert C.split_text(None) == [] and C.split_text(" \n") == []
    assert C.split_text("short") == ["short"]
    long_ = "\n\n".join(f"Paragraph {i} " + "word " * 40 for i in range(6))
    got = C.split_text(long_)
    assert len(got) > 1 and got[1].startswith(got[0][-80:].strip()[:10]) or got[0][-80:] in got[1]
    assert C.split_text("# A\ntext one " + "x" * 90 + "\n# B\ntext two " + "y" * 90, Chunking(120, 0, 10))[1].startswith("# B")
    assert C.split_text("z" * 1300, Chunking(600, 80, 80)) == ["z" * 600, "z" * 600, "z" * 260]


def test_kinds_of_spans():
    text = "# 标题\n第一句是比较长一些的话对吧。第二句也是比较长的一句话！\n|a|b|\n|-|-|\n```py\nx = 1\n```\n短。接着的句子在同一行里面。\n```\nopen"
    kinds = [k for *_, k in C.spans(text)]
    assert kinds == ["head", "sent", "sent", "table", "table", "code", "sent", "code"]
    a, b, _ = C.spans(text)[6]
    assert text[a:b] == "短。接着的句子在同一行里面。"


def test_html_shapes():
    page = """<html><head><title>T</title></head><body><nav>menu</nav><h2>Head</h2><p>One<br>two<p>Three &amp; four
    <ul><li>a<li>b</ul><table><caption>Cap</caption><thead><tr><th>K<th></thead><tbody><tr><td>1<td>2<tr><td><td>3</tbody></table>
    <table><tr><th>only</table><pre>x
 y</pre><p>use <code>f()</code></p><hr><div aria-hidden="true">no</div><script>no()</script><footer>foot</footer></body></html>"""
    text = html.to_text(page)
    for part in ("## Head", "One\ntwo", "Three & four", "- a\n- b", "**Cap**\n- K：1；列2：2\n- 列2：3", "- only", "```\nx\n y\n```", "`f()`", "---"):
        assert part in text, part
    for part in ("menu", "no()", "foot", "no\n"):
        assert part not in text
    assert html.to_text(None) == "" and html.to_text("plain") == "plain"
    assert html.to_text("<div><header>h</header><article><p>body</article><p>rest</div>", page=True) == "body"
    hits = html.search_hits('<li class="b_algo"><h2><a href="http://x/">X</a></h2><p>s</p></li><li class="b_algo"><h2><a href="http://x/">X</a></h2></li>', "bing")
    assert hits == [{"title": "X", "url": "http://x/", "snippet": "s"}]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\n\r\n\r\n\r\ny ")
    (tmp_path / "b.csv").write_text('a,"b,c"\n\nd,e\n')
    (tmp_path / "c.html").write_text("<p>hi</p>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    got = {r["name"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert {k: got[k]["text"] for k in ("a.txt", "b.csv", "c.html", "e.docx")} == {"a.txt": "x\n\ny", "b.csv": "a | b,c\nd | e", "c.html": "hi", "e.docx": "one\ntwo"}
    assert got["d.pdf"]["text"] is None and "UnsupportedSource" in got["d.pdf"]["error"]
    rows = spark.createDataFrame([("x.md", bytearray(b"abc")), ("x.exe", bytearray(b"abc")), ("y.md", bytearray(b""))], "name string, content binary")
    assert [(r["name"], len(r["id"]), r["status"]) for r in files.uploads(rows).collect()] == [("x.md", 12, "stored")]


def test_copy_codec(spark, tmp_path):
    for text in ("a\tb", "a\\nb\n", "\\N", "", None, "\\\\t"):
        assert files.copy_unescape(files.copy_escape(text)) == text
    df = spark.createDataFrame([("1", "a\tb\\n"), ("2", None)], "k string, v string")
    files.write_copy(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_copy(spark, str(tmp_path / "c"), ["k", "v"]).collect())) == [("1", "a\tb\\n"), ("2", None)]


def test_url_guard(spark):
    good = ["http://example.com/a", "https://8.8.8.8/", "http://[2606:4700::1111]/"]
    bad = ["ftp://example.com/", "http://localhost/", "http://127.0.0.1/", "http://10.1.2.3/", "http://100.64.1.1/", "http://169.254.1.1/", "http://[::1]/", "http://[fd00::1]/", "nonsense", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "url string")
    got = {r["url"]: r["ok"] for r in df.select("url", web.may_fetch(F.col("url")).alias("ok")).collect()}
    assert all(got[u] for u in good) and not any(got[u] for u in bad)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, X.extract_terms(lit("Redis 的 AOF_x 持久"))) == ["Redis", "AOF_x", "的持", "持久"]
    assert one(spark, X.extract_terms(lit("中"))) == ["中"] and one(spark, X.extract_terms(lit(""))) == []
    assert one(spark, X.clean_text(lit(" a\r\n\r\n\r\n\r\nb\r"))) == "a\n\nb"
    assert one(spark, X.clip(lit("abc\ndef"), 5)) == "abc d…"
    assert one(spark, X.estimate_tokens(lit("abcd"))) == 3
    assert one(spark, X.ngrams(lit("a🙂ba🙂"), 2)) == ["a🙂", "🙂b", "ba"] and one(spark, X.ngrams(lit("a"), 2)) == []
    assert tuple(one(spark, X.model_ref(lit("p/m/x")))) == ("p", "m/x") and tuple(one(spark, X.model_ref(lit("m")))) == (None, "m")
    assert tuple(one(spark, X.split_item(lit("主题：旧 → 新")))) == ("主题", "旧", "新") and one(spark, X.split_item(lit("x"))) is None
    assert one(spark, X.lost_digits(lit("窗口 163: 个"), lit("一共 16384 个，163 不在"))) == []
    assert one(spark, X.lost_digits(lit("窗口 163: 个"), lit("一共 16384 个"))) == ["163"]
    assert one(spark, X.repair_digits(lit("窗口 1:6384"), lit("16384"))) == "窗口 16384" and one(spark, X.repair_digits(lit("12:30"), lit("1230"))) == "12:30"
    assert one(spark, X.longest_common_substring(lit("abcde"), lit("xbcdy"))) == 3
    assert X.copied_run("x" * 5 + "verbatim passage here", "the verbatim passage here ends") == 19 and X.copied_run("", "a") is None
    assert X.balanced_object('say {"a": "}{", "b": {"c": 1}} end') == '{"a": "}{", "b": {"c": 1}}' and X.balanced_object("{ open") is None
    assert abs(one(spark, X.yes_share(F.create_map(lit("Yes"), lit(0.6), lit("no"), lit(0.2)), ["yes"], ["no"])) - 0.75) < 1e-12
    assert one(spark, X.usable_label(lit("a1"))) and not one(spark, X.usable_label(lit("——")))
    v = F.array(*map(lit, (3.0, 4.0)))
    assert abs(one(spark, V.cosine_distance(v, F.array(lit(4.0), lit(3.0)))) - 0.04) < 1e-12 and one(spark, V.cosine_distance(v, F.array(lit(0.0), lit(0.0)))) == 1
    assert one(spark, V.decode(V.encode(v.cast("array<float>")))) == [3.0, 4.0]
    assert [one(spark, V.choose_k(lit(n), 30)) for n in (1, 8, 661, 10**6)] == [2, 2, 18, 30]


def test_knapsack_against_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        n, budget = rng.randrange(1, 9), rng.randrange(0, 30)
        costs, values = [rng.randrange(1, 12) for _ in range(n)], [rng.random() for _ in range(n)]
        best = max((sum(values[i] for i in c) for r in range(n + 1) for c in itertools.combinations(range(n), r) if sum(costs[i] for i in c) <= budget), default=0)
        got = S.knapsack_of(costs, values, budget)
        assert sum(costs[i] for i in got) <= budget and abs(sum(values[i] for i in got) - best) < 1e-9
    assert S.skip_greedy_of([5, 9, 3], 8) == [0, 2] and S.progressive_of(["a", "a", "b"], [1, 1, 1], 3) == [0, 2, 1]


@given(st.lists(st.sampled_from(["[1.2]", "[3]", "⟨4.5⟩", "text", "[", "]", "[not a citation at all", "\n"]), max_size=12), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_citations_do_not_depend_on_pieces(parts, size):
    text = "".join(parts)
    t = Transducer()
    out = "".join(t.feed(text[i : i + size]) for i in range(0, len(text), size)) + t.flush()
    whole = fix(text)
    assert out == whole["text"] and [{"n": n, "m": m, "offset": o} for n, m, o in t.found] == whole["cites"]
    assert all(out[c["offset"] :].startswith(f"[{c['n']}]") for c in whole["cites"])


def test_citation_forms():
    assert fix("see [12.3] and [4], [x]")["text"] == "see [12] and [4], [x]"
    with pytest.raises(KeyError):
        from sparkcorpus.providers.base import Registry

        Registry().resolve("nowhere/model")
