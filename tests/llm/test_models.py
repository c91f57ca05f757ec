import math
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa

from sparkcorpus.llm import attention as at
from sparkcorpus.llm import lm_score, quality_model
from sparkcorpus.llm.kernels import strings
from tests.llm import brute


def test_gradients_of_the_ordinal_model():
    rng = np.random.default_rng(0)
    n = 300
    words = [["fine", "good", "calm"], ["meh", "odd", "grey"], ["awful", "vile", "rude"]]
    grades = rng.integers(0, 3, n)
    texts = [" ".join(rng.choice(words[2 - g] + ["the", "of", "and"], 30)) for g in grades]
    index, values, bounds = quality_model.features(*strings(pa.array(texts)))
    model = quality_model.fit(index, values.astype(float), bounds, grades)
    scores = quality_model.row_sums(model.weights[index] * values, bounds)
    tails = model.tails(scores)
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert (np.round(tails.sum(1)) == grades).mean() > 0.97


def test_fit_reaches_what_plain_descent_reaches():
    rng = np.random.default_rng(5)
    words = ["good", "fine", "bad", "poor", "the", "and", "vile"]
    texts = [" ".join(rng.choice(words, 12, p=p)) for p in ([0.3, 0.3, 0, 0, 0.2, 0.2, 0], [0, 0.1, 0.3, 0.3, 0.15, 0.15, 0], [0, 0, 0.2, 0.1, 0.2, 0.2, 0.3]) for _ in range(40)]
    grades = np.repeat([2, 1, 0], 40)
    index, values, bounds = quality_model.features(*strings(pa.array(texts)))
    rows = [dict(zip(index[a:b].tolist(), values[a:b].tolist(), strict=True)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    model = quality_model.fit(index, values, bounds, grades)
    got = brute.ordinal_loss(rows, grades, dict(enumerate(model.weights.tolist())), model.thresholds)
    # a plain version: dense rows, gradients by differences in the score, steps downhill
    used = sorted({k for r in rows for k in r})
    x = np.array([[r.get(k, 0.0) for k in used] for r in rows])
    w, t = np.zeros(len(used)), np.array([-1.0, 1.0])

    def loss(w, t):
        below = np.concatenate([np.zeros((len(x), 1)), 1 / (1 + np.exp((x @ w)[:, None] - t)), np.ones((len(x), 1))], 1)
        return -np.log(np.maximum(below[np.arange(len(x)), grades + 1] - below[np.arange(len(x)), grades], 1e-12))

    for _ in range(400):
        slope = (loss_at(x @ w + 1e-5, t, grades) - loss_at(x @ w - 1e-5, t, grades)) / 2e-5
        cut = [(loss(w, t + 1e-5 * np.eye(2)[k]).mean() - loss(w, t - 1e-5 * np.eye(2)[k]).mean()) / 2e-5 for k in range(2)]
        w, t = w - 2.0 * x.T @ slope / len(x), np.sort(t - 2.0 * np.array(cut))
    assert got <= loss(w, t).mean() + 0.02


def loss_at(scores, t, grades):
    below = np.concatenate([np.zeros((len(scores), 1)), 1 / (1 + np.exp(scores[:, None] - t)), np.ones((len(scores), 1))], 1)
    return -np.log(np.maximum(below[np.arange(len(scores)), grades + 1] - below[np.arange(len(scores)), grades], 1e-12))


def test_features_of_repeated_and_empty_texts():
    index, values, bounds = quality_model.features(*strings(pa.array(["", None, "Word", "Word"])))
    assert list(np.diff(bounds)[:2]) == [0, 0]
    a, b = (slice(bounds[i], bounds[i + 1]) for i in (2, 3))
    assert (index[a] == index[b]).all() and (values[a] == values[b]).all()


def test_held_out_accuracy(spark, sf):
    base = sf.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{base}/labels.parquet")
    fit_on, test_on = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    model = quality_model.train(docs, fit_on)
    got = quality_model.rate(docs.join(test_on, "doc_id"), model).select("quality", "toxic", "kept").toPandas()
    good, toxic, poor = got[(got.quality == 1) & (got.toxic == 0)], got[got.toxic == 1], got[(got.quality == 0) & (got.toxic == 0)]
    assert good.kept.mean() > 0.97 and toxic.kept.mean() < 0.15 and poor.kept.mean() < 0.03


def test_rating_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "some text", 1), (3, "some text", 1), (None, "x " * 50_000, 1)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(3, 1, None), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_model.rate(docs, quality_model.train(docs, labels)).collect()
    assert len(got) == 5 and not any(r["kept"] for r in got if r["doc_id"] in (1, 2))
    none = quality_model.train(docs, labels.limit(0))
    assert len(quality_model.rate(docs, none).collect()) == 5
    assert quality_model.rate(docs.limit(0), none).collect() == []


def test_the_sample_is_bounded_whatever_a_labelled_id_holds(spark, monkeypatch):
    """A third of all rows are copies under a labelled id, another third different texts under another."""
    rows = [(1, "copy of one text")] * 300 + [(2, f"text number {i} of many") for i in range(300)] + [(10 + i, f"poor stuff {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0)] + [(10 + i, 0, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    fitted, real = [], quality_model.fit
    monkeypatch.setattr(quality_model, "fit", lambda *a: (fitted.append(a), real(*a))[1])
    quality_model.train(docs, labels, sample=50)
    quality_model.train(docs, labels)
    quality_model.train(docs.repartition(2), labels)
    quality_model.train(docs, labels, most_bytes=1600)
    assert [len(a[3]) for a in fitted[:3]] == [50, 601, 601] and 0 < len(fitted[3][3]) < 120
    assert all((x == y).all() for x, y in zip(fitted[1][:4], fitted[2][:4]))


def small(seed=0):
    rng = np.random.default_rng(seed)
    n = 40
    counts = rng.integers(1, 100, n + 1).astype(float)
    spaced = np.append(rng.random(n) < 0.5, False)
    frequent = np.argsort(-counts[:-1], kind="stable")[:20]
    after = rng.integers(0, 30, (20, 20))
    vocab = at.vocabulary(counts, spaced, after, frequent)
    params = at.start(vocab, after, np.bincount(vocab.group, weights=counts, minlength=at.CLASSES), frequent)
    params["mixed"] += rng.normal(0, 0.3, params["mixed"].shape).astype(np.float32)
    return vocab, params, rng


def test_probabilities_sum_to_one_and_are_causal():
    vocab, p, rng = small()
    text = rng.integers(0, 40, 37)
    score = lambda ids: at.log10_probabilities(p, vocab, *at.layout(vocab, [np.asarray(ids)])[:3]).sum()
    # the last symbol may be any id or the end: their probabilities, given the text before, sum to one; of those
    # that go on a word, the model gives that of the class
    inputs, targets, first, _ = at.layout(vocab, [text])
    total, inside = 0.0, np.flatnonzero(vocab.group == at.INSIDE)
    for last in range(vocab.end + 1):
        t = targets.copy().ravel()
        keep = np.full_like(t, -1)
        keep[np.flatnonzero(t >= 0)[-1]] = last
        share = 1 / len(inside) if last in inside else 1
        total += share * 10 ** at.log10_probabilities(p, vocab, inputs, keep.reshape(-1, at.BLOCK), first).sum()
    assert abs(total - 1) < 1e-4
    # what comes later changes nothing before it
    other = np.append(text[:20], (text[20:] + 1) % 40)
    per = [at.log10_probabilities(p, vocab, *at.layout(vocab, [x])[:3]) for x in (text, other)]
    assert abs(per[0][0] - per[1][0]) < 1e-5
    # texts that are scored together do not see each other
    both = at.layout(vocab, [text, text[:5], text[:0]])
    sums = np.bincount(both[3], weights=at.log10_probabilities(p, vocab, *both[:3], together=2), minlength=3)
    assert np.allclose(sums, [score(text), score(text[:5]), score(text[:0])], atol=1e-3)


def test_log_probabilities_match_a_plain_forward_pass():
    vocab, p, rng = small(2)
    text = rng.integers(0, 40, 45)
    got = at.log10_probabilities(p, vocab, *at.layout(vocab, [text])[:3])
    seen, want = [vocab.end + 1, *text], np.zeros(len(got))
    x = p["embed"][seen].astype(float)
    for i, target in enumerate([*text, vocab.end]):
        begin = max(0, (i // at.BLOCK - 1) * at.BLOCK)  # its own block and the one before
        scores = np.array([x[i] @ p["query"] @ (x[j] @ p["key"]) / at.WIDTH**0.5 + p["back"][i - j] for j in range(begin, i + 1)])
        weights = np.exp(scores - scores.max())
        mixed = (weights[:, None] * (x[begin : i + 1] @ p["value"])).sum(0) / weights.sum()
        logits = (x[i] + mixed @ p["mixed"]) @ p["out"] + p["bias"]
        logs = logits - logits.max() - np.log(np.exp(logits - logits.max()).sum())
        want[i // at.BLOCK] += logs[vocab.group[target]] / np.log(10) + vocab.share[target]
    assert np.allclose(got, want, atol=1e-3)


def test_gradients_of_the_attention_model():
    vocab, p, rng = small(1)
    p = {k: x.astype(np.float64) for k, x in p.items()}
    inputs, targets, first, _ = at.layout(vocab, [rng.integers(0, 40, n) for n in (5, 40, 17)])
    g, ids, _ = at.gradients(p, vocab, inputs, targets, first)
    loss = lambda q: at.gradients(q, vocab, inputs, targets, first, with_loss=True)[2]
    for name in p:
        for _ in range(4):
            row = int(rng.integers(0, len(g[name])))
            rest = tuple(int(rng.integers(0, s)) for s in p[name].shape[1:])
            at_ = (int(ids[row]) if name == "embed" else row, *rest)
            up, down = ({k: x.copy() for k, x in p.items()} for _ in range(2))
            up[name][at_] += 1e-4
            down[name][at_] -= 1e-4
            slope = (loss(up) - loss(down)) / 2e-4
            assert abs(slope - g[name][row, *rest]) < 1e-4 + 0.02 * abs(slope), name


def test_exponentials_of_rows_far_apart():
    z = np.array([[0, 1, -1e9, 2], [-500, -501, -1e9, -502], [90, 95, 91, 1], [-1e4, -2e4, -3e4, -1e4]], dtype=np.float32)
    want = np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
    for rows in (1, 2, 4):
        shifted = z.copy()
        e, total = at.exps(shifted, rows)
        assert np.allclose(e / total, want, atol=1e-6) and np.allclose(np.exp(shifted), e)


def test_large_scores_stay_finite():
    vocab, p, rng = small(4)
    p = p | {"embed": p["embed"] * np.float32(1e4)}
    lay = at.layout(vocab, [rng.integers(0, 40, 50)])[:3]
    assert np.isfinite(at.log10_probabilities(p, vocab, *lay)).all()
    assert all(np.isfinite(x).all() for x in at.gradients(p, vocab, *lay)[0].values())


def test_words_spelled_and_their_continuations():
    enc = lm_score.encoder(lm_score.public_tokenizers.path(lm_score.VOCABULARY), lm_score.public_tokenizers.PATTERN)
    size = enc.n_vocab + 1
    spaced = np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(size - 1)] + [True])
    words = "zyxwvut qrst zyxwvut don't 1234567 zyxw caf\u00e9 \u4e2d\u6587 x".split() + ["a\u00a0", "\u00a0", "\u2003", "\u3000b", "\x1c", "x\x85y"]
    pairs = Counter(p for w in words for i in [enc.encode_ordinary(" " + w)] for p in zip(i, i[1:]))
    own = np.zeros(size, dtype=np.int64)
    for (_, b), c in pairs.items():
        own[b] += c
    before, ids, counts = (np.array(x) for x in zip(*[(a, b, c) for (a, b), c in pairs.items()], strict=True))
    inside = lm_score.Inside.of(before, ids, counts, own, spaced)
    for a in (before[0], before[-1], 11):  # after any subword, the probabilities of all that go on sum to one
        all_ = np.flatnonzero(~spaced)
        assert abs((10 ** inside.log10(np.full(len(all_), a), all_)).sum() - 1) < 1e-9
    texts = [" ".join(words), "", "x x", "new words here", words[0]]
    known = np.sort(lm_score.Words(*strings(pa.array(words[:3])), lower=True).hashes())
    spelled = lm_score.Spelled(enc, inside, np.unique(known), np.arange(len(np.unique(known))) + 0.5)
    for part in (texts, texts[::-1]):
        w = lm_score.Words(*strings(pa.array(part)), lower=True)
        flat, many, logs, base = spelled(w, w.hashes())
        assert [bool(x) for x in ~np.isnan(base)] == [x in words[:3] for t in part for x in t.split(" ") if x]
        want = [enc.encode_ordinary(" " + x) for t in part for x in t.split(" ") if x]
        assert flat.tolist() == [y for x in want for y in x] and many.tolist() == list(map(len, want))
        assert np.allclose(logs, [sum(inside.log10(np.array(x[:-1], int), np.array(x[1:], int))) for x in want])


def test_frequent_words_are_bounded(spark):
    rows = [(i, f"w{i}".encode(), 1 + i * i) for i in range(50)] + [(99, b"", 10**6)]
    df = spark.createDataFrame(rows, "h long, word binary, c long")
    for most in (0, 1, 7, 50, 100):
        got = sorted(r["c"] for r in lm_score.frequent_words(df, most).collect())
        assert len(got) <= most and got == sorted(c for _, w, c in rows if w)[50 - len(got) :]
    assert len(lm_score.frequent_words(df, 100).collect()) == 50 and len(lm_score.frequent_words(df, 20).collect()) > 10


def test_base_scores_match_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(10_001, None), (10_002, ""), (10_003, "zzqx zzqx never Seen"), (5, docs[5][1])]
    got = lm_score.score(spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, score int").repartition(3)).collect()
    assert len(got) == len(docs)
    held = lambda k: crc32(str(k).encode()) % 5 == 1
    count = Counter()
    for k, t in docs:
        if not held(k):
            count.update([*brute.words(brute.lower(t)), None])
    n, v = sum(count.values()), len(count)
    text = dict(docs)
    for r in got:
        tokens = [*brute.words(brute.lower(text[r["doc_id"]])), None]
        want = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens)
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(count[x] > 0 for x in tokens))
        assert brute.near(r["base_score"], want) and r["score"] < 0
    mean = lambda name: sum(r[name] for r in got if r["held_out"]) / sum(r["n_tokens"] for r in got if r["held_out"])
    assert mean("score") > -5.5  # of 200 texts little is learnt
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_attention_model_learns_from_all_subwords(spark, monkeypatch):
    texts = [" ".join(f"w{(i * 7 + j * j) % 30}" for j in range(n)) for i, n in enumerate([1, 0, 200, 3000, 25, 24, 60])]
    keys = [k for k in range(100) if crc32(str(k).encode()) % 5 != 1][: len(texts)]
    seen = {}

    def spy(name, f):
        def run(*args):
            seen[name] = f(*args)
            return seen[name]

        return run

    for name in ("neighbours", "averaged"):
        monkeypatch.setattr(lm_score, name, spy(name, getattr(lm_score, name)))
    monkeypatch.setattr(lm_score, "GROUP_IDS", 500, raising=False)
    lm_score.score(spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string").repartition(2)).collect()
    enc = lm_score.encoder(lm_score.public_tokenizers.path(lm_score.VOCABULARY), lm_score.public_tokenizers.PATTERN)
    ids = [enc.encode_ordinary(" " + t) if t else [] for t in texts]
    counted = Counter(y for x in texts for w in x.split() for y in enc.encode_ordinary(" " + w))
    pairs = Counter(p for x in ids for p in zip(x, x[1:]) if p[0] in counted and p[1] in counted)
    assert seen["neighbours"].sum() == sum(pairs.values())
    assert seen["averaged"][1] == sum(len(x) + 1 for x in ids)


def test_scores_do_not_depend_on_partitions(spark, sf, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same = "one text that a third of all rows repeat, word by word " * 40
    docs += [(1_000_000 + i, same) for i in range(len(docs) // 2)] + [(2_000_000, None)] * 5
    monkeypatch.setattr(lm_score, "LEARNT_IDS", 5_000)  # the copies have more than a bucket, so they are dealt one by one
    scores = []
    for n in (3, 7):
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
        scores.append(sorted((r["doc_id"], r["score"]) for r in lm_score.score(df).collect()))
    a, b = scores
    assert len(a) == len(docs) and [k for k, _ in a] == [k for k, _ in b]
    assert all(abs(x - y) <= 1e-4 * abs(x) for (_, x), (_, y) in zip(a, b, strict=True))


def test_copies_are_dealt_one_by_one(spark):
    from sparkcorpus.llm.scratch import Scratch

    rows = [([7] * 9,)] * 1000 + [([i, i + 1],) for i in range(50)] * 2 + [([],)] * 30
    got = lm_score.dealt(spark.createDataFrame(rows, "ids array<int>").repartition(5), Scratch(spark, "dealt"), 100).collect()
    assert Counter(tuple(r["ids"]) for r in got) == Counter(tuple(x) for x, in rows)
    sizes = Counter()
    for r in got:
        sizes[r["bucket"]] += len(r["ids"]) + 1
    buckets = -(-(10_000 + 300 + 30) // 100)
    assert set(sizes) <= set(range(buckets)) and len(sizes) > 0.9 * buckets and max(sizes.values()) < 400
    by = {}
    for r in got:  # copies that fit a bucket stay together
        by.setdefault(tuple(r["ids"]), set()).add(r["bucket"])
    assert len(by[(7,) * 9]) > 50 and all(len(v) == 1 for k, v in by.items() if len(k) < 9)
    assert lm_score.dealt(spark.createDataFrame([], "ids array<int>"), Scratch(spark, "dealt")).collect() == []


def test_rare_pairs_of_subwords_count_as_frequent_ones_do(spark, monkeypatch):
    """With no pair frequent enough to be broadcast, each meets its count in a join, and scores are the same."""
    docs = [(i, " ".join(f"wor{j}quax zyx{i % 4}vut{j}" for j in range(i % 9))) for i in range(60)]
    df, scores = spark.createDataFrame(docs, "doc_id long, text string"), []
    for share in (1e-9, 1.0):
        monkeypatch.setattr(lm_score, "SHARE", share)
        scores.append([r["score"] for r in lm_score.score(df).orderBy("doc_id").collect()])
    assert np.allclose(*scores, rtol=1e-9, atol=1e-9)


def test_words_are_remembered_by_sorted_hashes():
    """A word keeps its place when words with smaller and larger hashes come after it, and no word is looked up one by one."""
    enc = lm_score.encoder(lm_score.public_tokenizers.path(lm_score.VOCABULARY), lm_score.public_tokenizers.PATTERN)
    size = enc.n_vocab + 1
    inside = lm_score.Inside.of(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(size), np.append(lm_score.spaced_ids(enc), True))
    spelled = lm_score.Spelled(enc, inside, np.zeros(0, np.uint64), np.zeros(0))
    for texts in (["strawberry a", "zz"], ["b strawberry\nanthill", ""], ["zz anthill c strawberry unseen d a b"]):
        w = lm_score.Words(*strings(pa.array(texts)), lower=True)
        flat, many, _, _ = spelled(w, w.hashes())
        words = " ".join(texts).split()
        assert [x.tolist() for x in np.split(flat, np.cumsum(many)[:-1])] == [enc.encode_ordinary(" " + x) for x in words]
    assert len(spelled.slot) == 8 and (np.diff(spelled.hashes.astype(object)) > 0).all()


def test_places_of_hashes_that_share_a_cell():
    """Hashes that take one cell from one another keep their numbers, and one that is as an empty cell begins is not taken as known."""
    places, rng = lm_score.Places(), np.random.default_rng(5)
    near = np.arange(40, dtype=np.uint64) + (np.uint64(7) << lm_score.SHIFT)
    want = {}
    for n in (1, 30, 200, 0, 200):
        hashes = rng.choice(np.concatenate([near, np.zeros(1, np.uint64), places.cell[:3], rng.integers(0, 1 << 63, 20).astype(np.uint64)]), n)
        slots, new = places.places(hashes)
        assert sorted(slots[new].tolist()) == list(range(len(want), len(want) + len(new))) and len(set(hashes[new].tolist())) == len(new)
        want |= dict(zip(hashes[new].tolist(), slots[new].tolist(), strict=True))
        assert [want[h] for h in hashes.tolist()] == slots.tolist() and len(places.slot) == len(want)


def test_words_are_counted_alike_however_few_are_remembered(spark, monkeypatch):
    texts = [" ".join(f"W{(i * j) % 23}" for j in range(i % 11)) for i in range(90)] + ["", " ", "once"]
    want = Counter(w.lower().encode() for t in texts for w in t.split()) + Counter({b"": len(texts)})
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    for most in (0, 5, 400_000):
        monkeypatch.setattr(lm_score, "REMEMBERED", most)
        rows = lm_score.word_counts(df).collect()
        assert {bytes(r["word"]): r["c"] for r in rows} == dict(want) and len(rows) == len(want)


def test_steps_that_share_memory_score_and_learn_as_alone():
    """A step's arrays are written again by a smaller and a larger one; pieces of products that come out even and those that do not agree."""
    vocab, p, rng = small(6)
    space = at.Space(p["embed"].dtype)
    for n in (700, 30, 256 * 3 - 1, 900):
        inputs, targets, first, _ = at.layout(vocab, [rng.integers(0, 40, n)])
        alone, shared = (at.gradients(p, vocab, inputs, targets, first, with_loss=True, space=s) for s in (None, space))
        assert (alone[1] == shared[1]).all() and alone[2] == shared[2]
        assert all(np.array_equal(alone[0][k], shared[0][k]) for k in alone[0])
        whole, parts = (at.log10_probabilities(p, vocab, inputs, targets, first, together=k).sum() for k in (256, 3))
        assert abs(whole - parts) < 1e-3 and abs(whole + alone[2] * (n + 1) / np.log(10) - vocab.share[targets[targets >= 0]].sum()) < 1e-2


def test_weights_of_keys_whatever_the_scores():
    """Hidden keys have none, also where scores leave what 32 bits hold and where a hidden key has the largest."""
    rng, first = np.random.default_rng(7), np.array([True, False, False, True])
    for scale in (1, 30, 1e4):
        scores = (rng.normal(0, scale, (4, at.BLOCK, 2 * at.BLOCK))).astype(np.float32)
        scores[1, :, -1] += 50 * scale
        back = np.where(at.mask(), -1e9, -0.1 * at.BACK).astype(np.float32)
        want = scores.astype(float) + back
        want[first, :, : at.BLOCK] = -1e9
        want = np.exp2(want - want.max(2, keepdims=True))
        a, total = at.attend(scores, back, first, at.Space(scores.dtype))
        assert np.allclose(a / total, want / want.sum(2, keepdims=True), atol=1e-3 if scale > 1e3 else 1e-5)


def test_sums_of_exponentials_with_a_bias():
    z = np.array([[0, 1, -3, 0], [400, 380, 390, 0], [-500, -520, -490, 0], [-1e4, -2e4, -3e4, 0]], dtype=np.float32)
    bias = np.array([-1, -2, 0.5, -1e9], dtype=np.float32)  # nothing is in the last class
    want = z + bias.astype(float)
    want = np.exp(want - want.max(1, keepdims=True))
    for rows in (1, 2, 4):
        e, total = at.exps(z.copy(), rows, bias=bias)
        assert np.allclose(e * np.exp(bias) / total, want / want.sum(1, keepdims=True), atol=1e-6)


def test_a_text_is_one_row_whatever_words_it_has(spark, monkeypatch):
    """Words and pairs of subwords that meet their counts in a join are lists of their text's row, not rows with a null in all other columns."""
    kept, real = {}, lm_score.Scratch.keep

    def keep(self, df, name):
        kept[name] = real(self, df, name)
        if name == "encoded":
            kept["rows"] = [(r["n_tokens"], len(r["rare"]), len(r["ids"])) for r in kept[name].collect()]
        return kept[name]

    monkeypatch.setattr(lm_score.Scratch, "keep", keep)
    monkeypatch.setattr(lm_score, "KNOWN", 3)
    monkeypatch.setattr(lm_score.frequent_words, "__defaults__", (3,))
    docs = [(i, " ".join(f"word{j}x{i}" for j in range(i % 5))) for i in range(40)] + [(40, None)]
    lm_score.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(kept["rows"]) == 41 and all(rare == n - 1 for n, rare, _ in kept["rows"])
    enc = lm_score.encoder(lm_score.public_tokenizers.path(lm_score.VOCABULARY), lm_score.public_tokenizers.PATTERN)
    assert sorted(b for *_, b in kept["rows"]) == sorted(2 * len(enc.encode_ordinary(" " + t)) if t else 0 for _, t in docs)
