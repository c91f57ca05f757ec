"""Plain, slow versions of what the operators compute."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base_rules(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w)}


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_groups(rows):
    """rows: (doc_id, text); (doc_id, n_shingles, component_id) of each."""
    sets = [(k, shingles(t)) for k, t in rows]
    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(i)
    shared = Counter((a, b) for m in where.values() for x, a in enumerate(m) for b in m[x + 1 :])
    links = [(sets[a][0], sets[b][0]) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n)]
    group = components([k for k, _ in sets], links)
    return [(k, len(s), group[k]) for k, s in sets]


def repeats(texts, width=35):
    """(n_words, n_removed, kept_sha256) of each text."""
    lists = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def near(a, b):
    return abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))


def line_rules(text):
    """Lines with words, those that fail, their words, and the verdict."""
    text = text or ""
    seen, lines, gone, words_gone = set(), 0, 0, 0
    endings = {c.encode()[-1] for c in '.!?:;"\')]' + "\u2026\u00bb\u201d\u2019\u3002\uff01\uff1f"}
    phrases = ("all rights reserved", "licensed under the", "is licensed under", "terms of service", "privacy policy", "cookie policy", "enable javascript", "lorem ipsum")
    for line in text.split("\n"):
        w = words(line)
        if not w:
            continue
        lines += 1
        fails = w[-1].encode()[-1] not in endings and len(w) <= 60
        fails |= sum(c in "!?" for c in line) > 0.5 * len(w)
        fails |= sum(c in "#*$%&|<>" for c in line) > 0.1 * sum(map(len, w))
        fails |= w.count("|") > 0.2 * len(w)
        fails |= any(p in lower(line) for p in phrases)
        fails |= line in seen
        seen.add(line)
        gone += fails
        words_gone += fails * len(w)
    base = base_rules(text)
    return {"n_lines": lines, "n_lines_removed": gone, "n_words_removed": words_gone, "kept": not base["base_failed"] and base["n_words"] - words_gone >= 0.5 * base["n_words"]}


def mixing_targets(sizes, weights, most=3.0):
    """By bisection on the words a unit of weight gets: min(weight * x, most * size) sums to all."""
    total = sum(sizes)
    lo, hi = 0.0, most * total + 1.0
    for _ in range(200):
        x = (lo + hi) / 2
        if sum(min(w * x, most * s) for s, w in zip(sizes, weights, strict=True)) < total:
            lo = x
        else:
            hi = x
    return [min(w * hi, most * s) for s, w in zip(sizes, weights, strict=True)]


def ordinal_loss(rows, grades, weights, thresholds):
    """Mean negative log-likelihood of a cumulative-link model; rows: dicts of feature to value."""
    import math

    total = 0.0
    for row, grade in zip(rows, grades, strict=True):
        s = sum(weights.get(k, 0.0) * v for k, v in row.items())
        below = [0.0, *[1 / (1 + math.exp(s - t)) for t in thresholds], 1.0]
        total -= math.log(max(below[grade + 1] - below[grade], 1e-12))
    return total / len(rows)
