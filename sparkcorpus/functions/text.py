"""Functions on strings.  Lengths count code points."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from sparkcorpus.functions.arrow import arrow

#: Fixed values.
WORD = r"[A-Za-z0-9_]{2,}"
CJK = r"[\u4e00-\u9fff]"
IDENTIFIER = r"[A-Za-z][A-Za-z0-9_\-.]{2,}|\d{2,}"
ARROW, COLON = "→", "："
NO_HISTORY = ("—", "-", "", "无", "未提及")
CODE = r"(?:\b(?:public|private|static|void|class|def|import|return|const|function)\b|[{};]\s*$|=>|\(\))"


def clean_text(c: Column) -> Column:
    """Line ends to newlines, at most one blank line, no white space around."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squash(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(c, r"\s+", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def clip(c: Column, n: int) -> Column:
    """At most n characters of one line; an ellipsis marks what was cut."""
    line = strip(F.regexp_replace(c, r"\n", " "))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)


def estimate_tokens(c: Column, per_token: float = 1.5) -> Column:
    return F.when(c.isNull() | (c == ""), 0).otherwise(F.ceil(F.length(c) / F.lit(per_token))).cast("int")


def extract_terms(c: Column, most: int = 24) -> Column:
    """Distinct search terms in order: words, then pairs of neighbouring CJK characters."""
    words = F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)
    cjk = F.regexp_extract_all(c, F.lit(f"({CJK})"), 1)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cjk) - 1, F.lit(1))), lambda i: F.concat(F.try_element_at(cjk, i), F.try_element_at(cjk, i + 1)))
    pairs = F.when(F.size(cjk) > 1, pairs).when(F.size(cjk) == 1, cjk).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(words, pairs)), 1, most)


def cjk_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(CJK)) / F.length(c)).otherwise(0.0)


def is_content_block(c: Column, least: int = 150, share: float = 0.45) -> Column:
    return (F.length(c) >= least) & (cjk_share(c) >= share)


def looks_like_code(c: Column) -> Column:
    return (cjk_share(c) < 0.35) | c.rlike(CODE)


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, each ended by a NUL; null is empty."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("\0"))]), 256)


def short_sha1(c: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(F.encode(strip(c), "UTF-8")), 1, n)


def all_ngrams(c: Column, n: int) -> Column:
    """Character n-grams at every place, in one pass (cutting them out one by one would scan each from the start)."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams; none of shorter strings."""
    return F.array_distinct(all_ngrams(c, n))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def coverage(a: Column, b: Column) -> Column:
    """Share of a's elements that b has."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def usable_label(c: Column, least: int = 2) -> Column:
    """Long enough, and with a letter or digit."""
    return F.coalesce((F.length(strip(c)) >= least) & c.rlike(r"[\p{L}\p{Nd}]"), F.lit(False))


def model_ref(c: Column) -> Column:
    """`provider/model` parted at the first slash; without one, no provider."""
    at = F.locate("/", c)
    return F.struct(F.when(at > 1, F.substr(c, F.lit(1), at - 1)).alias("provider"), F.when(at > 1, F.substr(c, at + 1)).otherwise(c).alias("model"))


def stored_model(c: Column) -> Column:
    return F.regexp_replace(c, "/", ":")


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    return F.when(ms > 0, tokens * 1000.0 / ms).otherwise(0.0)


def identifiers(c: Column, stop: list[str] = ()) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"({IDENTIFIER})"), 1), F.lower))
    return F.array_except(found, F.array(*map(F.lit, stop)).cast("array<string>"))


def split_item(c: Column) -> Column:
    """`topic：old → new` as a struct; null for other shapes."""
    a, b = F.locate(COLON, c), F.locate(ARROW, c)
    parts = F.struct(strip(F.substr(c, F.lit(1), a - 1)).alias("topic"), strip(F.substr(c, a + 1, b - a - 1)).alias("old"), strip(F.substr(c, b + 1)).alias("new"))
    return F.when((a > 1) & (b > a), parts)


def lost_digits(item: Column, source: Column) -> Column:
    """Numbers before a colon that are not in the source but begin a longer one there."""
    numbers = F.regexp_extract_all(source, F.lit(r"(\d+)"), 1)
    return F.filter(F.regexp_extract_all(item, F.lit(r"(\d{2,})[:：]"), 1), lambda d: ~F.array_contains(numbers, d) & F.exists(numbers, lambda s: (F.length(s) > F.length(d)) & s.startswith(d)))


def repair_digits(item: Column, source: Column) -> Column:
    """Numbers parted by a colon are joined where the source has them joined."""
    numbers = F.regexp_extract_all(source, F.lit(r"(\d+)"), 1)
    found = F.regexp_extract_all(item, F.lit(r"(\d:\d{4,})"), 1)
    return F.aggregate(found, item, lambda text, m: F.when(F.array_contains(numbers, F.replace(m, F.lit(":"), F.lit(""))), F.replace(text, m, F.replace(m, F.lit(":"), F.lit("")))).otherwise(text))


def sentence_type(c: Column) -> Column:
    return (
        F.when(c.rlike(r"[?？]|为什么|如何|怎么|^(?i:why|how|what|when|who)\b"), "question")
        .when(c.rlike(r"如果|假如|若|(?i:\bif\b|\bunless\b)"), "condition")
        .when(c.rlike(r"因为|所以|因此|导致|(?i:\bbecause\b|\btherefore\b|\bhence\b)"), "cause")
        .when(c.rlike(r"但是|然而|不过|(?i:\bbut\b|\bhowever\b|\bwhereas\b)"), "contrast")
        .when(c.rlike(r"例如|比如|(?i:\bfor example\b|\be\.g\.)"), "example")
        .otherwise("plain")
    )


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def document_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 12)


def title_of(question: Column, n: int = 30) -> Column:
    return F.substring(strip(question), 1, n)


def yes_share(probabilities: Column, yes: list[str], no: list[str]) -> Column:
    """yes / (yes + no) over a map of token probabilities; null if neither is there."""
    total = lambda names: F.aggregate(F.map_values(F.map_filter(probabilities, lambda k, _: F.lower(F.trim(k)).isin(names))), F.lit(0.0), lambda a, x: a + x)
    y, n = total(yes), total(no)
    return F.when(y + n > 0, y / (y + n))


def choice_shares(probabilities: Column, choices: list[str]) -> Column:
    """Probabilities of the choices, made to sum to one; null if none is there."""
    kept = F.map_filter(probabilities, lambda k, _: k.isin(choices))
    total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform_values(kept, lambda _, v: v / total))


def token_probabilities(entries: Column) -> Column:
    """Map of trimmed token to the largest exp(logprob), from array<struct<token, logprob>>."""
    keys = F.array_distinct(F.transform(entries, lambda e: F.trim(e["token"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_max(F.transform(F.filter(entries, lambda e: F.trim(e["token"]) == k), lambda e: F.exp(e["logprob"])))))


def common_run(a: str | None, b: str | None) -> int:
    """Length of the longest common substring: the longer string is walked through the suffix automaton of the shorter."""
    if not a or not b:
        return 0
    short, long_ = sorted((a, b), key=len)
    after, link, size, last = [{}], [-1], [0], 0
    for c in short:
        new, p = len(after), last
        after.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if size[q] > size[p] + 1:  # q also ends longer strings: the part up to size[p] + 1 becomes a state of its own
                twin = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                link[q] = twin
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                q = twin
            link[new] = q
        last = new
    best = now = state = 0
    for c in long_:
        while state and c not in after[state]:
            state = link[state]
            now = size[state]
        if c in after[state]:
            state, now = after[state][c], now + 1
            best = max(best, now)
    return best


@arrow("int")
def longest_common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_run(x, y) for x, y in zip(a, b, strict=True)])


def copied_run(answer: str | None, source: str | None, least: int = 12) -> int | None:
    """Length of the longest stretch of the answer that the source has word for word, white space aside; 0 below `least`,
    null if either has no characters."""
    a, s = (re.sub(r"\s+", "", x or "") for x in (answer, source))
    if not a or not s:
        return None
    found = common_run(a, s)
    return found if found >= least else 0


@arrow("int")
def longest_copy(answer: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([copied_run(x, y) for x, y in zip(answer, source, strict=True)], dtype="Int32")


@arrow("double")
def normal_tail(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))


#: A string, an escaped character, a brace, or a quote that opens a string without end.
JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*"|\\.|[{}"]', re.S)


def balanced_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text; braces inside strings do not count."""
    for begin in re.finditer("{", text or ""):
        depth = 0
        for part in JSON_PART.finditer(text, begin.start()):
            if part.group() == '"':
                break
            depth += (part.group() == "{") - (part.group() == "}")
            if depth == 0:
                return text[begin.start() : part.end()]
    return None


@arrow("string")
def first_json_object(text: pd.Series) -> pd.Series:
    return text.map(balanced_object)
