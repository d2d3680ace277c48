"""Similarities of two texts, as column expressions; Jaro-Winkler and n-gram cosine by Arrow."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import tokens

#: The consonant groups of the phonetic code; every other letter is 0.
SOUND_GROUPS = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}
#: Weights of named rules in the heuristic score.
RULE_WEIGHTS = {
    "exact_name": 1.2, "name_country": 1.0, "latin_name": 0.9, "latin_country": 0.8, "name_p6": 0.5, "latin_p6": 0.4,
    "name_tok0": 0.4, "name_tok1": 0.3, "addr_p10": 0.5, "addr_num_word": 0.5, "addr_num_word2": 0.3,
}
OTHER_RULE = 0.2


def levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts: 1."""
    longest = F.greatest(F.char_length(a), F.char_length(b), F.lit(1))
    return 1 - F.levenshtein(a, b) / longest


def jaro_winkler_of(a: str, b: str) -> float:
    """Prefix weight 0.1 for up to 4 characters, above 0.7 only. Two empty texts: 1, one: 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [ch for ch, u in zip(b, used, strict=True) if u]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)])


def _overlap(a: Column, b: Column) -> tuple[Column, Column]:
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def token_jaccard(a: Column, b: Column, *, empty: float = 1.0) -> Column:
    """Shared words by all words; ``empty`` if both have none."""
    both, every = _overlap(tokens(a), tokens(b))
    return F.when(every == 0, F.lit(empty)).otherwise(both / every)


def raw_token_jaccard(a: Column, b: Column) -> Column:
    """Of lower-cased words as they are; 0 if either has none."""
    return token_jaccard(F.lower(a), F.lower(b), empty=0.0)


def grams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; a shorter text is its own."""
    whole = F.transform(F.sequence(F.lit(1), F.char_length(c) - (n - 1)), lambda i: F.substr(c, i, F.lit(n)))
    return F.array_distinct(F.when(F.char_length(c) >= n, whole).otherwise(F.array(c)))


def char_dice(a: Column, b: Column, n: int = 3) -> Column:
    """Both empty: 1, one: 0."""
    x, y = grams(a, n), grams(b, n)
    share = 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(share)


def word_grams(text: str, low: int = 2, high: int = 4) -> Counter:
    """Counts of runs of 2 to 4 characters inside each word with a space on both sides."""
    out: Counter = Counter()
    for word in text.split():
        w = f" {word} "
        out.update(w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1))
    return out


@F.pandas_udf(T.DoubleType())
def ngram_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[str, tuple[Counter, float]] = {}

    def of(s: str) -> tuple[Counter, float]:
        if s not in known:
            c = word_grams(s)
            known[s] = c, sum(v * v for v in c.values()) ** 0.5
        return known[s]

    out = []
    for x, y in zip(a, b, strict=True):
        (p, n), (q, m) = of(x), of(y)
        out.append(sum(v * q[g] for g, v in p.items() if g in q) / (n * m) if n and m else 0.0)
    return pd.Series(out)


def soundex(name: Column) -> Column:
    """First letter and three digits of the letters' groups; a vowel, H, W or Y parts equal digits."""
    letters = F.regexp_replace(F.upper(name), r"[^\p{L}]", "")
    source = "".join(SOUND_GROUPS.values())
    target = "".join(d * len(g) for d, g in SOUND_GROUPS.items())
    digits = F.regexp_replace(F.translate(letters, source, target), r"[^1-6]", "0")
    # equal neighbours count once, the first letter's own digit not at all
    code = F.substr(F.regexp_replace(digits, r"([0-6])\1+", "$1"), F.lit(2))
    out = F.rpad(F.substr(F.concat(F.substr(letters, F.lit(1), F.lit(1)), F.replace(code, F.lit("0"), F.lit(""))), F.lit(1), F.lit(4)), 4, "0")
    return F.when(letters == "", "0000").otherwise(out)


def length_difference(a: Column, b: Column) -> Column:
    return F.abs(F.char_length(a) - F.char_length(b)) / F.greatest(F.char_length(a), F.char_length(b), F.lit(1))


def rule_score(rules: Column) -> Column:
    weights = F.create_map(*(F.lit(x) for kv in RULE_WEIGHTS.items() for x in kv))
    return F.aggregate(rules, F.lit(0.0), lambda a, r: a + F.coalesce(F.try_element_at(weights, r), F.lit(OTHER_RULE)))
