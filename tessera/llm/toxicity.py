"""Toxicity by weak supervision.

Voters are words and word beginnings, from a fixed lexicon and from terms that
training labels favour, and patterns of writing. Terms are counted in Spark
over a sample of at most SAMPLE labelled training rows, taken by hash of
doc_id, one for each; they become voters while the expected share of chance finds stays
below FALSE_SHARE (Benjamini-Hochberg).

A generative label model with a hidden class per document explains all votes,
the given label being one more voter: expectation-maximisation finds each
voter's rates of firing in both classes, correlations between voters within a
class discount votes that say the same, and the posterior of the class labels
the sample anew. A logistic model on the same signs is trained on posteriors
and scores every whole text, one row at a time; text is its only input.

Defined results: null or empty text fires nothing and gets the base score;
labels with a null doc_id or toxic are ignored; of several labels of one
doc_id the largest counts, of several texts the smallest is learned from; without labels of both kinds the lexicon alone
decides; repeated rows get equal scores; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import append, fields, fresh, map_arrow, raw, stage_table, table

#: Production parameters.
SAMPLE, VOTERS, FALSE_SHARE, THRESHOLD = 20_000, 400, 0.02, 0.7
#: Beginnings of words that count as terms, by length.
LENGTHS = (3, 4, 5, 6, 7, 8)
#: Plain English insults and the marks of terms.
LEXICON = ("bastard", "clown", "cretin", "disgusting", "dumb", "filth", "fool", "idiot", "imbecile", "jerk", "liar", "loser", "lowlife", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: bytes | None) -> set[str]:
    return set(_WORD.findall(text.decode("utf-8", "replace").lower())) if text else set()


def terms_of(text: bytes | None) -> set[str]:
    """The text's terms: whole words, and word beginnings with a star."""
    words = words_of(text)
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in LENGTHS))


#: Patterns of writing: name and test of a decoded text.
def _shouting(text: str) -> bool:
    letters = sum(map(str.isalpha, text))
    return letters > 20 and sum(map(str.isupper, text)) > letters / 2


PATTERNS = [("shouting", _shouting), ("exclaiming", lambda t: t.count("!") > len(t) / 50 + 3), ("repeating", lambda t: re.search(r"(\w)\1{4}", t) is not None)]


@dataclass
class Model:
    """weights: of the signs, by place; the last is the bias. terms: place of each term."""

    terms: dict[str, int]
    weights: np.ndarray

    def __post_init__(self) -> None:
        # most words begin like no term: one look-up settles them
        self.heads = {t.rstrip("*")[: LENGTHS[0]] for t in self.terms}

    def signs(self, text: bytes | None) -> list[int]:
        """Places of the signs that the text shows."""
        out, get, heads = set(), self.terms.get, self.heads
        for w in words_of(text):
            if w[: LENGTHS[0]] in heads:
                out.add(get(w))
                out.update(get(w[:n] + "*") for n in LENGTHS if len(w) >= n)
        out.discard(None)
        if text:
            plain = text.decode("utf-8", "replace")
            out.update(len(self.terms) + k for k, (_, f) in enumerate(PATTERNS) if f(plain))
        return sorted(out)

    def score(self, text: bytes | None) -> float:
        z = self.weights[-1] + self.weights[self.signs(text)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def labels_of(labels: DataFrame) -> DataFrame:
    """doc_id, toxic: one row for each labelled document."""
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def training_sample(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``size`` labelled rows that are not held out, one for each doc_id: that of the smallest text."""
    chosen = labels_of(labels).where(remainder(F.col("doc_id"), 3) != 1).orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(size)
    # bounded by ``size`` rows of two numbers
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # texts of one doc_id are combined before the shuffle, however many
    one = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return stage_table(one.select("text", "toxic"), "toxicity-sample")


def find_terms(sample: DataFrame, base: float) -> list[str]:
    schema = fields("term string, n bigint, t bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, t = Counter(), Counter()
                for text, toxic in zip(raw(part.column(0)), part.column(1).to_pylist(), strict=True):
                    own = terms_of(text)
                    n.update(own)
                    if toxic:
                        t.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64()), pa.array([t[k] for k in n], pa.int64())], names=["term", "n", "t"])

    sums = map_arrow(sample, run, schema).groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).where("n >= 3")
    share = F.least(F.col("t") / F.col("n"), F.lit(1 - 1e-9))
    # Chernoff's bound on the chance of so many toxic rows among n
    gain = F.col("n") * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    scored = stage_table(sums.select("term", "t", F.when(share > base, gain).otherwise(0.0).alias("gain"), share.alias("share")), "toxicity-terms")
    tested = scored.count()
    best = scored.where("share >= 0.6").orderBy(F.desc("gain"), "term").limit(5 * VOTERS).collect()
    out: list[str] = []
    for k, r in enumerate(best, 1):
        if tested * np.exp(-r.gain) > FALSE_SHARE * k:
            break
        out.append(r.term)
    return out[:VOTERS]


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior of class 1 for each row, when it changes no more. votes: rows x voters of 0 and 1; given: labels, as noisy as any vote."""
    every = np.column_stack([votes, given]).astype(np.float32)
    y = np.clip(given.astype(np.float64), 0.05, 0.95)
    together = every.T @ every
    for _ in range(rounds):
        prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        rate1 = (y @ every + 0.5 * prior) / (y.sum() + prior)
        rate0 = ((1 - y) @ every + 0.5 * (1 - prior)) / ((1 - y).sum() + 1 - prior)
        # the excess of common votes within the classes, as a correlation
        expected = np.outer(rate1, rate1) * y.sum() + np.outer(rate0, rate0) * (1 - y).sum()
        variance = rate1 * (1 - rate1) * y.sum() + rate0 * (1 - rate0) * (1 - y).sum()
        corr = (together - expected) / np.sqrt(np.outer(variance, variance) + 1e-9)
        np.fill_diagonal(corr, 0)
        discount = 1 / (1 + np.clip(corr, 0, 1).sum(axis=1))
        discount[-1] = 1
        yes, no = np.log(rate1 / rate0), np.log((1 - rate1) / (1 - rate0))
        z = np.log(prior / (1 - prior)) + (every * (yes - no) + no) @ discount
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - y).max() < 1e-4:
            y = new
            break
        y = new
    return y


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.03, rounds: int = 25) -> np.ndarray:
    """Weights and bias (last) by Newton's method on soft labels."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    sample = training_sample(documents, labels, size)
    count = sample.agg(F.count("*"), F.sum("toxic")).first()
    n, toxic = count[0], count[1] or 0
    mined = find_terms(sample, toxic / n) if 0 < toxic < n else []
    terms = {t: k for k, t in enumerate(dict.fromkeys([*LEXICON, *mined]))}
    width = len(terms) + len(PATTERNS)
    plain = Model(terms, np.append(np.full(len(terms), 6.0), [0.0] * len(PATTERNS) + [-3.0]))
    if not 0 < toxic < n:
        return plain
    # a few numbers for each of at most ``size`` rows
    seen = append(sample, "text", fields("signs array<int>"), lambda texts: [[plain.signs(t) for t in texts]]).select("signs", "toxic").toPandas()
    x = np.zeros((len(seen), width), np.float32)
    for k, signs in enumerate(seen.signs):
        x[k, signs] = 1
    y = label_model(x, seen.toxic.to_numpy(np.float32))
    return Model(terms, logistic(x, y))


def with_scores(documents: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    return append(documents, text, fields(f"{name} double"), lambda texts: [[model.score(t) for t in texts]])


def drop_toxic(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns only."""
    name = fresh(documents, "toxic_score")
    return with_scores(documents, train(documents, labels), name).where(F.col(name) < threshold).select(*(F.col(f"`{c}`") for c in documents.columns))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = with_scores(docs, train(docs, table(spark, sf_dir, "labels")), "score")
    return got.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
