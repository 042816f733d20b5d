"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed as toxic; everything else is unlabelled, whatever its label says. With the class prior
p, the risk of a classifier is p R+ (positives taken as positive) + max(0, Ru- - p R+-) (unlabelled taken as negative, less
the share of positives among them). Features are the presence of words and of beginnings of words that are
over-represented among the positives, and the model is linear; it's fitted with numpy on a bounded sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, per_text, row_of, swept

FOLDS, HELD, CUT = 3, 1, 0.7
#: Bounds of the fit: documents of either kind in the sample, by the hash of their ids; words that are features.
POSITIVES, UNLABELLED, FEATURES = 4000, 12000, 2000
#: Positives in which a word must occur, how many times more often in them than in unlabelled documents, and the least
#: product of the positives and the logarithm of that.
LEAST_IN, LIFT, GAIN = 5, 4.0, 20.0
#: Lengths of the beginnings.
STEMS = (4, 5, 6, 7, 8)
STEPS, BATCHES, RATE, DECAY, SEED = 100, 8, 0.05, 1e-4, 7
#: A word: letters and digits, apostrophes inside.
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def vocabulary(text: bytes | None) -> set[str]:
    """The distinct words of a whole text, and their beginnings with an asterisk."""
    if not text:
        return set()
    out = set(WORD.findall(text.decode("utf-8", "replace").lower()))
    for k in STEMS:
        out |= {w[:k] + "*" for w in out if len(w) > k and w[-1] != "*"}
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, text) -> for each batch, in how many positive and other texts a feature occurs."""
    for b in batches:
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for positive, text in zip(b.column(0), b.column(1)):
            sums[positive.as_py()].update(vocabulary(text.as_py()))
        words = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([sums[1][w] for w in words], pa.int64()), pa.array([sums[0][w] for w in words], pa.int64())], ["word", "p", "u"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def _within(n: int, most: int) -> Column:
    """Whether doc_id is among about `most` of n, by hash."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit((most << 30) // max(n, 1))


class Rows:
    """Which of n features each document has, the rows one after another."""

    def __init__(self, rows: list[np.ndarray], n: int):
        self.size, self.n = np.array([len(r) for r in rows], np.int64), n
        self.start = np.cumsum(self.size) - self.size
        self.features = np.concatenate(rows) if rows else np.zeros(0, np.int64)

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the document among docs, feature) for each feature of these documents."""
        size = self.size[docs]
        row = np.repeat(np.arange(len(docs)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        return row, self.features[np.repeat(self.start[docs], size) + at]


def fit(x: list[np.ndarray], positive: np.ndarray, n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk under the logistic loss.

    x: the numbers of each document's features, of n. Where a batch's estimate of the negatives' risk falls below zero,
    overfitting shows there; it then counts as zero and has no gradient. What is learned follows from the order of x.
    """
    random, rows = np.random.default_rng(SEED), Rows(x, n)
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = math.log(prior / (1 - prior))
    parts = [np.flatnonzero(positive), np.flatnonzero(~positive)]
    step = 0

    def scores(docs: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        z = np.bincount(of[0], w[of[1]], len(docs)) + w[n]
        return 1 / (1 + np.exp(-z.clip(-30, 30)))

    def gathered(docs: np.ndarray, of: tuple[np.ndarray, np.ndarray], by: np.ndarray) -> np.ndarray:
        """The mean over docs of by times each feature and the constant."""
        return np.append(np.bincount(of[1], by[of[0]], n), by.sum()) / len(docs)

    for _ in range(STEPS):
        orders = [np.array_split(random.permutation(p), BATCHES) for p in parts]
        for pos, unl in zip(*orders):
            if not len(pos) or not len(unl):
                continue
            of_p, of_u = rows.of(pos), rows.of(unl)
            sp, su = scores(pos, of_p), scores(unl, of_u)
            negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
            g = prior * gathered(pos, of_p, sp - 1)
            if negative >= 0:
                g += gathered(unl, of_u, su) - prior * gathered(pos, of_p, sp)
            g[:n] += DECAY * w[:n]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:n], float(w[n])


class Classifier:
    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept

    def score(self, text: bytes | None) -> tuple[float, int]:
        z = self.intercept + sum(sorted(self.weights[t] for t in vocabulary(text) & self.weights.keys()))
        s = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return s, int(s >= CUT)


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """docs (doc_id, text), labels (doc_id, toxic) -> classifier, from the rows that aren't held out.

    The prior is the share of toxic documents among all labelled ones. A document with several labels is toxic if any says
    so. Without a positive or an unlabelled document, every score is the prior. UNLABELLED bounds the sample that word counts
    and weights are learned from; which words are over-represented, and how much the weights vary, depends on it, scoring
    covers all documents. Equal inputs give equal weights however they are partitioned.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max((toxic + 0.5) / (n + 1), 1e-4), 0.9)
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    positives = known.where("toxic = 1").where(_within(toxic, POSITIVES)).select("doc_id")
    # about POSITIVES ids of eight bytes: a bounded broadcast
    of_p = rows.join(F.broadcast(positives), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "doc_id", "text")
    of_u = rows.where(_within(rows.count(), UNLABELLED)).select(F.lit(False).alias("positive"), "doc_id", "text")
    with swept(docs.sparkSession):
        return _trained(kept(of_p.union(of_u), "sample"), prior)


def _trained(seen: DataFrame, prior: float) -> Classifier:
    """seen (positive, doc_id, text), the sample -> classifier. Documents are taken in the order of their ids' hashes, ids and
    texts' hashes, whatever the partitions; rows alike in all of these are alike."""
    count = {r["positive"]: r["n"] for r in seen.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, u = count.get(True, 0), count.get(False, 0)
    none = Classifier({}, math.log(prior / (1 - prior)))
    if not p or not u:
        return none
    each = seen.select("positive", F.col("text").cast("binary")).mapInArrow(_counts, "word string, p bigint, u bigint")
    words = each.groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    lift = (F.col("p") / p) / ((F.col("u") + 1) / (u + 1))
    gain = F.col("p") * F.log(lift)
    best = words.where((F.col("p") >= LEAST_IN) & (lift >= LIFT) & (gain >= GAIN)).orderBy(F.desc(gain), "word").limit(FEATURES)
    names = sorted(r["word"] for r in best.collect())
    if not names:
        return none
    at = {w: k for k, w in enumerate(names)}
    order = [F.xxhash64("doc_id").alias("h"), F.col("doc_id"), F.xxhash64("text").alias("of")]
    found = per_text(seen.select("positive", *order, "text"), "words array<int>", lambda: lambda t: (sorted(at[w] for w in vocabulary(t) & at.keys()),))
    sample = found.orderBy("h", "doc_id", "of", "positive").collect()
    w, b = fit([np.array(r["words"], np.int64) for r in sample], np.array([r["positive"] for r in sample]), len(names), prior)
    return Classifier({t: float(x) for t, x in zip(names, w) if x}, b)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text), from its text alone.

    Null and empty texts get the score of a text without any of the words. A null doc_id isn't held out, nor learned from.
    Other columns are ignored, repeated rows stay.
    """
    model = train(docs, labels)
    return per_text(docs.select("doc_id", held_out().alias("held_out"), "text"), "score double, predicted int", lambda: model.score)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic; columns as in docs. Null and empty texts are scored as texts without features and
    stay, repeated rows stay or go together, an empty table gives one."""
    model = train(docs, labels)
    return per_text(docs.select(row_of(docs), "text"), "score double, predicted int", lambda: model.score).where("predicted = 0").select("row.*")
