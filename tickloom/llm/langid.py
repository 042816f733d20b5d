"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent n-grams (1 to 3 letters; a space stands for the ends of a word). A
document goes to the language whose profile is nearest by out-of-place distance: the sum, over the document's n-grams, of
how far each stands from its place in the language's list, or the list's length if it isn't there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text

#: Length of the profiles. Languages are learned from up to TRAIN labelled texts of each, chosen by hash.
PLACES, TRAIN = 300, 3000
FOLDS, HELD = 4, 2
NONE = "und"
_SPACE, _BITS = 32, 21
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text as packed code points, and how often each occurs. No letter: none."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _is_letter()[x]
    x = np.concatenate(([_SPACE], np.where(letter, x, _SPACE), [_SPACE]))
    space = np.concatenate(([True], ~letter, [True]))
    keep = ~(space & np.concatenate(([False], space[:-1])))  # one space for each run of others
    x, space = x[keep], space[keep]
    if len(x) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (x[:-1] << _BITS) | x[1:]
    three = (two[:-1] << _BITS) | x[2:]
    return np.unique(np.concatenate((x[~space], two, three[~space[1:-1]])), return_counts=True)


def places(codes: np.ndarray, often: np.ndarray, n: int = PLACES) -> np.ndarray:
    """The n most frequent codes, most frequent first, ties by code."""
    if len(codes) > 4 * n:
        least = np.partition(often, len(often) - n)[len(often) - n]
        codes, often = codes[often >= least], often[often >= least]
    return codes[np.lexsort((codes, -often))][:n]


class Profiles:
    def __init__(self, of: dict[str, list[int]]):
        self.langs = sorted(of)
        self.codes = np.unique(np.array([c for p in of.values() for c in p], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(of[lang], np.int64)), k] = np.arange(len(of[lang]))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """The nearest language (of equals, the first by name), and how much nearer it is than the worst case, 0 to 1."""
        mine = places(*grams(text))
        if not len(mine) or not self.langs:
            return NONE, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        rank = np.where((self.codes[at] == mine)[:, None], self.rank[at], -1)
        away = np.where(rank < 0, PLACES, np.abs(rank - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (PLACES * len(mine)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def learn(docs: DataFrame, most: int = TRAIN) -> Profiles:
    """Profiles from the texts with a language that aren't held out; a bounded sample of `most` for each language, by the hash
    of its ids. N-gram counts are summed over Spark; the driver gets PLACES n-grams for each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return Profiles({})
    limit = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], (most << 30) // r["n"])])
    chosen = known.where(F.col("h") < F.try_element_at(limit, F.col("lang"))).select("lang", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sums = b.column(0).to_pylist(), {}
            for lang, text in zip(langs, b.column(1)):
                for c, n in zip(*(x.tolist() for x in grams(text.as_py()))):
                    sums[lang, c] = sums.get((lang, c), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array(list(sums.values()), pa.int64())], ["lang", "code", "n"])

    summed = chosen.select("lang", F.col("text").cast("binary")).mapInArrow(rows, "lang string, code bigint, n bigint")
    total = summed.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = total.withColumn("k", F.expr("row_number() OVER (PARTITION BY lang ORDER BY n DESC, code)")).where(F.col("k") <= PLACES)
    of: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "k").collect():
        of.setdefault(r["lang"], []).append(r["code"])
    return Profiles(of)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text, lang).

    Texts that are null or have no letter get "und" and 0, as all do if nothing can be learned. A null doc_id isn't held
    out. Other columns are ignored, repeated rows stay, an empty table gives one.
    """
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    model = learn(docs)
    return per_text(docs.select("doc_id", held_out().alias("held_out"), "text"), "lang_pred string, score double", lambda: model.predict)
