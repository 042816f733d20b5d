"""Periodic runs of words: end positions of a suffix automaton, merged small to large, seed squares that are extended to runs.

A run is a stretch of words with smallest period q and a length of at least max(LEAST, 3 * q) that neither neighbour extends. Its
last length - q words occur twice, q words apart, and are the longest string of their state, as the words in front of the two
differ. Nothing of that state ends in between, or the run would have a smaller period. So the two ends become neighbours for the
first time when the end sets of that state's children are merged, and the seed is the run itself. Other neighbours at most a
state's length apart are squares too; they extend to runs that are known already, or to multiples of a smaller period.

The automaton is built only over stretches in which each window of WINDOW words occurs again near enough: every window of a run
does so within the run, thus no run is lost and ordinary prose needs no automaton.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_text, words

#: The least length of a run, and the least periods in it.
LEAST, PERIODS = 24, 3
#: Words of a window. A run has at least max(24, 3 * q) words, so a window of 8 in it has another one q words on or back.
WINDOW = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """length, link and own end (-1 for a copied state) of the states of the suffix automaton of ids; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    length, link, own, last = [0], [-1], [-1], 0
    for end, c in enumerate(ids):
        new, p = len(length), last
        step.append({})
        length.append(end + 1)
        link.append(0)
        own.append(end)
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] > length[p] + 1:
                q, old = len(length), q
                step.append(step[old].copy())
                length.append(length[p] + 1)
                link.append(link[old])
                own.append(-1)
                link[old] = q
                while p >= 0 and step[p].get(c) == old:
                    step[p][c] = q
                    p = link[p]
            link[new] = q
        last = new
    return length, link, own


class Runs:
    """The stretches of ids with period d that seeds have been extended to, each once."""

    def __init__(self, ids: list[int]):
        self.ids, self.starts, self.ends = ids, {}, {}

    def seed(self, start: int, end: int, d: int) -> None:
        """ids[start:end] has period d. Of stretches with one period, two share fewer than d words, so of the known ones only
        the last that begins no later can hold the seed."""
        ids, starts = self.ids, self.starts.setdefault(d, [])
        k = bisect_right(starts, start)
        if k and self.ends[d, starts[k - 1]] >= end:
            return
        while start and ids[start - 1] == ids[start - 1 + d]:
            start -= 1
        while end < len(ids) and ids[end] == ids[end - d]:
            end += 1
        insort(starts, start)
        self.ends[d, start] = end

    def found(self) -> list[tuple[int, int, int]]:
        """(start, length, period): of periods of one stretch the smallest, which divides the others."""
        least: dict[tuple[int, int], int] = {}
        for (d, start), end in self.ends.items():
            least[start, end] = min(d, least.get((start, end), d))
        return sorted((a, z - a, d) for (a, z), d in least.items() if z - a >= max(LEAST, PERIODS * d))


def of_stretch(ids: list[int]) -> list[tuple[int, int, int]]:
    """The runs of ids by the automaton. A state's end set is a list with the latest end first; a state's own end is its
    earliest one, so it goes to the list's end. Seeds that their own run's state gives exactly are enough: those with
    at least PERIODS periods and LEAST words."""
    length, link, own = automaton(ids)
    ends: list[list[int] | None] = [None if x < 0 else [-x] for x in own]
    runs = Runs(ids)
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up = link[v]
        if not up:
            ends[v] = None
            continue
        small, large, most = ends[v], ends[up], length[up]
        ends[v] = None
        if large is None:
            ends[up] = small
            continue
        if len(small) > len(large):
            small, large = large, small
        for x in small:
            k = bisect_left(large, x)
            for y in large[max(k - 1, 0) : k + 1]:  # its neighbours, before it stands between them
                d = abs(x - y)
                if d <= most and most >= (PERIODS - 1) * d and most + d >= LEAST:
                    first = -max(x, y)
                    runs.seed(first - most + 1, first + d + 1, d)
            large.insert(k, x)
        ends[up] = large
    return runs.found()


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that may hold runs: at least LEAST words, each window of which has an equal one (by hash) at
    most a third of the stretch away."""
    n = len(ids) - WINDOW + 1
    if n < LEAST - WINDOW + 1:
        return []
    x = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    x ^= x >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = h * _BASE + x[k : k + n]
    order = np.argsort(h, kind="stable")
    apart = np.where(h[order[1:]] == h[order[:-1]], np.diff(order), len(ids))
    near = np.empty(n, np.int64)
    near[order] = np.minimum(np.append(apart, len(ids)), np.insert(apart, 0, len(ids)))

    def within(start: int, end: int) -> list[tuple[int, int]]:
        """The stretches of words start to end whose windows have equals near enough for that length."""
        live = near[start : end - WINDOW + 1] <= (end - start) // PERIODS
        edges = np.flatnonzero(np.diff(np.concatenate(([False], live, [False])).astype(np.int8)))
        return [(start + a, start + z + WINDOW - 1) for a, z in edges.reshape(-1, 2).tolist() if z - a > LEAST - WINDOW]

    todo, out = [(0, len(ids))], []
    while todo:
        start, end = todo.pop()
        parts = within(start, end)
        (out if parts == [(start, end)] else todo).extend(parts)
    return sorted(out)


def runs_of(found: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of words, by start, then period."""
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found))
    return sorted((start + a, n, d) for start, end in stretches(ids) for a, n, d in of_stretch(ids[start:end].tolist()))


def _collapse(text: bytes | None) -> tuple[list[int], list[int], list[int], bytes]:
    found = words(text)
    runs = runs_of(found)
    if runs:
        gone = np.zeros(len(found) + 1, np.int64)
        for start, n, d in runs:
            gone[start + d] += 1
            gone[start + n] -= 1
        found = [w for w, x in zip(found, np.cumsum(gone).tolist()) if not x]
    starts, lengths, periods = zip(*runs) if runs else ((), (), ())
    return list(starts), list(lengths), list(periods), b" ".join(found)


def collapsed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, runs (array of start, length, period, numbered from word 0, by start, then period) and
    collapsed, the words that no run holds after its first period, joined by one space.

    A null or empty text and one of white space have no runs and collapse to an empty text. Repeated rows stay, null ids too;
    other columns are ignored; an empty table gives one. Texts are independent: no shuffle. A task holds the automaton of one
    stretch, about a thousand bytes for each of its words.
    """
    each = per_text(docs.select("doc_id", "text"), "start array<bigint>, length array<bigint>, period array<bigint>, collapsed binary", lambda: _collapse)
    return each.select("doc_id", F.arrays_zip("start", "length", "period").alias("runs"), F.col("collapsed").cast("string").alias("collapsed"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of docs, where about a tenth of the texts end in repetitions of a part: if the id's CRC32 h is a multiple of
    10, each word i >= a becomes word a + (i - a) % p, with g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8). A null id
    plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    each = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), cut.alias("w")).withColumn("n", F.size("w"))
    at = each.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    by = at.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    new = F.expr("array_join(transform(w, (x, i) -> if(i >= a, get(w, int(a + (i - a) % p)), x)), ' ')")
    return by.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """Of an array of runs the one with the greatest length / period, compared exactly; ties: smallest start, then period. Null if
    there is none."""

    def order(x: Column, y: Column) -> Column:
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        earlier = (x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))
        return F.when(left != right, F.when(left > right, -1).otherwise(1)).when(earlier, -1).when((x["start"] == y["start"]) & (x["period"] == y["period"]), 0).otherwise(1)

    return F.get(F.array_sort(runs, order), F.lit(0))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the strongest run of each planted() text, runs_sha256 and
    collapsed_sha256."""
    each = collapsed(planted(docs)).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return each.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
