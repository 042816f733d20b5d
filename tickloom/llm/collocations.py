"""Phrase collocations: generalised suffix automata by shard, whose end-position counts are added up over all shards.

A shard is a few megabytes of text of one language. Phrases of fewer than LEAST occurrences matter nowhere, and most pairs of
neighbouring words are such, so shards first agree on the words and pairs that are frequent over the corpus: each sends the
hashes of its distinct ones, sorted, with counts, in a chunk for each range of hashes; for each range the counts are added up and
every shard gets one bit for each hash. Words of two texts that share a hash may let an infrequent pair through; none is lost.
Then each shard cuts its pieces between words that are no frequent pair, puts the distinct parts with their numbers of occurrences into
an automaton, and enumerates the phrases of up to WORDS words from its root. These go, in chunks by ranges of their hashes too, to
where equal phrases of all shards are added up.

All parts of a candidate (its suffixes along suffix links, and theirs of its prefixes) are at least as frequent, so they stand in the
same table: cuts are joined to it, and a longer candidate hands its frequency down to all that it contains.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, swept

#: The least occurrences of a candidate, its most words, and how many are returned of each language.
LEAST, WORDS, TOP = 30, 4, 2000
#: A longer candidate stands for what it contains if it has this share, in percent, of its occurrences.
SHARE = 80
#: Bytes of text in a shard, and those whose distinct words and pairs are counted in one task.
SHARD, RANGE = 2 << 20, 16 << 20
#: Low bytes of a hash that are sent; its high ones choose the range.
HASH = 5
#: Bytes: A-Z to lower case; what ends a piece to a line feed, a tab to a space.
_TABLE = bytearray(bytes(range(256)).lower())
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shards(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """docs (text, lang, ...) -> shard, lang, size, text: all texts of a task, one after another, in parts of about `size` bytes by
    language, as Zstandard bytes, so that no row of the shuffle is large. A longer text is cut between two pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, open_ = TaskContext.get().partitionId() << 32, {}
        n = 0

        def row(lang: str, text: bytes) -> pa.RecordBatch:
            nonlocal n
            n += 1
            return pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([lang]), pa.array([len(text)]), pa.array([pa.compress(text, "zstd", asbytes=True)], pa.binary())], ["shard", "lang", "size", "text"])

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                lang, text = lang.as_py(), text.as_py().translate(_TABLE)
                while len(text) > 2 * size and (cut := text.find(b"\n", size)) >= 0:
                    yield row(lang, text[:cut])
                    text = text[cut + 1 :]
                parts = open_.setdefault(lang, [0])
                parts[0] += len(text) + 1
                parts.append(text)
                if parts[0] >= size:
                    yield row(lang, b"\n".join(open_.pop(lang)[1:]))
        for lang, parts in open_.items():
            yield row(lang, b"\n".join(parts[1:]))

    asked = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    return asked.mapInArrow(run, "shard bigint, lang string, size bigint, text binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


class Shard:
    """The words of a shard's text as numbers, and its distinct words and pairs of neighbours with hashes and counts."""

    def __init__(self, lang: str, text: bytes):
        self.text, raw = text, np.frombuffer(text, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], (raw != 32) & (raw != 10), [False])).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        piece = np.cumsum(raw == 10, dtype=np.int32)[self.starts]
        hashes, first, self.ids, self.counts = np.unique(self._hashes(), return_index=True, return_inverse=True, return_counts=True)
        if not self._same(first[self.ids]):
            hashes, first = self._renumbered()
        self.first = first
        with_next = np.flatnonzero(piece[1:] == piece[:-1])
        codes, of, n = np.unique(self.ids[with_next] * len(hashes) + self.ids[with_next + 1], return_inverse=True, return_counts=True)
        self.pairs_at, self.pairs = with_next, of
        salt = np.uint64(xxhash.xxh64_intdigest(lang) & ~7)
        one, two = hashes[codes // max(len(hashes), 1)], hashes[codes % max(len(hashes), 1)]
        self.hashes = np.concatenate((_mixed(hashes ^ salt), _mixed((one * _M1 + _mixed(two)) ^ (salt + np.uint64(2)))))
        self.order = np.argsort(self.hashes, kind="stable")
        self.occurrences = np.minimum(np.concatenate((self.counts, n)), LEAST).astype(np.uint8)

    def _blocks(self, starts: np.ndarray, sizes: np.ndarray, at: int) -> np.ndarray:
        """Eight bytes of each word from its byte `at`, zeros behind its end."""
        padded = self._padded
        windows = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        left = np.minimum(sizes - at, 8).astype(np.uint64)
        return windows[starts + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))

    def _hashes(self) -> np.ndarray:
        self._padded = self.text + bytes(8)
        sizes = self.ends - self.starts
        out, rest, at = sizes.astype(np.uint64) * _M1, np.arange(len(sizes)), 0
        while len(rest):
            out[rest] = _mixed(out[rest] ^ (self._blocks(self.starts[rest], sizes[rest], at) * _M1))
            at += 8
            rest = rest[sizes[rest] > at]
        return out

    def _same(self, first: np.ndarray) -> bool:
        """Whether each word is that of index `first`, byte by byte."""
        sizes = self.ends - self.starts
        if (sizes != sizes[first]).any():
            return False
        rest, at = np.arange(len(sizes)), 0
        while len(rest):
            if (self._blocks(self.starts[rest], sizes[rest], at) != self._blocks(self.starts[first[rest]], sizes[rest], at)).any():
                return False
            at += 8
            rest = rest[sizes[rest] > at]
        return True

    def _renumbered(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers by the words themselves, where two words of the shard share a hash."""
        number: dict[bytes, int] = {}
        at = [number.setdefault(self.text[a:z], len(number)) for a, z in zip(self.starts.tolist(), self.ends.tolist())]
        self.ids = np.array(at, np.int64)
        _, first, self.counts = np.unique(self.ids, return_index=True, return_counts=True)
        return self._hashes()[first], first

    def word(self, n: int) -> bytes:
        at = self.first[n]
        return self.text[self.starts[at] : self.ends[at]]

    def parts(self, frequent: np.ndarray) -> dict[tuple[int, ...], int]:
        """The parts between words that are no frequent pair, as word numbers, with how often each occurs; frequent says it for each
        of hashes. Infrequent words stand in none."""
        words = len(self.counts)
        good = frequent[:words][self.ids]
        joined = np.zeros(len(self.ids) + 1, bool)  # whether a word and the one in front are in one part
        joined[self.pairs_at[frequent[words:][self.pairs]] + 1] = True
        joined[1:-1] &= good[1:] & good[:-1]
        joined[-1] = False
        starts = np.flatnonzero(~joined[:-1] & joined[1:])
        ends = np.flatnonzero(joined[:-1] & ~joined[1:]) + 1
        ids = self.ids.astype(np.int32)
        raw = ids.tobytes()
        found = Counter([raw[a:z] for a, z in zip((4 * starts).tolist(), (4 * ends).tolist())])
        out = {tuple(memoryview(k).cast("i").tolist()): n for k, n in found.items()}
        inside = joined[:-1] | joined[1:]
        alone = np.bincount(self.ids[good & ~inside], minlength=words)
        return out | {(k,): n for k, n in zip(np.flatnonzero(alone).tolist(), alone[alone > 0].tolist())}


class Automaton:
    """A generalised suffix automaton of sequences with weights. A state's count is that of the end positions of its strings."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.length, self.link, self.count = [0], [-1], [0]

    def _state(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that end in one of p's and c, and for shorter ones."""
        step, link = self.step, self.link
        new = self._state(self.length[p] + 1, link[q], step[q].copy())
        link[q] = new
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = new
            p = link[p]
        return new

    def add(self, sequence: tuple[int, ...], weight: int) -> None:
        step, length, link, count = self.step, self.length, self.link, self.count
        at = 0
        for c in sequence:
            q = step[at].get(c)
            if q is not None:
                at = q if length[q] == length[at] + 1 else self._split(at, c, q)
            else:
                p, at = at, self._state(length[at] + 1, 0, {})
                while p >= 0 and c not in step[p]:
                    step[p][c] = at
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[at] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            count[at] += weight

    def counted(self) -> None:
        """Hands counts on along the suffix links, longest states first."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def phrases(self, words: list[bytes | None], most: int = WORDS) -> tuple[list[bytes], list[int]]:
        """All sequences of up to `most` words, space-joined, and their counts."""
        step, count, out, counts = self.step, self.count, [], []
        ready = [(words[c], q, 1) for c, q in step[0].items()]
        while ready:
            phrase, q, k = ready.pop()
            out.append(phrase)
            counts.append(count[q])
            if k < most:
                ready.extend([(phrase + b" " + words[c], r, k + 1) for c, r in step[q].items()])
        return out, counts


def _chunks(ranges: int):
    """Shards -> for each range of hashes that a shard has some in: range, shard, the low bytes of the hashes in their order, and counts
    up to LEAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, lang, size, text in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3)):
                s = Shard(lang, pa.decompress(text.as_py(), size, "zstd", asbytes=True))
                hashes, n = s.hashes[s.order], s.occurrences[s.order]
                of = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist()
                low = hashes.view(np.uint8).reshape(-1, 8)[:, :HASH]
                rows = [(int(of[a]), key, low[a:z].tobytes(), n[a:z].tobytes()) for a, z in zip(cuts, cuts[1:])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "shard", "hashes", "n"])

    return run


def _decided(chunks: pa.Table) -> pa.Table:
    """The chunks of one range -> range, shard and a bit for each of its hashes: whether all shards together have LEAST."""
    each = [np.frombuffer(x.as_py(), np.uint8) for x in chunks.column("n")]
    n = np.concatenate(each)
    whole = np.zeros((len(n), 8), np.uint8)
    whole[:, :HASH] = np.frombuffer(b"".join(chunks.column("hashes").to_pylist()), np.uint8).reshape(-1, HASH)
    found, of = np.unique(whole.view("<u8").ravel(), return_inverse=True)
    frequent = (np.bincount(of, n, len(found)) >= LEAST)[of]
    cuts = np.cumsum([0, *map(len, each)]).tolist()
    bits = pa.array([np.packbits(frequent[a:z]).tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary())
    return pa.Table.from_arrays([chunks.column("range"), chunks.column("shard"), pa.array([len(x) for x in each], pa.int64()), bits], ["range", "shard", "size", "bits"])


def _enumerated(ranges: int):
    """A shard and its bits -> range, lang, phrases (in order, one a line) and n (their occurrences in the shard). The empty phrase
    has all words."""
    names, types = ["range", "lang", "phrases", "n"], (pa.int64(), pa.string(), pa.binary(), pa.binary())

    def run(text: pa.Table, bits: pa.Table) -> pa.Table:
        if not text.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names)
        lang, size, packed = (text.column(c)[0].as_py() for c in ("lang", "size", "text"))
        s = Shard(lang, pa.decompress(packed, size, "zstd", asbytes=True))
        frequent = np.zeros(len(s.order), bool)
        if bits.num_rows:
            bits = bits.sort_by("range")
            got = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n).astype(bool) for x, n in zip(bits.column("bits"), bits.column("size").to_pylist())]
            frequent[s.order] = np.concatenate(got)
        automaton = Automaton()
        for part, n in s.parts(frequent).items():
            automaton.add(part, n)
        automaton.counted()
        words: list[bytes | None] = [None] * len(s.counts)
        for c in automaton.step[0]:
            words[c] = s.word(c)
        dealt: dict[int, list[tuple[bytes, int]]] = {crc32(b"") % ranges: [(b"", len(s.ids))]}
        for x in zip(*automaton.phrases(words)):
            dealt.setdefault(crc32(x[0]) % ranges, []).append(x)
        rows = []
        for k, found in dealt.items():
            phrases, counts = zip(*sorted(found))
            rows.append((k, lang, b"\n".join(phrases), np.array(counts, np.int64).tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _summed(chunks: pa.Table) -> pa.Table:
    """The chunks of one range and language -> lang, phrase and f, of phrases with LEAST occurrences and of the empty one."""
    phrases = [pa.array(x.as_py().split(b"\n"), pa.binary()) for x in chunks.column("phrases")]
    n = pa.array(np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in chunks.column("n")]))
    found = pa.table({"phrase": pa.chunked_array(phrases), "n": n}).group_by("phrase").aggregate([("n", "sum")])
    found = found.filter(pc.or_(pc.greater_equal(found["n_sum"], LEAST), pc.equal(found["phrase"], b"")))
    lang = pa.array([chunks.column("lang")[0].as_py()] * found.num_rows, pa.string())
    return pa.table({"lang": lang, "phrase": found["phrase"].cast(pa.string()), "f": found["n_sum"]})


def frequencies(docs: DataFrame, shard: int = SHARD, span: int = RANGE) -> DataFrame:
    """lang, phrase, k, f: the phrases of 1 to WORDS words that occur LEAST times or more in pieces of a language's texts, and for
    the empty phrase (k = 0) the number of its words. Texts pass through the shared folder once and are shuffled once."""
    stored = kept(shards(docs, shard), "shards")
    size = stored.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, -(-size // span))
    chunks = stored.mapInArrow(_chunks(ranges), "range bigint, shard bigint, hashes binary, n binary")
    bits = chunks.groupBy("range").applyInArrow(_decided, "range bigint, shard bigint, size bigint, bits binary")
    each = stored.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(_enumerated(ranges), "range bigint, lang string, phrases binary, n binary")
    found = each.groupBy("range", "lang").applyInArrow(_summed, "lang string, phrase string, f bigint")
    k = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1)
    return found.withColumn("k", k).select("lang", "phrase", "k", "f")


def _side(phrase: str, n: Column) -> Column:
    """The first n words of a phrase, or the last -n."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), n)


def candidates(counted: DataFrame) -> DataFrame:
    """frequencies() -> lang, phrase, k, a, l, r, score of every phrase of two words or more: those of the cut that scores lowest,
    ties (as rounded down) to the first one. Products are decimals of 38 digits."""
    several = counted.where("k >= 2").withColumnRenamed("f", "a")
    cut = several.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = cut.withColumns({"left": _side("phrase", F.col("at")), "right": _side("phrase", F.col("at") - F.col("k"))})
    of = counted.where("k >= 1")
    both = sides.join(of.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(of.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * a div (CAST(l AS DECIMAL(20, 0)) + r)")
    least = both.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("x"))
    return least.select("lang", "phrase", "k", "a", "x.l", "x.r", "x.score")


def subsumed(found: DataFrame) -> DataFrame:
    """lang, phrase of the candidates that stand in a longer one with at least SHARE percent of their occurrences. Every part of
    two words or more of a longer one is a suffix, along its suffix links, of one of its prefixes; each gets the largest number."""
    longer = found.where("k >= 3").select("lang", F.col("phrase").alias("whole"), "k", F.col("a").alias("more"))
    prefixes = longer.withColumn("end", F.explode(F.sequence(F.lit(2), F.col("k")))).withColumn("prefix", _side("whole", F.col("end")))
    links = prefixes.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("end")))).where("n < k")
    most = links.groupBy("lang", _side("prefix", -F.col("n")).alias("phrase")).agg(F.max("more").alias("more"))
    return found.join(most, ["lang", "phrase"]).where(f"CAST(100 AS DECIMAL(20, 0)) * more >= CAST({SHARE} AS DECIMAL(20, 0)) * a").select("lang", "phrase")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """docs (text, lang, ...) -> lang, rank, phrase, a, l, r, n, score: each language's first `top` candidates by score and a, both
    descending, then phrase in the order of its bytes.

    Null texts have no words, a null lang is `und`. Repeated rows count each time, other columns are ignored, an empty table gives
    one. A language's candidates are ranked in parts first, so that a task gets at most 64 times `top` of them.
    """
    with swept(docs.sparkSession) as outliving:
        counted = kept(frequencies(docs), "counted")
        found = kept(candidates(counted), "candidates")
        left = found.join(subsumed(found), ["lang", "phrase"], "left_anti")
        order = "ORDER BY score DESC, a DESC, phrase"
        some = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).where("a > 0").withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, part {order})")).where(F.col("place") <= top)
        ranked = some.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("bigint")).where(F.col("rank") <= top)
        words = counted.where("k = 0").select("lang", F.col("f").alias("n"))
        return outliving(ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")


SQL = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, {WORDS + 1}) s(k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
words AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= {LEAST}),
cut AS (SELECT c.*, j, array_to_string(w[1 : j], ' ') AS lp, array_to_string(w[j + 1 :], ' ') AS rp FROM c, range(1, {WORDS}) s(j) WHERE j < k),
scored AS (SELECT cut.lang, cut.phrase, cut.k, a, j, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = lp JOIN f r ON r.lang = cut.lang AND r.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i : i + n - 1], ' ') AS phrase, max(a) AS more FROM c, range(1, {WORDS}) s(i), range(2, {WORDS}) t(n) WHERE n < k AND i + n - 1 <= k GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE more IS NULL OR 100 * more < {SHARE} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept) JOIN (SELECT lang, CAST(n AS BIGINT) AS n FROM words) USING (lang) WHERE rank <= {TOP}"""
