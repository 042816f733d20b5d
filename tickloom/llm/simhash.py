"""SimHash near-duplicates: fingerprints, a positional inverted index with count filtering, and components.

A fingerprint has 8 bytes. Two fingerprints with at most 4 differing bits agree in at least 4 of the 8 byte positions,
so a pair is worth verifying only if it shares 4 positional bytes. Lists of a single positional byte would have only
256 values and grow with the square of the corpus; the index therefore keys its lists by 3 positional bytes at once.
It needs 20 of the 56 triples of positions: any 4 positions contain one of them. Within a list, postings of the other
positions' bytes tally what a pair shares beyond the key. A list of over LONG members is split by a fourth byte, one that is
still longer into blocks of which each two meet in a task; two blocks that are too long together are split again, until all are
compared. So no task holds more than LONG members of a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, per_text, row_of, small, swept, words
from .components import stars

SHINGLE, SEED, MOST_BITS, POSITIONS = 4, 42, 4, 8
#: Positions in which a linked pair must agree.
LEAST_SHARED = POSITIONS - MOST_BITS
#: Members of a list that a task compares.
LONG = 16_384
#: Hashes counted at a time; bounds the memory for a very long text.
AT_ONCE = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1).astype(np.int64)
_OFFSETS = np.arange(POSITIONS, dtype=np.int64) * 256


def triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions such that any 4 positions contain one: with the positions in three classes, those
    within a class and those with two of one class and one of the next."""
    kind = [0, 0, 0, 1, 1, 1, 2, 2]
    return [t for t in combinations(range(POSITIONS), 3) if any([kind[p] for p in t].count(k) + 2 * ([kind[p] for p in t].count((k + 1) % 3)) in (3, 4) and [kind[p] for p in t].count(k) >= 2 for k in range(3))]


def fingerprint(text: bytes | None) -> int:
    """The 64-bit SimHash of a text as a signed integer; 0 if there is no word.

    Words are lower-cased in A-Z only; shingles of 4 words with repeats, or the whole sequence if there are fewer.
    A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).
    """
    found = words(text.lower()) if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts, digest = np.zeros(256 * POSITIONS, np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), AT_ONCE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE])])
        bytes_ = np.frombuffer(hashes, np.uint8).reshape(-1, POSITIONS)
        counts += np.bincount((bytes_ + _OFFSETS).ravel(), minlength=256 * POSITIONS)
    ones = np.einsum("pv,vb->pb", counts.reshape(POSITIONS, 256), _BITS).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _bytes(positions: tuple[int, ...]) -> Column:
    """fp's bytes in these positions, one after another."""
    out = F.lit(0).cast("bigint")
    for p in positions:
        out = F.shiftleft(out, 8) + F.shiftright("fp", 56 - 8 * p).bitwiseAND(F.lit(255))
    return out


def postings(prints: DataFrame) -> DataFrame:
    """prints (fp) -> (key, fp): one row for each of the 20 triples of positions; key holds the triple's number and its three bytes."""
    return prints.select(F.explode(F.array(*[F.lit(n << 24) + _bytes(t) for n, t in enumerate(triples())])).alias("key"), "fp")


def by_fourth(lists: DataFrame) -> DataFrame:
    """The members of triples' lists (key, fp), by each fourth position as well. Pairs that share 4 bytes meet again; which of a
    set of four positions were the triple doesn't matter."""
    fours = list(combinations(range(POSITIONS), 4))

    def key(f: tuple[int, ...]) -> Column:
        return F.lit((1 << 60) + (fours.index(f) << 32)) + _bytes(f)

    keys = F.lit(None).cast("array<bigint>")
    for n, t in enumerate(triples()):
        keys = F.when(F.shiftright("key", 24) == n, F.array(*[key(tuple(sorted({*t, p}))) for p in range(POSITIONS) if p not in t])).otherwise(keys)
    return lists.select(F.explode(keys).alias("key"), "fp").distinct()


def in_blocks(lists: DataFrame, long: int, turn: int) -> DataFrame:
    """The members of lists (key, fp, n: its length) for each two blocks of a list, of 0.4 * long members each on average. With
    over `long` members there are three blocks at least, so each two members meet, and the next turn deals them otherwise."""
    blocks = F.ceil(F.col("n") / (0.4 * long)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(turn)), blocks).cast("int")
    mine = lists.select("key", "fp", own.alias("a"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("b")).where("a <> b")
    return mine.select(F.xxhash64("key", F.least("a", "b"), F.greatest("a", "b"), F.lit(turn)).alias("key"), "fp")


def shared(x: np.ndarray) -> np.ndarray:
    """How many bytes of each uint64 are zero: the tally of a pair's equal positional bytes, from their difference."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(~(((x & low) + low) | x | low))


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then verification, for pairs of uint64 fingerprints."""
    x = a ^ b
    passed = np.flatnonzero(shared(x) >= LEAST_SHARED)
    out = np.zeros(len(x), bool)
    out[passed] = np.bitwise_count(x[passed]) <= MOST_BITS
    return out


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """For one list of the index (int64 fingerprints): (child, parent), each child under the smallest member of its component
    within the list.

    The positions in which all members agree count for each pair; the postings of the others tally the rest. Where these hold
    more than the members not reached yet, all of those are tallied instead, so a dense group takes little.
    """
    fps = np.unique(fps)
    u, of = fps.view(np.uint64), fps.byteswap().view(np.uint8).reshape(-1, POSITIONS)
    free = np.flatnonzero((of != of[0]).any(axis=0))
    need = LEAST_SHARED - (POSITIONS - len(free))
    orders = [np.argsort(of[:, p], kind="stable") for p in free]
    starts = [np.searchsorted(of[o, p], np.arange(257)) for o, p in zip(orders, free)]
    alive, left, out = np.ones(len(fps), bool), np.arange(len(fps)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        alive[root], ready = False, [root]
        while ready and len(left):
            x = ready.pop()
            spans = [(o, s[v], s[v + 1]) for o, s, v in zip(orders, starts, of[x, free].tolist())]
            if need > 0 and sum(b - a for _, a, b in spans) < len(left):
                near, tally = np.unique(np.concatenate([o[a:b] for o, a, b in spans]), return_counts=True)
                near = near[(tally >= need) & alive[near]]
                near = near[np.bitwise_count(u[near] ^ u[x]) <= MOST_BITS]
            else:
                near = left[linked(u[left], u[x])]
            if len(near):
                ready.extend(near.tolist())
                out.extend((c, int(fps[root])) for c in fps[near].tolist())
                alive[near] = False
                left = left[alive[left]]
    return out


def _forests(long: int):
    """Sorted (key, fp) -> edges, and the keys and lengths of lists of over `long` members, which aren't compared. Lists of one
    are passed over, lists of two compared all at once."""
    names = ["child", "parent", "key", "n"]

    def edges(child: np.ndarray, parent: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(child), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent), none, none], names)

    def of(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = linked(a.view(np.uint64), b.view(np.uint64))
        child, parent = [np.maximum(a, b)[near]], [np.minimum(a, b)[near]]
        if found := [e for s, n in zip(starts[sizes > 2], sizes[sizes > 2]) for e in forest(fps[s : s + n])]:
            c, p = np.array(found, np.int64).T
            child.append(c)
            parent.append(p)
        return edges(np.concatenate(child), np.concatenate(parent))

    def over(key: int, n: int) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([key], pa.int64()), pa.array([n], pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, passed, n = np.zeros(0, np.int64), np.zeros(0, np.int64), None, 0
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if passed is not None:  # the rest of a long list is only counted
                rest = int(np.searchsorted(k, passed, "right"))
                n += rest
                k, f = k[rest:], f[rest:]
                if not len(k):
                    continue
                yield over(passed, n)
                passed = None
            keys, fps = np.concatenate((keys, k)), np.concatenate((fps, f))
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last list may go on in the next batch
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.append(starts, len(keys)))
            for s in starts[(sizes > long) & (starts < cut)]:
                yield over(int(keys[s]), int(sizes[starts == s][0]))
            good = np.repeat(sizes <= long, sizes)[:cut]
            if good.any():
                yield of(keys[:cut][good], fps[:cut][good])
            keys, fps = keys[cut:], fps[cut:]
            if len(keys) > long:
                passed, n = int(keys[0]), len(keys)
                keys, fps = keys[:0], fps[:0]
        if passed is not None:
            yield over(passed, n)
        elif len(keys):
            yield of(keys, fps)

    return run


def links(distinct: DataFrame, long: int = LONG) -> DataFrame:
    """distinct (fp) -> child, parent: links that join what is linked. Lists of over `long` members are few or none; their keys
    are joined to their members again, first by a fourth byte, then in pairs of blocks until no list is longer."""
    lists, whole, turn = postings(distinct), None, 0
    while True:
        found = kept(lists.repartition("key").sortWithinPartitions("key").mapInArrow(_forests(long), "child bigint, parent bigint, key bigint, n bigint"), "lists")
        edges = found.where("child IS NOT NULL").select("child", "parent")
        whole = edges if whole is None else whole.union(edges)
        over = found.where("key IS NOT NULL").select("key", "n")
        if not (n := over.count()):
            return whole
        members = lists.join(small(over, n), "key")
        lists = kept(in_blocks(members, long, turn) if turn else by_fourth(members), "long")
        turn += 1


def groups(prints: DataFrame, long: int = LONG) -> DataFrame:
    """prints (fp, ...), repeats allowed -> (fp, root) for each distinct fp; root is the smallest fp reachable by links of
    at most 4 bits. Equal fingerprints count once, so a group of copies adds one entry to a list. No fingerprints: no rows."""
    with swept(prints.sparkSession) as outliving:
        distinct = kept(prints.select("fp").distinct(), "distinct")
        found = kept(stars(links(distinct, long)).withColumnsRenamed({"child": "fp", "parent": "root"}), "roots")
        return outliving(distinct.join(found, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, fingerprint, component_id, and the digits' integer fp, for each row.

    component_id is the smallest doc_id of the component, null if all of its ids are null. Null and empty texts and
    texts of white space have fingerprint zero and are linked like any other. Repeated rows stay. Other columns are ignored.
    """
    prints = kept(per_text(docs.select("doc_id", "text"), "fp bigint", lambda: lambda t: (fingerprint(t),)), "prints")
    with swept(docs.sparkSession) as outliving:
        least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        each = kept(groups(prints).join(least, "fp"), "each")
        of = each.groupBy("root").agg(F.min("least").alias("component_id"))
        named = outliving(each.join(of, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id (nulls last; of rows
    that share it, one). Columns as in docs; a null or empty text is near all other such texts. An empty table gives one.

    The rows that go are found by number, and taken away: as few of them are counted, they are broadcast or joined by shuffle.
    """
    taken = docs.select(row_of(docs), F.col("text"), F.monotonically_increasing_id().alias("n"))
    stored = kept(per_text(taken, "fp bigint", lambda: lambda t: (fingerprint(t),)), "tagged")
    with swept(docs.sparkSession) as outliving:
        ids = stored.select("fp", "n", F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), "n").alias("who"))
        first = ids.groupBy("fp").agg(F.min("who").alias("who"))
        each = kept(groups(ids).join(first, "fp"), "each")
        winners = each.groupBy("root").agg(F.min("who").alias("first"))
        winner = each.join(winners, "root").select("fp", F.col("first.n").alias("first"))
        losers = outliving(ids.select("fp", "n").join(winner, "fp").where("n <> first").select("n"), "losers")
    return stored.join(small(losers, losers.count()), "n", "left_anti").select("row.*")
