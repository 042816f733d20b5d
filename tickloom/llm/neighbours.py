"""Near-duplicate embeddings by NN-descent: a neighbour graph refined by comparing neighbours of a common neighbour.

Equal vectors are one node. Nodes within RADIUS of a leader form a capsule: any two of its members are linked, as angles obey the
triangle inequality, so a large group of near copies is some capsules instead of all its pairs. The graph's vertices are the
leaders. Its first lists come from blocks of vectors on the same sides of random hyperplanes; each round then compares the neighbours
(of both directions) of every vertex that got new ones. A list holds LIST entries; one that is full of leaders near enough for a link is
saturated and gets twice the room, as often as needed, so no link is cut off. Vertices of very many neighbours compare them in blocks
that are drawn anew each round. At the end a sample of leaders is compared with all; if a link is missing, further hyperplanes and
rounds follow.

Two capsules are linked as a whole if even their farthest members must be; else their members are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small, swept
from .components import stars

#: The least cosine of a link.
LEAST = 0.95
#: Entries of a list, vectors of a block of hyperplanes on average, members of a capsule or a block at most, and neighbours compared at once.
LIST, LEAF, BLOCK, JOINED = 10, 64, 1024, 64
#: Sets of hyperplanes of the first lists, rounds at most, and the share of new entries below which a graph is settled.
TREES, ROUNDS, SETTLED = 4, 8, 0.03
#: Leaders of the audit at most, the recall it asks for, and how often it may ask for more.
AUDIT, RECALL, AGAIN = 500, 0.995, 4
_REACH = math.acos(LEAST)
#: Below this angle to a common leader two vectors are linked. The margins are far above the error of an angle.
RADIUS, _MARGIN = (_REACH - 1e-6) / 2, 1e-6
_CAPSULE = "node bigint, unit binary, radius double, total bigint, members array<bigint>, weights array<bigint>, units binary"


def usable(vector: str) -> Column:
    """Whether it has a component, none is null or not finite, and not all are zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(finite & F.exists(x, lambda c: c != 0), F.lit(False))


def _planes(tree: int, bits: int, size: int) -> np.ndarray:
    return np.random.default_rng([tree, size]).standard_normal((bits, size))


def _units(b: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float64) for x in b.column(column).to_pylist()]


def nodes(rows: DataFrame) -> DataFrame:
    """rows (vec_id, vector of doubles), all usable -> node, vector, least (its smallest vec_id), weight (its rows) by distinct vector."""
    return rows.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")).withColumn("node", F.monotonically_increasing_id())


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, vector, weight -> node, unit, weight; scaled by the largest component first, so that no square overflows."""
    for b in batches:
        out = []
        for x in b.column(1):
            x = np.asarray(x.values.to_numpy(), np.float64)
            x = x / np.abs(x).max()
            out.append((x / np.sqrt(x @ x)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["node", "unit", "weight"])


def leaves(units: DataFrame, trees: range, n: int, most: int) -> DataFrame:
    """units (node, unit, ...) -> tree, leaf, part and units' columns: for each tree the sides of random hyperplanes, enough for LEAF
    vectors to a leaf on average; a leaf of more than `most` is dealt into parts. Vectors of different sizes share no leaf."""
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    names = units.columns
    at = names.index("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _units(b, at)
            sizes = np.array([len(u) for u in x])
            for tree in trees:
                leaf = np.zeros(len(x), np.int64)
                for size in np.unique(sizes):
                    mine = np.flatnonzero(sizes == size)
                    sides = np.stack([x[i] for i in mine]) @ _planes(tree, bits, int(size)).T > 0
                    leaf[mine] = sides @ (1 << np.arange(bits, dtype=np.int64)) + (int(size) << 44)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int64)), pa.array(leaf), *b.columns], ["tree", "leaf", *names])

    dealt = units.mapInArrow(run, f"tree bigint, leaf bigint, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in units.schema.fields)}")
    full = dealt.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    parts = dealt.join(full, ["tree", "leaf"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / (most // 2))), F.lit(0)))
    return parts.select("tree", "leaf", "part", *names)


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches of whole groups, and where these begin and end; rows come sorted by the first `keys` columns, whole numbers."""
    rest = None
    for b in batches:
        b = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for k in range(keys):
            x = b.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        rest = b.slice(starts[-1])
        if len(starts) > 1:
            yield b.slice(0, starts[-1]), list(zip(starts, starts[1:]))
    if rest is not None:
        yield rest, [(0, rest.num_rows)]


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tree, leaf, part, node, unit, weight -> capsules: the first vector left leads all within RADIUS of it."""
    for b, groups in _by_group(batches, 3):
        node, weight, units, rows = b.column(3).to_numpy(), b.column(5).to_numpy(), b.column(4).to_pylist(), []
        for start, end in groups:
            for a in range(start, end, BLOCK):
                z = min(a + BLOCK, end)
                x = np.frombuffer(b"".join(units[a:z]), np.float64).reshape(z - a, -1)
                cosines, left = x @ x.T, np.ones(z - a, bool)
                near = cosines >= math.cos(RADIUS)
                np.fill_diagonal(near, True)
                for i in range(z - a):
                    if left[i]:
                        own = np.flatnonzero(near[i] & left)
                        left[own] = False
                        apart = np.arccos(np.clip(cosines[i, own], -1, 1))
                        apart[own == i] = 0
                        rows.append((int(node[a + i]), units[a + i], float(apart.max()), int(weight[a + own].sum()), node[a + own].tolist(), weight[a + own].tolist(), b"".join([units[a + j] for j in own]) if len(own) > 1 else None))
        types = (pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["node", "unit", "radius", "total", "members", "weights", "units"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two key columns, part, node, unit, radius, worst, fresh -> v, u, cosine: for each vertex of a group those that are better than
    the worst of its list, up to LIST, and all near enough for a link. Of each two one must be fresh."""
    for b, groups in _by_group(batches, 3):
        node, radius, worst, fresh, units, out = b.column(3).to_numpy(), b.column(5).to_numpy(), b.column(6).to_numpy(), b.column(7).to_numpy(zero_copy_only=False), b.column(4).to_pylist(), []
        for start, end in groups:
            for a in range(start, end, BLOCK):
                z = min(a + BLOCK, end)
                x = np.frombuffer(b"".join(units[a:z]), np.float64).reshape(z - a, -1)
                cosines = x @ x.T
                np.fill_diagonal(cosines, -2)
                good = cosines > worst[a:z, None]
                if z - a > LIST + 1:
                    good &= cosines >= np.partition(cosines, -LIST, axis=1)[:, -LIST, None]
                r = radius[a:z]
                good |= cosines >= (np.cos(np.minimum(_REACH + r[:, None] + r + _MARGIN, math.pi)) if r.any() else LEAST)
                good &= fresh[a:z, None] | fresh[a:z]
                np.fill_diagonal(good, False)
                i, j = np.nonzero(good)
                out.append((node[a + i], node[a + j], cosines[i, j]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["v", "u", "cosine"])


_EDGES = "v bigint, u bigint, cosine double"


def near_enough(cosine: Column, one: Column, two: Column) -> Column:
    """Whether members of capsules of these radii may be linked, by their leaders' cosine."""
    return cosine >= F.cos(F.least(F.lit(_REACH + _MARGIN) + one + two, F.lit(math.pi)))


def merged(old: DataFrame | None, found: DataFrame, radii: DataFrame) -> DataFrame:
    """Lists (v, u, cosine, near, fresh) with what was found: the best of each, LIST of them or twice as many, as often doubled as the
    list is saturated, that is full of entries near enough for a link."""
    new = found.groupBy("v", "u").agg(F.max("cosine").alias("cosine"))
    one, two = (radii.select(F.col("node").alias(x), F.col("radius").alias(f"{x}_radius")) for x in "vu")
    near = near_enough(F.col("cosine"), F.col("v_radius"), F.col("u_radius"))
    each = new.join(one, "v").join(two, "u").select("v", "u", "cosine", near.alias("near"), F.lit(True).alias("fresh"))
    if old is not None:
        both = old.withColumn("fresh", F.lit(False)).unionByName(each)
        each = both.groupBy("v", "u").agg(F.max("cosine").alias("cosine"), F.bool_or("near").alias("near"), F.bool_and("fresh").alias("fresh"))
    links = F.expr("count_if(near) OVER (PARTITION BY v)")
    room = LIST * F.pow(F.lit(2), F.greatest(F.ceil(F.log2((links + 1) / LIST)), F.lit(0)))
    return each.withColumns({"room": room, "place": F.expr("row_number() OVER (PARTITION BY v ORDER BY cosine DESC, u)")}).where("place <= room").select("v", "u", "cosine", "near", "fresh")


def _state(capsules: DataFrame, lists: DataFrame | None) -> DataFrame:
    """node, unit, radius, worst: the cosine that an entry must pass to get into the node's list; -2 where there is room."""
    own = capsules.select("node", "unit", "radius")
    if lists is None:
        return own.withColumn("worst", F.lit(-2.0))
    worst = lists.groupBy(F.col("v").alias("node")).agg(F.when(F.count(F.lit(1)) >= LIST, F.min("cosine")).alias("worst"))
    return own.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0)))


def _sorted(groups: DataFrame, keys: list[str]) -> DataFrame:
    return groups.repartition(*keys).sortWithinPartitions(*keys)


def in_leaves(capsules: DataFrame, lists: DataFrame | None, trees: range, n: int) -> DataFrame:
    """What blocks of hyperplanes find for the lists."""
    blocks = leaves(_state(capsules, lists), trees, n, BLOCK).withColumn("fresh", F.lit(True))
    return _sorted(blocks, ["tree", "leaf", "part"]).mapInArrow(_compared, _EDGES)


def in_neighbourhoods(capsules: DataFrame, lists: DataFrame, turn: int) -> DataFrame:
    """What a vertex and its neighbours find in each other: lists joined to lists by the vertex in the middle, both directions. Only
    vertices with a fresh entry take part; more than JOINED neighbours meet in parts, drawn by turn."""
    ways = lists.select(F.col("v").alias("middle"), F.col("u").alias("node"), "fresh").union(lists.select("u", "v", "fresh")).union(lists.select("v", "v", F.lit(False)))
    each = ways.groupBy("middle", "node").agg(F.bool_or("fresh").alias("fresh"))
    sizes = each.groupBy("middle").agg(F.count(F.lit(1)).alias("n"), F.bool_or("fresh").alias("any")).where("any").select("middle", "n")
    parts = F.when(F.col("n") > JOINED, F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / (JOINED // 2)))).otherwise(0)
    dealt = each.join(sizes, "middle").select("middle", F.lit(0).cast("bigint").alias("none"), parts.alias("part"), "node", "fresh")
    groups = dealt.join(_state(capsules, lists), "node").select("middle", "none", "part", "node", "unit", "radius", "worst", "fresh")
    return _sorted(groups, ["middle", "none", "part"]).mapInArrow(_compared, _EDGES)


def audit(capsules: DataFrame, lists: DataFrame, turn: int) -> float:
    """The share of links that the lists have, of those of up to AUDIT leaders, half of them with a link, with all others."""
    order = F.xxhash64("node", F.lit(turn))
    linked = lists.where("near").select(F.col("v").alias("node")).distinct()
    half = capsules.select("node", "unit", "radius").join(linked, "node").orderBy(order).limit(AUDIT // 2)
    rest = capsules.select("node", "unit", "radius").join(linked, "node", "left_anti").orderBy(order).limit(AUDIT // 2)
    asked = [(r.node, np.frombuffer(r.unit, np.float64), r.radius) for r in half.union(rest).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, radius, x, out = b.column(0).to_numpy(), b.column(2).to_numpy(), _units(b, 1), []
            sizes = np.array([len(u) for u in x])
            for size in np.unique(sizes):
                mine, some = np.flatnonzero(sizes == size), [q for q in asked if len(q[1]) == size]
                if some:
                    cosines = np.stack([x[i] for i in mine]) @ np.stack([q[1] for q in some]).T
                    reach = np.cos(np.minimum(_REACH + radius[mine, None] + np.array([q[2] for q in some]), math.pi))
                    i, j = np.nonzero(cosines >= reach)
                    out += [(some[k][0], int(node[mine[m]])) for m, k in zip(i.tolist(), j.tolist()) if some[k][0] != node[mine[m]]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["v", "u"])

    true = capsules.select("node", "unit", "radius").mapInArrow(run, "v bigint, u bigint")
    ways = lists.where("near").select("v", "u").union(lists.where("near").select("u", "v")).distinct().withColumn("found", F.lit(1))
    got = true.join(ways, ["v", "u"], "left").agg(F.count(F.lit(1)).alias("n"), F.count("found").alias("found")).first()
    return got.found / got.n if got.n else 1.0


def graph(capsules: DataFrame, trees: int = TREES, rounds: int = ROUNDS) -> DataFrame:
    """capsules -> v, u, cosine, near, fresh: the settled lists of their leaders."""
    n, radii, turn = capsules.count(), capsules.select("node", "radius"), 0
    lists = None
    for again in range(1 + AGAIN):
        found = in_leaves(capsules, lists, range(again * trees + 1, (again + 1) * trees + 1), n)
        lists = kept(merged(lists, found, radii), "lists")
        for _ in range(rounds):
            turn += 1
            lists = kept(merged(lists, in_neighbourhoods(capsules, lists, turn), radii), "lists")
            share = lists.agg(F.avg(F.col("fresh").cast("int"))).first()[0] or 0.0
            if share <= SETTLED:
                break
        if audit(capsules, lists, again) >= RECALL:
            break
    return lists


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two capsules a row (v, u, then members, weights and units of each) -> node, n, v, u: the links of each member with the other
    capsule's, and one row for the pair (without a node) if there is any."""
    for b in batches:
        out = []
        cells = [b.column(k).to_pylist() for k in range(8)]
        for v, u, mv, wv, xv, mu, wu, xu in zip(*cells):
            x, y = (np.frombuffer(units, np.float64).reshape(len(m), -1) for units, m in ((xv, mv), (xu, mu)))
            linked = x @ y.T >= LEAST
            if linked.any():
                out.append((None, 0, v, u))
                out += [(m, int(k), None, None) for m, k in zip(mv, linked @ np.array(wu)) if k]
                out += [(m, int(k), None, None) for m, k in zip(mu, np.array(wv) @ linked) if k]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["node", "n", "v", "u"])


def near_duplicates(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept: how many other rows have a cosine of LEAST or more, the
    smallest vec_id reachable by such links (its own included), and whether that is the row's own.

    Null and empty vectors, zeros, and those with a null or non-finite component link with nothing, nor do vectors of different
    sizes. Repeated rows are rows of their own, linked to each other. A null vec_id isn't reachable by number: such a row's
    component is that of its neighbours, null without any, and it is never kept. Other columns are ignored; an empty table gives one.
    """
    spark = rows.sparkSession
    with swept(spark) as outliving:
        asked = rows.select("vec_id", F.col(f"`{vector}`").cast("array<double>").alias("vector"))
        stored = kept(asked.withColumn("good", usable("vector")), "rows")
        distinct = kept(nodes(stored.where("good")), "nodes")
        units = kept(distinct.select("node", "vector", "weight").mapInArrow(_unit, "node bigint, unit binary, weight bigint"), "units")
        blocks = _sorted(leaves(units, range(1), units.count(), BLOCK), ["tree", "leaf", "part"])
        capsules = kept(blocks.mapInArrow(_leaders, _CAPSULE), "capsules")
        lists = graph(capsules)
        pairs = kept(lists.where("near").groupBy(F.least("v", "u").alias("v"), F.greatest("v", "u").alias("u")).agg(F.max("cosine").alias("cosine")), "pairs")
        of = {x: capsules.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("radius", "total")]) for x in "vu"}
        both = pairs.join(of["v"], "v").join(of["u"], "u")
        sure = F.acos(F.least("cosine", F.lit(1.0))) + F.col("v_radius") + F.col("u_radius") <= _REACH - _MARGIN
        told = kept(both.withColumn("sure", sure), "told")
        whole = told.where("sure")
        bulk = whole.select(F.col("v").alias("leader"), F.col("u_total").alias("n")).union(whole.select("u", "v_total")).groupBy("leader").agg(F.sum("n").alias("bulk"))
        inner = {x: capsules.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("members", "weights")], F.coalesce("units", "unit").alias(f"{x}_units")) for x in "vu"}
        doubtful = told.where("NOT sure").select("v", "u").join(inner["v"], "v").join(inner["u"], "u").select("v", "u", "v_members", "v_weights", "v_units", "u_members", "u_weights", "u_units")
        checked = kept(doubtful.mapInArrow(_members, "node bigint, n bigint, v bigint, u bigint"), "checked")
        single = checked.where("node IS NOT NULL").groupBy("node").agg(F.sum("n").alias("single"))
        edges = whole.select(F.col("u").alias("child"), F.col("v").alias("parent")).union(checked.where("node IS NULL").select("u", "v"))
        roots = stars(edges).withColumnsRenamed({"child": "leader", "parent": "root"})
        inside = capsules.select(F.col("node").alias("leader"), "total", F.explode("members").alias("node"))
        n = F.col("total") - 1 + F.coalesce("bulk", F.lit(0)) + F.coalesce("single", F.lit(0))
        linked = inside.join(bulk, "leader", "left").join(roots, "leader", "left").join(single, "node", "left").select("node", n.alias("n_links"), F.coalesce("root", "leader").alias("root"))
        each = kept(linked.join(distinct, "node").select("vector", "n_links", "root", "least"), "linked")
        least = each.groupBy("root").agg(F.min("least").alias("component_id"))
        named = each.join(least, "root").select("vector", "n_links", "component_id", F.lit(True).alias("good"))
        out = stored.join(named, ["vector", "good"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
        return outliving(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near")


SQL = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.i, b.i AS j FROM good a JOIN good b ON a.i <> b.i AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {LEAST}),
r AS (SELECT i, i AS j FROM v UNION SELECT r.i, e.j FROM r JOIN e ON e.i = r.j),
c AS (SELECT r.i, min(v.vec_id) AS component_id FROM r JOIN v ON v.i = r.j GROUP BY 1), n AS (SELECT i, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (i) LEFT JOIN n USING (i)"""
