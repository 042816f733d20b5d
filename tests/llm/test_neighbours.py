"""NN-descent against all pairs."""

import math

import numpy as np
import pytest

from tests.compare import SMALL, difference
from tickloom.llm import neighbours
from tickloom.llm.queries import QUERIES, SQL


def plain(rows):
    """(vec_id, links, component, kept) of each row by comparing all."""
    good = [i for i, (_, x) in enumerate(rows) if x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    near = [[] for _ in rows]
    for size in {len(rows[i][1]) for i in good}:
        mine = [i for i in good if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in mine], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a in range(0, len(mine), 1000):
            for i, j in np.argwhere(x[a : a + 1000] @ x.T >= 0.95):
                if a + i != j:
                    near[mine[a + i]].append(mine[j])
    seen, out = set(), {}
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = [j for j in near[todo.pop()] if j not in group]
                group.update(new)
                todo += new
            seen |= group
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            out |= dict.fromkeys(group, least)
    return sorted([(k, len(near[i]), out[i], k is not None and k == out[i]) for i, (k, _) in enumerate(rows)], key=str)


def got(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect()], key=str)


def around(r, center, n, spread):
    return [(center + spread * r.standard_normal(len(center)) / math.sqrt(len(center))).tolist() for _ in range(n)]


def test_clusters_of_all_kinds(spark):
    """Tight ones, ones about the threshold, chains, a large one of which many pairs aren't linked, and noise."""
    r = np.random.default_rng(5)
    some = [r.standard_normal(32) for _ in range(60)]
    some = [x / np.linalg.norm(x) for x in some]
    vectors = [x for k, c in enumerate(some[:40]) for x in around(r, c, 2 + k % 9, 0.1 + 0.03 * (k % 8))]
    vectors += around(r, some[50], 900, 0.08) + around(r, some[51], 150, 0.22)
    vectors += [(math.cos(t) * some[52] + math.sin(t) * some[53]).tolist() for t in np.arange(0, 3, 0.2)]
    vectors += r.standard_normal((2500, 32)).tolist()
    vectors += [vectors[0]] * 300 + [(2 * np.array(vectors[1])).tolist()] * 2
    rows = [(int(k), x) for k, x in zip(r.permutation(len(vectors)), vectors)]
    have, want = got(spark, rows), plain(rows)
    assert sum(w[1] for w in want) > 800_000
    assert sum(h[1] for h in have) >= 0.995 * sum(w[1] for w in want) and all(h[1] <= w[1] for h, w in zip(have, want))
    assert np.mean([h == w for h, w in zip(have, want)]) > 0.97


def test_capsules_and_lists_grow_without_loss(spark, monkeypatch):
    """A group of 120 whose vectors are too far from each other for capsules, and all linked: lists are enlarged."""
    r = np.random.default_rng(8)
    c = r.standard_normal(48)
    rows = list(enumerate(around(r, c / np.linalg.norm(c), 120, 0.2) + r.standard_normal((300, 48)).tolist()))
    want = plain(rows)
    assert sum(w[1] > 60 for w in want) > 100
    assert got(spark, rows) == want


def test_edges(spark):
    inf, nan = math.inf, math.nan
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1e300, 1e299]), (9, [1e-300, 0.0]), (None, [0.0, 1.0]), (10, [0.0, 2.0]), (None, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (3, [0.0, 0.0])]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []
    extra = spark.createDataFrame([(1, [1.0, 2.0], 3, 4, 5), (2, [1.0, 2.0], 3, 4, 5)], "vec_id bigint, embedding array<float>, node int, vector int, good int")
    assert sorted(tuple(r) for r in neighbours.near_duplicates(extra).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("angle", [18.18, 18.2])
def test_threshold(spark, angle):
    t = math.radians(angle)
    rows = [(5, [1.0, 0.0]), (6, [math.cos(t), math.sin(t)])]
    assert [x[1] for x in got(spark, rows)] == [int(math.cos(t) >= 0.95)] * 2


def test_same_rows_as_sql(spark, duck):
    assert not difference(QUERIES["op13_neighbours"](spark, SMALL), duck, SQL["op13_neighbours"])
