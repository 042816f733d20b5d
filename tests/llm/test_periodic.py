"""Periodic runs against a plain search of every period."""

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import SMALL
from tickloom.llm import periodic
from tickloom.llm.queries import QUERIES, table


def period(words):
    """The smallest period, by the table of borders."""
    border, k = [0] * len(words), 0
    for j in range(1, len(words)):
        while k and words[j] != words[k]:
            k = border[k - 1]
        k += words[j] == words[k]
        border[j] = k
    return len(words) - border[-1]


def plain(words):
    """Every maximal stretch of every period, kept if it is long enough and has no smaller one."""
    out = []
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(24, 3 * q) and period(words[start : i + q]) == q:
                out.append((start, i + q - start, q))
            i += 1
    return sorted(out)


@st.composite
def texts(draw):
    out = draw(st.lists(st.integers(0, draw(st.sampled_from([0, 1, 2, 40]))), max_size=120))
    for _ in range(draw(st.integers(0, 3))):
        a, p, n = (draw(st.integers(0, len(out))), draw(st.integers(1, 30)), draw(st.integers(0, 90)))
        part = out[a : a + p] or [0]
        out[a:a] = [part[i % len(part)] for i in range(n)]
    return out


@settings(max_examples=400, deadline=None)
@given(texts())
def test_runs_are_those_of_a_plain_search(words):
    assert periodic.runs_of(words) == plain(words)


@pytest.mark.parametrize(("n", "p", "found"), [(24, 8, True), (24, 9, False), (23, 1, False), (24, 1, True), (30, 10, True), (29, 10, False), (5000, 1, True), (5000, 1666, True), (5000, 1667, False)])
def test_edges_of_length_and_period(n, p, found):
    assert periodic.runs_of([i % p for i in range(n)]) == ([(0, n, p)] if found else [])


def test_overlapping_runs_and_multiples():
    words = ["a", "b"] * 15 + ["a", "c"] * 15 + [str(i) for i in range(40)] + ["x"] * 100
    assert periodic.runs_of(words) == plain(words) == [(0, 31, 2), (30, 30, 2), (100, 100, 1)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    """The whole query for one row, in loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(kept))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def order(row):
    return tuple((x is None, x or 0) for x in row[:1]), str(row)


def test_query_over_all_documents(spark):
    docs = table(spark, SMALL, "documents")
    got = [tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_periodic"](spark, SMALL).collect()]
    want = [expected(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(r[1] > 0 for r in want) > 5


def test_edges_of_rows(spark):
    ten = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    runs = "la " * 30 + "fin\x0b\x1c" + " x y" * 25
    rows = [(1, None), (1, None), (2, ""), (3, " \t\n"), (ten, None), (ten, ""), (ten, "one"), (ten, "a b c d e f g h " * 40), (None, runs), (4, runs), (4, runs), (5, "Ü " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, runs int, start string, n int")
    got = [tuple(r[c] for c in COLUMNS) for r in periodic.report(docs).collect()]
    short = [expected(i, t) for i, t in rows[:-1]]
    assert sorted(got, key=order) == sorted([*short, (5, 1, 0, 50_000, 1, 50_000_000, sha("0,50000,1\n"), sha("Ü"))], key=order)
    assert periodic.report(docs.limit(0)).collect() == []


def test_spans_and_texts_of_the_operator(spark):
    docs = spark.createDataFrame([(7, "start " + "one two three " * 9 + "end")], "doc_id bigint, text string")
    (row,) = periodic.collapsed(docs).collect()
    assert [tuple(r) for r in row.runs] == [(1, 27, 3)] and row.collapsed == "start one two three end"
