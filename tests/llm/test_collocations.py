"""Collocations against SQL, and against counts and cuts in plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import SMALL
from tickloom.llm import collocations
from tickloom.llm.queries import table


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows):
    """By language, all phrases of up to four words within pieces; '' has all words."""
    out = {}
    for lang, text in rows:
        f = out.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n-\r]", lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            f[""] += len(words)
            f.update(" ".join(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    return out


def plain(rows, top=2000):
    out = []
    for lang, f in plain_counts(rows).items():
        found = {p: n for p, n in f.items() if " " in p and n >= 30}
        gone = set()
        for p, n in found.items():
            w = p.split(" ")
            gone |= {q for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * n >= 80 * found[q := " ".join(w[i : i + k])]}
        scored = []
        for p, a in found.items():
            if p not in gone:
                w = p.split(" ")
                cuts = [(2_000_000 * a // (f[" ".join(w[:j])] + f[" ".join(w[j:])]), j, f[" ".join(w[:j])], f[" ".join(w[j:])]) for j in range(1, len(w))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, p.encode(), left, right))
        out += [(lang, k, p.decode(), -a, x, y, f[""], -s) for k, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 5)), max_size=12))
def test_counts_of_the_automaton(parts):
    a, want = collocations.Automaton(), Counter()
    for part, weight in parts:
        a.add(tuple(part), weight)
        for k in range(1, 5):
            for i in range(len(part) - k + 1):
                want[" ".join(map(str, part[i : i + k]))] += weight
    a.counted()
    phrases, counts = a.phrases([b"0", b"1", b"2", b"3"])
    assert dict(zip([p.decode() for p in phrases], counts)) == want and len(phrases) == len(want)


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    text = b"one two three four\nsix two one three eleven twelvehundredandninety twelvehundredandninety-one\n\n one two"
    want = collocations.Shard("en", text)
    monkeypatch.setattr(collocations.Shard, "_hashes", lambda self: setattr(self, "_padded", self.text + bytes(8)) or np.zeros(len(self.starts), np.uint64))
    same = collocations.Shard("en", text)

    def parts(s):
        return {tuple(map(s.word, k)): n for k, n in s.parts(np.ones(len(s.hashes), bool)).items()}

    assert parts(same) == parts(want) and len(same.counts) == 8 and len(parts(want)) == 3


def test_many_shards_and_ranges_agree_with_plain_counts(spark):
    rows = [(r.lang, r.text) for r in table(spark, SMALL, "documents").select("lang", "text").collect()]
    want = {(lang, p): n for lang, f in plain_counts(rows).items() for p, n in f.items() if p == "" or n >= 30}
    docs = table(spark, SMALL, "documents").repartition(3)
    few = {(r.lang, r.phrase): r.f for r in collocations.frequencies(docs, shard=3000, span=20_000).collect()}
    assert few == want and collocations.shards(docs, 3000).where("size > 6500").count() < 20


def test_edges(spark):
    r = random.Random(3)
    vocabulary = ["Ünder", "the", "THE", "a b", "x\x00", "né", "of", "of\x1c"]
    rows = [("en", " ".join(r.choice(vocabulary) for _ in range(400)) + r.choice([".", "", "\t", "!? "])) for _ in range(30)]
    rows += [("fr", "un deux\ntrois, quatre\rcinq six "), (None, "null lang  here\t")] * 40 + [("und", "null lang"), (None, None), ("de", None), ("es", ""), ("it", " ,;. ")]
    rows += [("en", "long word " + "y" * 70_000 + " long word " * 50)]
    docs = spark.createDataFrame([(t, lang, 1, 2, "k") for lang, t in rows], "text string, lang string, phrase int, rank int, f string")
    assert got(collocations.collocations(docs)) == plain(rows)
    assert got(collocations.collocations(docs, top=3)) == plain(rows, 3)
    assert got(collocations.collocations(docs.limit(0))) == []


@pytest.mark.parametrize(("a", "l", "r"), [(3 * 10**13, 4 * 10**13, 10**14), (9 * 10**17, 9 * 10**17, 10**18)])
def test_products_beyond_64_bits(spark, a, l, r):  # noqa: E741
    rows = [("en", "u v", 2, a), ("en", "u", 1, l), ("en", "v", 1, r), ("en", "", 0, r)]
    (row,) = collocations.candidates(spark.createDataFrame(rows, "lang string, phrase string, k int, f bigint")).collect()
    assert (row.l, row.r, row.score) == (l, r, 2_000_000 * a // (l + r))
