"""The text operators against SQL, brute force, the libraries, exact round trips and held-out accuracy."""

import functools
import gzip
import hashlib
import math
import random
import re
import threading
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tests.compare import SMALL, difference
from tickloom.llm import common, langid, linededup, media, mixing, quality, queries, simhash, spm, tokencount, toxicity, warc

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return queries.table(spark, SMALL, "documents")


@pytest.fixture(scope="module")
def rows(documents):
    return documents.orderBy("doc_id").collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert not difference(queries.QUERIES[name](spark, SMALL), duck, queries.SQL[name])


# near-duplicates


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Least id of each row's component by comparing all pairs."""
    at = {f: f for f in set(prints.values())}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    every = sorted(at)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                at[root(a)] = root(b)
    least = {}
    for k, f in prints.items():
        least[root(f)] = min(k, least.get(root(f), k))
    return {k: least[root(f)] for k, f in prints.items()}


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_near_duplicates_are_those_of_all_pairs(spark, folder):
    prints = {r.doc_id: plain_fingerprint(r.text) for r in queries.table(spark, folder, "documents").collect()}
    want = {k: (f"{prints[k]:016x}", c) for k, c in plain_groups(prints).items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op1_simhash"](spark, folder).collect()}
    assert got == want


def test_a_list_of_100_000_that_share_three_bytes(spark, monkeypatch):
    """No task compares more than a block pair, and links across blocks aren't lost: planted pairs, each 4 bits apart."""
    r = np.random.default_rng(1)
    low = np.unique(r.integers(0, 1 << 40, 99_000, np.int64))
    fps = (np.int64(0x123456) << np.int64(40)) | low
    flips = np.array([(1 << 3) | (1 << 12) | (1 << 21) | (1 << 35)], np.int64)
    fps = np.unique(np.concatenate((fps, fps[:500] ^ flips)))
    frame = spark.createDataFrame(pd.DataFrame({"fp": fps}))
    lists = simhash.postings(frame)
    assert lists.groupBy("key").count().where("count > 90000").count() == 1
    got = {x.fp: x.root for x in simhash.groups(frame).collect()}
    want = {int(a): int(b) for a, b in simhash.forest(fps)}
    assert len(want) >= 500 and got == {int(f): want.get(int(f), int(f)) for f in fps}


@pytest.mark.parametrize("long", [8, 16])
def test_long_lists_are_split_without_loss(spark, long):
    """With a small bound, a family whose members share most bytes goes through all ways of splitting, in several turns, against all
    pairs. The bound reaches the workers: lists are marked as over it."""
    r = random.Random(7)
    fps = {0x1122334455667788}
    while len(fps) < 150:
        f = r.choice(sorted(fps)) if r.random() < 0.7 else 0x1122334455667788
        for b in r.sample(range(32), r.choice((1, 3, 5, 7))):
            f ^= 1 << b
        fps.add(f)
    signed = {f: f - (f >> 63 << 64) for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed.values()], "fp bigint")
    found = simhash.postings(frame).repartition("key").sortWithinPartitions("key").mapInArrow(simhash._forests(long), "child bigint, parent bigint, key bigint, n bigint")
    assert {x.n for x in found.where("key IS NOT NULL").collect()} >= {150}
    fours = simhash.by_fourth(simhash.postings(frame).groupBy("key").agg(F.count("fp").alias("n")).where(f"n > {long}").join(simhash.postings(frame), "key"))
    assert fours.groupBy("key").count().where(f"count > {5 * long}").count() >= 1  # so blocks are needed
    got = {x.fp: x.root for x in simhash.groups(frame, long).collect()}
    want = plain_groups({f: f for f in fps})
    pairs = {(got[signed[f]], c) for f, c in want.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) > 1


def test_pairs_of_blocks_hold_every_pair_in_every_turn(spark):
    lists = spark.range(400).select(F.lit(5).cast("bigint").alias("key"), F.col("id").alias("fp"), F.lit(400).alias("n"))
    for turn in (1, 2):
        met = set()
        for x in simhash.in_blocks(lists, 100, turn).groupBy("key").agg(F.collect_list("fp").alias("fps")).collect():
            met |= {(a, b) for a in x.fps for b in x.fps}
        assert len(met) == 400 * 400


def test_a_list_of_81_920_that_shares_four_bytes_loses_no_link(spark):
    """The real bound, members told apart by one byte and parts of others, so that only blocks split them: planted pairs a few bits apart."""
    r = np.random.default_rng(4)
    low = np.unique(r.integers(0, 1 << 32, 82_400, np.int64))[:81_920]
    fps = (np.int64(0x12345678) << np.int64(32)) | low
    near = np.unique(np.concatenate((fps, fps[::400] ^ np.int64((1 << 3) | (1 << 12) | (1 << 21) | (1 << 28)))))
    got = {x.fp: x.root for x in simhash.groups(spark.createDataFrame(pd.DataFrame({"fp": near}))).collect()}
    assert all(got[a] == got[a ^ ((1 << 3) | (1 << 12) | (1 << 21) | (1 << 28))] for a in fps[::400].tolist())
    assert len(got) == len(near) and sum(f != r for f, r in got.items()) >= 205


def test_the_tally_counts_equal_bytes():
    x = np.random.default_rng(2).integers(0, 1 << 63, 5000, np.int64).view(np.uint64) & np.uint64(0xFF00FFFF00FF80FF)
    assert (simhash.shared(x) == [sum(b == 0 for b in int(v).to_bytes(8, "big")) for v in x]).all()


def test_any_four_positions_hold_a_triple():
    from itertools import combinations

    assert all(any(set(t) <= set(four) for t in simhash.triples()) for four in combinations(range(8), 4)) and len(simhash.triples()) == 20


def test_links_of_random_fingerprints_in_chains(spark):
    random.seed(3)
    fps = [random.getrandbits(64) for _ in range(30)]
    for f in list(fps):
        for _ in range(12):
            for b in random.sample(range(64), random.choice((1, 4, 5))):
                f ^= 1 << b
            fps.append(f)
    signed = [f - (f >> 63 << 64) for f in fps]
    got = {r.fp: r.root for r in simhash.groups(spark.createDataFrame([(f,) for f in signed], "fp bigint")).collect()}
    want = plain_groups(dict(enumerate(fps)))
    pairs = {(got[signed[k]], c) for k, c in want.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


# archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    payloads = [b"", b"x" * 99, bytes(range(256)) * 3, b"\r\n\r\nHTTP/1.0\n"]
    urls = ["http://a/ b", None, "-", ""]
    data = warc.arc_head(version, "f")
    for k, (u, p) in enumerate(zip(urls, payloads)):
        data += b"\n" + warc.arc_record(version, k, u, p, len(data) + 1, "f")
    for packed in (data + b"\n", zlib.compress(data, wbits=31)):
        got = list(warc.parse_arc(packed))
        assert [(g[1], g[2], g[-1]) for g in got] == [(k, u, p) for k, (u, p) in enumerate(zip(urls, payloads))]
        assert all(data[int(g[0].split(":")[1]) :].startswith(media_url) for g, media_url in zip(got, (b"http://a/%20b ", b"- ", b"%2D ", b"% ")))
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-3]))


def test_equal_payloads_revisit_the_smallest_page(spark):
    long_, short = "é" * 50, "a" * 99
    pages = spark.createDataFrame([(3, None, long_), (1, "u", long_), (2, "v", long_), (5, "w", short), (4, "x", short), (None, "y", long_), (6, None, None), (1, "u", long_)], "page_id bigint, url string, html string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages).collect())
    assert got == sorted([(0, 100, "response", None), (1, 100, "response", None), (1, 100, "response", None), (2, 100, "revisit", 1), (3, 100, "revisit", 1), (4, 99, "response", None), (5, 99, "response", None), (6, 0, "response", None)])


def test_foreign_arc_records(spark, tmp_path):
    """HTTP without a length, HTTP with a wrong one, a revisit of it, and no HTTP at all."""
    same = b"y" * 120
    blocks = [("http://a/", "text/html", b"HTTP/1.0 200 OK\r\nX-Page-Id: 1\r\n\r\n" + same), ("http://b/", "text/html", b"HTTP/1.0 200 OK\r\nContent-Length: 7\r\nX-Page-Id: 2\r\n\r\n" + same), ("http://c/", "text/html", b"HTTP/1.0 200 OK\r\nContent-Length: 7\r\n\r\nabc"), ("dns:a", "text/dns", b"20240101000000\na. IN A 1.2.3.4\n")]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/f.arc").write_bytes(warc.arc_head(1, "f") + b"".join(b"\n%s 0.0.0.0 20240101000000 %s %d\n%s" % (u.encode(), m.encode(), len(b), b) for u, m, b in blocks) + b"\n")
    warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = {r.url: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.with_targets(warc.read_warc(spark, f"{tmp_path}/warc")).collect()}
    assert got == {"http://a/": (120, "response", None), "http://b/": (120, "revisit", 1), "http://c/": (3, "response", None), "dns:a": (31, "resource", None)}
    held = [x for f in (tmp_path / "warc").glob("part-*") for x in warc.parse_warc(f.read_bytes())]
    assert [(f["content-type"], b) for f, b in held if f["warc-type"] == "resource"] == [("text/dns", blocks[3][2])]


def test_records_have_identifiers_and_members_of_their_own(spark, tmp_path):
    """Repeated rows differ in identifier; a revisit's headers name its target; each record can be read from its own offset; and
    a second conversion gives the same records."""
    long_ = "x" * 300
    pages = spark.createDataFrame([(2, "b", long_), (1, "a", long_), (1, "a", long_), (3, None, "y" * 200_000)], "page_id bigint, url string, html string").coalesce(1)
    warc.write_arc(pages, f"{tmp_path}/arc")
    for out in ("one", "two"):
        warc.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/{out}")
    (file,) = [f for f in (tmp_path / "one").glob("part-*") if f.stat().st_size]
    data = file.read_bytes()
    records = [f for f, _ in warc.parse_warc(data)]
    assert gzip.decompress(data).count(b"WARC/1.1") == len(records) == len({f["warc-record-id"] for f in records}) == 5
    by_page = {f["warc-target-uri"]: f for f in records if "warc-target-uri" in f}
    revisit = by_page["b"]
    assert revisit["warc-type"] == "revisit" and revisit["warc-refers-to-target-uri"] == "a" and revisit["warc-refers-to-date"] == revisit["warc-date"]
    assert revisit["warc-refers-to"] in {f["warc-record-id"] for f in records if f.get("warc-target-uri") == "a"}
    starts = [m.start() for m in re.finditer(rb"\x1f\x8b\x08\x00", data)]
    heads = [zlib.decompressobj(31).decompress(data[k:])[:8] for k in starts]
    assert heads.count(b"WARC/1.1") == 5 and set(heads) == {b"WARC/1.1", b""}
    twice = [sorted(r.record_id for r in warc.read_warc(spark, f"{tmp_path}/{out}").collect()) for out in ("one", "two")]
    assert twice[0] == twice[1]


# media


def plain_feature(payload):
    n = len(payload)
    counts = Counter(payload)
    mean = sum(payload) / n
    deviation = math.sqrt(max(0.0, sum(c * v * v for v, c in counts.items()) / n - mean * mean))
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    return [mean, deviation, entropy, sum(abs(a - b) for a, b in zip(payload, payload[1:])) / (n - 1)]


def test_media_round_trip(spark, rows):
    got = {r.doc_id: r for r in queries.QUERIES["op3_media"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = (r.text or "").encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        g = got[r.doc_id]
        assert media.samples(stored) == payload
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert [float(x) for x in g.feature.split()] == pytest.approx(plain_feature(payload), abs=6e-4)
        items, n = [("media", None, f"picture 1 of {len(r.text or '')} characters")], 0
        for line in (r.text or "").split("\n"):
            if line.strip():
                n += 1
                items.append(("text", len(line), None))
                if n % 4 == 0:
                    items.append(("media", None, f"picture {1 + n // 4} of {len(r.text)} characters"))
        if "\r" not in (r.text or ""):
            assert [(x.pos, x.kind, x.n_chars, x.caption) for x in g["items"]] == [(k, *x) for k, x in enumerate(items)]


def test_sequences_with_several_payloads(spark):
    """Positions, captions and payloads of pages that share some, against a plain list; one reference leads nowhere."""
    r, made, want = random.Random(4), [], {}
    sizes = {f"d{k}": k * 10 for k in range(6)}
    for page in range(40):
        parts, items = [], []
        for k in range(r.randrange(9)):
            if r.random() < 0.5:
                parts.append(f"<p>text {k} &lt;</p>")
                items.append(("text", f"text {k} <", None, None))
            else:
                ref, words = r.choice([*sizes, "lost"]), f"caption {k}" if r.random() < 0.5 else ""
                parts.append(f'<figure><img src="sha256:{ref}" alt="alt"><figcaption>{words}</figcaption></figure>' if words else f'<img src="sha256:{ref}" alt="alt">')
                items.append(("media", ref, words or "alt", sizes.get(ref)))
        made.append((page, "".join(parts)))
        want[page] = [(k, *x) for k, x in enumerate(items)]
    stock = spark.createDataFrame(list(sizes.items()), "digest string, size int")
    got = media.interleaved(spark.createDataFrame([*made, (99, None)], "id int, page string"), "id", stock).collect()
    assert {r.id: [(i.pos, i.kind, i.text or i.ref, i.caption, i.payload and i.payload.size) for i in r["items"]] for r in got} == want | {99: []}


def test_real_pages_keep_their_order(spark):
    """The texts of the pages table in order, against the pages without tags and hidden parts."""
    import html as escapes

    for r in media.parsed(queries.table(spark, SMALL, "pages").select("page_id", "html"), "html").collect():
        raw = queries.table(spark, SMALL, "pages").where(f"page_id = {r.page_id}").first().html if r.page_id < 5 else None
        assert [i.pos for i in r["items"]] == list(range(len(r["items"])))
        if raw is not None:
            shown = re.sub(r"(?s)<!--.*?-->|<(script|style|title|template)\b.*?</\1>", "", raw)
            words = escapes.unescape(re.sub(r"(?s)<[^>]*>", " ", shown)).split()
            assert "".join(" ".join(i.text for i in r["items"] if i.kind == "text").split()) == "".join(words)


def test_hidden_media_and_stray_captions():
    page = '<img src="sha256:a" alt="own"><template><figure><img src="sha256:b"></figure><p>no</template><figcaption>stray</figcaption>end'
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.sequence(page)] == [("media", "a", "own"), ("text", "stray", None), ("text", "end", None)]




def test_sequence_of_a_page():
    page = '<p>one &amp; <b>two</b><p>three<figure><img src="sha256:ab" alt="old"><figcaption>new</figcaption></figure><script>no</script><img src="sha256:cd" alt="x">end'
    got = [(i["pos"], i["kind"], i["text"] or i["ref"], i["caption"]) for i in media.sequence(page)]
    assert got == [(0, "text", "one & two", None), (1, "text", "three", None), (2, "media", "ab", "new"), (3, "media", "cd", "x"), (4, "text", "end", None)]
    assert media.sequence(None) == media.sequence("") == []


def test_captions_in_front_of_behind_and_left_open():
    a, b = '<img src="a" alt="old">', '<img src="b">'
    for inner in (f"<figcaption>new</figcaption>{a}{b}", f"{a}{b}<figcaption>new</figcaption>", f"{a}<figcaption>new</figcaption>{b}", f"<figcaption>new{a}{b}", f"{a}{b}<figcaption>new"):
        got = [(i["pos"], i["text"] or i["ref"], i["caption"]) for i in media.sequence(f"<p>one</p><figure>{inner}</figure><p>later</p><img src='c' alt='own'>")]
        assert got == [(0, "one", None), (1, "a", "new"), (2, "b", "new"), (3, "later", None), (4, "c", "own")]
    assert [(i["ref"], i["caption"]) for i in media.sequence(f"<figure>{a}<figcaption>new")] == [("a", "new")]
    assert [(i["pos"], i["text"]) for i in media.sequence("<figure><figcaption>alone</figcaption><table><tr><td>x</table></figure>end")] == [(0, "alone"), (1, "x"), (2, "end")]


# mixing


@pytest.mark.parametrize(("sizes", "want"), [({"a": 100, "b": 100, "c": 100}, {"a": 200.0, "b": 250 / 3, "c": 500 / 3}), ({"a": 0, "b": 10}, {"a": 0.0, "b": 15.0}), ({None: 4}, {None: 6.0}), ({}, {})])
def test_targets(sizes, want):
    assert mixing.targets(sizes) == pytest.approx(want)


def test_taken_words_come_near_the_targets(spark):
    got = queries.QUERIES["op5_mixing"](spark, MEDIUM)
    for r in got.groupBy("source_size", "target").agg({"taken": "sum", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["target"]) <= r["max(size)"]
    assert got.where("taken > 2 * size").isEmpty() and sorted(map(tuple, got.collect())) == sorted(map(tuple, queries.QUERIES["op5_mixing"](spark, MEDIUM).collect()))


# classifiers


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    scores = toxicity.scored(docs, labels).where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id").select("score", "predicted", "toxic").collect()
    good, bad = [r.score for r in scores if not r.toxic], [r.score for r in scores if r.toxic]
    auc = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    found, alarms = sum(r.predicted for r in scores if r.toxic), sum(r.predicted for r in scores if not r.toxic)
    print(f"AUC {auc:.3f}, found {found} of {len(bad)}, alarms {alarms} of {len(good)}")
    assert auc > 0.9 and found > 0.6 * len(bad) and alarms < 0.05 * len(good)


def test_the_risk_is_never_fitted_below_zero():
    x = [np.array([0])] * 40 + [np.array([1])] * 100 + [np.array([0])] * 10
    w, b = toxicity.fit(x, np.arange(150) < 40, 2, 0.2)
    assert w[0] + b > 0 > w[1] + b


def looped_fit(x, positive, n, prior):
    """toxicity.fit in plain loops, with the same random orders."""
    rng = np.random.default_rng(toxicity.SEED)
    w, m, v, step = [0.0] * n + [math.log(prior / (1 - prior))], [0.0] * (n + 1), [0.0] * (n + 1), 0
    parts = [[k for k, p in enumerate(positive) if p], [k for k, p in enumerate(positive) if not p]]

    def mean(docs, f):
        out = [0.0] * (n + 1)
        for d in docs:
            for k in (*x[d], n):
                out[k] += f(d) / len(docs)
        return out

    for _ in range(toxicity.STEPS):
        orders = [np.array_split(rng.permutation(np.array(p)), toxicity.BATCHES) for p in parts]
        for pos, unl in zip(*orders):
            if not len(pos) or not len(unl):
                continue
            s = {int(d): 1 / (1 + math.exp(-(sum(w[k] for k in x[d]) + w[n]))) for d in (*pos, *unl)}
            risk = sum(-math.log(1 - s[d]) for d in unl) / len(unl) - prior * sum(-math.log(1 - s[d]) for d in pos) / len(pos)
            g = [prior * a for a in mean(pos, lambda d: s[d] - 1)]
            if risk >= 0:
                g = [a + b - prior * c for a, b, c in zip(g, mean(unl, s.get), mean(pos, s.get))]
            step += 1
            for k in range(n + 1):
                d = g[k] + (toxicity.DECAY * w[k] if k < n else 0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                w[k] -= toxicity.RATE * (m[k] / (1 - 0.9**step)) / (math.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w[:n], w[n]


def test_the_fit_is_the_plain_loops():
    r = random.Random(6)
    x = [np.array(sorted(r.sample(range(12), r.randrange(5))), np.int64) for _ in range(120)]
    positive = np.array([k < 30 for k in range(120)])
    got, want = toxicity.fit(x, positive, 12, 0.2), looped_fit(x, positive, 12, 0.2)
    assert np.allclose(got[0], want[0], atol=1e-9) and abs(got[1] - want[1]) < 1e-9


def test_toxicity_is_the_same_however_rows_are_partitioned(spark):
    docs, labels = (queries.table(spark, MEDIUM, t) for t in ("documents", "labels"))
    one, two, three = ({r.doc_id: r.score for r in toxicity.scored(d, l).collect()} for d, l in ((docs, labels), (docs.repartition(7), labels.repartition(3)), (docs.orderBy("text").coalesce(1), labels)))
    assert one == two == three


def test_texts_alike_have_one_score(spark, labels):
    docs = spark.createDataFrame([(k, t) for k in range(4) for t in ("some words", "", None)], "doc_id bigint, text string")
    got = toxicity.scored(docs, labels).collect()
    assert len({r.score for r in got}) == 1 and {r.predicted for r in got} <= {0, 1}


def test_a_groups_own_quantiles_decide_as_it_grows(spark):
    """Groups of 1, 2 and 500 documents with a symbol in every fourth word, among 2000 without: one of 500 sets its own
    threshold, so its documents stay; those of 1 and 2 are judged by their language."""
    plain, odd = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" + "#" * (k % 4 == 0) for k in range(60))
    rows = [(k, plain, "en", f"s{k % 20}") for k in range(2000)] + [(3000, odd, "en", "one"), (3001, odd, "en", "two"), (3002, plain, "en", "two")] + [(4000 + k, odd, "en", "many") for k in range(500)]
    rows += [(5000 + k, odd, "en", "s0") for k in range(8)]
    got = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[4000 + k] for k in range(500)) and all(got[k] for k in range(2000)) and got[3002]
    assert not any(got[5000 + k] for k in range(8))
    counts = quality.measured(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), ["doc_id", "lang", "source"])
    high = {r.source: r.high for r in quality.thresholds(counts).where("rule = 'symbols'").collect()}
    assert high["many"] > 250 > high["s0"] and len(set(high.values())) > 3


def plain_profile(texts, n):
    counts = Counter()
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        joined = " " + " ".join(words) + " "
        for size in (1, 2, 3):
            for k in range(len(joined) - size + 1):
                g = joined[k : k + size]
                if words and not (size == 1 and g == " ") and not (size == 3 and g[1] == " "):
                    counts[g] += 1

    def code(g):
        out = 0
        for c in g:
            out = out << 21 | ord(c)
        return out

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:n]


def test_languages_against_plain_profiles(spark, rows):
    """Profiles and distances in plain Python. Below TRAIN, all texts that aren't held out are learned from."""
    known = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    place = {lang: {g: k for k, g in enumerate(plain_profile([r.text for r in known if r.lang == lang], 300))} for lang in {r.lang for r in known}}
    got = {r.doc_id: r for r in queries.QUERIES["op9_langid"](spark, SMALL).collect()}
    for r in rows:
        mine = plain_profile([r.text], 300)
        away = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(mine)) for lang, p in place.items()}
        lang = min(sorted(away), key=away.get) if mine else "und"
        assert got[r.doc_id].lang_pred == lang and 0 <= got[r.doc_id].score <= 1
        assert got[r.doc_id].score == pytest.approx(1 - away[lang] / (300 * len(mine)) if mine else 0.0)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_languages_of_held_out_documents(spark):
    docs = queries.table(spark, MEDIUM, "documents")
    got = langid.identify(docs).where("held_out AND lang_pred <> 'und'").join(docs.where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)


def test_out_of_place_distance_by_hand():
    p = langid.Profiles({"x": [ord(c) for c in "abc"], "y": [ord(c) for c in "cba"]})
    assert p.predict(b"aaa bb")[0] == "x" and p.predict(b"12 -")[0] == "und" == p.predict(None)[0]


# tokens

_words = st.lists(st.sampled_from([*"abeinrst", "ü", " ", "  ", "\n", "▁", "1", ".", "日", "😀", "'", "\t", "\xa0"]), max_size=60).map("".join)


@functools.cache
def processor():
    return SentencePieceProcessor(model_file=queries.PIECES)


@pytest.fixture(scope="module")
def library():
    return processor()


def test_pieces_are_the_librarys(spark, rows, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op10_sentencepiece"](spark, SMALL).collect()}
    for r in rows:
        ids = library.encode(r.text or "", num_threads=1)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


@settings(max_examples=400, deadline=None)
@given(_words)
def test_pieces_of_any_text(text):
    sp, model = processor(), spm.loaded(queries.PIECES)
    ids = sp.encode(text)
    assert model.encode(text) == ids and model.decode(ids) == sp.decode(ids)
    assert model.digests(text.encode()) == (len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), sp.decode(ids))))


def test_ids_round_trip(spark, documents):
    some = documents.where("text IS NOT NULL")
    back = spm.texts(spm.token_ids(some, queries.PIECES), queries.PIECES).withColumnRenamed("text", "back")
    assert back.join(some, "doc_id").where("text <> back AND NOT text LIKE '%▁%'").isEmpty()


def test_token_counts_without_a_trie(spark, rows):
    model = tokencount.Unigram(queries.RANKS, queries.PRETOKENS)
    cost = {t: -((v + 1) >> tokencount.SHIFT) for t, v in model.value.items()}

    def fewest(token):
        best = [(0, 0)]
        for i in range(1, len(token) + 1):
            best.append(min((best[j][0] + cost[token[j:i]], best[j][1] + 1) for j in range(max(0, i - 80), i) if token[j:i] in cost))
        return best[-1][1]

    known: dict = {}
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in queries.QUERIES["op8_tokencount"](spark, SMALL).collect()}
    for r in rows:
        parts = regex.findall(queries.PRETOKENS, r.text or "")
        for p in parts:
            known.setdefault(p, fewest(p.encode()) if p not in known else 0)
        assert got[r.doc_id] == (len(parts), sum(known[p] for p in parts))


@pytest.mark.parametrize("nodes", [1, 50])
def test_a_full_trie_is_begun_anew_without_a_change(monkeypatch, rows, nodes):
    texts = [r.text.encode() for r in rows[:40] if r.text] + [b"abcdefgh" * 30, b"abcdefgi" * 30]
    whole = tokencount.Unigram(queries.RANKS, queries.PRETOKENS)
    want = [whole.counts(t) for t in texts]
    assert len(whole.best) == len(whole.children) + 1 and len(whole.best) <= 1 + sum(min(len(p.encode()), tokencount.DEEPEST) for p in whole.ends) + 2 * tokencount.DEEPEST
    monkeypatch.setattr(tokencount, "NODES", nodes)
    small = tokencount.Unigram(queries.RANKS, queries.PRETOKENS)
    assert [small.counts(t) for t in texts] == want and len(small.best) <= nodes + 1 + tokencount.DEEPEST


def test_scores_of_a_long_pretoken_in_a_window(monkeypatch):
    text = "".join(chr(97 + (k * k // 7 + k) % 23) for k in range(5000)).encode()
    model = tokencount.Unigram(queries.RANKS, queries.PRETOKENS)
    want = model.counts(text)
    monkeypatch.setattr(tokencount, "PATH", 10)
    assert model.counts(text) == want and want[0] == 1
    monkeypatch.setattr(tokencount, "DEEPEST", 10_000)
    assert tokencount.Unigram(queries.RANKS, queries.PRETOKENS).counts(text) == want


# edges

TEXTS = [(1, None, "s", "en"), (2, "", None, None), (3, " \n\t ", "s", "en"), (3, " \n\t ", "s", "en"), (None, "a b c", "t", "de"), (4, "word " * 30000, "s", "en"), (5, ("x y z\n" + "l " * 60 + "\n") * 3, None, "en"), (6, "tie tie", "t", "de"), (7, "tie tie", "t", "de")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    names = ["row", "fp", "n", "h", "size", "of", "words", "score", "id", "gone", "component_id"]
    return spark.createDataFrame([(*t, *(["?"] * len(names))) for t in TEXTS], "doc_id bigint, text string, source string, lang string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, None), (None, 1), (6, 1), (6, 0)], "doc_id bigint, toxic int")


OPERATORS = {
    "simhash": simhash.near_duplicates, "media": media.columns, "quality": quality.assess, "mixing": mixing.mix, "linededup": linededup.report, "langid": langid.identify,
    "tokencount": lambda d: tokencount.counted(d, queries.RANKS, queries.PRETOKENS), "spm": lambda d: spm.encoded(d, queries.PIECES),
}
SAME = {"linededup": linededup.replaced, "simhash": simhash.one_of_each, "mixing": mixing.mixed}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_each_give_one(odd, name):
    got = OPERATORS[name](odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(t[0]) for t in TEXTS)
    assert OPERATORS[name](odd.limit(0)).count() == 0


@pytest.mark.parametrize("name", SAME)
def test_stages_keep_all_columns(odd, name):
    out = SAME[name](odd)
    assert out.dtypes == odd.dtypes and SAME[name](odd.limit(0)).count() == 0
    if name == "simhash":  # null, empty and blank texts are one group, and so are the ties
        assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "5", "6", "None"]


def test_odd_rows_toxicity(odd, labels):
    got = toxicity.scored(odd, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.clean(odd, labels).dtypes == odd.dtypes and toxicity.scored(odd.limit(0), labels.limit(0)).count() == 0


def test_no_documents_leave_none(spark, odd, labels):
    assert toxicity.clean(odd.limit(0), labels.limit(0)).count() == 0 and toxicity.clean(odd, labels.limit(0)).count() == len(TEXTS)


def test_odd_pages(spark):
    kind = "page_id bigint, url string, html string, size int, digest string, place string, first string, record string, payload string"
    assert warc.archive(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, "u", "y" * 3_000_000, 7, *["?"] * 5), (2, "v", "y" * 3_000_000, 7, *["?"] * 5), (None, None, None, None, *[None] * 5)]
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(1, 3_000_000, "response", None), (2, 3_000_000, "revisit", 1), (None, 0, "response", None)}


def test_a_source_without_words(spark):
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "", "t"), (3, None, "t"), (4, "d", None)], "doc_id bigint, text string, source string")
    assert {r.doc_id: (r["size"], r.target, r.taken) for r in mixing.mix(docs).collect() if r["size"] == 0} == {2: (0, 0.0, 0), 3: (0, 0.0, 0)}
    assert {r.doc_id for r in mixing.mixed(docs).collect()} == {1, 4}


def test_tables_of_a_block_go_with_it(spark):
    def there(frame):
        return Path(frame.inputFiles()[0].removeprefix("file://")).parent

    with common.swept(spark) as outliving:
        inner = there(common.kept(spark.range(3), "inner"))
        with common.swept(spark) as handed_on:
            middle = handed_on(spark.range(4), "middle")
        assert middle.count() == 4 and there(middle).exists() and inner.exists()
        held = there(middle)
        out = outliving(spark.range(5), "outer")
    assert out.count() == 5 and there(out).exists() and not inner.parent.exists() and not held.parent.exists()


class Cluster:
    class conf:
        get = staticmethod(lambda *_: None)

    class sparkContext:
        master = "spark://host:7077"


def test_blocks_of_threads_are_apart(spark):
    """A block's tables go with it, whatever block another thread has open meanwhile."""
    done, out = threading.Event(), []

    def other():
        with common.swept(spark):
            out.append(common.kept(spark.range(3).toDF("x"), "other"))
            done.wait(60)
            out.append(out[0].count())

    thread = threading.Thread(target=other)
    with common.swept(spark):
        thread.start()
        while not out:
            time.sleep(0.05)
        mine = common.kept(spark.range(2).toDF("x"), "mine")
        assert mine.count() == 2
    done.set()
    thread.join()
    assert out[1] == 3
    with pytest.raises(Exception):
        spark.read.schema("x bigint").parquet(mine.inputFiles()[0]).count()


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError):
        common.folder(Cluster, "x")


def test_boundaries_move_with_inserted_lines():
    body = [f"line {i} of a passage".encode() for i in range(40)]
    a, b = linededup.boundaries(body, [5] * 40), linededup.boundaries([b"new first line", *body], [3] + [5] * 40)
    assert a[2:] == b[3:] and 12 < sum(a) < 28
    assert all(any(a[k : k + 3]) for k in range(37))  # each four lines hold one
    long_ = linededup.boundaries(body, [17] * 40)
    assert all(any(long_[k : k + 2]) for k in range(38)) and all(linededup.boundaries(body, [26] * 40))  # so does each stretch of over fifty words


def plain_lines(texts):
    """By (id, text) in order: the lines that stay, by the rule of linededup's docstring."""
    pairs, singles, out = {}, {}, []
    every = []
    for d, text in texts:
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.split()]
        words = [len(lines[i].split()) for i in full]
        every.append((lines, full, words))
        for k in range(len(full)):
            singles.setdefault(lines[full[k]], (d, k))
            if k + 1 < len(full):
                pairs.setdefault((lines[full[k]], lines[full[k + 1]]), (d, k))
    for (d, _), (lines, full, words) in zip(texts, every):
        r = []
        for a, b in zip(full, full[1:]):
            h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in (a, b)]
            r.append((h[1] + 31 * h[0]) % 2**32)
        cut = [words[k] + words[k + 1] > 50 or k + 1 == len(r) or not (all(x > y for x, y in ((x, y) for x in [r[k]] for y in r[max(0, k - 1) : k] + r[k + 1 : k + 2]))) for k in range(len(r))]
        again = [pairs[lines[full[k]], lines[full[k + 1]]] < (d, k) for k in range(len(r))]
        gone, k = {k for k in range(len(full)) if words[k] >= 50 and singles[lines[full[k]]] < (d, k)}, 0
        while k < len(again):
            end = k
            while end < len(again) and again[end]:
                end += 1
            if any(cut[k:end]):
                gone.update(range(k, end + 1))
            k = max(end, k + 1)
        stay, at = [], {i: k for k, i in enumerate(full)}
        for i, x in enumerate(lines):
            beside = [k for k in (max((k for j, k in at.items() if j < i), default=None), min((k for j, k in at.items() if j > i), default=None)) if k is not None]
            if at[i] not in gone if i in at else not (beside and all(k in gone for k in beside)):
                stay.append(x)
        out.append("\n".join(stay))
    return out


def made_texts(seed):
    """Passages of 2 to 8 lines under 50 words in other contexts each time, with blank lines, repeats within a text, copies."""
    r = random.Random(seed)
    line = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    shared = [[line(r.choice((2, 51 // k + r.randrange(1, 4)))) for _ in range(k)] for k in range(2, 9) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [[line(r.randrange(1, 20)) for _ in range(r.randrange(1, 5))] for _ in range(4)]
        for p in r.sample(shared, 3):
            parts.insert(r.randrange(len(parts)), [*p[:1], *([""] if len(p) == 5 else []), *p[1:]])
        texts.append("\n".join(x for p in parts for x in p))
    return [*texts, "\n".join([line(10)] * 30), texts[3], "\n\n", line(60), texts[5].replace("\n", "\n\n"), texts[7] + "\n"]


def test_repeated_runs_against_a_plain_loop(spark):
    texts = list(enumerate(made_texts(5)))
    texts.append((len(texts), texts[-3][1] + "\nmore"))
    got = {r.doc_id: r for r in linededup.report(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    want = plain_lines(texts)
    assert [got[d].text for d, _ in texts] == want
    assert got[60].text.count("\n") == 0 and got[60].gone_lines == 29  # of thirty equal lines one stays
    for (d, text), stay in zip(texts, want):
        assert got[d].n_lines == text.count("\n") + 1 and got[d].gone_words == len(text.split()) - len(stay.split())


def test_recall_of_repeated_runs(spark):
    """Over sf0.1: of the lines in runs of neighbouring lines that each stand, pair by pair, in an earlier document, how many go;
    and each line's first place stays."""
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents").orderBy("doc_id").collect()
    got = {r.doc_id: r.text for r in linededup.report(queries.table(spark, "/root/testdata/sf0.1", "documents")).collect()}
    seen, lines_seen, total, gone = {}, set(), Counter(), Counter()
    for d in docs:
        lines = [x for x in (d.text or "").split("\n") if x.split()]
        left, stays, j = [x for x in (got[d.doc_id] or "").split("\n") if x.split()], [], 0
        for x in lines:
            stays.append(j < len(left) and left[j] == x)
            j += stays[-1]
        pairs = list(zip(lines, lines[1:]))
        early = [seen.get(p, d.doc_id) < d.doc_id for p in pairs] + [False]
        start = 0
        for k, e in enumerate(early):
            if not e:
                if n := k - start:
                    kind = {1: "two", 2: "three"}.get(n, "long")
                    total[kind] += n + 1
                    gone[kind] += n + 1 - sum(stays[start : k + 1])
                start = k + 1
        assert all(s or x in lines_seen or x in lines[:i] for i, (s, x) in enumerate(zip(stays, lines)))
        lines_seen.update(lines)
        for p in pairs:
            seen.setdefault(p, d.doc_id)
    print({k: (gone[k], n) for k, n in total.items()})
    assert gone["long"] >= 0.97 * total["long"] > 1000


def test_runs_of_three_lines_and_lines_that_stand_earlier_elsewhere_go(spark):
    """Whatever lies around them: a run of three lines; a run whose pairs stand in different earlier texts; the last two lines."""
    r = random.Random(8)
    other = lambda n: [f"other {r.randrange(10**9)}" for _ in range(n)]
    shared = [[f"run {k} line {i}" for i in range(3)] for k in range(40)]
    texts = [[*other(3), *x, *other(3)] for x in shared] + [[*other(4), *x, *other(4)] for x in shared]
    a, b, c, d = "first line", "second line", "third line", "fourth line"
    texts += [[*other(2), a, b, c, *other(2)], [*other(2), b, c, d, *other(2)], [*other(2), a, b, c, d, *other(2)], [*other(2), c, d]]
    got = {x.doc_id: x for x in linededup.report(spark.createDataFrame([(n, "\n".join(x)) for n, x in enumerate(texts)], "doc_id bigint, text string")).collect()}
    assert [got[n].gone_lines for n in range(80)] == [0] * 40 + [3] * 40
    assert got[82].gone_lines == 4 and got[83].gone_lines == 2


def test_workers_hold_only_what_their_operator_asks_for(spark):
    """A worker that has encoded texts keeps the model for more of them, and not for the next operator."""
    rows = spark.createDataFrame([(1, "a text")], "doc_id bigint, text string").coalesce(1)

    def seen():
        return lambda text: (len(common._held),)

    def count():
        return common.per_text(rows, "n int", lambda: seen()).first().n

    common._held.clear()
    made = []
    for _ in range(2):
        common.begun(lambda: common.held("a", lambda: made.append(1) or made))
    assert made == [1] and list(common._held) == ["a"]
    common.begun(lambda: len)
    assert not common._held
    assert spm.encoded(rows, queries.PIECES).first().n_tokens > 0 and count() == 0
