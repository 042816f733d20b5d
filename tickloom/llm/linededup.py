"""Removal of passages that repeat across documents, by content-defined chunks of lines.

The lines with words of a text follow each other, whatever lines without words lie between. A rolling hash over the hashes
of two neighbouring lines chooses boundaries that depend on these lines and the next ones alone, so they move with inserted
text: a pair is a boundary unless its hash is above both of its neighbours', or if it has over PASSAGE words or ends its text. The
two lines at a boundary are a chunk; a line of LONG words or more is one by itself.

Chunks are compared over the whole corpus, by hash and, where a hash occurs again, by their bytes. A chunk that stands
earlier (by doc_id, nulls last, then position) is repeated, and from it the match goes on to both sides, line by line, as
long as neighbouring lines stand earlier, too. The lines of such a run go. So each repeated run of three lines or more goes,
and each of two lines or one with over PASSAGE words; of shorter runs of two lines those that are a chunk. The first place of
a line keeps it. A line without words goes with the lines around it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, per_text, row_of, swept

BASE, MODULUS = 31, 1 << 32
#: A pair of lines with more words than PASSAGE is always a boundary, a line of LONG words a chunk.
PASSAGE, LONG = 50, 50


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def laid(text: bytes | None) -> tuple[list[bytes], list[int], list[int]]:
    """All lines of a text, and of those with words their numbers and how many words they have. Null: none; an empty text is
    one empty line."""
    if text is None:
        return [], [], []
    lines = text.split(b"\n")
    counted = [(i, n) for i, x in enumerate(lines) if (n := len(x.split()))]
    return lines, [i for i, _ in counted], [n for _, n in counted]


def boundaries(full: list[bytes], words: list[int]) -> list[bool]:
    """Whether each pair of neighbouring lines with words is a boundary."""
    h = [line_hash(x) for x in full]
    r = [(b + BASE * a) % MODULUS for a, b in zip(h, h[1:])]
    out = []
    for k, x in enumerate(r):
        beside = r[max(k - 1, 0) : k] + r[k + 1 : k + 2]
        out.append(k + 1 == len(r) or x <= max(beside) or words[k] + words[k + 1] > PASSAGE)
    return out


def marks(text: bytes | None) -> tuple[list[int], list[int]]:
    """Number and 63-bit hash of what is compared: of the k-th line with words and the next (2k + 1), of a long line (2k)."""
    lines, at, words = laid(text)
    every = [(2 * k + 1, lines[i] + b"\n" + lines[j]) for k, (i, j) in enumerate(zip(at, at[1:]))]
    every += [(2 * k, lines[i]) for k, (i, n) in enumerate(zip(at, words)) if n >= LONG]
    return [k for k, _ in every], [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "big") >> 1 for _, x in every]


def taken(text: bytes | None, numbers: list[int]) -> tuple[list[int], list[str]]:
    """These lines and pairs of lines as texts; only a pair has a line end."""
    lines, at, _ = laid(text)
    return numbers, [b"\n".join(lines[i] for i in at[n // 2 : n // 2 + 1 + n % 2]).decode("utf-8", "replace") for n in numbers]


def repeated_lines(text: bytes, numbers: list[int]) -> set[int]:
    """The lines that go, given the numbers (as in marks()) of what stands earlier."""
    lines, at, words = laid(text)
    again = set(numbers)
    pairs = sorted(n // 2 for n in again if n % 2)
    cut = boundaries([lines[i] for i in at], words) if pairs else []
    gone = {n // 2 for n in again if not n % 2}
    run: list[int] = []
    for k in [*pairs, -1]:
        if run and k != run[-1] + 1:
            if any(cut[j] for j in run):
                gone.update(range(run[0], run[-1] + 2))
            run = []
        run.append(k)
    out = {at[k] for k in gone}
    for k, (a, b) in enumerate(zip([-1, *at], [*at, len(lines)])):
        beside = [j in gone for j in (k - 1, k) if 0 <= j < len(at)]
        if beside and all(beside):
            out.update(range(a + 1, b))
    return out


def without(text: bytes | None, numbers: list[int] | None) -> tuple[str | None, int, int, int]:
    """text without the lines that go; its lines, and the lines and words that went."""
    if text is None:
        return None, 0, 0, 0
    lines = text.split(b"\n")
    gone = repeated_lines(text, numbers) if numbers else set()
    rest = b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text
    return rest.decode("utf-8", "replace"), len(lines), len(gone), sum(len(lines[i].split()) for i in gone)


def _alike(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col(f"{a}_hash") == F.col(f"{b}_hash"))


def repeated(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> id, id_hash, gone: for each text with something that stands earlier, the numbers of its pairs and
    long lines that do, as in marks(). Rows alike in doc_id and text are one document; id_hash is the text's hash."""
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("id_hash"), "text")
    with swept(docs.sparkSession) as outliving:
        found = per_text(keyed, "ks array<int>, marks array<bigint>", lambda: marks)
        each = kept(found.select("id", "id_hash", F.explode(F.arrays_zip("ks", "marks")).alias("x")).select("id", "id_hash", F.col("x.ks").alias("k"), F.col("x.marks").alias("mark")), "marks")
        again = kept(each.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"), "again")
        # these sides grow with the corpus at any share of repeats, so none is broadcast
        asked = kept(each.join(again.hint("merge"), "mark").groupBy("id", "id_hash").agg(F.sort_array(F.collect_set("k")).alias("ask")), "asked")
        texts = keyed.join(asked.withColumnsRenamed({"id": "of", "id_hash": "of_hash"}).hint("merge"), _alike("id", "of")).select("id", "id_hash", "text", "ask")
        bytes_ = per_text(texts, "ks array<int>, chunk array<string>", lambda: taken, also="ask")
        who = F.struct(F.col("id").isNull().alias("none"), "id", "id_hash", F.col("x.ks").alias("k")).alias("who")
        same = kept(bytes_.select("id", "id_hash", F.explode(F.arrays_zip("ks", "chunk")).alias("x")).select(who, F.col("x.chunk").alias("chunk")), "bytes")
        # grouping and joining by the chunk itself compares all of its bytes
        first = kept(same.groupBy("chunk").agg(F.min("who").alias("first"), F.max("who").alias("last")).where("first < last").select("chunk", "first"), "firsts")
        later = same.join(first.hint("merge"), "chunk").where("who > first")
        return outliving(later.groupBy("who.id", "who.id_hash").agg(F.collect_set("who.k").alias("gone")), "gone")


def deduplicated(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), new_text, n_lines, gone_lines, gone_words for each row of docs (doc_id, text, ...).

    A text may lose all of its lines and is then empty; its row stays. Null texts stay null and have no lines. Repeated rows
    (alike in doc_id and text) are one document and get equal results; copies under other ids lose what the first has. Null
    ids come last. An empty table gives one.
    """
    gone = repeated(docs).withColumnsRenamed({"id": "of", "id_hash": "of_hash"})
    rows = docs.select(row_of(docs), F.col("doc_id").alias("id"), F.xxhash64("text").alias("id_hash"))
    joined = rows.join(gone.hint("merge"), _alike("id", "of"), "left").select("row", F.col("row.text").alias("text"), "gone")
    return per_text(joined, "new_text string, n_lines bigint, gone_lines bigint, gone_words bigint", lambda: without, also="gone")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, text (deduplicated), n_lines, gone_lines and gone_words for each row of docs."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select("row.doc_id", F.col("new_text").alias("text"), "n_lines", "gone_lines", "gone_words")


def replaced(docs: DataFrame) -> DataFrame:
    """docs with the deduplicated texts; columns as in docs, n_chars, if there, counting the new text."""
    out = deduplicated(docs)
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("bigint")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, CAST(('0x' || substr(md5(line), 1, 8)) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
f AS (SELECT *, row_number() OVER d AS k, lead(line) OVER d AS next, (lead(h) OVER d + 31 * h) % 4294967296 AS r, w + lead(w) OVER d AS w2 FROM h WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, w2 > 50 OR coalesce(r <= lag(r) OVER d, false) OR coalesce(r <= lead(r) OVER d, true) AS cut,
    next IS NOT NULL AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id NULLS LAST, k) > 1 AS again,
    w >= 50 AND row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, k) > 1 AS alone FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
g AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM b),
s AS (SELECT *, again AND max(CASE WHEN again AND cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run) = 1 AS goes FROM g),
z AS (SELECT doc_id, i, goes OR alone OR coalesce(lag(goes) OVER (PARTITION BY doc_id ORDER BY k), false) AS gone FROM s),
e AS (SELECT h.doc_id, h.i, h.line, h.w, last_value(z.gone IGNORE NULLS) OVER d AS before, first_value(z.gone IGNORE NULLS) OVER u AS after
    FROM h LEFT JOIN z ON h.doc_id IS NOT DISTINCT FROM z.doc_id AND h.i = z.i WINDOW d AS (PARTITION BY h.doc_id ORDER BY h.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY h.doc_id ORDER BY h.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT *, coalesce(before AND after, before, after, false) AS gone FROM e),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, CAST(count(*) AS BIGINT) AS n_lines,
    CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS gone_lines, CAST(coalesce(sum(w) FILTER (WHERE gone), 0) AS BIGINT) AS gone_words FROM x GROUP BY doc_id)
SELECT d.doc_id, o.text, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.gone_lines, 0) AS gone_lines, coalesce(o.gone_words, 0) AS gone_words FROM documents d LEFT JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id
"""
