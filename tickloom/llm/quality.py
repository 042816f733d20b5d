"""Quality rules whose thresholds adapt to language and source.

Each document gives a few integer rates. A sketch counts the documents of a language and source by rate, keeping a rate's
six leading binary digits: sketches merge by adding counts, and a quantile is right to 1 part in 32. A group's quantiles are
drawn towards those of its language, and these towards those of everything, by the weight of PRIOR documents: with few
documents the parents decide, with many the group itself, and no size is a switch.

The upper threshold of a rate lies in the first gap among the upper quantiles, at the geometric mean of two neighbours of which
one is GAP times the other; without a gap, REACH times the way from the median to the last quantile beyond it. The thresholds
are joined to the documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, per_text, swept, words

#: Quantiles in percent, the upper ones from the third on; documents that the parent group's quantiles weigh as many as; how many
#: times a quantile must be the one before for a gap; spans beyond the last quantile.
QUANTILES, PRIOR, GAP, REACH = (1, 50, 75, 90, 95, 99), 50, 4, 2
#: name: (numerator, denominator, scale, size of differences that mean nothing, whether low rates count too)
RATES = {"symbols": ("n_symbols", "n_words", 1000, 25, False), "repeats": ("n_repeat_words", "n_words", 1000, 40, False), "lines": ("n_dup_lines", "n_lines", 1000, 200, False), "length": ("word_chars", "n_words", 100, 60, True)}
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"


def base(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """Counts of a whole text: words, their code points, symbols, lines with a word equal to an earlier line, words in
    three-word windows that occur twice or more (each word once), lines with a word. Null: zeros."""
    found = words(text)
    if not found:
        return (0, 0, 0, 0, 0, 0)
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in found), np.int64, len(found))
    repeats = 0
    if len(w) > 2:
        _, pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
        _, where, often = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        twice = often[where] > 1
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeats = int(covered.sum())
    joined = b"".join(found)
    return (len(w), len(joined.decode("utf-8", "replace")), sum(map(joined.count, _SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines))


_SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]


def measured(docs: DataFrame, others: list[str]) -> DataFrame:
    """The columns `others`, the counts of base(), and base_failed: under 50 words, or over half of them in repeated windows."""
    out = per_text(docs.select(*others, "text"), BASE, lambda: base)
    return out.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def coarse(rate: Column) -> Column:
    """A rate's six leading binary digits, the rest zero."""
    shift = F.greatest(F.length(F.bin(rate)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", rate, shift), shift)


def rate(name: str) -> Column:
    top, bottom, scale, _, _ = RATES[name]
    return F.expr(f"CASE WHEN {bottom} > 0 THEN {scale} * {top} DIV {bottom} ELSE 0 END")


def thresholds(counts: DataFrame) -> DataFrame:
    """counts (lang, source, measured columns) -> lang, source, rule, low, high for each language and source.

    Only documents that pass the base rules count. Sketch rows: one for each language, source, rule and coarse rate.
    """
    each = counts.where(~F.col("base_failed")).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), coarse(rate(k)).alias("value")) for k in RATES])).alias("x"))
    sketch = kept(each.groupBy("lang", "source", "x.rule", "x.value").agg(F.count(F.lit(1)).alias("n")), "sketch")

    def quantiles(by: list[str], tag: str) -> DataFrame:
        merged = sketch.groupBy(*by, "rule", "value").agg(F.sum("n").alias("n"))
        keys = ", ".join([*by, "rule"])
        ranked = merged.withColumn("upto", F.expr(f"sum(n) OVER (PARTITION BY {keys} ORDER BY value)")).withColumn("all", F.expr(f"sum(n) OVER (PARTITION BY {keys})"))
        return ranked.groupBy(*by, "rule").agg(F.max("all").alias(f"n_{tag}"), *[F.expr(f"min(value) FILTER (WHERE 100 * upto >= {q} * `all`)").cast("double").alias(f"q{q}_{tag}") for q in QUANTILES])

    own, lang, whole = quantiles(["lang", "source"], "s"), quantiles(["lang"], "l"), quantiles([], "a")
    out = own.join(lang.withColumnsRenamed({"lang": "lang_", "rule": "rule_"}), F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("rule") == F.col("rule_"))).join(whole, "rule")

    def drawn(q: Column, n: Column, parent: Column) -> Column:
        return (n * q + F.lit(float(PRIOR)) * parent) / (n + F.lit(float(PRIOR)))

    out = out.select("lang", "source", "rule", *[drawn(F.col(f"q{q}_s"), F.col("n_s"), drawn(F.col(f"q{q}_l"), F.col("n_l"), F.col(f"q{q}_a"))).alias(f"q{q}") for q in QUANTILES])
    least = F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(float(v[3])))])[F.col("rule")]
    first, middle, last = F.col(f"q{QUANTILES[0]}"), F.col(f"q{QUANTILES[1]}"), F.col(f"q{QUANTILES[-1]}")
    upper = [F.col(f"q{q}") for q in QUANTILES[2:]]
    gaps = [F.when(b + least >= GAP * (a + least), F.sqrt((a + least) * (b + least)) - least) for a, b in zip(upper, upper[1:])]
    high = F.coalesce(*gaps, last + REACH * (last - middle) + least)
    return out.select("lang", "source", "rule", (first - REACH * (middle - first) - least).alias("low"), high.alias("high"))


def judged(counts: DataFrame) -> DataFrame:
    """counts with kept: false if base_failed, else whether no rate lies beyond its threshold.

    A language and source without thresholds (all its documents fail the base rules) keeps none, by the base rules.
    Null languages and sources are groups of their own. The thresholds are a few rows for each language and source.
    """
    with swept(counts.sparkSession) as outliving:
        wide = thresholds(counts).groupBy("lang", "source").agg(*[F.expr(f"max({e}) FILTER (WHERE rule = '{k}')").alias(f"{e}_{k}") for k in RATES for e in ("low", "high")])
        wide = outliving(wide.withColumnsRenamed({"lang": "lang_", "source": "source_"}), "thresholds")
    beyond = F.lit(False)
    for k, (*_, both) in RATES.items():
        beyond |= (rate(k) > F.col(f"high_{k}")) | (F.lit(both) & (rate(k) < F.col(f"low_{k}")))
    out = counts.join(wide, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    return out.select(*counts.columns, (~F.col("base_failed") & ~F.coalesce(beyond, F.lit(False))).alias("kept"))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs (doc_id, text, lang, source); other columns are ignored.

    Null and empty texts have no words and fail the base rules. Repeated rows stay and each count in their group's quantiles; a null
    language or source is a group like any other. An empty table gives one.
    """
    counts = kept(measured(docs, ["doc_id", "lang", "source"]), "counts")
    return judged(counts).drop("lang", "source", "n_lines")


def _sql() -> str:
    """The same rows in DuckDB's SQL, by windows of three words as rows."""
    coarse = "(({v} >> greatest(length(bin({v})) - 6, 0)) << greatest(length(bin({v})) - 6, 0))"
    rates = {k: f"CASE WHEN {b} > 0 THEN {s} * {t} // {b} ELSE 0 END" for k, (t, b, s, _, _) in RATES.items()}
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {x} AS v FROM c WHERE NOT base_failed" for k, x in rates.items())

    def quantiles(by: str) -> str:
        keys = f"{by}, rule" if by else "rule"
        ranked = f"SELECT {keys}, value, sum(sum(n)) OVER (PARTITION BY {keys} ORDER BY value) AS upto, sum(sum(n)) OVER (PARTITION BY {keys}) AS every FROM sk GROUP BY {keys}, value"
        each = ", ".join(f"CAST(min(value) FILTER (WHERE 100 * upto >= {q} * every) AS DOUBLE) AS q{q}" for q in QUANTILES)
        return f"SELECT {keys}, CAST(max(every) AS DOUBLE) AS n, {each} FROM ({ranked}) GROUP BY {keys}"

    beyond = " OR ".join(f"(t.rule = '{k}' AND (({x}) > t.high" + (f" OR ({x}) < t.low" if RATES[k][4] else "") + "))" for k, x in rates.items())
    p = f"{PRIOR}::DOUBLE"
    drawn = ", ".join(f"(o.n * o.q{q} + {p} * ((l.n * l.q{q} + {p} * a.q{q}) / (l.n + {p}))) / (o.n + {p}) AS q{q}" for q in QUANTILES)
    least = "CASE rule " + " ".join(f"WHEN '{k}' THEN {v[3]}::DOUBLE" for k, v in RATES.items()) + " END"
    first, middle, last = (f"q{QUANTILES[k]}" for k in (0, 1, -1))
    gaps = " ".join(f"WHEN q{b} + least >= {GAP} * (q{a} + least) THEN sqrt((q{a} + least) * (q{b} + least)) - least" for a, b in zip(QUANTILES[2:], QUANTILES[3:]))
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS often FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(3) x(k) WHERE often > 1 GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
c AS (SELECT * EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
e AS ({each}),
sk AS (SELECT lang, source, rule, {coarse.format(v="v")} AS value, count(*) AS n FROM e GROUP BY ALL),
o AS ({quantiles("lang, source")}), l AS ({quantiles("lang")}), a AS ({quantiles("")}),
q AS (SELECT o.lang, o.source, o.rule, {drawn} FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.rule = l.rule JOIN a ON o.rule = a.rule),
t AS (SELECT lang, source, rule, {first} - {REACH} * ({middle} - {first}) - least AS low, CASE {gaps} ELSE {last} + {REACH} * ({last} - {middle}) + least END AS high FROM (SELECT *, {least} AS least FROM q))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT EXISTS (SELECT 1 FROM t WHERE t.lang IS NOT DISTINCT FROM c.lang AND t.source IS NOT DISTINCT FROM c.source AND ({beyond})) AS kept FROM c
"""


RULES_SQL = _sql()
