"""Mixing sources to target weights by hash thresholds.

Each document has a 60-bit hash. Words are summed by source and leading 12 bits of the hash; the bucket in which the sum
crosses a source's budget is refined by the next 12 bits, and so on, until it holds one hash. What lies below that
threshold is in the mix: a filter on each row, with no sort and no shuffle of texts. A target above its source's size
takes every document once and those below the threshold twice, so thresholds for growing targets are nested.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, per_text, row_of, small, words

#: Weights of the sources in the order of their names, repeating; the mix's words as a share of all; the most a source's words are repeated.
WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), 1.5, 2
BITS, LEVELS = 12, 5
ALL = 1 << (BITS * LEVELS)


def _key(name: str | None) -> tuple[bool, str]:
    return (name is None, name or "")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> dict[str | None, float]:
    """Words to take from each source: share of all words by weight, at most `most` times a source's size, the excess
    going to the other sources by weight until none is above. One number for each source, not for each document."""
    names = sorted(sizes, key=_key)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, out, free = share * sum(sizes.values()), {}, sum(weight.values())
    for s in sorted(names, key=lambda s: (most * sizes[s] / weight[s], _key(s))):
        if budget * weight[s] / free < most * sizes[s]:
            break
        out[s] = float(most * sizes[s])
        budget, free = budget - out[s], free - weight[s]
    return {s: out.get(s, weight[s] * budget / free if free else 0.0) for s in names}


def sized(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) -> row, source, h, size: a 60-bit hash of id and text, and the number of words."""
    id_text = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    h = F.conv(F.substring(F.md5(id_text), 1, 15), 16, 10).cast("bigint")
    return per_text(docs.select(row_of(docs), "source", h.alias("h"), "text"), "size bigint", lambda: lambda t: (len(words(t)),))


def cuts(light: DataFrame, budgets: dict[str | None, float]) -> dict[str | None, int]:
    """light (source, h, size), budgets below the source's words -> threshold: the words with h below it come nearest the budget."""
    spark = light.sparkSession
    found = {s: (0, 0) for s in budgets}  # the bucket's leading bits so far, the words before it
    schema = T.StructType([light.schema["source"], T.StructField("prefix", T.LongType()), T.StructField("before", T.LongType()), T.StructField("budget", T.DoubleType())])
    for level in range(LEVELS):
        rows = [(s, p, b, float(budgets[s])) for s, (p, b) in found.items()]
        at = small(spark.createDataFrame(rows, schema).withColumnRenamed("source", "of"), len(rows))
        shift = BITS * (LEVELS - level)
        hist = (
            light.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.shiftrightunsigned("h", shift) == F.col("prefix")))
            .groupBy("of", "before", "budget", F.shiftrightunsigned("h", shift - BITS).alias("bucket")).agg(F.sum("size").alias("size"))
        )
        # at most 4096 buckets in each group
        by = F.expr("sum(size) OVER (PARTITION BY of ORDER BY bucket)")
        crossed = hist.withColumn("upto", F.col("before") + by).where("upto > budget").groupBy("of").agg(F.min_by(F.struct("bucket", "upto", "size"), "bucket").alias("b"))
        for r in crossed.collect():  # a row for each source
            found[r["of"]] = (r["b"]["bucket"], r["b"]["upto"] - r["b"]["size"])
            if level == LEVELS - 1:
                over, under = r["b"]["upto"] - budgets[r["of"]], budgets[r["of"]] - found[r["of"]][1]
                found[r["of"]] = (found[r["of"]][0] + (over < under), 0)
    return {s: p for s, (p, _) in found.items()}


def plan(light: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """light (source, h, size) -> of, source_size, target, once, cut for each source: every document is taken `once` times, those with h < cut once more."""
    sizes = {r["source"]: r["n"] or 0 for r in light.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes, weights, share)
    once = {s: min(math.floor(goal[s] / n), MOST_COPIES) if (n := sizes[s]) else 0 for s in sizes}
    open_ = {s: goal[s] - once[s] * sizes[s] for s in sizes if 0 < goal[s] - once[s] * sizes[s] < sizes[s]}
    cut = cuts(light, open_) if open_ else {}
    schema = T.StructType([T.StructField("of", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("once", T.IntegerType()), T.StructField("cut", T.LongType())])
    rows = [(s, sizes[s], goal[s], once[s], cut.get(s, 0)) for s in sizes]
    return small(light.sparkSession.createDataFrame(rows, schema), len(rows))


def copies() -> Column:
    return F.col("once") + (F.col("h") < F.col("cut")).cast("int")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes from the row, repeats counted) for each row of docs.

    Null and empty texts have size 0. Rows without a source form one. Rows alike in id and text share a hash and are in
    or out together; so do rows of equal hash. The hash depends on nothing else, so reruns agree. No rows: no rows.
    """
    light = kept(sized(docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))).select(F.col("row.doc_id").alias("doc_id"), "source", "h", "size"), "sizes")
    out = light.join(plan(light, weights, share), F.col("source").eqNullSafe(F.col("of")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """The rows of docs that the mix takes, a row taken twice standing there twice; columns as in docs.

    Rows without words (null and empty texts, too) have size 0 and add nothing to a target: they are taken as often as any row
    below their source's threshold, so a source whose target is 0, as it has no words at all, is not in the mix. Rows without
    a source form one; rows alike in id and text are in or out together. No rows: no rows.
    """
    every = kept(sized(docs.withColumn("source", F.col("source").cast("string"))), "sized")
    out = every.join(plan(every.select("source", "h", "size"), weights, share), F.col("source").eqNullSafe(F.col("of")))
    return out.select("row", F.explode(F.array_repeat(F.lit(0), copies()))).select("row.*")


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, 1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
    sum(w) OVER (ORDER BY k DESC) AS free FROM o),
u AS (SELECT CAST(budget AS DOUBLE) AS budget, CAST(free AS DOUBLE) AS free, k FROM c WHERE budget * w / free < 2 * source_size ORDER BY k LIMIT 1),
t AS (SELECT c.source, c.source_size, CASE WHEN u.k IS NULL OR c.k < u.k THEN CAST(2 * c.source_size AS DOUBLE) ELSE c.w * u.budget / u.free END AS target FROM c LEFT JOIN u ON true),
g AS (SELECT *, least(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END, 2) AS once FROM t),
h AS (SELECT source, h, sum(size) AS part FROM d GROUP BY source, h),
r AS (SELECT h.source, h.h, h.part, g.target - g.once * g.source_size AS b, sum(h.part) OVER (PARTITION BY h.source ORDER BY h.h) AS upto FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source),
i AS (SELECT source, h, b > 0 AND (upto <= b OR (upto - part <= b AND upto - b < b - (upto - part))) AS extra FROM r)
SELECT d.doc_id, d.size, g.source_size, g.target, CAST(d.size * (g.once + CASE WHEN i.extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN i ON d.source IS NOT DISTINCT FROM i.source AND d.h = i.h
"""
