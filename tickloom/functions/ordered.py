"""Positions in long sequences, and windows over them, without a key's whole sequence in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dealt(rows: DataFrame, partitions: int | None, *by: str) -> DataFrame:
    """rows shuffled by key into that many partitions, which Spark doesn't put together again; None: as they are.

    Spark puts partitions together until they hold so many compressed bytes. Keys and times of 12 bytes a row take ten times that
    and more where they are sorted or grouped, so a count that follows from the number of rows is what bounds a task's memory.
    """
    return rows if partitions is None else rows.repartition(partitions, *by)


def numbered(rows: DataFrame, by: str, order: str, bucket: Column, partitions: int | None = None) -> DataFrame:
    """rows with k, their position (from 1) by `order` among those of their key. bucket must not fall as `order` rises.

    Rows are numbered within (key, bucket); what lies in front comes from one count for each of these. Of rows equal in order
    any may be first. partitions: as in dealt().
    """
    each = dealt(rows.withColumn("_bucket", bucket), partitions, by, "_bucket")
    counts = dealt(each.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n")), partitions, by)
    front = counts.withColumn("_front", F.expr(f"coalesce(sum(_n) OVER (PARTITION BY `{by}` ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).drop("_n")
    inside = each.withColumn("_k", F.expr(f"row_number() OVER (PARTITION BY `{by}`, _bucket ORDER BY `{order}`)"))
    return inside.join(front, [by, "_bucket"]).withColumn("k", F.col("_front") + F.col("_k")).drop("_bucket", "_front", "_k")


def parts(rows: DataFrame, before: int, size: int = 10_000) -> DataFrame:
    """numbered() rows dealt into parts of at least `size` positions, each with the `before` rows in front of it too (own is
    false for these): windows by (key, part) over at most that many rows give each own row what windows by key would."""
    size = max(size, before)
    part, later = F.floor((F.col("k") - 1) / size), F.floor((F.col("k") - 1 + before) / size)
    return rows.withColumn("part", F.explode(F.array_distinct(F.array(part, later)))).withColumn("own", F.col("part") == part)


def ahead(rows: DataFrame, by: str, at: str, value: str, reach: int) -> DataFrame:
    """by, at, low, high for each (by, at) of rows: the least and greatest value of its key's rows later than `at` and by at most
    `reach`; null if there are none. at is a whole number; rows without one are left out.

    Time is cut into blocks of `reach`: what is ahead of a row is the rest of its block and the beginning of the next one, so
    running extremes from the end and from the start of each block are enough, and each row is read twice, however many lie
    within reach. A probe in the next block, `reach` later, picks up the second. No window holds more than a block and its probes.
    """
    each = rows.where(f"`{at}` IS NOT NULL").select(F.col(f"`{by}`").alias("_by"), F.col(f"`{at}`").alias("_at"), F.col(f"`{value}`").alias("_x")).groupBy("_by", "_at").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    own = each.select("_by", F.col("_at").alias("_of"), "_at", F.lit(0).alias("_probe"), "_low", "_high")
    nothing = [F.lit(None).cast(each.schema[c].dataType).alias(c) for c in ("_low", "_high")]
    probes = each.select("_by", F.col("_at").alias("_of"), (F.col("_at") + reach).alias("_at"), F.lit(1).alias("_probe"), *nothing)
    both = own.union(probes).withColumn("_block", F.floor(F.col("_at") / reach))
    block = "PARTITION BY _by, _block ORDER BY"
    up, down = f"OVER ({block} _at, _probe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({block} _at DESC, _probe DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    # a probe's block is the one after its row's, so what lies up to it there is ahead of that row; so is what lies behind a row in its own
    found = both.select("_by", "_of", *[F.expr(f"CASE _probe WHEN 1 THEN {f}({c}) {up} ELSE {f}({c}) {down} END AS {c}") for f, c in (("min", "_low"), ("max", "_high"))])
    return found.groupBy("_by", "_of").agg(F.min("_low").alias("low"), F.max("_high").alias("high")).withColumnsRenamed({"_by": by, "_of": at})


def rolling(rows: DataFrame, keys: str, order: str, sums: dict[str, tuple[str, int]]) -> DataFrame:
    """rows with columns of sums over the last rows of their window (keys, by order): name -> (expression, how many rows). Each is the
    difference of two running sums, so its cost doesn't grow with the number of rows; these are of decimals with 20 places, so
    nothing cancels. Null terms count as 0; terms are below 1e17."""
    window = f"PARTITION BY {keys} ORDER BY {order}"
    terms = rows.withColumns({f"_t{k}": F.expr(f"coalesce(CAST({x} AS DECIMAL(38, 20)), 0)") for k, (x, _) in enumerate(sums.values())})
    total = terms.withColumns({f"_s{k}": F.expr(f"sum(_t{k}) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") for k in range(len(sums))})
    less = {name: F.expr(f"CAST(_s{k} - coalesce(lag(_s{k}, {n}) OVER ({window}), 0) AS DOUBLE)") for k, (name, (_, n)) in enumerate(sums.items())}
    return total.withColumns(less).drop(*[f"_{x}{k}" for k in range(len(sums)) for x in "ts"])
