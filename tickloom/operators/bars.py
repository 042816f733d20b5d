"""Bars from ticks, wider bars from bars, and order-book analytics by bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.rounding import rounded
from .access import by_time


def start(width: str, column: str = "timestamp") -> Column:
    """The start of the bar, closed at the left, as TIMESTAMP_NTZ."""
    return F.window(column, width)["start"]


def build(ticks: DataFrame, width: str) -> DataFrame:
    """instrument, timestamp, open, high, low, close, volume, n. First and last by time, then sequence number (a missing one first);
    of ticks equal in both any one. Null prices count in n alone, ticks without a time in no bar. Sums combine before the shuffle."""
    return ticks.groupBy("instrument", start(width).alias("timestamp")).agg(F.min_by("ltp", F.when(F.col("ltp").isNotNull(), by_time())).alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", F.when(F.col("ltp").isNotNull(), by_time())).alias("close"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("n"))


def widen(bars: DataFrame, width: str, complete: int | None = None) -> DataFrame:
    """Bars of a larger width; only those of `complete` parts, if that's given."""
    out = bars.groupBy("instrument", start(width).alias("bar")).agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))
    out = out.withColumnRenamed("bar", "timestamp")
    return out if complete is None else out.where(F.col("n") == complete)


def analytics(books: DataFrame, width: str) -> DataFrame:
    """Spread, imbalance, depth and cumulative delta by instrument and bar.

    Ticks with a side without levels have no spread and don't count in its mean; a bar without any has 0. Prices are subtracted as
    decimals. Sides without quantity have no imbalance (0). The running sum restarts each day, so its window holds a day's bars of
    an instrument.
    """
    best = [F.get(side, F.lit(0))["price"].cast("decimal(28, 14)") for side in ("best_5_sell", "best_5_buy")]
    spread = best[0] - best[1]
    depth = F.col("total_buy_qty") + F.col("total_sell_qty")
    imbalance = F.when(depth > 0, (F.col("total_buy_qty") - F.col("total_sell_qty")) / depth).otherwise(0.0)
    none = F.lit(0.0)
    out = books.groupBy("instrument", start(width).alias("timestamp")).agg(
        F.max_by("ltp", by_time()).alias("ltp"),
        rounded(F.coalesce(F.avg(spread).cast("double"), none), 2).alias("avg_spread"),
        rounded(F.coalesce(F.max(spread).cast("double"), none), 1).alias("max_spread"),
        rounded(F.coalesce(F.avg(imbalance), none), 4).alias("imbalance"),
        F.avg("total_buy_qty").cast("bigint").alias("buy_depth"),
        F.avg("total_sell_qty").cast("bigint").alias("sell_depth"),
        F.sum(F.col("total_buy_qty") - F.col("total_sell_qty")).alias("delta"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.withColumn("cum_delta", F.expr("sum(delta) OVER (PARTITION BY instrument, CAST(timestamp AS DATE) ORDER BY timestamp)"))


def wall_counts(books: DataFrame, width: str, least: int = 2000) -> DataFrame:
    """Levels of at least this quantity by instrument, bar and side."""

    def walls(side: str) -> Column:
        return F.sum(F.size(F.filter(F.coalesce(side, F.array()), lambda x: x["quantity"] >= least))).alias(side.replace("best_5", "walls"))

    return books.groupBy("instrument", start(width).alias("timestamp")).agg(walls("best_5_buy"), walls("best_5_sell"))


def levels(books: DataFrame, least: int) -> DataFrame:
    """row (all columns of books), side, place and level for each level of at least this quantity."""
    both = F.array(F.struct(F.lit("BUY").alias("side"), F.col("best_5_buy").alias("levels")), F.struct(F.lit("SELL").alias("side"), F.col("best_5_sell").alias("levels")))
    row = F.struct(*[F.col(f"`{c}`") for c in books.columns if not c.startswith("best_5_")])
    one = books.select(row.alias("row"), F.explode(both).alias("s")).select("row", "s.side", F.posexplode("s.levels").alias("place", "level"))
    return one.where(F.col("level.quantity") >= least)


def _first() -> list[Column]:
    """The order of a bar's levels: their tick's, then the place."""
    return [F.col("row.timestamp"), F.col("row.sequence_number"), F.col("place")]


def walls(books: DataFrame, least: int = 5000) -> DataFrame:
    """The first level of at least this quantity for each instrument, minute, side and price to one decimal. Books without a time
    are in no minute; empty and null sides have no levels."""
    key = levels(books, least).where("row.timestamp IS NOT NULL").select("*", start("1 minute", "row.timestamp").alias("minute"), rounded(F.col("level.price")).alias("price"), F.col("row.instrument").alias("instrument"))
    first = F.struct(*_first(), F.col("level.quantity").alias("quantity"), F.col("row.ltp").alias("ltp"))
    out = key.groupBy("instrument", "minute", "side", "price").agg(F.min(first).alias("f"))
    return out.select("instrument", "minute", "side", "price", "f.quantity", "f.ltp", "f.timestamp")


#: How far a price is followed after a wall, in microseconds.
REACH = 300_000_000


def absorptions(books: DataFrame, least: int = 3000) -> DataFrame:
    """Walls that the price passes within five minutes: the first that qualifies for each instrument, minute, side and price, with
    the tick's time.

    The following prices are ordered.ahead() of the ticks' prices alone; of the books only those with a level of at least this
    quantity are shuffled to them.
    """
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    next_ = ordered.ahead(books.select("instrument", at.alias("_at"), "ltp"), "instrument", "_at", "ltp", REACH).withColumnsRenamed({"low": "_low", "high": "_high"})
    thick = [F.exists(F.coalesce(side, F.array()), lambda x: F.coalesce(x["quantity"] >= least, F.lit(False))) for side in ("best_5_buy", "best_5_sell")]
    some = books.where("timestamp IS NOT NULL").where(thick[0] | thick[1]).withColumn("_at", at)
    each = levels(some.join(next_, ["instrument", "_at"]), least).where("level.price > 0")
    price, buy = F.col("level.price"), F.col("side") == "BUY"
    reached = F.when(buy, F.col("row._low")).otherwise(F.col("row._high"))
    return first_absorptions(each.where(F.when(buy, reached < price).otherwise(reached > price)).withColumn("reached", reached))


def first_absorptions(hits: DataFrame) -> DataFrame:
    """Of hits (row, side, place and level as in levels(), reached) the first of each instrument, minute, side and price to one
    decimal, and how far the price moved beyond it."""
    price = F.col("level.price")
    key = [F.col("row.instrument").alias("instrument"), start("1 minute", "row.timestamp").alias("minute"), "side", rounded(price).alias("wall")]
    first = F.struct(*_first(), rounded(F.col("row.ltp")).alias("price"), F.col("level.quantity").alias("quantity"), rounded(F.col("reached") - price).alias("move"))
    out = hits.groupBy(*key).agg(F.min(first).alias("f"))
    return out.select("instrument", "minute", "side", "wall", "f.price", "f.quantity", "f.move", "f.timestamp", "f.sequence_number", "f.place")


def strip(analytics: DataFrame, counts: DataFrame, absorbed: DataFrame | None = None) -> DataFrame:
    """One row for each instrument: mean of the positive spreads, largest spread, mean imbalance and its bias, walls, and if
    absorbed (instrument, ...) is given how many of its rows. Bars without counts have no walls; halves round to even."""
    both = analytics.join(counts, ["instrument", "timestamp"], "left")
    out = both.groupBy("instrument").agg(
        rounded(F.avg(F.when(F.col("avg_spread") > 0, F.col("avg_spread"))), 2).alias("avg_spread"), F.max("max_spread").alias("max_spread"), rounded(F.avg("imbalance"), 4).alias("imbalance"),
        F.sum(F.coalesce("walls_buy", F.lit(0))).alias("walls_buy"), F.sum(F.coalesce("walls_sell", F.lit(0))).alias("walls_sell"),
    )
    out = out.withColumn("bias", F.when(F.col("imbalance") > 0.02, "BUY").when(F.col("imbalance") < -0.02, "SELL").otherwise("NEUTRAL"))
    if absorbed is None:
        return out
    n = absorbed.groupBy("instrument").agg(F.count(F.lit(1)).alias("absorptions"))
    return out.join(n, "instrument", "left").withColumn("absorptions", F.coalesce("absorptions", F.lit(0)))
