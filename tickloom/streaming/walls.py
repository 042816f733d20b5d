"""Walls and what becomes of them while ticks come in: a join of two streams by an interval of time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.rounding import rounded
from ..operators import bars


def extremes(at: np.ndarray, times: np.ndarray, prices: np.ndarray, end: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest price later than each of `at` and by at most `reach`; NaN if there is none. All of `at` lie before `end`
    and at most `reach` before it: what is ahead is the rest up to there, and the beginning of what follows. Of prices that are
    NaN the greatest is NaN, as for Spark."""
    order = np.argsort(times, kind="stable")
    times, prices = times[order], prices[order]
    cut = int(np.searchsorted(times, end))
    behind, until = np.searchsorted(times[:cut], at, side="right"), np.searchsorted(times[cut:], at + reach, side="right")
    some = (behind < cut) | (until > 0)
    out = []
    # where one of the two has no tick, what stands there loses against every price
    for f, least in ((np.fmin, np.inf), (np.maximum, -np.inf)):
        rest = np.append(f.accumulate(prices[:cut][::-1])[::-1], least)
        begun = np.append(least, f.accumulate(prices[cut:]))
        out.append(np.where(some, f(rest[behind], begun[until]), np.nan))
    return out[0], out[1]


@F.pandas_udf(StructType().add("low", ArrayType(DoubleType())).add("high", ArrayType(DoubleType())))
def _ahead(at: pd.Series, times: pd.Series, prices: pd.Series, end: pd.Series) -> pd.DataFrame:
    found = [extremes(np.asarray(a, np.int64), np.asarray(t, np.int64), np.asarray(p, float), e, bars.REACH) for a, t, p, e in zip(at, times, prices, end)]
    return pd.DataFrame({"low": [x for x, _ in found], "high": [x for _, x in found]})


def absorptions(books: DataFrame, ticks: DataFrame, late: str = "1 minute", least: int = 3000) -> DataFrame:
    """bars.absorptions() of a stream of books and one of ticks (instrument, ltp), each with `at`, an event time: the walls that the
    price passes within five minutes, the first of each instrument, minute, side and price to one decimal, once these five minutes
    can get no more rows.

    An instrument's time is cut into blocks of five minutes: the walls of a block and the ticks of it and the next one are a row of
    state, which goes as the watermark passes the second. A tick is in two such rows, however many walls there are, and no wall meets
    ticks one by one. What comes more than `late` behind that is lost.
    """
    each = bars.levels(books.withWatermark("at", late), least).where("level.price > 0")
    wall = F.struct(F.col("row.at").alias("wall_at"), F.col("row.sequence_number").alias("sequence_number"), "place", "side", F.col("row.ltp").alias("ltp"), "level.quantity", "level.price")
    left = each.select(F.col("row.instrument").alias("instrument"), F.col("row.at").alias("at"), wall.alias("wall"))
    # no filter here: it would move below the watermark, and rows without a price move that, too
    tick = F.when(F.col("ltp").isNotNull(), F.struct(F.unix_micros("at").alias("at"), "ltp")).alias("tick")
    both = left.unionByName(ticks.withWatermark("at", late).select("instrument", "at", tick), allowMissingColumns=True)
    reach = F.make_dt_interval(secs=F.lit(bars.REACH / 1e6))
    span, block = f"{2 * bars.REACH // 10**6} seconds", f"{bars.REACH // 10**6} seconds"
    dealt = both.withColumn("w", F.window("at", span, block)).where(F.col("wall").isNull() | (F.col("at") < F.col("w.start") + reach))
    met = dealt.groupBy("w", "instrument").agg(F.collect_list("wall").alias("walls"), F.collect_list("tick").alias("ticks")).where((F.size("walls") > 0) & (F.size("ticks") > 0) & F.col("instrument").isNotNull())
    at = F.transform("walls", lambda x: F.unix_micros(x["wall_at"]))
    found = met.withColumn("x", _ahead(at, F.col("ticks.at"), F.col("ticks.ltp"), F.unix_micros(F.col("w.start") + reach)))
    hits = found.select("w", "instrument", F.explode(F.arrays_zip("walls", F.col("x.low").alias("low"), F.col("x.high").alias("high"))).alias("x")).select("w", "instrument", "x.walls.*", "x.low", "x.high")
    buy = F.col("side") == "BUY"
    passed = hits.where(F.when(buy, F.col("low") < F.col("price")).otherwise(F.col("high") > F.col("price")))
    first = F.struct("wall_at", "sequence_number", "place", "ltp", "quantity", "price", F.when(buy, F.col("low")).otherwise(F.col("high")).alias("reached"))
    key = [F.date_trunc("minute", "wall_at").alias("minute"), "side", rounded(F.col("price")).alias("wall")]
    out = passed.groupBy("w", "instrument", *key).agg(F.min(first).alias("f"))
    return out.select("instrument", "minute", "side", "wall", rounded(F.col("f.ltp")).alias("price"), "f.quantity", rounded(F.col("f.reached") - F.col("f.price")).alias("move"))


def widened(ticks: DataFrame, widths: tuple[tuple[int, int], ...], late: str = "1 minute") -> DataFrame:
    """Bars of bars of a stream of ticks (instrument, at, sequence_number, ltp, quantity): from one-minute bars to each width in turn,
    given as (minutes, the bars of the width before that it must have); incomplete ones are dropped. Each level waits for the one
    before: a bar comes out once the watermark has passed its end."""
    order = F.struct(F.col("at"), F.col("sequence_number"))
    one = ticks.withWatermark("at", late).groupBy(F.window("at", "1 minute").alias("w"), "instrument")
    out = one.agg(F.min_by("ltp", order).alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", order).alias("close"), F.sum("quantity").alias("volume"))
    for minutes, parts in widths:
        wider = out.select("*", F.window_time("w").alias("end")).drop("w").groupBy(F.window("end", f"{minutes} minutes").alias("w"), "instrument")
        out = wider.agg(
            F.min_by("open", "end").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "end").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n")
        ).where(F.col("n") >= parts).drop("n")
    return out.select("instrument", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")
