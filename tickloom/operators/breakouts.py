"""Breakout studies: six signals a day, their trades in closed form, and what they came to.

A day of one instrument is at most a session of minute bars, so everything is laid out once by (instrument, day) and no
window or group holds more. Days are compared with earlier ones through one row a day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clock:
    """Minutes of the day: when the session opens, both opening ranges end, levels of the day before may be passed, and
    trades are closed (that minute's bar included); the minutes of a confirming candle."""

    open: int = 9 * 60 + 15
    short: int = 9 * 60 + 45
    first: int = 10 * 60 + 15
    levels: int = 9 * 60 + 30
    exit: int = 15 * 60 + 20
    candle: int = 15


#: Share of a range's width that a close must pass it by; points a trade costs; days of a mean range and the share of it that is narrow.
BUFFER, COST, DAYS, NARROW = 0.05, 2.0, 5, 0.5
KEY = ["instrument", "day"]
SIGNAL = [*KEY, "name", "side", "entry", "minute", "start", "stop", "width"]


def laid_out(bars: DataFrame, least: int = 300) -> DataFrame:
    """instrument, day, minute, high, low, close by (instrument, day), of days with at least so many bars. Bars without a
    timestamp or with a null price are left out."""
    each = bars.where("timestamp IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL").select("instrument", F.to_date("timestamp").alias("day"), (F.hour("timestamp") * 60 + F.minute("timestamp")).alias("minute"), "high", "low", "close")
    return each.repartition(*KEY).withColumn("n", F.expr("count(1) OVER (PARTITION BY instrument, day)")).where(F.col("n") >= least).drop("n")


def candles(each: DataFrame, clock: Clock) -> DataFrame:
    """The last close of each candle; minute is the candle's start."""
    start = F.col("minute") - F.col("minute") % clock.candle
    return each.groupBy(*KEY, start.alias("k")).agg(F.max_by("close", "minute").alias("close")).withColumnRenamed("k", "minute")


def levels(each: DataFrame, clock: Clock, buffer: float, flat: bool = False) -> DataFrame:
    """The levels that a day's closes may pass, from one row a day: hi, lo, the minute `begin` they count from, their buffer and
    the mean range of the DAYS days in front (null without so many). FIRST and SHORT are opening ranges, of some width
    unless flat ones count as well, FRONT the high and low of the day in front."""

    def of(f, column: str, end: int) -> Column:
        return f(F.when((F.col("minute") >= clock.open) & (F.col("minute") < end), F.col(column)))

    days = each.groupBy(*KEY).agg(F.max("high").alias("top"), F.min("low").alias("bottom"), *[of(f, c, end).alias(f"{c}_{end}") for end in {clock.first, clock.short} for f, c in ((F.max, "high"), (F.min, "low"))])
    order = "OVER (PARTITION BY instrument ORDER BY day"
    frame = f"{order} ROWS BETWEEN {DAYS} PRECEDING AND 1 PRECEDING)"
    front = days.withColumns({"front_top": F.expr(f"lag(top) {order})"), "front_bottom": F.expr(f"lag(bottom) {order})"), "mean": F.when(F.expr(f"count(1) {frame}") == DAYS, F.expr(f"avg(top - bottom) {frame}"))})

    def level(kind: str, hi: str, lo: str, begin: int, share: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(hi).alias("hi"), F.col(lo).alias("lo"), F.lit(begin).alias("begin"), F.lit(share).alias("buffer"))

    all_ = F.array(*[level(kind, f"high_{end}", f"low_{end}", end, buffer) for kind, end in (("FIRST", clock.first), ("SHORT", clock.short))], level("FRONT", "front_top", "front_bottom", clock.levels, 0.0))
    return front.select(*KEY, "mean", F.explode(all_).alias("x")).select(*KEY, "mean", "x.*").where(F.when(F.lit(flat) | (F.col("kind") == "FRONT"), F.col("hi").isNotNull()).otherwise(F.col("hi") > F.col("lo")))


def passed(each: DataFrame, levels: DataFrame, clock: Clock) -> DataFrame:
    """For each level the day's first candle from `begin` on that closes beyond it: side, entry, minute and the level's hi, lo, mean."""
    wide = F.col("buffer") * (F.col("hi") - F.col("lo"))
    side = F.when(F.col("close") > F.col("hi") + wide, "LONG").when(F.col("close") < F.col("lo") - wide, "SHORT")
    later = candles(each, clock).join(levels, KEY).where((F.col("minute") >= F.col("begin")) & (F.col("minute") < clock.exit)).withColumn("side", side).where("side IS NOT NULL")
    return later.groupBy(*KEY, "kind").agg(F.min(F.struct("minute", "side", F.col("close").alias("entry"), "hi", "lo", "mean")).alias("f")).select(*KEY, "kind", "f.*")


def retested(each: DataFrame, found: DataFrame, clock: Clock) -> DataFrame:
    """The first bar after the confirming candle that comes back to the passed end: entry there, stop half a width beyond."""
    long, half = F.col("side") == "LONG", 0.5 * (F.col("hi") - F.col("lo"))
    back = F.when(long, F.col("low") <= F.col("hi")).otherwise(F.col("high") >= F.col("lo"))
    path = each.where(F.col("minute") <= clock.exit).join(found.withColumnRenamed("minute", "seen"), KEY).where((F.col("minute") >= F.col("seen") + clock.candle) & back)
    first = path.groupBy(*KEY, "side", "hi", "lo").agg(F.min("minute").alias("minute")).withColumn("entry", F.when(long, F.col("hi")).otherwise(F.col("lo")))
    return first.select(*KEY, F.lit("FH_RETEST").alias("name"), "side", "entry", "minute", (F.col("minute") + 1).alias("start"), F.when(long, F.col("entry") - half).otherwise(F.col("entry") + half).alias("stop"), (2 * half).alias("width"))


def signals(each: DataFrame, clock: Clock = Clock(), buffer: float = BUFFER, flat: bool = False) -> DataFrame:
    """The six signals of each instrument and day, as rows of SIGNAL: a trade's path begins where its candle ends (after a
    retest: with the next bar), and unless the name says otherwise its stop is the level's other end."""
    found = passed(each, levels(each, clock, buffer, flat), clock)
    long, width = F.col("side") == "LONG", F.col("hi") - F.col("lo")
    other = F.when(long, F.col("lo")).otherwise(F.col("hi"))

    def made(when: Column, name: str, side: Column = F.col("side"), stop: Column = other) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("name"), side.alias("side"), stop.alias("stop")))

    first = F.col("kind") == "FIRST"
    all_ = F.array_compact(F.array(
        made(first, "FH_BREAK"), made(F.col("kind") == "SHORT", "ORB30"), made(F.col("kind") == "FRONT", "PDH_PDL"), made(first & (width < NARROW * F.col("mean")), "VOL_CONTRACT"),
        made(first, "FH_FADE", F.when(long, "SHORT").otherwise("LONG"), F.when(long, F.col("entry") + 0.5 * width).otherwise(F.col("entry") - 0.5 * width)),
    ))
    each_one = found.select(*KEY, "entry", "minute", width.alias("width"), F.explode(all_).alias("s")).select(*KEY, "s.name", "s.side", "entry", "minute", (F.col("minute") + clock.candle).alias("start"), "s.stop", "width")
    return each_one.unionByName(retested(each, found.where(first), clock))


def trades(each: DataFrame, signals: DataFrame, clock: Clock = Clock(), cost: float = COST, target: Column | None = None) -> DataFrame:
    """The trades of signals: left at the stop, else at the target (if there is one and the stop isn't touched by the same
    bar), else at the last close. Signals whose stop isn't on the losing side, or with no bar after them, make none.

    mfe and mae are the best and worst prices against the entry up to and with the bar of the exit, never below 0.
    """
    long = F.col("side") == "LONG"
    losing = F.when(long, F.col("stop") < F.col("entry")).otherwise(F.col("stop") > F.col("entry"))
    goal = F.lit(None).cast("double") if target is None else target
    path = each.where(F.col("minute") <= clock.exit).withColumnRenamed("minute", "at").join(signals.where(losing).withColumn("target", goal), KEY).where("at >= start")
    hit = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    won = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    whole = "OVER (PARTITION BY instrument, day, name)"
    marked = path.withColumns({"hit": hit, "won": won}).withColumns({"stopped": F.expr(f"min(CASE WHEN hit THEN at END) {whole}"), "reached": F.expr(f"min(CASE WHEN won THEN at END) {whole}")})
    up, down = F.col("high") - F.col("entry"), F.col("entry") - F.col("low")
    seen = marked.where(F.col("at") <= F.coalesce(F.least("stopped", "reached"), F.col("at")))
    one = seen.groupBy(*SIGNAL, "target", "stopped", "reached").agg(F.max_by("close", "at").alias("last"), F.greatest(F.max(F.when(long, up).otherwise(down)), F.lit(0.0)).alias("mfe"), F.greatest(F.max(F.when(long, down).otherwise(up)), F.lit(0.0)).alias("mae"))
    reason = F.when(F.col("stopped") <= F.coalesce("reached", "stopped"), "stop").when(F.col("reached").isNotNull(), "target").otherwise("eod")
    exit_ = F.when(F.col("reason") == "stop", F.col("stop")).when(F.col("reason") == "target", F.col("target")).otherwise(F.col("last"))
    gain = F.when(long, F.col("exit") - F.col("entry")).otherwise(F.col("entry") - F.col("exit")) - cost
    risk = F.abs(F.col("entry") - F.col("stop"))
    out = one.withColumn("reason", reason).withColumn("exit", exit_).withColumns({"pnl": gain, "risk": risk}).withColumn("r", F.col("pnl") / F.col("risk"))
    return out.select("instrument", "day", "name", "side", "minute", "entry", "stop", "exit", "reason", "width", "risk", "pnl", "r", "mfe", "mae")


def suite(bars: DataFrame, clock: Clock = Clock(), least: int = 300) -> DataFrame:
    """The trades of all six signals."""
    each = laid_out(bars, least)
    return trades(each, signals(each, clock), clock)


def first_hour(bars: DataFrame, clock: Clock = Clock(), buffer: float = 0.0, least: int = 300) -> DataFrame:
    """The trades of the first range alone, without costs."""
    each = laid_out(bars, least)
    return trades(each, signals(each, clock, buffer).where("name = 'FH_BREAK'"), clock, cost=0.0)


def periods(trades: DataFrame, split: str) -> DataFrame:
    """Each trade as one of ALL and again as one of PRE or POST, by its day."""
    label = F.when(F.col("day") < F.lit(split).cast("date"), "PRE").otherwise("POST")
    return trades.withColumn("period", F.explode(F.array(F.lit("ALL"), label)))


def _factor(x: str, without: float | None) -> Column:
    """Gains by losses; `without` where nothing was lost."""
    gains, losses = F.sum(F.when(F.col(x) > 0, F.col(x)).otherwise(0)), -F.sum(F.when(F.col(x) <= 0, F.col(x)).otherwise(0))
    return F.round(F.coalesce(F.try_divide(gains, losses), F.lit(without)), 4)


def outcomes(trades: DataFrame, *by: str) -> DataFrame:
    """Trades, wins, points, mean excursions, stops and profit factor (null without losses) of each group."""
    n = F.count(F.lit(1))
    return trades.groupBy(*by).agg(n.alias("n"), F.round(100.0 * F.count_if(F.col("pnl") > 0) / n, 2).alias("win_pct"), F.round(F.sum("pnl"), 4).alias("net"), F.round(F.avg("pnl"), 8).alias("mean"), F.round(F.avg("mfe"), 8).alias("mfe"), F.round(F.avg("mae"), 8).alias("mae"), F.round(100.0 * F.count_if(F.col("reason") == "stop") / n, 2).alias("stop_pct"), _factor("pnl", None).alias("profit_factor"))


def expectancy(trades: DataFrame, *by: str, least: int = 20) -> DataFrame:
    """Wins, mean and sum of R, profit factor (99 without losses) and t of each group with at least so many trades."""
    n, sd = F.count(F.lit(1)), F.stddev_pop("r")
    out = trades.groupBy(*by).agg(n.alias("n"), F.round(100.0 * F.count_if(F.col("r") > 0) / n, 2).alias("win_pct"), F.round(F.avg("r"), 8).alias("mean_r"), F.round(F.sum("r"), 4).alias("sum_r"), _factor("r", 99.0).alias("profit_factor"), F.round(F.avg("r") / F.when(sd > 0, sd).otherwise(1e-9) * F.sqrt(n), 3).alias("t"))
    return out.where(F.col("n") >= least)


def filters(trades: DataFrame, early: int = 11 * 60 + 30, first: int = 10 * 60 + 15) -> DataFrame:
    """What each of nine filters, and none, keeps of an instrument's trades: n, share kept, wins, points, profit factor (99
    without losses). Narrow ranges are below the instrument's median width; an instrument has one width a day."""
    median = trades.groupBy("instrument").agg(F.median("width").alias("median"), F.count(F.lit(1)).alias("base"))
    narrow, soon, short = F.col("width") < F.col("median"), F.col("minute") <= early, F.col("side") == "SHORT"
    kinds = {"none": F.lit(True), "narrow": narrow, "wide": ~narrow, "early": soon, "late": ~soon, "first": F.col("minute") == first, "long": ~short, "short": short, "narrow_early": narrow & soon, "narrow_early_short": narrow & soon & short}
    labels = F.array_compact(F.array(*[F.when(x, F.lit(k)) for k, x in kinds.items()]))
    n = F.count(F.lit(1))
    each = trades.join(median, "instrument").withColumn("filter", F.explode(labels))
    return each.groupBy("instrument", "filter").agg(n.alias("n"), F.round(100.0 * n / F.max("base"), 2).alias("kept_pct"), F.round(100.0 * F.count_if(F.col("pnl") > 0) / n, 2).alias("win_pct"), F.round(F.sum("pnl"), 4).alias("net"), F.round(F.avg("pnl"), 8).alias("mean"), _factor("pnl", 99.0).alias("profit_factor"))
