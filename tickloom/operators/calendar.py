"""Trading days as data: holidays and special sessions joined to days, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The exchange's holidays of 2026, and its session on a Sunday.
HOLIDAYS = (
    "2026-01-15", "2026-01-26", "2026-03-03", "2026-03-26", "2026-03-31", "2026-04-03", "2026-04-14", "2026-05-01",
    "2026-05-28", "2026-06-26", "2026-09-14", "2026-10-02", "2026-10-20", "2026-11-10", "2026-11-24", "2026-12-25",
)
SPECIAL = ("2026-02-01",)
#: Minutes without a sign of life after which a service is stale while the market is open.
STALE = {"tick_downloader": 10, "ohlcv_scheduler": 15, "instrument_sync_scheduler": 24 * 60}
#: The session, in minutes of the day.
OPEN, CLOSE = 9 * 60 + 15, 15 * 60 + 30


def trading(day: Column, holidays: Iterable[str] = HOLIDAYS, special: Iterable[str] = SPECIAL) -> Column:
    """Special sessions, and weekdays that are no holidays. Both lists hold some days a year, so they are literals of the plan."""

    def among(days: Iterable[str]) -> Column:
        return F.coalesce(day.isin([F.lit(x).cast("date") for x in days]), F.lit(False)) if days else F.lit(False)

    return among(special) | ((F.weekday(day) < 5) & ~among(holidays))


def days(spark: SparkSession, first: str, last: str, holidays: Iterable[str] = HOLIDAYS, special: Iterable[str] = SPECIAL) -> DataFrame:
    """day, is_trading, covered for each day from first to last; covered says whether the lists have that year."""
    return _told(spark.range(1).select(F.lit(first).cast("date").alias("first"), F.lit(last).cast("date").alias("last")), holidays, special)


def days_of(rows: DataFrame, holidays: Iterable[str] = HOLIDAYS, special: Iterable[str] = SPECIAL) -> DataFrame:
    """days() from the first to the last day of rows' timestamps; none if they have none."""
    return _told(rows.agg(F.to_date(F.min("timestamp")).alias("first"), F.to_date(F.max("timestamp")).alias("last")), holidays, special)


def _told(spans: DataFrame, holidays: Iterable[str], special: Iterable[str]) -> DataFrame:
    years = {int(x[:4]) for x in (*holidays, *special)}
    each = spans.select(F.explode(F.sequence("first", "last")).alias("day"))
    return each.select("day", trading(F.col("day"), holidays, special).alias("is_trading"), F.year("day").isin(*years).alias("covered") if years else F.lit(False).alias("covered"))


def uncovered(first: datetime, last: datetime, holidays: Iterable[str] = HOLIDAYS) -> list[int]:
    """The years from first to last that the list of holidays doesn't have."""
    return sorted({*range(first.year, last.year + 1)} - {int(x[:4]) for x in holidays})


def due_slot(ts: Column, settle: int = 10) -> Column:
    """The five-minute slot whose bar may be fetched at ts, or null: trading days from 09:20 to 15:30, `settle` seconds into the slot's minute."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    good = trading(F.to_date(ts)) & (minute % 5 == 0) & (F.second(ts) >= settle) & minute.between(OPEN + 5, CLOSE)
    return F.when(good, F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute))


def health(seen: DataFrame, now: datetime) -> DataFrame:
    """seen (service, last_seen) with minutes_ago and status: unknown without a last_seen, stale while the market is open
    (both ends included) and a service of STALE has been silent for longer, else ok."""
    at = F.lit(now).cast("timestamp_ntz")
    second = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    open_ = trading(F.to_date(at)) & second.between(OPEN * 60, CLOSE * 60)
    ago = F.timestamp_diff("SECOND", F.col("last_seen"), at) / 60
    allowed = F.create_map(*[F.lit(x) for pair in STALE.items() for x in pair])[F.col("service")]
    status = F.when(F.col("last_seen").isNull(), "unknown").when(open_ & (ago > allowed), "stale").otherwise("ok")
    return seen.select("service", "last_seen", F.round(ago, 1).alias("minutes_ago"), status.alias("status"))


def fetches(instruments: DataFrame, last: DataFrame, now: datetime, minutes: int = 5, days: int = 90, derivative_days: int = 30, chunk: int = 5) -> DataFrame:
    """token, start, end of the requests that fill the bars of instruments (token, expiry, derivative) up to now.

    From the bar after the last stored one (last: token, timestamp), else from `days` before the end, for derivatives at most
    derivative_days; to now, or the end of the day of expiry. Requests are of at most `chunk` days. None where nothing is open,
    spans without a trading day stay, see open_fetches().
    """
    at = F.lit(now).cast("timestamp_ntz")
    end = F.least(at, F.coalesce(F.col("expiry").cast("timestamp_ntz") + F.expr("INTERVAL '0 23:59:59.999999' DAY TO SECOND"), at))
    reach = F.when(F.col("derivative"), F.lit(min(days, derivative_days))).otherwise(F.lit(days))
    cursor = last.groupBy("token").agg(F.max("timestamp").alias("seen"))
    start = F.coalesce(F.col("seen") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), F.col("end") - F.make_dt_interval(reach))
    whole = instruments.join(cursor, "token", "left").withColumn("end", end).withColumn("start", start).where("start < end")
    parts = F.ceil(F.timestamp_diff("SECOND", F.col("start"), F.col("end")) / (chunk * 86400)).cast("int")
    step = F.make_dt_interval(F.col("k") * chunk)
    each = whole.select("token", "start", "end", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("k"))
    return each.select("token", (F.col("start") + step).alias("start"), F.least(F.col("start") + step + F.make_dt_interval(F.lit(chunk)), F.col("end")).alias("end"))


def open_fetches(requests: DataFrame) -> DataFrame:
    """Those of fetches() whose days hold a trading day."""
    return requests.where(F.exists(F.sequence(F.to_date("start"), F.to_date("end")), lambda d: trading(d)))
