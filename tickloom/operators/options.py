"""Option chains, histories of implied volatility, and the premium over realised volatility.

options: token, name, strike, expiry (date), kind (CE or PE). closes: token, timestamp, close. underlying: name, timestamp,
close. Rows of equal key and timestamp: the larger close stands. A volatility that no price has is null.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from . import access, volatility

#: Bars of the realised volatility.
WINDOW = 5 * 75


def solved(rows: DataFrame) -> DataFrame:
    """rows (close, spot, strike, expiry, timestamp, kind) with iv, a fraction of 1."""
    years = volatility.years_to(F.col("expiry"), F.to_date("timestamp"))
    good = F.when((F.col("close") > 0) & (F.col("spot") > 0) & (F.col("strike") > 0), F.col("close"))
    iv = volatility.implied_vol(F.coalesce("spot", F.lit(0.0)), F.coalesce("strike", F.lit(0.0)), F.coalesce(years, F.lit(0.0)), F.coalesce(good, F.lit(0.0)), F.coalesce(F.col("kind") == "CE", F.lit(False)))
    return rows.withColumn("iv", F.nanvl(iv, F.lit(None).cast("double")))


def last_closes(closes: DataFrame, by: str, as_of: datetime) -> DataFrame:
    """The last close of each key at or before as_of, of those that have one."""
    seen = closes.where(F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz"))
    return seen.groupBy(by).agg(F.max(F.struct("timestamp", "close")).alias("r")).select(by, "r.timestamp", "r.close")


def chain(options: DataFrame, closes: DataFrame, underlying: DataFrame, as_of: datetime) -> DataFrame:
    """name, expiry, strike with the last close and the volatility in percent of its call and its put, as of a time.

    Time to expiry counts from as_of; expired options are left out. Of several options alike the largest token stands.
    """
    spot = last_closes(underlying, "name", as_of).select("name", F.col("close").alias("spot"))
    rows = options.where(F.col("expiry") >= F.lit(as_of.date())).join(last_closes(closes, "token", as_of), "token").join(spot, "name").withColumn("timestamp", F.lit(as_of).cast("timestamp_ntz"))
    each = solved(rows).withColumn("x", F.struct("token", "close", F.round(F.col("iv") * 100, 2).alias("iv")))

    def of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("x"))).alias(kind)

    out = each.groupBy("name", "expiry", "strike").agg(of("CE"), of("PE"))
    return out.select("name", "expiry", "strike", F.col("CE.close").alias("ce_close"), F.col("CE.iv").alias("ce_iv"), F.col("PE.close").alias("pe_close"), F.col("PE.iv").alias("pe_iv"))


def at_the_money(options: DataFrame, closes: DataFrame, underlying: DataFrame, as_of: datetime, step: int = 50, expiries: int = 5) -> DataFrame:
    """By name: spot, the strike nearest to it, the next expiries that have closes, and the strikes of the first of them.

    The lists are of an exchange's listed strikes and of `expiries` dates, not of its bars.
    """
    spot = last_closes(underlying, "name", as_of).select("name", F.col("close").alias("spot"), volatility.nearest_strike(F.col("close"), step).alias("atm"))
    traded = options.where(F.col("expiry") >= F.lit(as_of.date())).join(closes.select("token").distinct(), "token", "left_semi").select("name", "expiry", "strike").distinct()
    dates = traded.groupBy("name", "expiry").agg(F.array_sort(F.collect_set("strike")).alias("strikes"))
    next_ = dates.groupBy("name").agg(F.slice(F.array_sort(F.collect_list("expiry")), 1, expiries).alias("expiries"), F.min_by("strikes", "expiry").alias("strikes"))
    return spot.join(next_, "name")


def history(options: DataFrame, closes: DataFrame, underlying: DataFrame, partitions: int | None = None) -> DataFrame:
    """token, timestamp, close, spot, iv of the bars whose underlying has one of the same time; none without a volatility. partitions:
    as in premium()."""
    spots = ordered.dealt(underlying, partitions, "name", "timestamp").groupBy("name", "timestamp").agg(F.max("close").alias("spot"))
    bars = ordered.dealt(closes, partitions, "token").groupBy("token", "timestamp").agg(F.max("close").alias("close"))
    rows = ordered.dealt(bars.join(options, "token"), partitions, "name", "timestamp").join(spots, ["name", "timestamp"])
    return solved(rows).where("iv IS NOT NULL").select("token", "timestamp", "close", "spot", "iv")


def premium(options: DataFrame, closes: DataFrame, underlying: DataFrame, n: int = WINDOW, method: str = "garman_klass", partitions: int | None = None) -> DataFrame:
    """instrument (the option's token), timestamp, close, iv, rv of the last n bars that both have, and vrp = iv - rv.

    underlying has open, high and low too. rv and vrp are null until there are n bars; iv where no volatility fits. partitions:
    into how many the bars are dealt for groups, joins and numbers, as in ordered.dealt().
    """
    spots = ordered.dealt(underlying, partitions, "name", "timestamp").groupBy("name", "timestamp").agg(F.max(F.struct("close", "open", "high", "low")).alias("u"))
    bars = ordered.dealt(closes, partitions, "token").groupBy("token", "timestamp").agg(F.max("close").alias("paid"))
    named = ordered.dealt(bars.join(options, "token"), partitions, "name", "timestamp")
    both = named.join(spots, ["name", "timestamp"]).select("token", "timestamp", "strike", "expiry", "kind", "paid", "u.*")
    each = volatility.placed(both, n, by="token", partitions=partitions)
    rv = volatility.estimated(each, n, by="_key").where("own").withColumn("rv", volatility.by_name(method)).drop("_key", "k", "part", "own", "ret", *volatility.METHODS)
    rows = solved(rv.withColumnRenamed("close", "spot").withColumnRenamed("paid", "close"))
    return rows.select(F.col("token").alias("instrument"), "timestamp", "close", "expiry", "iv", "rv", (F.col("iv") - F.col("rv")).alias("vrp"))


def nearest_band(options: DataFrame, name: str, spot: float, today: str, step: int = 50, steps: int = 10) -> DataFrame:
    """A name's options of the next expiry within `steps` strikes of the one nearest to spot."""
    return access.strikes_near(options.where(F.col("name") == name), spot, step, steps, today)
