"""Point-in-time access: windows, as-of reads, latest rows, pages and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_time() -> Column:
    """The order of an instrument's ticks: time, then sequence number, a missing one first. Sequence numbers restart."""
    return F.struct("timestamp", "sequence_number")


def window(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows of start <= timestamp < end; end before start is an error, an empty window isn't."""
    if end < start:
        raise ValueError("the window ends before it starts")
    return rows.where((F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")) & (F.col("timestamp") < F.lit(end).cast("timestamp_ntz")))


def completed(bars: DataFrame, as_of: datetime, width: str) -> DataFrame:
    """Bars that had ended by as_of. The width is taken from the literal, so the filter on timestamp reaches the scan."""
    return bars.where(F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {width}"))


def inclusive(rows: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Rows of start <= timestamp <= end."""
    return rows.where(F.col("timestamp").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def day_window(rows: DataFrame, day: date) -> DataFrame:
    """Rows of a day from 09:00 to 15:35, both included."""
    return inclusive(rows, datetime(day.year, day.month, day.day, 9), datetime(day.year, day.month, day.day, 15, 35))


def latest(rows: DataFrame, by: str = "instrument", order: Sequence[str] = ("timestamp", "sequence_number"), as_of: datetime | None = None) -> DataFrame:
    """The last row of each key by `order` (nulls first), of those up to as_of if it's given; by aggregation, so one row for each key
    and task is shuffled. Of rows equal in all of `order` any one. A null key is one. No rows: no rows."""
    seen = rows if as_of is None else rows.where(F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz"))
    return seen.groupBy(by).agg(F.max_by(F.struct(*[c for c in rows.columns if c != by]), F.struct(*order)).alias("r")).select(by, "r.*")


def as_of(grid: DataFrame, ticks: DataFrame) -> DataFrame:
    """grid (instrument, timestamp) with the last price at or before each time; null if there is none.

    The sides are laid into one sequence for each instrument and day, after the last price of the days before has been
    carried to each day, so no window holds more than a day of an instrument. Ticks go by time, then sequence number, a missing
    one first; null prices are passed over.
    """
    day = F.to_date("timestamp")
    closes = ticks.where("ltp IS NOT NULL").groupBy("instrument", day.alias("day")).agg(F.max_by("ltp", by_time()).alias("close"))
    days = grid.select("instrument", day.alias("day")).distinct().join(closes, ["instrument", "day"], "full")
    before = days.withColumn("opening", F.expr("last(close, true) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")).select("instrument", "day", "opening")
    sides = ticks.select("instrument", "timestamp", "sequence_number", "ltp", F.lit(0).alias("side")).unionByName(grid.select("instrument", "timestamp", F.lit(None).cast("bigint").alias("sequence_number"), F.lit(None).cast("double").alias("ltp"), F.lit(1).alias("side")))
    last = F.expr("last(ltp, true) OVER (PARTITION BY instrument, day ORDER BY timestamp, side, sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    out = sides.withColumn("day", day).withColumn("ltp", last).where("side = 1").join(before, ["instrument", "day"], "left")
    return out.select("instrument", "timestamp", F.coalesce("ltp", "opening").alias("ltp"))


def page(rows: DataFrame, order: list[str], number: int, size: int, newest: bool = False) -> DataFrame:
    """The rows of a page in ascending order; with `newest`, page 1 is the end of the table. Nulls come first; of rows equal in all
    of `order` any may be on either side of a page's end. A page behind the last is empty."""
    by = [F.desc(c) if newest else F.asc(c) for c in order]
    return rows.orderBy(*by).offset((number - 1) * size).limit(size).orderBy(*order)


def paged(rows: DataFrame, order: list[str], number: int, size: int, newest: bool = False) -> DataFrame:
    """page() with the column `total`: how many rows there are on all pages. The count is one row."""
    return page(rows, order, number, size, newest).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


def truncated(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows by order, each with `note`: what was left out, or null if nothing was. One row more than `most` is
    read to know it."""
    top = rows.orderBy(*order).limit(most + 1)
    numbered = top.withColumns({"_k": F.expr(f"row_number() OVER (ORDER BY {', '.join(order)})"), "_n": F.expr("count(1) OVER ()")})
    note = F.when(F.col("_n") > most, f"truncated to the first {most:,} rows; what follows from them covers only these")
    return numbered.where(F.col("_k") <= most).withColumn("note", note).drop("_k", "_n")


def exists_before(rows: DataFrame, cutoff: datetime) -> DataFrame:
    """One row, `found`: whether any row is older than cutoff. Reads until one is found."""
    return rows.where(F.col("timestamp") < F.lit(cutoff).cast("timestamp_ntz")).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


def search(instruments: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Instruments whose symbol holds text, whatever the case, and whose type begins with kind."""
    out = instruments.where(F.col("symbol").ilike(f"%{text}%"))
    return out if kind is None else out.where(F.col("instrument_type").startswith(kind))


def filtered(instruments: DataFrame, kind: str | None = None, exchange: str | None = None, text: str | None = None, active: bool | None = None) -> DataFrame:
    """Instruments that pass all filters given: type, exchange, whether active, and text in symbol or name, whatever the case.
    Null cells pass none."""
    tests = [F.col(c) == x for c, x in (("instrument_type", kind), ("exchange", exchange), ("is_active", active)) if x is not None]
    if text:
        tests.append(F.col("symbol").ilike(f"%{text}%") | F.col("name").ilike(f"%{text}%"))
    return reduce(DataFrame.where, tests, instruments)


def listed(instruments: DataFrame, kinds: Sequence[str] = (), names: Sequence[str] = (), symbols: Sequence[str] = ()) -> DataFrame:
    """Active instruments of these types, names and symbols (whatever the case), each if given; with no list at all, none."""
    tests = [F.col("instrument_type").isin(*kinds)] if kinds else []
    tests += [F.col("name").isin(*names)] if names else []
    tests += [F.upper("symbol").isin(*[x.upper() for x in symbols])] if symbols else []
    return reduce(DataFrame.where, [F.col("is_active"), *tests], instruments) if tests else instruments.limit(0)


def of_symbol(instruments: DataFrame, symbol: str) -> DataFrame:
    """The instruments of a symbol, whatever the case: none, one, or several."""
    return instruments.where(F.upper("symbol") == symbol.upper())


def token_of(instruments: DataFrame, symbol: str | int) -> int:
    """The token of a symbol, the smallest if there are several; a number is one already. LookupError if there is none."""
    if isinstance(symbol, int):
        return symbol
    found = of_symbol(instruments, symbol).agg(F.min("token")).first()[0]
    if found is None:
        raise LookupError(f"no instrument has the symbol {symbol!r}")
    return found


def nearest_future(instruments: DataFrame, name: str, today: str) -> DataFrame:
    """The open future of a name that expires first; of equals that of the smallest token."""
    return instruments.where((F.col("instrument_type") == "FUTIDX") & (F.col("name") == name) & (F.col("expiry") >= F.lit(today).cast("date"))).orderBy("expiry", "token").limit(1)


def with_instrument(rows: DataFrame, instruments: DataFrame, key: str, *columns: str) -> DataFrame:
    """rows with columns of their instrument, joined by `key` to token; rows without one are left out. The list of an exchange's
    instruments is the smaller side, and Spark chooses by its size."""
    return rows.join(instruments.select(F.col("token").alias(key), *columns), key)


def band(instruments: DataFrame, spot: float, step: float, steps: int) -> DataFrame:
    """Instruments of the smallest lot size whose strike is within `steps` of the nearest one to spot."""
    atm = round(spot / step) * step
    near = instruments.where(F.col("strike").between(atm - steps * step, atm + steps * step))
    return near.join(F.broadcast(near.agg(F.min("lot_size").alias("lot_size"))), "lot_size")


def strikes_near(options: DataFrame, spot: float, step: float, steps: int, today: str) -> DataFrame:
    """Options of the first expiry from today on whose strike is within `steps` of the nearest one to spot."""
    atm = round(spot / step) * step
    open_ = options.where(F.col("expiry") >= F.lit(today).cast("date"))
    first = open_.agg(F.min("expiry").alias("expiry"))
    return open_.where(F.col("strike").between(atm - steps * step, atm + steps * step)).join(F.broadcast(first), "expiry").select(*options.columns)
