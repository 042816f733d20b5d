"""Contracts on raw records, whose cells are all text: what a cell must be, before anything is cast.

Findings are rows of instrument, sequence_number, field, code and severity. One pass over the records and no shuffle, except
for rules on their sequence, which validation.py has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import validation


@dataclass(frozen=True)
class Field:
    """A column of a contract. kind is number, whole or time; positive and floor (not negative) hold for present values."""

    name: str
    kind: str = "number"
    required: bool = True
    positive: bool = False
    floor: bool = False


@dataclass(frozen=True)
class Contract:
    name: str
    fields: tuple[Field, ...]
    minutes: int | None = None

    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    def prices(self) -> list[str]:
        return [f.name for f in self.fields if f.positive]


#: The fields of the contracts and the codes of findings.
_PRICES = tuple(Field(x, positive=True) for x in ("open", "high", "low", "close"))
BAR_1M, BAR_5M = (Contract(f"ohlcv_{n}m", (Field("timestamp", "time"), *_PRICES, Field("volume", floor=True)), n) for n in (1, 5))
TICK = Contract(
    "tick",
    (
        Field("timestamp", "time"), Field("ltp", positive=True),
        *[Field(x, required=False, positive=True) for x in ("open", "high", "low", "close", "avg_trade_price")],
        *[Field(x, "whole", required=False, floor=True) for x in ("ltq", "volume", "total_buy_qty", "total_sell_qty", "open_interest")],
    ),
)
CONTRACTS = {c.name: c for c in (BAR_1M, BAR_5M, TICK)}
#: What belongs to the record, not to its contract.
OWN = ("instrument", "sequence_number")
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_TIME = r"^\s*(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)(Z|[+-]\d{2}:?\d{2})?\s*$"


def number(cell: Column) -> Column:
    """The cell as a double; null for null cells and those that are no finite decimal number (also for true and false)."""
    return F.when(cell.rlike(_NUMBER), cell.try_cast("double"))


def moment(cell: Column) -> Column:
    """The ISO-8601 time in the cell as it is written, without its offset; null if there is none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(F.coalesce(cell, F.lit("")), _TIME, 1), F.lit(""))).cast("timestamp_ntz")


def offset(cell: Column) -> Column:
    """The cell's offset from UTC in minutes; null without one."""
    text = F.nullif(F.regexp_extract(F.coalesce(cell, F.lit("")), _TIME, 2), F.lit(""))
    digits = F.regexp_replace(text, "[^0-9]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")
    return F.when(text == "Z", 0).when(text.startswith("-"), -minutes).otherwise(minutes)


def local(cell: Column, minutes: int = 330) -> Column:
    """The cell's time on the exchange's clock, `minutes` ahead of UTC; times without an offset are on that clock already."""
    shift = F.coalesce(F.lit(minutes) - offset(cell), F.lit(0))
    return moment(cell) + F.make_dt_interval(F.lit(0), F.lit(0), shift)


def cells(raw: DataFrame, contract: Contract) -> list[Column]:
    """The contract's columns of raw, cast; those raw lacks are null."""

    def cell(f: Field) -> Column:
        c = F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string")
        return (F.when(offset(c).isNull(), moment(c)) if f.kind == "time" else number(c)).alias(f.name)

    return [cell(f) for f in contract.fields]


def typed(raw: DataFrame, contract: Contract) -> DataFrame:
    """raw with its cells cast; a time with an offset is unreadable (it's reported, not converted), as is what is malformed."""
    return raw.select(*OWN, *cells(raw, contract))


def _rules(raw: DataFrame, contract: Contract) -> list[tuple[str, str, Column]]:
    """(field, code, broken) of the rules on cells alone, over raw's columns beside `_typed`, the cast ones."""
    have, out = set(raw.columns), []
    for f in contract.fields:
        c = F.col(f.name) if f.name in have else F.lit(None).cast("string")
        x = F.col(f"_typed.{f.name}")
        if f.required:
            out.append((f.name, "missing_field", c.isNull()))
        if f.kind == "time":
            out.append((f.name, "malformed_timestamp", c.isNotNull() & moment(c).isNull()))
            out.append((f.name, "timezone_inconsistent", moment(c).isNotNull() & offset(c).isNotNull()))
            continue
        odd = x.isNull() if f.kind == "number" else x.isNull() | (x != F.floor(x))
        out.append((f.name, "unexpected_type", c.isNotNull() & odd))
        if f.positive or f.floor:
            out.append((f.name, "non_positive_price" if f.positive else "negative_value", ~odd & ((x <= 0) if f.positive else (x < 0))))
    known = {f.name for f in contract.fields} | set(OWN)
    return out + [(c, "unknown_field", F.lit(True)) for c in raw.columns if c not in known]


def _values(contract: Contract) -> list[tuple[str, str, Column]]:
    """(field, code, broken) of the rules on a record's cast cells; those with a null cell break none."""
    t = {f.name: F.col(f"_typed.{f.name}") for f in contract.fields}
    session = ("timestamp", "out_of_session", ~validation.in_session("_typed.timestamp"))
    inside = t["high"] >= t["low"]
    if contract.minutes is None:
        return [session, ("high", "ohlc_invariant", ~inside), ("ltp", "ltp_outside_day_range", inside & ~t["ltp"].between(t["low"], t["high"]))]
    whole = t["open"].isNotNull() & t["high"].isNotNull() & t["low"].isNotNull() & t["close"].isNotNull()
    most, least = F.greatest(t["open"], t["close"]), F.least(t["open"], t["close"])
    return [("timestamp", "timestamp_not_aligned", ~validation.aligned(contract.minutes, "_typed.timestamp")), session, ("high", "ohlc_invariant", whole & ~inside), ("high", "ohlc_invariant", whole & (t["high"] < most)), ("low", "ohlc_invariant", whole & (t["low"] > least))]


def findings(raw: DataFrame, contract: Contract) -> DataFrame:
    """All that each record breaks on its own. A column outside the contract is a warning for every record. Empty tables have none."""
    both = raw.withColumn("_typed", F.struct(*cells(raw, contract)))
    rules = _rules(raw, contract) + _values(contract)
    broken = F.array_compact(F.array(*[F.when(x, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))) for field, code, x in rules]))
    return both.select(*OWN, F.explode(broken).alias("x")).select(*OWN, "x.field", "x.code").withColumn("severity", validation.severity(F.col("code"), contract.minutes is None))


def described(spark: SparkSession, contract: Contract) -> DataFrame:
    """field, kind, required and price (whether it must be positive) of a contract's fields."""
    rows = [(f.name, f.kind, f.name in contract.required(), f.name in contract.prices()) for f in contract.fields]
    return spark.createDataFrame(rows, "field string, kind string, required boolean, price boolean")


def by_field(found: DataFrame, contract: Contract) -> DataFrame:
    """findings() by field and code: n, and the field's kind, whether it's required and whether it's a price; null for fields that the
    contract doesn't have."""
    counts = found.groupBy("field", "code").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(described(found.sparkSession, contract)), "field", "left")


def candles(raw: DataFrame, column: str = "candle") -> DataFrame:
    """Positional records [time, open, high, low, close, volume] of text as named ones; cells that aren't there are null."""
    names = ("timestamp", "open", "high", "low", "close", "volume")
    return raw.select(*OWN, *[F.get(column, F.lit(k)).alias(x) for k, x in enumerate(names)])


def quarantine(raw: DataFrame, found: DataFrame) -> DataFrame:
    """Records with an error: instrument, sequence_number, row (the record as JSON, as it came) and its reasons, sorted."""
    why = found.where("severity = 'ERROR'").groupBy(*OWN).agg(F.array_sort(F.collect_set("code")).alias("reasons"))
    return raw.select(*OWN, F.to_json(F.struct(*raw.columns)).alias("row")).join(why, list(OWN))


def write_quarantine(rows: DataFrame, path: str) -> None:
    """Appends quarantine()'s rows to JSON lines below path."""
    rows.withColumn("quarantined_at", F.current_timestamp()).write.mode("append").json(path)
