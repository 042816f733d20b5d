"""Upserts, first-wins inserts, activation flags, retention and archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, key: str | list[str], columns: list[str], at: Column | None = None) -> DataFrame:
    """table with `columns` replaced where new has the key (one column or several), and new's other rows; columns not named are kept or
    null. Of several new rows of a key the largest in `columns`, in their order, stands. Keys with a null match none, so such rows of
    new are added, as one for each key. With `at`, rows that new wrote have it as updated_at. Columns of table keep their names,
    whatever they are."""
    keys = [key] if isinstance(key, str) else list(key)
    fresh = new.groupBy(F.struct(*keys).alias("_key")).agg(F.max(F.struct(*columns)).alias("_new"))
    old = table.select(F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("_old"))
    same = reduce(Column.__and__, [F.col(f"_old.`{k}`") == F.col(f"_key.`{k}`") for k in keys])
    both = old.join(fresh, same, "full")
    written = F.col("_new").isNotNull()
    value = {c: F.when(written, F.col("_new").getField(c)).otherwise(F.col("_old").getField(c)) for c in columns}
    value |= {k: F.when(F.col("_old").isNotNull(), F.col("_old").getField(k)).otherwise(F.col("_key").getField(k)) for k in keys}
    if at is not None:
        value["updated_at"] = F.when(written, at).otherwise(F.col("_old").getField("updated_at"))
    return both.select(*[value.get(c, F.col("_old").getField(c)).alias(c) for c in table.columns])


def insert_first(table: DataFrame, new: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The rows of new to append: those whose key the table lacks, the first by arrival of each key."""
    first = new.groupBy(*key).agg(F.min_by(F.struct(*[c for c in new.columns if c not in key]), arrival).alias("r")).select(*key, "r.*")
    return first.join(table.select(*key), key, "left_anti")


def activate(instruments: DataFrame, spot: float, step: int, steps: int) -> DataFrame:
    """instruments with is_active: strikes within `steps` of the nearest one to spot."""
    atm = round(spot / step) * step
    return instruments.withColumn("is_active", F.coalesce(F.col("strike").between(atm - steps * step, atm + steps * step), F.lit(False)))


def activate_daily(instruments: DataFrame, name: str, today: str, spot: float | None, step: int = 50, steps: int = 10) -> DataFrame:
    """instruments (name, symbol, instrument_type, expiry, strike, is_active) with the day's flags, in one pass over a one-row
    minimum: expired ones off; a name's index and its open futures on; its options off but for those of the next expiry within
    `steps` strikes of spot (all off without a spot). The flags of all others stay."""
    day = F.lit(today).cast("date")
    kind, own, open_ = F.col("instrument_type"), F.col("name") == name, F.col("expiry") >= day
    option = (kind == "OPTIDX") & own
    first = instruments.where(option & open_).agg(F.min("expiry").alias("next_expiry"))
    near = F.lit(False)
    if spot is not None:
        atm = round(spot / step) * step
        near = (F.col("expiry") == F.col("next_expiry")) & F.col("strike").between(atm - steps * step, atm + steps * step)
    index = (kind == "AMXIDX") & (own | (F.col("symbol") == name))
    flag = F.when(option, F.coalesce(near, F.lit(False))).when(index | ((kind == "FUTIDX") & own & open_), True).when(F.col("expiry") < day, False).otherwise(F.col("is_active"))
    return instruments.join(F.broadcast(first)).withColumn("is_active", flag).drop("next_expiry")


def split(rows: DataFrame, today: str, keep_days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, old) by the day of timestamp; at least one day is kept."""
    cutoff = F.date_sub(F.lit(today).cast("date"), max(1, keep_days) - 1).cast("timestamp_ntz")
    return rows.where(F.col("timestamp") >= cutoff), rows.where(F.col("timestamp") < cutoff)


def _sums(rows: DataFrame) -> DataFrame:
    """trade_date, n and a sum over hashes of whole rows: equal only if all cells are there."""
    columns = sorted(c for c in rows.columns if c != "trade_date")
    return rows.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum"))


def archive(old: DataFrame, path: str) -> DataFrame:
    """old as Parquet at path, a folder for each day of timestamp (rows without one in a folder of their own).

    Every cell is read back, and its day is verified if rows and hashes agree with what was written. Returns trade_date, n and
    verified; only verified days may be deleted. No rows: no folders and no days.
    """
    dated = old.withColumn("trade_date", F.to_date("timestamp"))
    dated.write.partitionBy("trade_date").option("compression", "snappy").parquet(path)
    back = old.sparkSession.read.schema(dated.schema).parquet(path)
    there = _sums(back).select(F.col("trade_date").alias("day"), F.col("n").alias("n_back"), F.col("sum").alias("sum_back"))
    both = _sums(dated).join(there, F.col("trade_date").eqNullSafe(F.col("day")), "left")
    return both.select("trade_date", "n", F.coalesce((F.col("n") == F.col("n_back")) & F.col("sum").eqNullSafe(F.col("sum_back")), F.lit(False)).alias("verified"))


def purged(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """rows but for those of the verified days (trade_date, verified): a day that isn't verified stays whole. Days are few, and
    their side is the smaller one."""
    gone = verified.where("verified").select(F.col("trade_date").alias("_day"))
    return rows.join(gone, F.to_date("timestamp").eqNullSafe(F.col("_day")), "left_anti")


def compacted(spark: SparkSession, source: str, target: str, rows: int = 5_000_000) -> DataFrame:
    """The table at source, written to target with files of up to `rows` rows, a day after the other; how many files (files) there
    are before and after. The source stays, for whoever reads it."""
    table = spark.read.parquet(source)
    (table.repartition("trade_date") if "trade_date" in table.columns else table).write.option("maxRecordsPerFile", rows).partitionBy(*[c for c in table.columns if c == "trade_date"]).parquet(target)
    read = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(p) for p in (source, target)]
    return read[0].agg(F.count(F.lit(1)).alias("before")).join(read[1].agg(F.count(F.lit(1)).alias("after")))


def cleaned(master: DataFrame) -> DataFrame:
    """A downloaded list of instruments, all text, in its types. Strikes that are no number are null, those of options are in
    hundredths; expiries are like 28NOV2026 or 5JAN2027, others null; lots that are no number are 0; missing names, exchanges and types
    empty."""
    strike = F.col("strike").try_cast("double")
    option = F.col("instrumenttype").isin("OPTIDX", "OPTSTK")
    text = [F.coalesce(F.col(c), F.lit("")).alias(to) for c, to in (("name", "name"), ("exch_seg", "exchange"), ("instrumenttype", "instrument_type"))]
    lot = F.coalesce(F.col("lotsize").try_cast("double").cast("int"), F.lit(0))
    good = F.upper("expiry").rlike("^[0-9]{1,2}[A-Z]{3}[0-9]{4}$")
    expiry = F.to_date(F.try_to_timestamp(F.when(good, F.initcap(F.lower(F.lpad("expiry", 9, "0")))), F.lit("ddMMMyyyy")))
    return master.select(F.col("token").cast("string").alias("token"), "symbol", *text, expiry.alias("expiry"), F.when(option, strike / 100).otherwise(strike).alias("strike"), lot.alias("lot_size"))


#: What a run of a download may have come to.
OUTCOMES = ("success", "no_data", "failed")


def logged(runs: DataFrame) -> DataFrame:
    """runs (token, rows, error) as rows of the log: failed with an error, else no_data without rows, else success."""
    status = F.when(F.col("error").isNotNull(), OUTCOMES[2]).when(F.coalesce("rows", F.lit(0)) == 0, OUTCOMES[1]).otherwise(OUTCOMES[0])
    return runs.select("token", status.alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), F.col("error").alias("message"))


def write_csv(rows: DataFrame, path: str) -> None:
    """rows as CSV with a header line at path; quotes in cells are doubled, null and empty cells differ. A cell like a null's mark
    is written with one more backslash."""
    text = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"}
    cells = [F.regexp_replace(F.col(f"`{c}`"), r"^(\\+N)$", r"\\$1").alias(c) if c in text else F.col(f"`{c}`") for c in rows.columns]
    rows.select(*cells).write.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "\\N").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv() wrote."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("nullValue", "\\N").option("multiLine", True).csv(path)
    text = {f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"}
    return rows.select(*[F.regexp_replace(F.col(f"`{c}`"), r"^\\(\\+N)$", "$1").alias(c) if c in text else F.col(f"`{c}`") for c in rows.columns])
