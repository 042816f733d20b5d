"""Queries over streams: the tables come in ten batches, and what the stream has given at the end is held against SQL on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars
from ..sources import replay, tables
from ..streaming import feed, ordered, sinks, walls
from . import catalogue, records
from .registry import SQL, query

BATCHES = 10


def _tenth(rows: DataFrame) -> Column:
    """Which tenth of the numbers a row's is in."""
    most = rows.agg(F.max("sequence_number")).first()[0] or 0
    return F.expr(f"CAST(sequence_number * {BATCHES} div {most + 1} AS INT)")


def _tenth_of_time(rows: DataFrame) -> Column:
    """Which tenth of the span of `at` a row's is in: whatever its number, no row comes later than the watermark allows."""
    at = F.unix_micros("at")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    return F.expr(f"CAST((unix_micros(at) - {low or 0}) * {BATCHES} div {(high or 0) - (low or 0) + 1} AS INT)")


def _closing(rows: DataFrame, days: int = 1) -> DataFrame:
    """One row of no instrument, some days after the last: it moves the watermark past all others."""
    last = rows.agg(F.max("at").alias("at")).select((F.col("at") + F.make_dt_interval(F.lit(days))).alias("at"))
    nothing = [F.lit("").alias(c) if c == "instrument" else F.col("at") if c == "at" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    return last.select(*nothing)


def _all(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """All rows that a stream gives, each batch stored once."""
    folder = tables.shared_folder(spark)
    sinks.run_available(frame, folder, sinks.batches_at(folder))
    return sinks.stored(spark, folder, frame.schema).drop("batch")


def faulty_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records.faulty_ticks() with the time of arrival, which is that of the tick before it was made faulty."""
    arrived = records.moved(spark, sf_dir).select("instrument", "sequence_number", F.col("timestamp").cast("timestamp").alias("arrived"))
    rows = records.faulty_ticks(spark, sf_dir).join(arrived, ["instrument", "sequence_number"])
    return tables.replayed(spark, rows, _tenth(rows), BATCHES)


@query(SQL["tick_findings"])
def stream_tick_findings(spark, sf_dir):
    """The findings on ticks, rule by rule and in their order, as the ticks come in."""
    return _all(spark, ordered.findings(faulty_stream(spark, sf_dir)))


@query(SQL["absorption_events"])
def stream_absorptions(spark, sf_dir):
    """Walls that the price passes, books and later ticks met in blocks of time."""
    books = catalogue.books(spark, sf_dir).withColumn("at", F.col("timestamp").cast("timestamp"))
    rows = books.drop("timestamp")
    came = tables.replayed(spark, rows.union(_closing(rows)), F.when(F.col("instrument") == "", BATCHES).otherwise(_tenth_of_time(rows)), BATCHES + 1)
    return _all(spark, walls.absorptions(came, came.select("instrument", "ltp", "at"))).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


#: Three hundred times as fast, so that minutes have ticks.
_FAST = "TIMESTAMP '2024-01-01' + to_microseconds((epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-01')) // 300)"
_BAR = "arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, CAST(sum(volume) AS BIGINT) AS volume"


@query(
    f"""WITH {catalogue.TICKS}, one AS (SELECT instrument, time_bucket(INTERVAL 1 MINUTE, {_FAST}) AS timestamp, arg_min(ltp, sequence_number) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, sequence_number) AS close, sum(quantity) AS volume FROM ticks GROUP BY 1, 2),
five AS (SELECT instrument, time_bucket(INTERVAL 5 MINUTES, timestamp) AS timestamp, {_BAR} FROM one GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT instrument, time_bucket(INTERVAL 15 MINUTES, timestamp) AS timestamp, {_BAR} FROM five GROUP BY 1, 2 HAVING count(*) = 3"""
)
def stream_chained_bars(spark, sf_dir):
    """Bars of one, five and fifteen minutes, each from the ones before, in one stream; fives of at least three minutes, fifteens of
    three fives."""
    at = F.expr("timestamp_micros(unix_micros(TIMESTAMP '2024-01-01') + (unix_micros(CAST(timestamp AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01')) div 300)")
    rows = tables.ticks(spark, sf_dir).withColumn("at", at).drop("timestamp")
    came = tables.replayed(spark, rows.union(_closing(rows)), F.when(F.col("instrument") == "", BATCHES).otherwise(_tenth(rows)), BATCHES + 1)
    return _all(spark, walls.widened(came, ((5, 3), (15, 3)))).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


#: Each third tick comes again with another price two numbers later, in the same batch or the next; each seventh is timed on receipt.
_AGAIN = f"""{catalogue.TICKS}, m AS (SELECT max(sequence_number) + 1 AS m FROM ticks), sent AS (SELECT *, sequence_number AS came FROM ticks UNION ALL SELECT instrument, timestamp, sequence_number, ltp + 1 AS ltp, quantity, sequence_number + 2 FROM ticks WHERE sequence_number % 3 = 0),
dealt AS (SELECT sent.*, least(came * {BATCHES} // m, {BATCHES - 1}) AS batch FROM sent, m), first AS (SELECT * FROM dealt QUALIFY row_number() OVER (PARTITION BY instrument, timestamp, sequence_number ORDER BY batch, ltp) = 1)"""


def repeated_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = tables.ticks(spark, sf_dir)
    most = ticks.agg(F.max("sequence_number")).first()[0] or 0
    source = F.when(F.col("sequence_number") % 7 == 0, "received").otherwise("exchange").alias("time_source")
    sent = ticks.select("*", source, F.col("sequence_number").alias("came"))
    rows = sent.union(sent.where("sequence_number % 3 = 0").withColumns({"ltp": F.col("ltp") + 1, "came": F.col("came") + 2}))
    part = F.least(F.expr(f"CAST(came * {BATCHES} div {most + 1} AS INT)"), F.lit(BATCHES - 1))
    return tables.replayed(spark, rows, part, BATCHES).drop("came")


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    folder, came = tables.shared_folder(spark), repeated_stream(spark, sf_dir)
    sinks.run_available(came, folder, sinks.ticks_at(folder))
    return folder, came


@query(f"WITH {_AGAIN} SELECT instrument, timestamp, sequence_number, ltp, quantity FROM first")
def stream_stored_ticks(spark, sf_dir):
    """What a sink holds that stores each tick once, whichever batch brings it again."""
    folder, came = _ingested(spark, sf_dir)
    return sinks.stored(spark, folder, came.schema).select("instrument", "timestamp", "sequence_number", "ltp", "quantity")


@query(
    f"""WITH {_AGAIN}, b AS (SELECT batch, count(*) AS came, count(*) FILTER (WHERE sequence_number % 7 = 0) AS fallbacks FROM dealt GROUP BY 1), i AS (SELECT batch, count(*) AS inserted FROM first GROUP BY 1)
SELECT CAST(batch AS BIGINT) AS batch, coalesce(inserted, 0) AS inserted, came - coalesce(inserted, 0) AS skipped, fallbacks FROM b LEFT JOIN i USING (batch)"""
)
def stream_batch_counts(spark, sf_dir):
    """What each batch came to, counted by the pass that stores it."""
    return sinks.counts(spark, _ingested(spark, sf_dir)[0])


@query(
    f"""WITH {catalogue.TICKS}, n AS (SELECT instrument, timestamp, sequence_number, quantity, round(ltp * 20) AS n FROM ticks), levels AS (SELECT instrument, timestamp, sequence_number, n / 20 AS ltp, i AS place, s.side, CASE WHEN s.side = 'BUY' THEN (n - (i + 1)) / 20 ELSE (n + (i + 1)) / 20 END AS price,
CASE WHEN s.side = 'BUY' THEN quantity * (i + 1) * 20 ELSE quantity * (5 - i) * 20 END AS size FROM n, range(5) r(i), (VALUES ('BUY'), ('SELL')) s(side)), {catalogue._WALLS} SELECT instrument, minute, side, price, quantity, ltp, timestamp FROM first"""
)
def walls_of_twentieths(spark, sf_dir):
    """Walls at prices that are multiples of 0.05, half of which end in 5: their key is Python's round() to one decimal."""
    return bars.walls(tables.twentieths(tables.ticks(spark, sf_dir)))


@query(SQL["feed_ticks"])
def stream_feed_ticks(spark, sf_dir):
    """The feed's packets, recorded in a folder and replayed as a stream, as ticks."""
    lines, path = catalogue.feed_lines(spark, sf_dir), f"{tables.shared_folder(spark)}/packets"
    lines.repartition(4).write.parquet(path)
    out = feed.parsed(feed.packets(replay.stream(spark, path, lines.schema)), catalogue.feed_tokens(spark))
    best = F.get("best_5_buy", F.lit(0))["orders"]
    return _all(spark, out.select("instrument", "timestamp", "sequence_number", "ltp", "time_source", F.size("best_5_buy").cast("bigint").alias("levels"), best.alias("orders")))
