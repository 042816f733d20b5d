"""Ticks as a stream: event time, deduplication within a watermark, and bars."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation
from ..operators.access import by_time

#: How late a tick may come.
LATE = "10 seconds"


def event_time(exchange_ms: Column, traded_s: Column, received: Column) -> Column:
    """The first usable clock as a struct of time (NTZ, +05:30) and source; zero, negative and null clocks aren't usable."""

    def local(micros: Column) -> Column:
        return F.timestamp_micros(micros + 19_800_000_000).cast("timestamp_ntz")

    return F.when(exchange_ms > 0, F.struct(local(exchange_ms * 1000).alias("time"), F.lit("exchange").alias("source"))).when(traded_s > 0, F.struct(local(traded_s * 1_000_000).alias("time"), F.lit("last_traded").alias("source"))).otherwise(F.struct(received.alias("time"), F.lit("received").alias("source")))


def deduplicated(stream: DataFrame, late: str = LATE) -> DataFrame:
    """The first of the ticks alike in instrument, time and sequence number; keys are forgotten after the watermark."""
    return stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["instrument", "timestamp", "sequence_number"])


def stream_bars(stream: DataFrame, width: str, late: str = LATE) -> DataFrame:
    """bars.build() of a stream. A tick is late if its bar ended before the watermark that the batch before began with: the latest
    time seen until then, less `late`. Late ticks are dropped. Within a batch and the next one none is late."""
    bar = stream.withWatermark("timestamp", late).groupBy("instrument", F.window("timestamp", width).alias("w"))
    out = bar.agg(F.min_by("ltp", by_time()).alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", by_time()).alias("close"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("n"))
    return out.select("instrument", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume", "n")


def in_hours(ticks: DataFrame) -> DataFrame:
    """The ticks of trading sessions; a filter by event time, so a stream and a table give the same."""
    return ticks.where(validation.in_session())


def append_new(ticks: DataFrame, table: DataFrame, key: tuple[str, ...] = ("instrument", "timestamp", "sequence_number")) -> DataFrame:
    """The ticks to append to table: one of each key that it lacks. Keys with a null are compared like others."""
    first = ticks.groupBy(*key).agg(F.min(F.struct(*[c for c in ticks.columns if c not in key])).alias("r")).select(*key, "r.*")
    there = table.select(*[F.col(c).alias(f"_{c}") for c in key])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
    return first.join(there, same, "left_anti").select(*ticks.columns)


def bars_available_now(spark: SparkSession, stream: DataFrame, width: str, folder: str) -> DataFrame:
    """The bars of all that a stream holds now, updated batch by batch in a table below folder; the last update of a bar holds."""
    run = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def store(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{run}/bars/batch={n:09d}")

    query = stream_bars(stream, width).writeStream.outputMode("update").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()
    bars = spark.read.parquet(f"{run}/bars/batch=*")
    rest = [c for c in bars.columns if c not in ("instrument", "timestamp", "batch")]
    return bars.groupBy("instrument", "timestamp").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("instrument", "timestamp", "r.*")
