"""Sinks that hold each batch once, whatever is repeated after a failure, and what a batch came to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import ticks as stream

#: A batch's row in counts().
COUNTS = "batch bigint, inserted bigint, skipped bigint, fallbacks bigint"


def run_available(frame: DataFrame, folder: str, store: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Hands the batches of all that frame's source holds now to store(batch, number), and ends. The place reached is kept in folder, so
    a later run goes on after it; a batch that failed on the way is handed over again under its number."""
    query = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(store).start()
    query.awaitTermination()


def batches_at(folder: str) -> Callable[[DataFrame, int], None]:
    """A store that writes each batch to its own folder, in place of what an earlier attempt at it left."""

    def store(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n:09d}")

    return store


def stored(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """All rows of batches_at() or ticks_at() so far, with `batch`; none before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(StructType([*schema.fields]).add("batch", "integer")).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def ticks_at(folder: str) -> Callable[[DataFrame, int], None]:
    """A store of ticks (instrument, timestamp, sequence_number, time_source, ...) that appends those whose key no earlier batch holds,
    the first of each, in a folder by batch and day. What the batch came to is counted by the pass that writes: inserted, skipped
    (its other ticks), and fallbacks (ticks timed by neither of the feed's clocks).

    Only the days of the batch are read of what is stored. An attempt that is repeated replaces its own folder and doesn't see itself.
    """

    def store(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        came, new = Observation("came"), Observation("new")
        dated = batch.withColumn("trade_date", F.to_date("timestamp"))
        days = [r.trade_date for r in dated.select("trade_date").distinct().collect()]
        there = stored(spark, folder, dated.schema).where(F.col("batch") < n)
        near = there.where(F.col("trade_date").isin([d for d in days if d]) | (F.col("trade_date").isNull() if None in days else F.lit(False)))
        counted = dated.observe(came, F.count(F.lit(1)).alias("ticks"), F.count_if(F.col("time_source") == "received").alias("fallbacks"))
        fresh = stream.append_new(counted, near).observe(new, F.count(F.lit(1)).alias("ticks"))
        fresh.write.mode("overwrite").partitionBy("trade_date").parquet(f"{folder}/rows/batch={n:09d}")
        all_, own = came.get, new.get
        row = (n, own["ticks"], all_["ticks"] - own["ticks"], all_["fallbacks"])
        spark.createDataFrame([row], COUNTS).write.mode("overwrite").parquet(f"{folder}/counts/batch={n:09d}")

    return store


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """batch, inserted, skipped, fallbacks: a row for each batch that ticks_at() stored."""
    return spark.read.schema(COUNTS.replace("batch bigint, ", "")).option("basePath", f"{folder}/counts").parquet(f"{folder}/counts").select(F.col("batch").cast("bigint").alias("batch"), "inserted", "skipped", "fallbacks")
