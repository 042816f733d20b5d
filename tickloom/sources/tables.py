"""The tables as market data: ticks, books, instruments, trades, and faulty records for the validators.

All timestamps are TIMESTAMP_NTZ. An instrument's ticks are ordered by time; of equal timestamps the smaller sequence number
is earlier, a missing one earliest. Sequence numbers restart, so they say nothing about ticks of different times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows to a partition where their number decides.
SHARE = 250_000


def shares(rows: DataFrame) -> int:
    """How many partitions of about SHARE rows hold a table; one a core at least. Parquet's footers have the count."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // SHARE))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, timestamp, sequence_number, ltp, quantity; prices that aren't positive are no ticks."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").where("value > 0").select(F.col("event_type").alias("instrument"), F.col("ts").alias("timestamp"), F.col("event_id").alias("sequence_number"), F.col("value").alias("ltp"), k.alias("quantity"))


def books(ticks: DataFrame) -> DataFrame:
    """ticks with five levels to each side (array of price, quantity, orders) and the sides' totals."""

    def side(step: str, size: str) -> Column:
        return F.expr(f"transform(sequence(0, 4), i -> struct(ltp {step} 0.05D * (i + 1) AS price, quantity * {size} * 20 AS quantity, i + 1 AS orders))")

    return ticks.withColumns({"best_5_buy": side("-", "(i + 1)"), "best_5_sell": side("+", "(5 - i)"), "total_buy_qty": F.col("quantity") * 100, "total_sell_qty": F.col("quantity") % 7 * 150})


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, symbol, instrument_type, strike, lot_size. Symbols need not be unique."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("token"), F.col("p_name").alias("symbol"), F.col("p_type").alias("instrument_type"), F.col("p_retailprice").alias("strike"), F.col("p_size").alias("lot_size"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, strategy, entry_time, pnl: what an order's price is above or below 150,000, in whole units."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"), F.col("o_orderstatus").alias("strategy"), F.col("o_orderdate").alias("entry_time"), (F.floor("o_totalprice") - 150000).cast("bigint").alias("pnl"))


def restarted(ticks: DataFrame) -> DataFrame:
    """ticks whose sequence numbers restart again and again, against the order of time, and are missing for some."""
    n = F.col("sequence_number")
    return ticks.withColumn("sequence_number", F.when(n % 13 != 0, (n * 7) % 101))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token, symbol, name, exchange, instrument_type, expiry, strike, lot_size, is_active: the parts as a list of instruments."""
    n = F.col("p_partkey")

    def of(*values: str | None) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), (n % len(values) + 1).cast("int"))

    return table(spark, sf_dir, "part").select(
        n.alias("token"), F.concat_ws("-", "p_name", n).alias("symbol"), F.col("p_brand").alias("name"), of("NSE", "NFO", "BSE", "MCX", "NCX").alias("exchange"), of("OPTIDX", "FUTIDX", "AMXIDX", "").alias("instrument_type"),
        F.when(n % 7 != 0, F.date_add(F.lit("2026-09-01").cast("date"), (n % 40).cast("int"))).alias("expiry"), F.col("p_retailprice").alias("strike"), F.col("p_size").alias("lot_size"), (n % 3 != 0).alias("is_active"),
    )


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that all machines share; a local one only on a local master, where no other machine is."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = "file:///tmp/checkpoints/tickloom"
    return f"{base.rstrip('/')}/tickloom-{uuid.uuid4().hex}"


def replayed(spark: SparkSession, rows: DataFrame, part: Column, parts: int) -> DataFrame:
    """rows as a stream that comes in `parts` batches, those of part 0 first: for queries that show what a stream gives. Each part is one
    file, as a source tells files apart by their times alone."""
    folder = shared_folder(spark)
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(f"{folder}/parts")
    whole = spark.read.parquet(f"{folder}/parts")
    for k in range(parts):
        whole.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(f"{folder}/came")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/came")


def twentieths(ticks: DataFrame) -> DataFrame:
    """books() of ticks whose prices are multiples of 0.05, as an exchange's are; each the double nearest to its multiple."""
    n = F.round(F.col("ltp") * 20)

    def side(sign: int) -> Column:
        quantity = lambda i: F.col("quantity") * ((i + 1) if sign < 0 else (5 - i)) * 20
        return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct(((n + sign * (i + 1)) / 20).alias("price"), quantity(i).alias("quantity"), (i + 1).alias("orders")))

    return ticks.select(*[c for c in ticks.columns if c != "ltp"], (n / 20).alias("ltp"), side(-1).alias("best_5_buy"), side(1).alias("best_5_sell"))
