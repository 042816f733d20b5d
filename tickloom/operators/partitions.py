"""Tables of the catalog by partition: days dropped once they are verified, days compacted in place, and merges that rewrite only what
a batch touches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from . import upkeep

#: Partitions of a table by key.
BUCKETS = 64


def database(spark: SparkSession) -> str:
    """A new database whose tables lie in the shared folder and are the catalog's own: what it drops is deleted."""
    name = f"tickloom_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark)}'")
    return name


def created(rows: DataFrame, table: str, by: str) -> None:
    """table (database.name) with rows, partitioned by the column `by`."""
    rows.repartition(by).write.partitionBy(by).saveAsTable(table)


def listed(spark: SparkSession, table: str) -> list[str]:
    """The partitions that the catalog lists, as column=value, sorted."""
    return sorted(r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect())


def staged(rows: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """rows written to the shared folder and read again, by another session if one is given."""
    path = f"{shared_folder(rows.sparkSession)}/staged"
    rows.write.parquet(path)
    return (spark or rows.sparkSession).read.schema(rows.schema).parquet(path)


def replace(rows: DataFrame, table: str, most: int = 0) -> None:
    """Writes rows over the partitions that they have, in files of up to `most` rows if that's given; all others, and their files, stay.
    rows may come from the table itself: they are staged first. The mode is set in a session of its own, so no other write of the
    caller's gets it."""
    spark = rows.sparkSession
    other = spark.newSession()
    other.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    by = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    mine = staged(rows.select(*spark.table(table).columns), other).repartition(*by)
    mine.write.option("maxRecordsPerFile", most).insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)


def drop_days(spark: SparkSession, table: str, verified: DataFrame, by: str = "trade_date") -> list[str]:
    """Drops the partitions of the verified days (trade_date, verified) and deletes their files; returns them. A day that isn't verified
    stays, and so does one that has more rows by now than were archived (n): it came in meanwhile. A null day is never dropped."""
    now = spark.table(table).groupBy(F.col(by).alias("_day")).agg(F.count(F.lit(1)).alias("_now"))
    sure = verified.where("verified").join(now, F.col("trade_date") == F.col("_day")).where("n = _now").select("trade_date")
    days = sorted(str(r.trade_date) for r in sure.collect())
    for day in days:
        spark.sql(f"ALTER TABLE {table} DROP PARTITION ({by} = DATE'{day}')")
    return days


def retain(spark: SparkSession, table: str, today: str, keep_days: int, path: str) -> DataFrame:
    """Archives the days of table (timestamp, ..., trade_date) before the last keep_days at path, verifies them and drops those that
    are; returns the archive's days, rows and verdicts."""
    _, old = upkeep.split(spark.table(table).drop("trade_date"), today, keep_days)
    done = staged(upkeep.archive(old, path))
    drop_days(spark, table, done)
    return done


def compact(spark: SparkSession, table: str, by: str = "trade_date", rows: int = 5_000_000) -> DataFrame:
    """Rewrites the partitions of more than one file, in files of up to `rows` rows; returns partition and files before. The others stay
    as they are."""
    files = spark.table(table).select(by, F.input_file_name().alias("file")).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("files")).where("files > 1")
    many = staged(files)
    if not many.isEmpty():
        replace(spark.table(table).join(many.select(by), by), table, rows)
    return many


def bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    """Which partition a key belongs to; nulls hash like values."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def keyed(rows: DataFrame, table: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """table with rows and updated_at, partitioned by bucket()."""
    stamp = rows.columns if "updated_at" in rows.columns else [*rows.columns, F.lit(None).cast("timestamp_ntz").alias("updated_at")]
    created(rows.select(*stamp, bucket(keys, buckets).alias("bucket")), table, "bucket")


def merge(spark: SparkSession, table: str, new: DataFrame, keys: list[str], columns: list[str], at: Column, buckets: int = BUCKETS) -> int:
    """upkeep.upsert() of new into a keyed() table, with `at` as updated_at of the rows that new wrote. Only the partitions of new's keys
    are read and written over; their number is returned. Of the table's own rows of one key, all get the new values."""
    own = staged(new.select(*keys, *columns).withColumn("bucket", bucket(keys, buckets)))
    touched = [r.bucket for r in own.select("bucket").distinct().collect()]
    if touched:
        old = spark.table(table).where(F.col("bucket").isin(touched))
        merged = upkeep.upsert(old.drop("bucket"), own.drop("bucket"), keys, columns, at)
        replace(merged.withColumn("bucket", bucket(keys, buckets)), table)
    return len(touched)
