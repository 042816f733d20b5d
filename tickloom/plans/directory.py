"""Queries over the list of instruments, logs, trades, pages, sinks and retention, with their SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, breakouts, calendar, studies, upkeep
from ..sources import tables
from ..streaming import feed
from . import catalogue
from .registry import query

LISTING = """listing AS (SELECT p_partkey AS token, p_name || '-' || p_partkey AS symbol, p_brand AS name, ['NSE', 'NFO', 'BSE', 'MCX', 'NCX'][p_partkey % 5 + 1] AS exchange, ['OPTIDX', 'FUTIDX', 'AMXIDX', ''][p_partkey % 4 + 1] AS instrument_type,
CASE WHEN p_partkey % 7 <> 0 THEN DATE '2026-09-01' + CAST(p_partkey % 40 AS INTEGER) END AS expiry, p_retailprice AS strike, p_size AS lot_size, p_partkey % 3 <> 0 AS is_active FROM part)"""


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("expiry", F.col("expiry").cast("string"))


_ALL = "token, symbol, name, exchange, instrument_type, CAST(expiry AS VARCHAR) AS expiry, strike, lot_size, is_active"


@query(f"WITH {LISTING} SELECT {_ALL} FROM listing WHERE upper(symbol) = (SELECT upper(symbol) FROM listing WHERE token = 17)")
def instrument_of_symbol(spark, sf_dir):
    """A symbol typed in another case."""
    some = tables.listing(spark, sf_dir)
    symbol = some.where("token = 17").first()["symbol"]
    return _dated(some.where(F.col("token") == access.token_of(some, symbol.swapcase())))


@query(f"WITH {LISTING}, f AS (SELECT * FROM listing WHERE instrument_type = 'FUTIDX' AND exchange = 'NFO' AND (symbol ILIKE '%A%' OR name ILIKE '%A%') AND is_active) SELECT {_ALL}, (SELECT count(*) FROM f) AS total FROM f ORDER BY instrument_type, f.symbol, token LIMIT 20 OFFSET 20")
def instrument_page(spark, sf_dir):
    found = access.filtered(tables.listing(spark, sf_dir), kind="FUTIDX", exchange="NFO", text="A", active=True)
    return _dated(access.paged(found, ["instrument_type", "symbol", "token"], 2, 20))


@query(f"WITH {LISTING} SELECT {_ALL} FROM listing WHERE is_active AND instrument_type IN ('OPTIDX', 'FUTIDX') AND name IN ('Brand#13', 'Brand#21', 'Brand#42')")
def instruments_listed(spark, sf_dir):
    return _dated(access.listed(tables.listing(spark, sf_dir), kinds=("OPTIDX", "FUTIDX"), names=("Brand#13", "Brand#21", "Brand#42")))


@query(f"WITH {LISTING} SELECT {_ALL} FROM listing WHERE false")
def instruments_listed_without_lists(spark, sf_dir):
    """No list at all asks for nothing, not for everything."""
    return _dated(access.listed(tables.listing(spark, sf_dir)))


@query(f"WITH {LISTING} SELECT {_ALL} FROM listing WHERE instrument_type = 'FUTIDX' AND name = 'Brand#13' AND expiry >= DATE '2026-09-10' ORDER BY listing.expiry, token LIMIT 1")
def nearest_future(spark, sf_dir):
    return _dated(access.nearest_future(tables.listing(spark, sf_dir), "Brand#13", "2026-09-10"))


@query(f"WITH {LISTING} SELECT token, CAST(row_number() OVER (ORDER BY instrument_type, expiry NULLS LAST, symbol, token) AS INTEGER) AS place FROM listing ORDER BY instrument_type, expiry NULLS LAST, symbol, token LIMIT 200")
def instruments_in_order(spark, sf_dir):
    """The first two hundred by type, expiry (those without one last) and symbol."""
    order = [F.asc("instrument_type"), F.asc_nulls_last("expiry"), F.asc("symbol"), F.asc("token")]
    top = tables.listing(spark, sf_dir).orderBy(*order).limit(200)
    return top.withColumn("place", F.expr("row_number() OVER (ORDER BY instrument_type, expiry NULLS LAST, symbol, token)")).select("token", "place")


@query(f"WITH {LISTING}, s AS (SELECT token, CASE exchange WHEN 'NSE' THEN 1 WHEN 'NFO' THEN 2 WHEN 'BSE' THEN 3 WHEN 'MCX' THEN 5 END AS exchange_type FROM listing WHERE instrument_type IN ('OPTIDX', 'FUTIDX') AND is_active AND exchange <> 'NCX' ORDER BY instrument_type, symbol, token LIMIT 1000) SELECT exchange_type, list_sort(list(token)) AS tokens FROM s GROUP BY 1")
def feed_subscriptions_active(spark, sf_dir):
    return feed.subscriptions(feed.active(tables.listing(spark, sf_dir), ("OPTIDX", "FUTIDX")))


@query("SELECT c_name AS symbol, o_orderkey AS run, o_orderstatus AS status, o_orderdate AS at, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 50")
def download_logs(spark, sf_dir):
    """A page of the log, newest first, with the symbols of its instruments; the customers are those of the runs."""
    who = tables.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("token"), F.col("c_name").alias("symbol"))
    log = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("instrument"), F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))
    return access.paged(access.with_instrument(log, who, "instrument", "symbol"), ["at", "run"], 2, 50, newest=True).select("symbol", "run", "status", "at", "total")


@query("SELECT o_orderkey AS trade_id, o_orderdate AS entry_time, CAST(floor(o_totalprice) - 150000 AS BIGINT) AS pnl, c_name AS symbol FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def trades_of_strategy(spark, sf_dir):
    who = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("token"), F.col("c_name").alias("symbol"))
    owner = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade_id"), F.col("o_custkey").alias("instrument"))
    some = tables.trades(spark, sf_dir).where("strategy = 'P'").join(owner, "trade_id")
    return access.with_instrument(some, who, "instrument", "symbol").select("trade_id", "entry_time", "pnl", "symbol")


@query(f"WITH {catalogue._EQUITY} SELECT CAST(day AS VARCHAR) AS day, equity FROM q WHERE strategy = 'O'")
def equity_of_strategy(spark, sf_dir):
    return studies.equity(tables.trades(spark, sf_dir), 1_000_000_000).where("strategy = 'O'").select(F.col("day").cast("string").alias("day"), "equity")


@query(f"WITH {catalogue.TICKS} SELECT 'VIEW-EQ' AS symbol, timestamp, ltp FROM ticks WHERE instrument = 'view' ORDER BY timestamp DESC, sequence_number DESC LIMIT 1")
def latest_tick_of_symbol(spark, sf_dir):
    """By a symbol in another case; the few instruments of a symbol are joined to the ticks first."""
    names = catalogue.feed_tokens(spark).withColumnsRenamed({"instrument": "symbol"})
    ticks = tables.ticks(spark, sf_dir).withColumnRenamed("instrument", "token")
    found = access.latest(ticks.join(access.of_symbol(names, "view-eq"), "token"), "symbol")
    return found.select("symbol", "timestamp", "ltp")


@query(f"WITH {catalogue.TICKS} SELECT * FROM ticks WHERE timestamp BETWEEN TIMESTAMP '2024-01-10 09:00:00' AND TIMESTAMP '2024-01-10 15:35:00'")
def day_window(spark, sf_dir):
    return access.day_window(tables.ticks(spark, sf_dir), date(2024, 1, 10))


@query(f"WITH {catalogue.HOURS} SELECT * FROM bars WHERE timestamp BETWEEN TIMESTAMP '2024-01-08 09:00:00' AND TIMESTAMP '2024-01-12 15:00:00'")
def inclusive_window(spark, sf_dir):
    return access.inclusive(catalogue.hours(spark, sf_dir), datetime(2024, 1, 8, 9), datetime(2024, 1, 12, 15))


@query(f"WITH {catalogue.TICKS} SELECT *, CASE WHEN (SELECT count(*) FROM ticks) > 1000 THEN 'truncated to the first 1,000 rows; what follows from them covers only these' END AS note FROM ticks ORDER BY timestamp, sequence_number LIMIT 1000")
def truncated_ticks(spark, sf_dir):
    return access.truncated(tables.ticks(spark, sf_dir), ["timestamp", "sequence_number"], 1000)


@query(f"WITH {catalogue.TICKS} SELECT EXISTS (SELECT 1 FROM ticks WHERE timestamp < TIMESTAMP '2024-01-20') AS found")
def older_rows_exist(spark, sf_dir):
    return access.exists_before(tables.ticks(spark, sf_dir), datetime(2024, 1, 20))


_MASTER = """m AS (SELECT CAST(p_partkey AS VARCHAR) AS token, p_name AS symbol, CASE WHEN p_partkey % 6 <> 0 THEN p_brand END AS name, CASE WHEN p_partkey % 8 <> 0 THEN 'NFO' END AS exch_seg, ['OPTIDX', 'FUTIDX', 'OPTSTK', NULL][p_partkey % 4 + 1] AS instrumenttype,
CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'soon' WHEN 2 THEN '31FEB2026' ELSE strftime(DATE '2026-01-05' + CAST(p_partkey % 300 AS INTEGER), '%d') || upper(strftime(DATE '2026-01-05' + CAST(p_partkey % 300 AS INTEGER), '%b')) || '2026' END AS expiry,
CASE p_partkey % 10 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE CAST(p_partkey * 50 AS VARCHAR) END AS strike, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'lot' ELSE CAST(p_size AS VARCHAR) END AS lotsize FROM part)"""


@query(
    f"""WITH {_MASTER} SELECT token, symbol, coalesce(name, '') AS name, coalesce(exch_seg, '') AS exchange, coalesce(instrumenttype, '') AS instrument_type, CAST(CAST(try_strptime(expiry, '%d%b%Y') AS DATE) AS VARCHAR) AS expiry,
CASE WHEN instrumenttype IN ('OPTIDX', 'OPTSTK') THEN try_cast(strike AS DOUBLE) / 100 ELSE try_cast(strike AS DOUBLE) END AS strike, coalesce(try_cast(lotsize AS INTEGER), 0) AS lot_size FROM m"""
)
def master_cleaned(spark, sf_dir):
    return _dated(upkeep.cleaned(master(spark, sf_dir)))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of instruments as it is downloaded: all text, with cells that are missing or no numbers."""
    n = F.col("p_partkey")
    expires = F.upper(F.date_format(F.date_add(F.lit("2026-01-05").cast("date"), (n % 300).cast("int")), "ddMMMyyyy"))
    return tables.table(spark, sf_dir, "part").select(
        n.cast("string").alias("token"), F.col("p_name").alias("symbol"), F.when(n % 6 != 0, F.col("p_brand")).alias("name"), F.when(n % 8 != 0, "NFO").alias("exch_seg"),
        F.element_at(F.array(F.lit("OPTIDX"), F.lit("FUTIDX"), F.lit("OPTSTK"), F.lit(None)), (n % 4 + 1).cast("int")).alias("instrumenttype"),
        F.when(n % 9 == 0, F.lit(None)).when(n % 9 == 1, "soon").when(n % 9 == 2, "31FEB2026").otherwise(expires).alias("expiry"),
        F.when(n % 10 == 0, "n/a").when(n % 10 == 1, F.lit(None)).otherwise((n * 50).cast("string")).alias("strike"), F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, "lot").otherwise(F.col("p_size").cast("string")).alias("lotsize"),
    )


@query(f"WITH {LISTING} SELECT {_ALL} FROM listing")
def csv_round_trip(spark, sf_dir):
    """The list written as CSV and read again."""
    some, path = tables.listing(spark, sf_dir), tables.shared_folder(spark) + "/csv"
    upkeep.write_csv(some, path)
    return _dated(upkeep.read_csv(spark, path, some.schema.simpleString()[7:-1].replace(":", " ")))


@query("SELECT p_partkey AS token, CASE WHEN p_partkey % 5 = 0 THEN 'failed' WHEN p_partkey % 7 = 0 THEN 'no_data' ELSE 'success' END AS status, CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_partkey % 7 END AS BIGINT) AS rows, CASE WHEN p_partkey % 5 = 0 THEN 'timeout' END AS message FROM part UNION ALL SELECT -1, 'no_data', 0, NULL")
def log_append(spark, sf_dir):
    """Two batches of the log, one appended to the other, read back."""
    n, path = F.col("p_partkey"), tables.shared_folder(spark) + "/log"
    runs = tables.table(spark, sf_dir, "part").select(n.alias("token"), (n % 7).alias("rows"), F.when(n % 5 == 0, "timeout").alias("error"))
    for batch in (runs, spark.sql("SELECT -1L AS token, CAST(NULL AS BIGINT) AS rows, CAST(NULL AS STRING) AS error")):
        upkeep.logged(batch).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey AS run, '{\"short\":' || o_custkey || ',\"name\":\"' || o_orderstatus || '\",\"note\":null}' AS params, o_custkey AS short FROM orders")
def run_params(spark, sf_dir):
    """A run's parameters as JSON, and one of them read from it again."""
    params = F.to_json(F.struct(F.col("o_custkey").alias("short"), F.col("o_orderstatus").alias("name"), F.lit(None).cast("string").alias("note")), {"ignoreNullFields": "false"})
    rows = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), params.alias("params"))
    return rows.withColumn("short", F.get_json_object("params", "$.short").cast("bigint"))


_OLD = f"{catalogue.TICKS}, d AS (SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM ticks GROUP BY 1)"


@query(f"WITH {_OLD} SELECT CAST(day AS VARCHAR) AS day, n, CASE WHEN day < DATE '2024-01-20' THEN 'archived' ELSE 'kept' END AS part FROM d")
def retention_cycle(spark, sf_dir):
    """Old days archived, read back and verified, then taken from the table; the rest compacted and read again."""
    ticks, path = tables.ticks(spark, sf_dir), tables.shared_folder(spark)
    _, old = upkeep.split(ticks, "2024-01-26", 7)
    done = upkeep.archive(old, f"{path}/archive")
    left = upkeep.purged(ticks, done).withColumn("trade_date", F.to_date("timestamp"))
    left.write.partitionBy("trade_date").parquet(f"{path}/table")
    upkeep.compacted(spark, f"{path}/table", f"{path}/compact").collect()
    kept = spark.read.parquet(f"{path}/compact").groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"))
    archived = done.where("verified").select(F.col("trade_date").cast("string").alias("day"), "n", F.lit("archived").alias("part"))
    return archived.union(kept.select(F.col("trade_date").cast("string"), "n", F.lit("kept")))


@query(
    f"""WITH i AS (SELECT p_partkey AS token, p_partkey % 2 = 0 AS derivative FROM part WHERE p_partkey % 50 = 0), w AS (SELECT token, TIMESTAMP '2026-10-05 10:00:00' AS "end", TIMESTAMP '2026-10-05 10:00:00' - CASE WHEN derivative THEN INTERVAL 30 DAYS ELSE INTERVAL 90 DAYS END AS start FROM i),
p AS (SELECT token, start + to_days(CAST(k AS INTEGER)) AS start, least(start + to_days(CAST(k + 1 AS INTEGER)), "end") AS "end" FROM w, range(91) r(k) WHERE start + to_days(CAST(k AS INTEGER)) < "end")
SELECT token, start, "end" FROM p WHERE EXISTS (SELECT 1 FROM generate_series(TIMESTAMP '2026-07-01', TIMESTAMP '2026-10-10', INTERVAL 1 DAY) s(d) WHERE CAST(d AS DATE) BETWEEN CAST(start AS DATE) AND CAST("end" AS DATE) AND isodow(d) < 6 AND CAST(d AS DATE) NOT IN ({catalogue._HOLIDAYS}))"""
)
def fetch_plan_open(spark, sf_dir):
    """Requests of a day each, without those whose days are all holidays or weekends."""
    some = tables.instruments(spark, sf_dir).where("token % 50 = 0").select("token", F.lit(None).cast("date").alias("expiry"), (F.col("token") % 2 == 0).alias("derivative"))
    none = spark.createDataFrame([], "token bigint, timestamp timestamp_ntz")
    return calendar.open_fetches(calendar.fetches(some, none, datetime(2026, 10, 5, 10), chunk=1))


@query(f"WITH {catalogue._SUITE} SELECT name, round(sum(pnl) + 2 * count(*), 4) AS net FROM trades WHERE name = 'FH_BREAK' GROUP BY 1")
def first_hour_net(spark, sf_dir):
    """The first range alone, without costs."""
    found = breakouts.first_hour(catalogue.bars.build(tables.ticks(spark, sf_dir), "5 minutes"), catalogue.ALL_DAY, buffer=breakouts.BUFFER, least=3)
    return found.groupBy("name").agg(F.round(F.sum("pnl"), 4).alias("net"))
