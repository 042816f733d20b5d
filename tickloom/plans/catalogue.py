"""The market-data queries by name, and SQL that gives the same rows.

All run over whole tables; a limit stands only where it is the feature (pages, top lists).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, bars, breakouts, calendar, contracts, options, studies, upkeep, validation, volatility
from ..sources import tables
from ..streaming import feed
from ..streaming import ticks as stream
from .registry import QUERIES, SQL, query

#: Common parts of the SQL.
TICKS = "ticks AS (SELECT event_type AS instrument, ts AS timestamp, event_id AS sequence_number, value AS ltp, CAST(json_extract_string(props, '$.k') AS BIGINT) AS quantity FROM events WHERE value > 0)"
BARS = TICKS + ", bars AS (SELECT instrument, time_bucket(INTERVAL '{w}', timestamp) AS timestamp, arg_min(ltp, sequence_number) AS open, max(ltp) AS high, min(ltp) AS low, arg_max(ltp, sequence_number) AS close, CAST(sum(quantity) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY ALL)"
HOURS = BARS.replace("{w}", "1 hour")
BOOKS = TICKS + ", levels AS (SELECT t.*, i AS place, s.side, CASE WHEN s.side = 'BUY' THEN ltp - 0.05::DOUBLE * (i + 1) ELSE ltp + 0.05::DOUBLE * (i + 1) END AS price, CASE WHEN s.side = 'BUY' THEN quantity * (i + 1) * 20 ELSE quantity * (5 - i) * 20 END AS size FROM ticks t, range(5) r(i), (VALUES ('BUY'), ('SELL')) s(side))"
FAULTY = HOURS + """, faulty AS (SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY timestamp) AS sequence_number, timestamp + INTERVAL 15 MINUTE AS timestamp, open, high, low, close, volume FROM bars),
bad AS (SELECT instrument, sequence_number, CASE WHEN sequence_number % 31 = 0 THEN timestamp - INTERVAL 3 HOUR WHEN sequence_number % 37 = 0 THEN NULL ELSE timestamp END AS timestamp,
CASE WHEN sequence_number % 11 = 0 THEN -open ELSE open END AS open, CASE WHEN sequence_number % 13 = 0 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN sequence_number % 17 = 0 THEN -1 ELSE volume END AS volume FROM faulty)"""
SECOND = "(hour(timestamp) * 3600 + minute(timestamp) * 60 + second(timestamp))"
OPEN_, CLOSE_ = validation.OPEN, validation.CLOSE
ROW_FINDINGS = f"""rowwise AS (SELECT instrument, sequence_number, unnest(list_filter([
CASE WHEN timestamp IS NULL THEN 'missing_field' END, CASE WHEN open IS NULL THEN 'missing_field' END, CASE WHEN open <= 0 THEN 'non_positive_price' END, CASE WHEN high <= 0 THEN 'non_positive_price' END, CASE WHEN low <= 0 THEN 'non_positive_price' END, CASE WHEN close <= 0 THEN 'non_positive_price' END,
CASE WHEN volume < 0 THEN 'negative_value' END, CASE WHEN ({SECOND} - {OPEN_}) % 3600 <> 0 THEN 'timestamp_not_aligned' END,
CASE WHEN NOT (isodow(timestamp) < 6 AND {SECOND} >= {OPEN_} AND {SECOND} < {CLOSE_}) THEN 'out_of_session' END,
CASE WHEN high < low THEN 'ohlc_invariant' END, CASE WHEN high < greatest(open, close) THEN 'ohlc_invariant' END, CASE WHEN low > least(open, close) THEN 'ohlc_invariant' END], lambda x: x IS NOT NULL)) AS code FROM bad),
seq AS (SELECT instrument, sequence_number, CASE WHEN row_number() OVER (PARTITION BY instrument, timestamp ORDER BY sequence_number) > 1 THEN 'duplicate_timestamp' WHEN timestamp <= lag(timestamp) OVER (PARTITION BY instrument ORDER BY sequence_number) THEN 'out_of_order' END AS code FROM bad WHERE timestamp IS NOT NULL),
findings AS (SELECT *, CASE WHEN code = 'out_of_session' THEN 'WARNING' ELSE 'ERROR' END AS severity FROM (SELECT * FROM rowwise UNION ALL SELECT * FROM seq WHERE code IS NOT NULL))"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.build(tables.ticks(spark, sf_dir), "1 hour")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.books(tables.ticks(spark, sf_dir))


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, numbered by instrument, with faults at fixed numbers."""
    n = F.col("sequence_number")
    out = hours(spark, sf_dir).withColumn("timestamp", F.expr("timestamp + INTERVAL 15 MINUTES")).withColumn("sequence_number", F.expr("row_number() OVER (PARTITION BY instrument ORDER BY timestamp)").cast("bigint"))
    return out.select(
        "instrument", "sequence_number", F.when(n % 31 == 0, F.expr("timestamp - INTERVAL 3 HOURS")).when(n % 37 == 0, F.lit(None)).otherwise(F.col("timestamp")).alias("timestamp"),
        F.when(n % 11 == 0, -F.col("open")).otherwise(F.col("open")).alias("open"), F.when(n % 13 == 0, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", "close", F.when(n % 17 == 0, -1).otherwise(F.col("volume")).alias("volume"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = faulty(spark, sf_dir)
    return validation.row_findings(rows, 60).union(validation.sequence_findings(rows))


for _name, _width in (("bars_1h", "1 hour"), ("bars_5m", "5 minutes"), ("bars_15m", "15 minutes")):
    QUERIES[_name] = lambda spark, sf_dir, w=_width: bars.build(tables.ticks(spark, sf_dir), w)
    SQL[_name] = f"WITH {BARS.replace('{w}', _width)} SELECT * FROM bars"


@query(f"WITH {HOURS} SELECT instrument, time_bucket(INTERVAL '4 hours', timestamp) AS timestamp, arg_min(open, timestamp) AS open, max(high) AS high, min(low) AS low, arg_max(close, timestamp) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM bars GROUP BY instrument, 2 HAVING count(*) = 4")
def bars_complete_4h(spark, sf_dir):
    return bars.widen(hours(spark, sf_dir), "4 hours", complete=4)


@query(f"WITH {TICKS} SELECT * FROM ticks WHERE timestamp >= TIMESTAMP '2024-01-08 09:15:00' AND timestamp < TIMESTAMP '2024-01-12 15:30:00'")
def access_window(spark, sf_dir):
    return access.window(tables.ticks(spark, sf_dir), datetime(2024, 1, 8, 9, 15), datetime(2024, 1, 12, 15, 30))


@query(f"WITH {HOURS} SELECT * FROM bars WHERE timestamp + INTERVAL '1 hour' <= TIMESTAMP '2024-01-15 10:30:00'")
def access_completed_bars(spark, sf_dir):
    return access.completed(hours(spark, sf_dir), datetime(2024, 1, 15, 10, 30), "1 hour")


@query(f"WITH {TICKS} SELECT instrument, timestamp, sequence_number, ltp, quantity FROM ticks QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY sequence_number DESC) = 1")
def latest_per_instrument(spark, sf_dir):
    return access.latest(tables.ticks(spark, sf_dir)).select("instrument", "timestamp", "sequence_number", "ltp", "quantity")


@query(f"WITH {TICKS}, g AS (SELECT instrument, day + INTERVAL '12 hours' AS timestamp FROM (SELECT DISTINCT instrument FROM ticks), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) s(day)) SELECT g.instrument, g.timestamp, (SELECT arg_max(ltp, sequence_number) FROM ticks t WHERE t.instrument = g.instrument AND t.timestamp <= g.timestamp) AS ltp FROM g")
def as_of_grid(spark, sf_dir):
    ticks = tables.ticks(spark, sf_dir)
    grid = ticks.select("instrument").distinct().select("instrument", F.explode(F.expr("sequence(TIMESTAMP_NTZ'2024-01-01 12:00:00', TIMESTAMP_NTZ'2024-01-31 12:00:00', INTERVAL 1 DAY)")).alias("timestamp"))
    return access.as_of(grid, ticks)


@query(f"WITH {TICKS} SELECT instrument, count(*) AS n, min(ltp) AS low, max(ltp) AS high, round(avg(ltp), 4) AS mean, CAST(sum(quantity) AS BIGINT) AS volume, max(quantity) AS largest, min(timestamp) AS first, max(timestamp) AS last FROM ticks GROUP BY ALL")
def tick_summary(spark, sf_dir):
    return tables.ticks(spark, sf_dir).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.min("ltp").alias("low"), F.max("ltp").alias("high"), F.round(F.avg("ltp"), 4).alias("mean"), F.sum("quantity").alias("volume"), F.max("quantity").alias("largest"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


@query(f"WITH {TICKS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT s) AS out_of_session, count(DISTINCT CAST(timestamp AS DATE)) AS days, CAST(CAST(min(timestamp) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(timestamp) AS DATE) AS VARCHAR) AS last_day FROM (SELECT *, isodow(timestamp) < 6 AND {SECOND} >= {OPEN_} AND {SECOND} < {CLOSE_} AS s FROM ticks)")
def purge_summary(spark, sf_dir):
    day = F.to_date("timestamp")
    return tables.ticks(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(~validation.in_session()).alias("out_of_session"), F.count_distinct(day).alias("days"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"))


@query(f"WITH {TICKS} SELECT * FROM (SELECT * FROM ticks ORDER BY timestamp DESC, sequence_number DESC LIMIT 50 OFFSET 50)")
def page_newest(spark, sf_dir):
    return access.page(tables.ticks(spark, sf_dir), ["timestamp", "sequence_number"], 2, 50, newest=True)


@query("SELECT p_partkey AS token, p_name AS symbol, p_type AS instrument_type, p_retailprice AS strike, p_size AS lot_size FROM part WHERE p_name ILIKE '%a%'")
def search_symbols(spark, sf_dir):
    return access.search(tables.instruments(spark, sf_dir), "A")


@query("WITH n AS (SELECT p_partkey AS token, p_name AS symbol, p_type AS instrument_type, p_retailprice AS strike, p_size AS lot_size FROM part WHERE p_retailprice BETWEEN 920 AND 980) SELECT * FROM n WHERE lot_size = (SELECT min(lot_size) FROM n)")
def strike_band(spark, sf_dir):
    return access.band(tables.instruments(spark, sf_dir), 954.0, 10, 3)


@query("SELECT p_type AS instrument_type, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def candles_by_type(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("token"), "l_extendedprice")
    # summed by token before the join, so the larger table's rows aren't shuffled
    sums = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
    return sums.join(tables.instruments(spark, sf_dir), "token").groupBy("instrument_type").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("SELECT DISTINCT l_shipdate AS expiry FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' ORDER BY 1 LIMIT 5")
def nearest_expiries(spark, sf_dir):
    return tables.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("expiry")).where("expiry >= TIMESTAMP_NTZ'1996-01-01 00:00:00'").distinct().orderBy("expiry").limit(5)


@query("SELECT o_orderstatus AS status, count(*) AS runs, count(DISTINCT o_custkey) AS instruments, max(o_orderdate) AS last_run FROM orders GROUP BY 1")
def download_status(spark, sf_dir):
    return tables.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("o_custkey").alias("instruments"), F.max("o_orderdate").alias("last_run"))


_ANALYTICS = TICKS + ", b AS (SELECT *, quantity * 100 AS buy, quantity % 7 * 150 AS sell, (ltp + 0.05::DOUBLE) - (ltp - 0.05::DOUBLE) AS spread FROM ticks), a AS (SELECT instrument, time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, arg_max(ltp, sequence_number) AS ltp, CAST(printf('%.2f', avg(spread)) AS DOUBLE) AS avg_spread, CAST(printf('%.1f', max(spread)) AS DOUBLE) AS max_spread, CAST(printf('%.4f', avg(CASE WHEN buy + sell > 0 THEN (buy - sell) / (buy + sell) ELSE 0 END)) AS DOUBLE) AS imbalance, CAST(trunc(avg(buy)) AS BIGINT) AS buy_depth, CAST(trunc(avg(sell)) AS BIGINT) AS sell_depth, CAST(sum(buy - sell) AS BIGINT) AS delta, count(*) AS n FROM b GROUP BY 1, 2)"


@query(f"WITH {_ANALYTICS} SELECT *, CAST(sum(delta) OVER (PARTITION BY instrument, CAST(timestamp AS DATE) ORDER BY timestamp) AS BIGINT) AS cum_delta FROM a")
def book_analytics(spark, sf_dir):
    return bars.analytics(books(spark, sf_dir), "1 hour")


_COUNTS = ", w AS (SELECT instrument, time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, count(*) FILTER (WHERE side = 'BUY' AND size >= 2000) AS walls_buy, count(*) FILTER (WHERE side = 'SELL' AND size >= 2000) AS walls_sell FROM levels GROUP BY 1, 2)"


@query(f"WITH {BOOKS}{_COUNTS} SELECT * FROM w")
def wall_counts(spark, sf_dir):
    return bars.wall_counts(books(spark, sf_dir), "1 hour")


_WALLS = "first AS (SELECT instrument, date_trunc('minute', timestamp) AS minute, side, CAST(printf('%.1f', price) AS DOUBLE) AS price, size AS quantity, ltp, timestamp, sequence_number, place FROM levels WHERE size >= 5000 QUALIFY row_number() OVER (PARTITION BY instrument, date_trunc('minute', timestamp), side, CAST(printf('%.1f', price) AS DOUBLE) ORDER BY sequence_number, place) = 1)"


@query(f"WITH {BOOKS}, {_WALLS} SELECT instrument, minute, side, price, quantity, ltp, timestamp FROM first")
def wall_events(spark, sf_dir):
    return bars.walls(books(spark, sf_dir))


@query(f"WITH {BOOKS}, {_WALLS} SELECT instrument, minute, side, price, quantity, ltp, timestamp FROM first ORDER BY quantity DESC, timestamp, side, price LIMIT 50")
def wall_events_top50(spark, sf_dir):
    return bars.walls(books(spark, sf_dir)).orderBy(F.desc("quantity"), "timestamp", "side", "price").limit(50)


@query(f"WITH {BOOKS}, f AS (SELECT instrument, sequence_number, min(ltp) OVER w AS lo, max(ltp) OVER w AS hi FROM ticks WINDOW w AS (PARTITION BY instrument ORDER BY timestamp RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL 5 MINUTES FOLLOWING)), h AS (SELECT l.*, CASE WHEN side = 'BUY' THEN lo ELSE hi END AS reached FROM levels l JOIN f USING (instrument, sequence_number) WHERE size >= 3000 AND price > 0 AND ((side = 'BUY' AND lo < price) OR (side = 'SELL' AND hi > price))) SELECT instrument, date_trunc('minute', timestamp) AS minute, side, CAST(printf('%.1f', price) AS DOUBLE) AS wall, CAST(printf('%.1f', ltp) AS DOUBLE) AS price, size AS quantity, CAST(printf('%.1f', (reached - price)) AS DOUBLE) AS move FROM h QUALIFY row_number() OVER (PARTITION BY instrument, date_trunc('minute', timestamp), side, CAST(printf('%.1f', price) AS DOUBLE) ORDER BY sequence_number, place) = 1")
def absorption_events(spark, sf_dir):
    return bars.absorptions(books(spark, sf_dir)).select("instrument", "minute", "side", "wall", "price", "quantity", "move")


@query(f"WITH {_ANALYTICS}{BOOKS.removeprefix(TICKS)}{_COUNTS}, s AS (SELECT a.instrument, CAST(printf('%.2f', avg(CASE WHEN avg_spread > 0 THEN avg_spread END)) AS DOUBLE) AS avg_spread, max(max_spread) AS max_spread, CAST(printf('%.4f', avg(imbalance)) AS DOUBLE) AS imbalance, CAST(sum(coalesce(walls_buy, 0)) AS BIGINT) AS walls_buy, CAST(sum(coalesce(walls_sell, 0)) AS BIGINT) AS walls_sell FROM a LEFT JOIN w ON a.instrument = w.instrument AND a.timestamp = w.timestamp GROUP BY 1) SELECT *, CASE WHEN imbalance > 0.02 THEN 'BUY' WHEN imbalance < -0.02 THEN 'SELL' ELSE 'NEUTRAL' END AS bias FROM s")
def dashboard_summary(spark, sf_dir):
    b = books(spark, sf_dir)
    return bars.strip(bars.analytics(b, "1 hour"), bars.wall_counts(b, "1 hour"))


_A = "137.47727084867520"
_RV = HOURS + f""", r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY timestamp)) AS ret FROM bars),
v AS (SELECT instrument, timestamp, row_number() OVER (PARTITION BY instrument ORDER BY timestamp) >= 20 AS ok, stddev_pop(ret) OVER (PARTITION BY instrument ORDER BY timestamp ROWS BETWEEN 18 PRECEDING AND CURRENT ROW) AS cc,
sum(ln(high / low) * ln(high / low)) OVER w / 20 / (4 * ln(2)) AS p, sum(0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open)) OVER w / 20 AS gk,
sum(ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open))) OVER w / 20 AS rs FROM r WINDOW w AS (PARTITION BY instrument ORDER BY timestamp ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
x AS (SELECT instrument, timestamp, CASE WHEN ok THEN round(cc * sqrt(18900), 6) END AS close_close, CASE WHEN ok AND p >= 0 THEN round(sqrt(p) * sqrt(18900), 6) END AS parkinson, CASE WHEN ok AND gk >= 0 THEN round(sqrt(gk) * sqrt(18900), 6) END AS garman_klass, CASE WHEN ok AND rs >= 0 THEN round(sqrt(rs) * sqrt(18900), 6) END AS rogers_satchell FROM v)"""


@query(f"WITH {_RV} SELECT * FROM x")
def realised_volatility(spark, sf_dir):
    return volatility.realised(hours(spark, sf_dir), 20)


@query(f"WITH {_RV}, y AS (SELECT instrument, arg_max(parkinson, timestamp) / 100 AS vol FROM x WHERE parkinson IS NOT NULL GROUP BY 1) SELECT instrument, round(vol, 6) AS vol, CASE WHEN vol < 0.1 THEN 'Low' WHEN vol < 0.15 THEN 'Normal' WHEN vol < 0.25 THEN 'Elevated' ELSE 'High' END AS regime FROM y")
def volatility_regime(spark, sf_dir):
    last = volatility.realised(hours(spark, sf_dir), 20).where("parkinson IS NOT NULL").groupBy("instrument").agg((F.max_by("parkinson", "timestamp") / 100).alias("vol"))
    return last.select("instrument", F.round("vol", 6).alias("vol"), volatility.regime(F.col("vol")).alias("regime"))


@query("SELECT p_partkey AS token, 0.1 + (p_partkey % 40) / 100 AS sigma, p_partkey % 2 = 0 AS call FROM part")
def implied_roundtrip(spark, sf_dir):
    """The volatility found from a price made with a known one."""
    strike = F.col("strike")
    spot, years, call = strike * (1 + (F.col("token") % 11) / 100), F.lit(0.25) + (F.col("token") % 5) / 10, F.col("token") % 2 == 0
    sigma = 0.1 + (F.col("token") % 40) / 100
    paid = volatility.priced(spot, strike, years, sigma, call)
    return tables.instruments(spark, sf_dir).select("token", F.round(volatility.implied_vol(spot, strike, years, paid, call), 3).alias("sigma"), call.alias("call"))


@query("WITH a AS (SELECT CAST(round_even(p_retailprice / 50, 0) AS BIGINT) * 50 AS strike, CASE WHEN p_partkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS kind, p_partkey AS token FROM part) SELECT CAST(strike AS DOUBLE) AS strike, max(CASE WHEN kind = 'CE' THEN token END) AS ce, max(CASE WHEN kind = 'PE' THEN token END) AS pe FROM a GROUP BY 1")
def strike_chain(spark, sf_dir):
    rows = tables.instruments(spark, sf_dir).select(volatility.nearest_strike(F.col("strike"), 50).alias("strike"), F.when(F.col("token") % 2 == 0, "CE").otherwise("PE").alias("kind"), "token")
    return rows.groupBy("strike").agg(F.max(F.when(F.col("kind") == "CE", F.col("token"))).alias("ce"), F.max(F.when(F.col("kind") == "PE", F.col("token"))).alias("pe"))


@query(f"SELECT d + to_minutes({OPEN_ // 60} + k * 60) AS timestamp FROM (SELECT unnest(generate_series(CAST(CAST(min(ts) AS DATE) AS TIMESTAMP), max(ts), INTERVAL 1 DAY)) AS d FROM events WHERE value > 0), range(6) r(k) WHERE isodow(d) < 6")
def session_grid(spark, sf_dir):
    """The starts of the bars of the sessions from the first tick to the last."""
    return validation.session_grid(calendar.days_of(tables.ticks(spark, sf_dir)), 60)


@query(f"WITH {FAULTY}, {ROW_FINDINGS} SELECT instrument, sequence_number, code, severity FROM findings")
def validation_findings(spark, sf_dir):
    return findings(spark, sf_dir)


@query(f"WITH {TICKS}, c AS (SELECT instrument, sequence_number, CAST(timestamp AS DATE) AS day, CASE WHEN sequence_number % 23 = 0 THEN NULL ELSE sequence_number % 50 * 10 + hour(timestamp) * 100 END AS volume FROM ticks), r AS (SELECT *, CAST(day IS DISTINCT FROM lag(day) OVER (PARTITION BY instrument ORDER BY sequence_number) AS INT) AS ch FROM c), s AS (SELECT *, sum(ch) OVER (PARTITION BY instrument ORDER BY sequence_number) AS run FROM r), l AS (SELECT *, last_value(volume IGNORE NULLS) OVER (PARTITION BY instrument, run ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s) SELECT instrument, sequence_number, 'volume_regression' AS code, 'WARNING' AS severity FROM l WHERE volume < before")
def volume_regressions(spark, sf_dir):
    n = F.col("sequence_number")
    return validation.volume_findings(tables.ticks(spark, sf_dir).withColumn("volume", F.when(n % 23 != 0, n % 50 * 10 + F.hour("timestamp") * 100)))


@query(f"WITH {HOURS}, b AS (SELECT instrument, timestamp + INTERVAL 15 MINUTES AS timestamp FROM bars), s AS (SELECT instrument, min(timestamp) AS lo, max(timestamp) AS hi FROM b GROUP BY 1), g AS (SELECT instrument, day + to_minutes({OPEN_ // 60} + k * 60) AS timestamp, lo, hi FROM s, generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-02-02', INTERVAL 1 DAY) d(day), range(6) r(k) WHERE isodow(day) < 6) SELECT instrument, timestamp FROM g WHERE timestamp BETWEEN lo AND hi AND NOT EXISTS (SELECT 1 FROM b WHERE b.instrument = g.instrument AND b.timestamp = g.timestamp)")
def session_gaps(spark, sf_dir):
    return validation.gaps(hours(spark, sf_dir).withColumn("timestamp", F.expr("timestamp + INTERVAL 15 MINUTES")), 60)


@query(f"WITH {FAULTY}, {ROW_FINDINGS} SELECT * FROM bad WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE severity = 'ERROR' AND f.instrument = bad.instrument AND f.sequence_number = bad.sequence_number)")
def screen_reject(spark, sf_dir):
    return validation.screened(faulty(spark, sf_dir), findings(spark, sf_dir))


@query(f"WITH {FAULTY}, {ROW_FINDINGS} SELECT instrument, sequence_number, string_agg(DISTINCT code, ',' ORDER BY code) AS reasons FROM findings WHERE severity = 'ERROR' GROUP BY 1, 2")
def quarantine(spark, sf_dir):
    return validation.quarantined(faulty(spark, sf_dir), findings(spark, sf_dir))


_BREAK = HOURS + """, e AS (SELECT *, CAST(timestamp AS DATE) AS day, hour(timestamp) AS hour FROM bars), s AS (SELECT instrument, day, max(high) AS hi, min(low) AS lo FROM e WHERE hour >= 9 AND hour < 12 GROUP BY 1, 2),
l AS (SELECT e.*, hi, lo, CASE WHEN close > hi + 0.05::DOUBLE * (hi - lo) THEN 'LONG' WHEN close < lo - 0.05::DOUBLE * (hi - lo) THEN 'SHORT' END AS side FROM e JOIN s USING (instrument, day) WHERE hour >= 12 AND hour < 20),
n AS (SELECT instrument, day, hi, lo, timestamp AS entered, side, close AS entry FROM l WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY instrument, day ORDER BY timestamp) = 1),
p AS (SELECT n.*, bool_or(CASE WHEN side = 'LONG' THEN e.low <= n.lo ELSE e.high >= n.hi END) AS stopped, arg_max(e.close, e.timestamp) AS last FROM n JOIN e USING (instrument, day) WHERE e.timestamp > entered AND e.hour < 20 GROUP BY ALL),
x AS (SELECT instrument, day, side, entered, entry, CASE WHEN stopped THEN CASE WHEN side = 'LONG' THEN lo ELSE hi END ELSE last END AS exit, stopped FROM p),
t AS (SELECT *, round(CASE WHEN side = 'LONG' THEN exit - entry ELSE entry - exit END - 2, 6) AS pnl FROM x)"""


def hourly_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of a range from 9 to 12 over hourly bars, left before 20 o'clock."""
    clock = breakouts.Clock(open=9 * 60, first=12 * 60, exit=20 * 60 - 1, candle=60)
    each = breakouts.laid_out(hours(spark, sf_dir), least=1)
    found = breakouts.trades(each, breakouts.signals(each, clock, flat=True).where("name = 'FH_BREAK'"), clock)
    entered = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minute"))
    return found.select("instrument", "day", "side", entered.alias("entered"), "entry", "exit", (F.col("reason") == "stop").alias("stopped"), F.round("pnl", 6).alias("pnl"))


@query(f"WITH {_BREAK} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM t")
def breakout_trades(spark, sf_dir):
    return hourly_breakouts(spark, sf_dir).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_BREAK} SELECT side, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE pnl > 0) / count(*), 2) AS win_pct, round(sum(pnl), 4) AS net, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END), 0), 4) AS profit_factor FROM t GROUP BY side")
def breakout_study(spark, sf_dir):
    return studies.study(hourly_breakouts(spark, sf_dir), "side")


_HOLIDAYS, _SPECIAL = (", ".join(f"DATE '{x}'" for x in days) for days in (calendar.HOLIDAYS, calendar.SPECIAL))


def spread(spark: SparkSession, sf_dir: str, *days: int) -> DataFrame:
    """The ticks moved by each of these numbers of days."""
    return tables.ticks(spark, sf_dir).withColumn("_by", F.explode(F.array(*map(F.lit, days)))).withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(F.col("_by"))).drop("_by")


def span_sql(first: int, last: int) -> str:
    """The days from the first tick's, moved by `first`, to the last one's, moved by `last`."""
    return f"(SELECT unnest(generate_series(CAST(CAST(min(ts) AS DATE) AS TIMESTAMP) + INTERVAL {first} DAY, CAST(CAST(max(ts) AS DATE) AS TIMESTAMP) + INTERVAL {last} DAY, INTERVAL 1 DAY)) AS d FROM events WHERE value > 0)"


@query(f"SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, CAST(d AS DATE) IN ({_SPECIAL}) OR (isodow(d) < 6 AND CAST(d AS DATE) NOT IN ({_HOLIDAYS})) AS is_trading, year(d) = 2026 AS covered FROM {span_sql(700, 1000)}")
def trading_calendar(spark, sf_dir):
    """The days from the first tick to the last, and which of them are known to be trading days."""
    return calendar.days_of(spread(spark, sf_dir, 700, 1000)).withColumn("day", F.col("day").cast("string"))


@query("WITH s AS (SELECT 'tick_downloader' AS service, max(ts) AS last_seen FROM events UNION ALL SELECT 'ohlcv_scheduler', max(o_orderdate) FROM orders UNION ALL SELECT 'instrument_sync_scheduler', NULL) SELECT service, last_seen, round(date_sub('second', last_seen, TIMESTAMP '2024-01-31 12:00:00') / 60, 1) AS minutes_ago, CASE WHEN last_seen IS NULL THEN 'unknown' WHEN date_sub('second', last_seen, TIMESTAMP '2024-01-31 12:00:00') / 60 > CASE service WHEN 'tick_downloader' THEN 10 ELSE 15 END THEN 'stale' ELSE 'ok' END AS status FROM s")
def scheduler_health(spark, sf_dir):
    last = tables.table(spark, sf_dir, "events").agg(F.lit("tick_downloader").alias("service"), F.max("ts").alias("last_seen"))
    last = last.union(tables.table(spark, sf_dir, "orders").agg(F.lit("ohlcv_scheduler"), F.max("o_orderdate"))).union(spark.sql("SELECT 'instrument_sync_scheduler', CAST(NULL AS TIMESTAMP_NTZ)"))
    return calendar.health(last, datetime(2024, 1, 31, 12))


@query("""WITH i AS (SELECT p_partkey AS token, CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '1998-11-20 23:59:59.999999' ELSE TIMESTAMP '1998-12-15 10:00:00' END AS "end", p_partkey % 2 = 0 AS derivative FROM part), l AS (SELECT l_partkey AS token, max(l_shipdate) AS seen FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY 1),
w AS (SELECT token, "end", coalesce(seen + INTERVAL 5 MINUTES, "end" - CASE WHEN derivative THEN INTERVAL 30 DAYS ELSE INTERVAL 90 DAYS END) AS start FROM i LEFT JOIN l USING (token))
SELECT token, start + to_days(CAST(k * 5 AS INTEGER)) AS start, least(start + to_days(CAST(k * 5 + 5 AS INTEGER)), "end") AS "end" FROM w, range(2000) r(k) WHERE start + to_days(CAST(k * 5 AS INTEGER)) < "end" """)
def fetch_plan(spark, sf_dir):
    expiry = F.when(F.col("token") % 3 == 0, F.lit("1998-11-20").cast("date"))
    some = tables.instruments(spark, sf_dir).select("token", expiry.alias("expiry"), (F.col("token") % 2 == 0).alias("derivative"))
    last = tables.table(spark, sf_dir, "lineitem").where("l_partkey % 5 <> 0").select(F.col("l_partkey").alias("token"), F.col("l_shipdate").alias("timestamp"))
    return calendar.fetches(some, last, datetime(1998, 12, 15, 10))


_RAW = FAULTY + """, raw AS (SELECT instrument, sequence_number, CASE WHEN sequence_number % 41 = 0 THEN 'soon' WHEN sequence_number % 43 = 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || '+05:30' ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S') END AS timestamp,
CASE WHEN sequence_number % 47 = 0 THEN 'true' ELSE CAST(open AS VARCHAR) END AS open, high, low, CASE WHEN sequence_number % 19 = 0 THEN NULL ELSE close END AS close, volume FROM bad),
t AS (SELECT *, CASE WHEN timestamp NOT LIKE '%+05:30' THEN try_cast(timestamp AS TIMESTAMP) END AS ts, CASE WHEN open <> 'true' THEN CAST(open AS DOUBLE) END AS o FROM raw),
x AS (SELECT *, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s, o IS NOT NULL AND close IS NOT NULL AS four FROM t),
f AS (SELECT instrument, sequence_number, unnest([CASE WHEN timestamp IS NULL THEN 'timestamp missing_field' END, CASE WHEN timestamp = 'soon' THEN 'timestamp malformed_timestamp' END, CASE WHEN timestamp LIKE '%+05:30' THEN 'timestamp timezone_inconsistent' END, CASE WHEN open = 'true' THEN 'open unexpected_type' END, CASE WHEN close IS NULL THEN 'close missing_field' END,
CASE WHEN o <= 0 THEN 'open non_positive_price' END, CASE WHEN high <= 0 THEN 'high non_positive_price' END, CASE WHEN low <= 0 THEN 'low non_positive_price' END, CASE WHEN close <= 0 THEN 'close non_positive_price' END, CASE WHEN volume < 0 THEN 'volume negative_value' END, 'source unknown_field',
CASE WHEN (s - 33300) % 300 <> 0 THEN 'timestamp timestamp_not_aligned' END, CASE WHEN isodow(ts) > 5 OR s < 33300 OR s >= 55800 THEN 'timestamp out_of_session' END, CASE WHEN four AND high < low THEN 'high ohlc_invariant' END, CASE WHEN four AND high < greatest(o, close) THEN 'high ohlc_invariant' END, CASE WHEN four AND low > least(o, close) THEN 'low ohlc_invariant' END]) AS fc FROM x),
found AS (SELECT instrument, sequence_number, split_part(fc, ' ', 1) AS field, split_part(fc, ' ', 2) AS code, CASE WHEN split_part(fc, ' ', 2) IN ('out_of_session', 'unknown_field') THEN 'WARNING' ELSE 'ERROR' END AS severity FROM f WHERE fc IS NOT NULL)"""


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty bars as text, with faults that only text can have and a column that no contract knows."""
    n, text = F.col("sequence_number"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return faulty(spark, sf_dir).select(
        "instrument", "sequence_number", F.when(n % 41 == 0, "soon").when(n % 43 == 0, F.concat(text, F.lit("+05:30"))).otherwise(text).alias("timestamp"), F.when(n % 47 == 0, "true").otherwise(F.col("open").cast("string")).alias("open"),
        F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"), F.when(n % 19 != 0, F.col("close").cast("string")).alias("close"), F.col("volume").cast("string").alias("volume"), F.lit("feed").alias("source"),
    )


@query(f"WITH {_RAW} SELECT * FROM found")
def raw_findings(spark, sf_dir):
    return contracts.findings(raw_bars(spark, sf_dir), contracts.BAR_5M)


@query(f"WITH {_RAW} SELECT instrument, sequence_number, list_sort(list(DISTINCT code)) AS reasons FROM found WHERE severity = 'ERROR' GROUP BY 1, 2")
def raw_quarantine(spark, sf_dir):
    raw = raw_bars(spark, sf_dir)
    return contracts.quarantine(raw, contracts.findings(raw, contracts.BAR_5M)).drop("row")


#: Options made of the parts: their prices come from a known volatility (sigma), which the solver has to find again.
_OPTIONS = """o AS (SELECT p_partkey AS token, p_brand AS name, CASE WHEN p_partkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS kind, 700 + p_partkey % 8 * 50 AS strike FROM part),
c AS (SELECT l_partkey AS token, l_shipdate AS timestamp, 0.15 + (l_partkey % 30) / 100 AS sigma FROM lineitem GROUP BY ALL)"""


def option_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is an option of its brand."""
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("token"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 2 == 0, "CE").otherwise("PE").alias("kind"), (700 + F.col("p_partkey") % 8 * 50).cast("double").alias("strike"), F.lit("2002-06-30").cast("date").alias("expiry"))


def option_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """options, closes and underlying: a part's ship dates are its bars, a brand's price follows the day. A bar comes as often as its
    date does, each time with the same close; the operators keep one."""
    some = option_list(spark, sf_dir)
    days = tables.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("token"), F.col("l_shipdate").alias("timestamp"))
    spot = 1050.0 + F.pmod(F.datediff(F.col("timestamp"), F.lit("1992-01-01")) * 7, F.lit(100))
    years = volatility.years_to(F.col("expiry"), F.to_date("timestamp"))
    paid = volatility.priced(spot, F.col("strike"), years, 0.15 + (F.col("token") % 30) / 100, F.col("kind") == "CE")
    closes = days.join(some, "token").select("token", "timestamp", paid.alias("close"))
    under = days.join(some, "token").select("name", "timestamp").distinct().withColumn("close", spot)
    return some, closes, under.withColumns({"open": F.col("close") - 1, "high": F.col("close") + 4, "low": F.col("close") - 3})


@query(f"WITH {_OPTIONS} SELECT token, timestamp, round(sigma, 3) AS iv FROM c JOIN o USING (token)")
def implied_history(spark, sf_dir):
    dealt = tables.shares(tables.table(spark, sf_dir, "lineitem"))
    return options.history(*option_tables(spark, sf_dir), partitions=dealt).select("token", "timestamp", F.round("iv", 3).alias("iv"))


@query(f"WITH {_OPTIONS}, n AS (SELECT DISTINCT token, sigma FROM c WHERE timestamp <= TIMESTAMP '1997-06-30' AND timestamp > TIMESTAMP '1990-01-01'), x AS (SELECT name, CAST(strike AS DOUBLE) AS strike, arg_max(sigma, token) FILTER (WHERE kind = 'CE') AS ce, arg_max(sigma, token) FILTER (WHERE kind = 'PE') AS pe FROM o JOIN n USING (token) GROUP BY 1, 2) SELECT name, strike, round(ce * 100, 1) AS ce_iv, round(pe * 100, 1) AS pe_iv FROM x")
def implied_chain(spark, sf_dir):
    """The last close as of a day is priced anew at that day, so that its volatility is the one it was made with."""
    some, closes, under = option_tables(spark, sf_dir)
    at = datetime(1997, 6, 30)
    spot = options.last_closes(under, "name", at).select("name", F.col("close").alias("spot"))
    years = volatility.years_to(F.col("expiry"), F.lit(at.date()))
    known = closes.select("token", "timestamp").join(some, "token").join(spot, "name")
    closes = known.select("token", "timestamp", volatility.priced(F.col("spot"), F.col("strike"), years, 0.15 + (F.col("token") % 30) / 100, F.col("kind") == "CE").alias("close"))
    return options.chain(some, closes, under, at).select("name", "strike", F.round("ce_iv", 1).alias("ce_iv"), F.round("pe_iv", 1).alias("pe_iv"))


@query(f"WITH {_OPTIONS}, u AS (SELECT name, max(timestamp) AS last FROM o JOIN c USING (token) WHERE timestamp <= TIMESTAMP '1997-06-30' GROUP BY 1), s AS (SELECT name, 1050.0::DOUBLE + (date_diff('day', TIMESTAMP '1992-01-01', last) * 7) % 100 AS spot FROM u) SELECT name, spot, CAST(round_even(spot / 50, 0) * 50 AS DOUBLE) AS atm, (SELECT count(DISTINCT strike) FROM o WHERE o.name = s.name AND token IN (SELECT token FROM c)) AS strikes FROM s")
def at_the_money(spark, sf_dir):
    return options.at_the_money(*option_tables(spark, sf_dir), datetime(1997, 6, 30)).select("name", "spot", "atm", F.size("strikes").cast("bigint").alias("strikes"))


_VRP = """, b AS (SELECT token, timestamp, sigma, 1050.0::DOUBLE + (date_diff('day', TIMESTAMP '1992-01-01', timestamp) * 7) % 100 AS close FROM c JOIN o USING (token)),
g AS (SELECT *, 0.5::DOUBLE * ln((close + 4) / (close - 3)) ** 2 - (2 * ln(2) - 1) * ln(close / (close - 1)) ** 2 AS term FROM b),
v AS (SELECT token, timestamp, sigma, CASE WHEN count(*) OVER w >= 5 THEN sqrt(sum(term) OVER w / 5) * sqrt(18900) END AS rv FROM g WINDOW w AS (PARTITION BY token ORDER BY timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_OPTIONS}{_VRP} SELECT token, timestamp, round(sigma, 3) AS iv, round(rv, 4) AS rv, round(sigma - rv, 4) AS vrp FROM v")
def volatility_premium(spark, sf_dir):
    """Implied less realised volatility of each option's bars."""
    dealt = tables.shares(tables.table(spark, sf_dir, "lineitem"))
    out = options.premium(*option_tables(spark, sf_dir), n=5, partitions=dealt)
    return out.select(F.col("instrument").alias("token"), "timestamp", F.round("iv", 3).alias("iv"), F.round("rv", 4).alias("rv"), F.round("vrp", 4).alias("vrp"))


@query(f"WITH {_OPTIONS} SELECT token, name, kind, CAST(strike AS DOUBLE) AS strike FROM o WHERE name = 'Brand#13' AND strike BETWEEN 900 AND 1000")
def nearest_options(spark, sf_dir):
    return options.nearest_band(option_list(spark, sf_dir), "Brand#13", 951.0, "1997-06-30", 50, 1).select("token", "name", "kind", "strike")


@query("WITH i AS (SELECT p_partkey AS token, CASE WHEN p_partkey % 5 = 0 THEN 'NIFTY' ELSE p_brand END AS name, p_name AS symbol, CASE p_partkey % 3 WHEN 0 THEN 'OPTIDX' WHEN 1 THEN 'FUTIDX' ELSE 'AMXIDX' END AS instrument_type, p_retailprice AS strike, DATE '2026-09-01' + CAST(p_partkey % 4 * 7 AS INTEGER) AS expiry, p_partkey % 2 = 0 AS is_active FROM part) SELECT token, CASE WHEN instrument_type = 'OPTIDX' AND name = 'NIFTY' THEN expiry = DATE '2026-09-15' AND strike BETWEEN 900 AND 1000 WHEN name = 'NIFTY' AND (instrument_type = 'AMXIDX' OR expiry >= DATE '2026-09-10') THEN true WHEN expiry < DATE '2026-09-10' THEN false ELSE is_active END AS is_active FROM i")
def activate_daily(spark, sf_dir):
    n = F.col("p_partkey")
    some = tables.table(spark, sf_dir, "part").select(n.alias("token"), F.when(n % 5 == 0, "NIFTY").otherwise(F.col("p_brand")).alias("name"), F.col("p_name").alias("symbol"), F.element_at(F.array(F.lit("OPTIDX"), F.lit("FUTIDX"), F.lit("AMXIDX")), (n % 3 + 1).cast("int")).alias("instrument_type"), F.col("p_retailprice").alias("strike"), F.date_add(F.lit("2026-09-01").cast("date"), (n % 4 * 7).cast("int")).alias("expiry"), (n % 2 == 0).alias("is_active"))
    return upkeep.activate_daily(some, "NIFTY", "2026-09-10", 951.0, 10, 5).select("token", "is_active")


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as lines of the feed: every seventh without the exchange's clock, every eleventh with none at all."""
    n, cents = F.col("event_id"), F.round(F.col("value") * 100).cast("bigint").cast("string")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000 - 19800
    level = F.array(F.struct(cents.alias("price"), n.alias("quantity"), F.lit(0).alias("num_orders"), F.lit(3).alias("orders")), F.struct(F.lit(None).cast("string").alias("price"), n.alias("quantity"), F.lit(1).alias("num_orders"), F.lit(1).alias("orders")))
    packet = F.struct(F.col("event_type").alias("token"), n.alias("sequence_number"), cents.alias("last_traded_price"), F.when((n % 7 != 0) & (n % 11 != 0), F.floor(seconds * 1000).cast("string")).alias("exchange_timestamp"), F.when(n % 11 != 0, F.floor(seconds).cast("string")).otherwise("0").alias("last_traded_timestamp"), level.alias("best_5_buy_data"))
    return tables.table(spark, sf_dir, "events").select(F.to_json(packet).alias("value"), F.col("ts").alias("received"))


def feed_tokens(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('click', 'CLICK-EQ'), ('view', 'VIEW-EQ'), ('purchase', 'BUY-EQ') AS t(token, instrument)")


@query("SELECT CASE event_type WHEN 'click' THEN 'CLICK-EQ' WHEN 'view' THEN 'VIEW-EQ' ELSE 'BUY-EQ' END AS instrument, CASE WHEN event_id % 11 = 0 THEN ts WHEN event_id % 7 = 0 THEN date_trunc('second', ts) ELSE date_trunc('millisecond', ts) END AS timestamp, event_id AS sequence_number, round(value * 100) / 100 AS ltp, CASE WHEN event_id % 11 = 0 THEN 'received' WHEN event_id % 7 = 0 THEN 'last_traded' ELSE 'exchange' END AS time_source, 1::BIGINT AS levels, 3::BIGINT AS orders FROM events WHERE event_type IN ('click', 'view', 'purchase') AND round(value * 100) > 0")
def feed_ticks(spark, sf_dir):
    out = feed.parsed(feed.packets(feed_lines(spark, sf_dir)), feed_tokens(spark))
    return out.select("instrument", "timestamp", "sequence_number", "ltp", "time_source", F.size("best_5_buy").cast("bigint").alias("levels"), F.get("best_5_buy", F.lit(0))["orders"].alias("orders"))


@query("SELECT CASE WHEN event_id % 11 = 0 THEN 'received' WHEN event_id % 7 = 0 THEN 'last_traded' ELSE 'exchange' END AS time_source, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') AND round(value * 100) > 0 GROUP BY 1")
def feed_clocks(spark, sf_dir):
    return feed.sources(feed.parsed(feed.packets(feed_lines(spark, sf_dir)), feed_tokens(spark)))


@query("WITH s AS (SELECT p_partkey AS token, CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 END AS exchange_type FROM part WHERE p_partkey % 6 < 5 ORDER BY p_type, p_name, p_partkey LIMIT 1000) SELECT CAST(exchange_type AS INTEGER) AS exchange_type, list_sort(list(token)) AS tokens FROM s GROUP BY 1")
def feed_subscriptions(spark, sf_dir):
    exchange = F.element_at(F.array(*[F.lit(x) for x in ("NSE", "NFO", "BSE", "BFO", "MCX", "NCX")]), (F.col("token") % 6 + 1).cast("int"))
    return feed.subscriptions(tables.instruments(spark, sf_dir).withColumn("exchange", exchange))


#: The events come at all hours, so their sessions are whole days and their candles hours.
ALL_DAY = breakouts.Clock(open=0, short=180, first=360, levels=60, exit=1380, candle=60)
_SUITE = BARS.replace("{w}", "5 minutes") + """, e AS (SELECT instrument, CAST(timestamp AS DATE) AS day, hour(timestamp) * 60 + minute(timestamp) AS minute, high, low, close FROM bars QUALIFY count(*) OVER (PARTITION BY instrument, CAST(timestamp AS DATE)) >= 3),
c AS (SELECT instrument, day, minute // 60 * 60 AS minute, arg_max(close, minute) AS close FROM e GROUP BY instrument, day, minute // 60),
d AS (SELECT instrument, day, max(high) AS top, min(low) AS bottom FROM e GROUP BY 1, 2),
f AS (SELECT instrument, day, lag(top) OVER o AS hi, lag(bottom) OVER o AS lo, CASE WHEN row_number() OVER o > 5 THEN avg(top - bottom) OVER (PARTITION BY instrument ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS mean FROM d WINDOW o AS (PARTITION BY instrument ORDER BY day)),
levels AS (SELECT 'H' AS kind, instrument, day, max(high) AS hi, min(low) AS lo, 360 AS begin, 0.05::DOUBLE AS buffer FROM e WHERE minute < 360 GROUP BY instrument, day HAVING max(high) > min(low) UNION ALL SELECT 'O', instrument, day, max(high), min(low), 180, 0.05::DOUBLE FROM e WHERE minute < 180 GROUP BY instrument, day HAVING max(high) > min(low) UNION ALL SELECT 'P', instrument, day, hi, lo, 60, 0::DOUBLE FROM f WHERE hi IS NOT NULL),
found AS (SELECT kind, instrument, day, hi, lo, c.minute, close AS entry, CASE WHEN close > hi + buffer * (hi - lo) THEN 'LONG' ELSE 'SHORT' END AS side FROM levels JOIN c USING (instrument, day) WHERE c.minute >= begin AND c.minute < 1380 AND (close > hi + buffer * (hi - lo) OR close < lo - buffer * (hi - lo)) QUALIFY row_number() OVER (PARTITION BY kind, instrument, day ORDER BY c.minute) = 1),
again AS (SELECT x.instrument, x.day, hi, lo, side, min(e.minute) AS minute FROM found x JOIN e ON e.instrument = x.instrument AND e.day = x.day AND e.minute >= x.minute + 60 AND e.minute <= 1380 WHERE kind = 'H' AND CASE WHEN side = 'LONG' THEN low <= hi ELSE high >= lo END GROUP BY ALL),
sig AS (SELECT instrument, day, CASE kind WHEN 'H' THEN 'FH_BREAK' WHEN 'O' THEN 'ORB30' ELSE 'PDH_PDL' END AS name, side, entry, minute, minute + 60 AS start, CASE WHEN side = 'LONG' THEN lo ELSE hi END AS stop, hi - lo AS width FROM found
UNION ALL SELECT instrument, day, 'FH_FADE', CASE WHEN side = 'LONG' THEN 'SHORT' ELSE 'LONG' END, entry, minute, minute + 60, CASE WHEN side = 'LONG' THEN entry + 0.5::DOUBLE * (hi - lo) ELSE entry - 0.5::DOUBLE * (hi - lo) END, hi - lo FROM found WHERE kind = 'H'
UNION ALL SELECT x.instrument, x.day, 'VOL_CONTRACT', side, entry, minute, minute + 60, CASE WHEN side = 'LONG' THEN x.lo ELSE x.hi END, x.hi - x.lo FROM found x JOIN f USING (instrument, day) WHERE kind = 'H' AND x.hi - x.lo < 0.5::DOUBLE * mean
UNION ALL SELECT instrument, day, 'FH_RETEST', side, CASE WHEN side = 'LONG' THEN hi ELSE lo END, minute, minute + 1, CASE WHEN side = 'LONG' THEN hi - 0.5::DOUBLE * (hi - lo) ELSE lo + 0.5::DOUBLE * (hi - lo) END, hi - lo FROM again),
path AS (SELECT s.*, e.minute AS later, high, low, close, CASE WHEN side = 'LONG' THEN low <= stop ELSE high >= stop END AS hit FROM sig s JOIN e ON e.instrument = s.instrument AND e.day = s.day AND e.minute >= start AND e.minute <= 1380 WHERE CASE WHEN side = 'LONG' THEN stop < entry ELSE stop > entry END),
ends AS (SELECT instrument, day, name, min(later) FILTER (WHERE hit) AS stopped FROM path GROUP BY 1, 2, 3),
walked AS (SELECT p.instrument, p.day, p.name, side, p.minute, entry, stop, width, stopped, arg_max(close, later) AS last, greatest(max(CASE WHEN side = 'LONG' THEN high - entry ELSE entry - low END), 0) AS mfe, greatest(max(CASE WHEN side = 'LONG' THEN entry - low ELSE high - entry END), 0) AS mae FROM path p JOIN ends n ON p.instrument = n.instrument AND p.day = n.day AND p.name = n.name AND later <= coalesce(stopped, later) GROUP BY ALL),
left_ AS (SELECT *, CASE WHEN stopped IS NULL THEN last ELSE stop END AS exit, CASE WHEN stopped IS NULL THEN 'eod' ELSE 'stop' END AS reason, abs(entry - stop) AS risk FROM walked),
trades AS (SELECT instrument, day, name, side, minute, entry, stop, exit, reason, width, risk, CASE WHEN side = 'LONG' THEN exit - entry ELSE entry - exit END - 2 AS pnl, (CASE WHEN side = 'LONG' THEN exit - entry ELSE entry - exit END - 2) / risk AS r, mfe, mae FROM left_)"""


def suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakouts.suite(bars.build(tables.ticks(spark, sf_dir), "5 minutes"), ALL_DAY, least=3)


@query(f"WITH {_SUITE} SELECT instrument, CAST(day AS VARCHAR) AS day, name, side, minute, entry, round(stop, 6) AS stop, round(exit, 6) AS exit, reason, round(width, 6) AS width, round(risk, 6) AS risk, round(pnl, 6) AS pnl, round(r, 6) AS r, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM trades")
def breakout_suite(spark, sf_dir):
    return suite(spark, sf_dir).withColumns({"day": F.col("day").cast("string"), **{c: F.round(c, 6) for c in ("stop", "exit", "width", "risk", "pnl", "r", "mfe", "mae")}})


@query(f"WITH {_SUITE} SELECT name, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE pnl > 0) / count(*), 2) AS win_pct, round(sum(pnl), 4) AS net, round(avg(pnl), 8) AS mean, round(avg(mfe), 8) AS mfe, round(avg(mae), 8) AS mae, round(100.0::DOUBLE * count(*) FILTER (WHERE reason = 'stop') / count(*), 2) AS stop_pct, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END), 0), 4) AS profit_factor FROM trades GROUP BY name")
def breakout_outcomes(spark, sf_dir):
    return breakouts.outcomes(suite(spark, sf_dir), "name")


@query(f"WITH {_SUITE}, p AS (SELECT t.*, period FROM trades t, (VALUES ('ALL'), ('PRE'), ('POST')) v(period) WHERE period = 'ALL' OR (period = 'PRE') = (day < DATE '2024-01-15')) SELECT name, period, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE r > 0) / count(*), 2) AS win_pct, round(avg(r), 8) AS mean_r, round(sum(r), 4) AS sum_r, round(coalesce(sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(-sum(CASE WHEN r <= 0 THEN r ELSE 0 END), 0), 99), 4) AS profit_factor, round(avg(r) / CASE WHEN stddev_pop(r) > 0 THEN stddev_pop(r) ELSE 1e-9::DOUBLE END * sqrt(count(*)), 3) AS t FROM p GROUP BY name, period HAVING count(*) >= 20")
def breakout_expectancy(spark, sf_dir):
    return breakouts.expectancy(breakouts.periods(suite(spark, sf_dir), "2024-01-15"), "name", "period")


@query(f"WITH {_SUITE}, t AS (SELECT * FROM trades WHERE name = 'FH_BREAK'), m AS (SELECT instrument, median(width) AS median, count(*) AS base FROM t GROUP BY 1), x AS (SELECT t.*, base, width < median AS narrow, minute <= 720 AS early FROM t JOIN m USING (instrument)), y AS (SELECT *, unnest(list_filter(['none', CASE WHEN narrow THEN 'narrow' ELSE 'wide' END, CASE WHEN early THEN 'early' ELSE 'late' END, CASE WHEN minute = 360 THEN 'first' END, lower(side), CASE WHEN narrow AND early THEN 'narrow_early' END, CASE WHEN narrow AND early AND side = 'SHORT' THEN 'narrow_early_short' END], lambda k: k IS NOT NULL)) AS filter FROM x) SELECT instrument, filter, count(*) AS n, round(100.0::DOUBLE * count(*) / max(base), 2) AS kept_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE pnl > 0) / count(*), 2) AS win_pct, round(sum(pnl), 4) AS net, round(avg(pnl), 8) AS mean, round(coalesce(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END), 0), 99), 4) AS profit_factor FROM y GROUP BY 1, 2")
def breakout_filters(spark, sf_dir):
    return breakouts.filters(suite(spark, sf_dir).where("name = 'FH_BREAK'"), early=720, first=360)


_EQUITY = "t AS (SELECT o_orderstatus AS strategy, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice) - 150000 AS BIGINT) AS pnl FROM orders), d AS (SELECT strategy, day, sum(pnl) AS pnl FROM t GROUP BY 1, 2), e AS (SELECT strategy, day, CAST(1000000000 + sum(pnl) OVER (PARTITION BY strategy ORDER BY day) AS BIGINT) AS equity FROM d), c AS (SELECT *, greatest(1000000000, max(equity) OVER (PARTITION BY strategy ORDER BY day)) AS peak FROM e), q AS (SELECT strategy, day, equity, peak, round((peak - equity) / peak * 100, 6) AS drawdown_pct FROM c)"


@query(f"WITH {_EQUITY} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM q")
def equity_curve(spark, sf_dir):
    return studies.equity(tables.trades(spark, sf_dir), 1_000_000_000).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_EQUITY}, r AS (SELECT strategy, equity / lag(equity) OVER (PARTITION BY strategy ORDER BY day) - 1 AS r FROM q), s AS (SELECT strategy, round(CASE WHEN stddev_pop(r) > 0 THEN (avg(r) - 0.065::DOUBLE / 252) / stddev_pop(r) * sqrt(252) ELSE 0 END, 4) AS sharpe FROM r WHERE r IS NOT NULL GROUP BY 1) SELECT t.strategy, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl <= 0) AS losses, round(100.0::DOUBLE * count(*) FILTER (WHERE pnl > 0) / count(*), 2) AS win_pct, CAST(sum(pnl) AS BIGINT) AS total, CAST(1000000000 + sum(pnl) AS BIGINT) AS ending, (SELECT max(drawdown_pct) FROM q WHERE q.strategy = t.strategy) AS max_drawdown_pct, any_value(s.sharpe) AS sharpe FROM t LEFT JOIN s USING (strategy) GROUP BY t.strategy")
def trade_metrics(spark, sf_dir):
    return studies.metrics(tables.trades(spark, sf_dir), 1_000_000_000)


@query("SELECT token, symbol, CASE WHEN token % 3 = 0 THEN 'FUT' ELSE instrument_type END AS instrument_type, strike, lot_size FROM (SELECT p_partkey AS token, p_name AS symbol, p_type AS instrument_type, p_retailprice AS strike, p_size AS lot_size FROM part) UNION ALL SELECT -p_partkey, NULL, 'FUT', NULL, NULL FROM part WHERE p_partkey % 10 = 0 AND p_partkey > 0")
def upsert_instruments(spark, sf_dir):
    table = tables.instruments(spark, sf_dir)
    new = table.where("token % 3 = 0").select("token", F.lit("FUT").alias("instrument_type")).union(table.where("token % 10 = 0 AND token > 0").select(-F.col("token"), F.lit("FUT")))
    return upkeep.upsert(table, new, "token", ["instrument_type"])


@query(f"WITH {TICKS} SELECT instrument, date_trunc('hour', timestamp) AS timestamp, arg_min(sequence_number, sequence_number) AS sequence_number, arg_min(ltp, sequence_number) AS ltp FROM ticks GROUP BY 1, 2 HAVING min(sequence_number) IS NOT NULL AND NOT (hour(date_trunc('hour', timestamp)) = 0)")
def insert_first_wins(spark, sf_dir):
    rows = tables.ticks(spark, sf_dir).select("instrument", bars.start("1 hour").alias("timestamp"), "sequence_number", "ltp")
    return upkeep.insert_first(rows.where("hour(timestamp) = 0"), rows, ["instrument", "timestamp"], "sequence_number")


@query("SELECT p_partkey AS token, p_name AS symbol, p_type AS instrument_type, p_retailprice AS strike, p_size AS lot_size, p_retailprice BETWEEN 920 AND 980 AS is_active FROM part")
def activate_band(spark, sf_dir):
    return upkeep.activate(tables.instruments(spark, sf_dir), 954.0, 10, 3)


@query(f"WITH {TICKS} SELECT CASE WHEN timestamp >= TIMESTAMP '2024-01-20' THEN 'kept' ELSE 'old' END AS part, count(*) AS n FROM ticks GROUP BY 1")
def retention_split(spark, sf_dir):
    kept, old = upkeep.split(tables.ticks(spark, sf_dir), "2024-01-26", 7)
    return kept.select(F.lit("kept").alias("part")).union(old.select(F.lit("old"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(SQL["bars_1h"])
def stream_bars(spark, sf_dir):
    """The stream's bars are those of the batch query."""
    source = spark.readStream.schema(tables.table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*")
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = source.where("value > 0").select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id").alias("sequence_number"), F.col("value").alias("ltp"), k.alias("quantity"))
    return stream.bars_available_now(spark, rows, "1 hour", tables.shared_folder(spark)).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
