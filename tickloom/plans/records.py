"""Queries over ticks whose sequence restarts, holidays, findings on ticks, and the whole quality report, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, bars, calendar, validation, volatility
from ..sources import tables
from ..streaming import feed
from ..streaming import ticks as stream
from . import catalogue
from .registry import query

#: Ticks whose sequence numbers restart and are missing for some; the order of time decides.
_ORDER = "ORDER BY timestamp, sequence_number NULLS FIRST"
RESTARTED = catalogue.TICKS.replace("event_id AS sequence_number", "CASE WHEN event_id % 13 <> 0 THEN event_id * 7 % 101 END AS sequence_number")


def restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.restarted(tables.ticks(spark, sf_dir))


@query(f"WITH {RESTARTED} SELECT instrument, timestamp, sequence_number, ltp, quantity FROM ticks QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY timestamp DESC, sequence_number DESC NULLS LAST) = 1")
def latest_by_time(spark, sf_dir):
    return access.latest(restarted(spark, sf_dir)).select("instrument", "timestamp", "sequence_number", "ltp", "quantity")


@query(f"WITH {RESTARTED} SELECT instrument, timestamp, ltp FROM ticks WHERE timestamp <= TIMESTAMP '2024-01-15 10:30:00' QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY timestamp DESC, sequence_number DESC NULLS LAST) = 1")
def latest_as_of(spark, sf_dir):
    return access.latest(restarted(spark, sf_dir), as_of=datetime(2024, 1, 15, 10, 30)).select("instrument", "timestamp", "ltp")


_BARS = f"""bars AS (SELECT instrument, time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, first(ltp {_ORDER}) AS open, max(ltp) AS high, min(ltp) AS low, last(ltp {_ORDER}) AS close,
CAST(sum(quantity) AS BIGINT) AS volume, count(*) AS n FROM ticks GROUP BY 1, 2)"""


@query(f"WITH {RESTARTED}, {_BARS} SELECT * FROM bars")
def bars_by_time(spark, sf_dir):
    return bars.build(restarted(spark, sf_dir), "1 hour")


_RESTARTED_LEVELS = RESTARTED + catalogue.BOOKS.removeprefix(catalogue.TICKS)


@query(
    f"""WITH {_RESTARTED_LEVELS} SELECT instrument, date_trunc('minute', timestamp) AS minute, side, CAST(printf('%.1f', price) AS DOUBLE) AS price, size AS quantity, ltp, timestamp FROM levels WHERE size >= 5000
QUALIFY row_number() OVER (PARTITION BY instrument, date_trunc('minute', timestamp), side, CAST(printf('%.1f', price) AS DOUBLE) ORDER BY timestamp, sequence_number NULLS FIRST, place) = 1"""
)
def walls_by_time(spark, sf_dir):
    return bars.walls(tables.books(restarted(spark, sf_dir)))


@query(
    f"""WITH {RESTARTED}, g AS (SELECT instrument, day + INTERVAL '12 hours' AS timestamp FROM (SELECT DISTINCT instrument FROM ticks), generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) s(day))
SELECT g.instrument, g.timestamp, (SELECT last(ltp {_ORDER}) FROM ticks t WHERE t.instrument = g.instrument AND t.timestamp <= g.timestamp) AS ltp FROM g"""
)
def as_of_by_time(spark, sf_dir):
    ticks = restarted(spark, sf_dir)
    grid = ticks.select("instrument").distinct().select("instrument", F.explode(F.expr("sequence(TIMESTAMP_NTZ'2024-01-01 12:00:00', TIMESTAMP_NTZ'2024-01-31 12:00:00', INTERVAL 1 DAY)")).alias("timestamp"))
    return access.as_of(grid, ticks)


#: The events moved to a time with two holidays and a session on a Sunday: 2026-01-20 to 2026-02-18.
_MOVED = catalogue.TICKS.replace("ts AS timestamp", "ts + INTERVAL 750 DAY AS timestamp")
_DAY = f"(CAST({{t}} AS DATE) IN ({catalogue._SPECIAL}) OR (isodow({{t}}) < 6 AND CAST({{t}} AS DATE) NOT IN ({catalogue._HOLIDAYS})))"
_SESSION = f"({_DAY.format(t='timestamp')} AND {catalogue.SECOND} >= {validation.OPEN} AND {catalogue.SECOND} < {validation.CLOSE})"
_MOVED_HOURS = f"{_MOVED}, {catalogue.HOURS.removeprefix(catalogue.TICKS + ', ')}, b AS (SELECT instrument, timestamp + INTERVAL 15 MINUTE AS timestamp FROM bars)"
_GRID = f"""s AS (SELECT instrument, min(timestamp) AS lo, max(timestamp) AS hi FROM b GROUP BY 1),
g AS (SELECT instrument, day + to_minutes({validation.OPEN // 60} + k * 60) AS timestamp FROM s, generate_series(TIMESTAMP '{{a}}', TIMESTAMP '{{z}}', INTERVAL 1 DAY) d(day), range(6) r(k) WHERE {_DAY.format(t='day')} AND day + to_minutes({validation.OPEN // 60} + k * 60) BETWEEN lo AND hi)"""
_MOVED_GRID = _GRID.format(a="2026-01-01", z="2026-03-10")


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ticks(spark, sf_dir).withColumn("timestamp", F.expr("timestamp + INTERVAL 750 DAYS"))


def moved_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.build(moved(spark, sf_dir), "1 hour").withColumn("timestamp", F.expr("timestamp + INTERVAL 15 MINUTES"))


@query(f"WITH {_MOVED_HOURS}, {_MOVED_GRID} SELECT instrument, timestamp FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.instrument = g.instrument AND b.timestamp = g.timestamp)")
def holiday_gaps(spark, sf_dir):
    return validation.gaps(moved_hours(spark, sf_dir), 60)


@query(f"WITH {_MOVED} SELECT instrument, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n FROM ticks WHERE {_SESSION} GROUP BY 1, 2")
def session_ticks(spark, sf_dir):
    ticks = stream.in_hours(moved(spark, sf_dir))
    return ticks.groupBy("instrument", F.to_date("timestamp").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH s AS {catalogue.span_sql(730, 1095)}, d AS (SELECT d AS day, {_DAY.format(t='d')} AS open FROM s)
SELECT day + to_minutes({validation.OPEN // 60} + k * 75) AS timestamp FROM d, range(5) r(k) WHERE open"""
)
def year_grid(spark, sf_dir):
    """The starts of the bars of a year's sessions, holidays and special days among them, from the first tick to the last."""
    return validation.session_grid(calendar.days_of(catalogue.spread(spark, sf_dir, 730, 1095)), 75)


#: Ticks of that time with faults at fixed numbers: times repeated, late and missing, prices outside of the day's, falling volumes.
FAULTY_TICKS = f"""{_MOVED}, odd AS (SELECT instrument, sequence_number, CASE WHEN sequence_number % 29 = 0 THEN timestamp - INTERVAL 2 HOUR WHEN sequence_number % 43 = 0 THEN NULL WHEN sequence_number % 5 = 0 THEN date_trunc('hour', timestamp) ELSE timestamp END AS timestamp,
CASE WHEN sequence_number % 47 = 0 THEN NULL WHEN sequence_number % 53 = 0 THEN -ltp ELSE ltp END AS ltp, CASE WHEN sequence_number % 31 = 0 THEN ltp - 1 ELSE ltp + 1 END AS high, CASE WHEN sequence_number % 37 = 0 THEN NULL ELSE ltp - 0.5 END AS low,
CASE WHEN sequence_number % 23 = 0 THEN NULL ELSE sequence_number % 50 * 10 + hour(timestamp) * 100 END AS volume FROM ticks),
own AS (SELECT instrument, sequence_number, unnest(list_filter([CASE WHEN timestamp IS NULL THEN 'missing_field' END, CASE WHEN ltp IS NULL THEN 'missing_field' END, CASE WHEN ltp <= 0 THEN 'non_positive_price' END, CASE WHEN high <= 0 THEN 'non_positive_price' END,
CASE WHEN low <= 0 THEN 'non_positive_price' END, CASE WHEN volume < 0 THEN 'negative_value' END, CASE WHEN NOT {_SESSION} THEN 'out_of_session' END, CASE WHEN high < low THEN 'ohlc_invariant' END, CASE WHEN high >= low AND ltp NOT BETWEEN low AND high THEN 'ltp_outside_day_range' END], lambda x: x IS NOT NULL)) AS code FROM odd),
times AS (SELECT instrument, sequence_number, row_number() OVER (PARTITION BY instrument, timestamp ORDER BY sequence_number) AS again, timestamp < lag(timestamp) OVER (PARTITION BY instrument ORDER BY sequence_number) AS late FROM odd WHERE timestamp IS NOT NULL),
runs AS (SELECT *, sum(ch) OVER (PARTITION BY instrument ORDER BY sequence_number) AS run FROM (SELECT *, CAST(CAST(timestamp AS DATE) IS DISTINCT FROM lag(CAST(timestamp AS DATE)) OVER (PARTITION BY instrument ORDER BY sequence_number) AS INT) AS ch FROM odd)),
fell AS (SELECT *, last_value(volume IGNORE NULLS) OVER (PARTITION BY instrument, run ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
coded AS (SELECT * FROM own UNION ALL SELECT instrument, sequence_number, CASE WHEN again > 1 THEN 'duplicate_timestamp' ELSE 'out_of_order' END FROM times WHERE again > 1 OR late UNION ALL SELECT instrument, sequence_number, 'volume_regression' FROM fell WHERE volume < before),
found AS (SELECT *, CASE WHEN code IN ('out_of_session', 'volume_regression', 'ltp_outside_day_range', 'duplicate_timestamp', 'out_of_order') THEN 'WARNING' ELSE 'ERROR' END AS severity FROM coded)"""


def faulty_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ltp, at = F.col("sequence_number"), F.col("ltp"), F.col("timestamp")
    late = F.when(n % 29 == 0, at - F.expr("INTERVAL 2 HOURS")).when(n % 43 == 0, F.lit(None)).when(n % 5 == 0, F.date_trunc("hour", at).cast("timestamp_ntz")).otherwise(at)
    return moved(spark, sf_dir).select(
        "instrument", "sequence_number", late.alias("timestamp"), F.when(n % 47 == 0, F.lit(None)).when(n % 53 == 0, -ltp).otherwise(ltp).alias("ltp"), F.when(n % 31 == 0, ltp - 1).otherwise(ltp + 1).alias("high"),
        F.when(n % 37 != 0, ltp - 0.5).alias("low"), F.when(n % 23 != 0, n % 50 * 10 + F.hour(at) * 100).alias("volume"),
    )


@query(f"WITH {FAULTY_TICKS} SELECT instrument, sequence_number, code, severity FROM found")
def tick_findings(spark, sf_dir):
    return validation.tick_findings(faulty_ticks(spark, sf_dir))


@query(f"WITH {FAULTY_TICKS} SELECT instrument, code, severity, count(*) AS n FROM found GROUP BY 1, 2, 3")
def issue_counts(spark, sf_dir):
    return validation.by_code(validation.tick_findings(faulty_ticks(spark, sf_dir)))


@query(
    f"""WITH {FAULTY_TICKS}, c AS (SELECT instrument, code, count(*) AS n, count(*) FILTER (WHERE severity = 'ERROR') AS e FROM found GROUP BY 1, 2),
s AS (SELECT instrument, sum(e) AS e, sum(n - e) AS w, string_agg(code || '=' || n, ', ' ORDER BY code || '=' || n) AS codes FROM c GROUP BY 1), r AS (SELECT instrument, count(*) AS n FROM odd GROUP BY 1)
SELECT instrument, 'tick: ' || r.n || ' rows, ' || CAST(coalesce(e, 0) AS BIGINT) || ' errors, ' || CAST(coalesce(w, 0) AS BIGINT) || ' warnings' || coalesce(' [' || codes || ']', '') AS line FROM r LEFT JOIN s USING (instrument)"""
)
def batch_summary(spark, sf_dir):
    rows = faulty_ticks(spark, sf_dir)
    return validation.summary(validation.tick_findings(rows), rows, "tick")


@query(f"""WITH {FAULTY_TICKS} SELECT instrument, sequence_number, '{{"code":"' || code || '","severity":"' || severity || '","record":' || sequence_number || '}}' AS finding FROM found""")
def findings_as_json(spark, sf_dir):
    return validation.serialised(validation.tick_findings(faulty_ticks(spark, sf_dir)))


_MODES = f"WITH {FAULTY_TICKS}, bad AS (SELECT DISTINCT instrument, sequence_number FROM found WHERE severity = 'ERROR')"


@query(f"{_MODES} SELECT 'report' AS mode, count(*) AS n FROM odd UNION ALL SELECT 'reject', count(*) FROM odd WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.instrument = odd.instrument AND bad.sequence_number = odd.sequence_number)")
def screen_modes(spark, sf_dir):
    rows = faulty_ticks(spark, sf_dir)
    found = validation.tick_findings(rows)
    one, two = (validation.screen(rows, found, m).agg(F.lit(m).alias("mode"), F.count(F.lit(1)).alias("n")) for m in ("report", "reject"))
    return one.union(two)


def _counters(source: str) -> str:
    groups = ", ".join(f"count(*) FILTER (WHERE code IN ({', '.join(repr(c) for c in codes)})) AS {k}" for k, codes in validation.GROUPS.items())
    return f"SELECT instrument, count(*) FILTER (WHERE severity = 'ERROR') AS errors, count(*) FILTER (WHERE severity = 'WARNING') AS warnings, {groups} FROM {source} GROUP BY 1"


_NAMES = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("errors", "warnings", *validation.GROUPS))
_STATUS = "CASE WHEN coalesce(errors, 0) > 0 THEN 'FAIL' WHEN coalesce(warnings, 0) > 0 THEN 'WARNING' ELSE 'PASS' END AS status"
_BAR_GAPS = f"""{catalogue.FAULTY}, {catalogue.ROW_FINDINGS}, b AS (SELECT instrument, timestamp FROM bad WHERE timestamp IS NOT NULL), {_GRID.format(a='2023-12-31', z='2024-02-02')},
missing AS (SELECT instrument, 'unexpected_gap' AS code, 'WARNING' AS severity FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.instrument = g.instrument AND b.timestamp = g.timestamp)),
every AS (SELECT instrument, code, severity FROM findings UNION ALL SELECT * FROM missing), ec AS ({_counters('every')}),
due AS (SELECT instrument, count(*) AS expected FROM g GROUP BY 1), rows_ AS (SELECT instrument, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM bad GROUP BY 1),
report AS (SELECT instrument, n, first, last, {_NAMES}, expected, CAST(printf('%.2f', 100.0::DOUBLE * (expected - coalesce(gaps, 0)) / expected) AS DOUBLE) AS completeness_pct, {_STATUS} FROM rows_ LEFT JOIN ec USING (instrument) LEFT JOIN due USING (instrument))"""


def bar_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.faulty(spark, sf_dir)
    every = catalogue.findings(spark, sf_dir).unionByName(validation.gap_findings(rows, 60))
    return validation.report(every, rows, validation.expected(rows, 60))


@query(f"WITH {_BAR_GAPS} SELECT * FROM report")
def quality_report(spark, sf_dir):
    """The report on the faulty bars with the gaps between their first and last one, and how complete they are."""
    return bar_report(spark, sf_dir)


_SECTIONS = f"""{_BAR_GAPS}, {FAULTY_TICKS.replace(' ticks AS', ' later AS').replace('ticks AS (', 'later AS (').replace('FROM ticks', 'FROM later')}, tc AS ({_counters('found')}), tr AS (SELECT instrument, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM odd GROUP BY 1),
t AS (SELECT instrument, n, first, last, {_NAMES}, NULL::BIGINT AS expected, NULL::DOUBLE AS completeness_pct, {_STATUS} FROM tr LEFT JOIN tc USING (instrument)),
both_ AS (SELECT *, 'tick' AS dataset, 0 AS place FROM t UNION ALL BY NAME SELECT *, 'ohlcv_60m' AS dataset, 1 AS place FROM report)"""


@query(
    f"""WITH {_SECTIONS} SELECT * EXCLUDE (place), CAST(row_number() OVER (PARTITION BY instrument ORDER BY place) AS INTEGER) AS position,
CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) OVER (PARTITION BY instrument) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS overall FROM both_"""
)
def quality_sections(spark, sf_dir):
    """Ticks and bars of each instrument, each read and validated, as the sections of its report."""
    ticks = faulty_ticks(spark, sf_dir)
    return validation.sections({"ohlcv_60m": bar_report(spark, sf_dir), "tick": validation.report(validation.tick_findings(ticks), ticks)})


@query(f"WITH {catalogue._RV} SELECT instrument, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, arg_max(parkinson, timestamp) AS vol FROM x WHERE parkinson IS NOT NULL GROUP BY 1, 2")
def volatility_by_day(spark, sf_dir):
    """The last value of each day."""
    rv = volatility.realised(catalogue.hours(spark, sf_dir), 20).where("parkinson IS NOT NULL")
    return rv.groupBy("instrument", F.to_date("timestamp").cast("string").alias("day")).agg(F.max_by("parkinson", "timestamp").alias("vol"))


_ABSORBED = catalogue.SQL["absorption_events"].removeprefix("WITH ")
_HIT = _ABSORBED[: _ABSORBED.index(" SELECT instrument, date_trunc('minute', timestamp) AS minute, side, CAST(printf('%.1f', price) AS DOUBLE) AS wall")]
_FIRSTS = f"""{_HIT}, a AS (SELECT instrument, date_trunc('minute', timestamp) AS minute, side, CAST(printf('%.1f', price) AS DOUBLE) AS wall, timestamp, sequence_number, place FROM h
QUALIFY row_number() OVER (PARTITION BY instrument, date_trunc('minute', timestamp), side, CAST(printf('%.1f', price) AS DOUBLE) ORDER BY timestamp, sequence_number, place) = 1)"""


@query(f"WITH {_FIRSTS} SELECT strftime(minute, '%H:%M') AS label, instrument, side, wall FROM a ORDER BY timestamp, sequence_number, side, place LIMIT 30")
def first_absorptions(spark, sf_dir):
    """The first thirty, with the label of their minute."""
    found = bars.absorptions(catalogue.books(spark, sf_dir)).orderBy("timestamp", "sequence_number", "side", "place").limit(30)
    return found.select(F.date_format("minute", "HH:mm").alias("label"), "instrument", "side", "wall")


_STRIP = catalogue.SQL["dashboard_summary"]
_STRIP_S = _STRIP.removeprefix("WITH ")[: _STRIP.removeprefix("WITH ").index(" SELECT *, CASE WHEN imbalance")]


@query(
    f"""WITH {_STRIP_S}, f2 AS (SELECT instrument, sequence_number, min(ltp) OVER q AS lo, max(ltp) OVER q AS hi FROM ticks WINDOW q AS (PARTITION BY instrument ORDER BY timestamp RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL 5 MINUTES FOLLOWING)),
k AS (SELECT instrument, count(*) AS n FROM (SELECT DISTINCT instrument, date_trunc('minute', timestamp) AS minute, side, CAST(printf('%.1f', price) AS DOUBLE) AS wall FROM levels l JOIN f2 USING (instrument, sequence_number) WHERE size >= 3000 AND price > 0 AND ((side = 'BUY' AND lo < price) OR (side = 'SELL' AND hi > price))) GROUP BY 1)
SELECT s.*, CASE WHEN imbalance > 0.02 THEN 'BUY' WHEN imbalance < -0.02 THEN 'SELL' ELSE 'NEUTRAL' END AS bias, coalesce(k.n, 0) AS absorptions FROM s LEFT JOIN k USING (instrument)"""
)
def dashboard_strip(spark, sf_dir):
    b = catalogue.books(spark, sf_dir)
    return bars.strip(bars.analytics(b, "1 hour"), bars.wall_counts(b, "1 hour"), bars.absorptions(b))


@query("SELECT CASE event_type WHEN 'click' THEN 'CLICK-EQ' WHEN 'view' THEN 'VIEW-EQ' ELSE 'BUY-EQ' END AS instrument, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') AND round(value * 100) > 0 AND hour(ts) * 60 + minute(ts) BETWEEN 555 AND 929 AND isodow(ts) < 6 GROUP BY 1")
def feed_in_session(spark, sf_dir):
    ticks = stream.in_hours(feed.parsed(feed.packets(catalogue.feed_lines(spark, sf_dir)), catalogue.feed_tokens(spark)))
    return ticks.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"))


_TIMES = "CAST(timestamp AS DATE)"


@query(
    f"""WITH {catalogue.TICKS}, t AS (SELECT *, isodow(timestamp) < 6 AND {catalogue.SECOND} >= {validation.OPEN} AND {catalogue.SECOND} < {validation.CLOSE} AS s, timestamp >= TIMESTAMP '2024-01-20' AS retained FROM ticks)
SELECT count(*) AS total, count(*) FILTER (WHERE NOT s) AS out_of_session, count(*) FILTER (WHERE sequence_number > 0) AS sequenced, count(*) FILTER (WHERE retained) AS retained, count(*) FILTER (WHERE NOT retained) AS old,
count(DISTINCT {_TIMES}) FILTER (WHERE NOT retained) AS old_days, CAST(min({_TIMES}) FILTER (WHERE NOT retained) AS VARCHAR) AS first_day, CAST(max({_TIMES}) FILTER (WHERE NOT retained) AS VARCHAR) AS last_day FROM t"""
)
def purge_report(spark, sf_dir):
    """What a purge would take and leave, in one aggregation."""
    kept, day = F.col("timestamp") >= F.lit("2024-01-20").cast("timestamp_ntz"), F.to_date("timestamp")
    return tables.ticks(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~validation.in_session()).alias("out_of_session"), F.count_if(F.col("sequence_number") > 0).alias("sequenced"), F.count_if(kept).alias("retained"), F.count_if(~kept).alias("old"),
        F.count_distinct(F.when(~kept, day)).alias("old_days"), F.min(F.when(~kept, day)).cast("string").alias("first_day"), F.max(F.when(~kept, day)).cast("string").alias("last_day"),
    )
