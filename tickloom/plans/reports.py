"""Queries for whole reports, levels of any kind of JSON, tables by partition, and records as they come, with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, breakouts, calendar, contracts, options, partitions, reporting, upkeep, validation, variants
from ..sources import tables
from ..streaming import sinks
from ..streaming import ticks as stream
from . import catalogue, records, streams
from .registry import SQL, query

_PERIOD = (datetime(2024, 1, 1), datetime(2026, 12, 31))
_NOTE = "The calendar has no holidays for 2024, 2025; only weekends are left out there, so holidays of those years count as unexpected gaps."
_ISO = "CASE WHEN {x} IS NULL THEN NULL WHEN microsecond({x}) % 1000000 <> 0 THEN strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S') END"
_REPORT = f"""{records._SECTIONS}, sc AS (SELECT instrument, 'tick' AS dataset, code, count(*) AS c FROM found GROUP BY 1, 2, 3 UNION ALL SELECT instrument, 'ohlcv_60m', code, count(*) FROM every GROUP BY 1, 2, 3),
ic AS (SELECT instrument, dataset, string_agg('"' || code || '":' || c, ',' ORDER BY code) AS codes FROM sc GROUP BY 1, 2),
each AS (SELECT both_.*, codes, {_ISO.format(x='first')} AS f, {_ISO.format(x='last')} AS l FROM both_ LEFT JOIN ic USING (instrument, dataset)),
overall AS (SELECT instrument, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARNING' ELSE 'PASS' END AS overall FROM each GROUP BY 1)"""
_JSON_CELLS = " || ".join(f"""',"{to}":' || coalesce(CAST({c} AS VARCHAR), 'null')""" for to, c in reporting._CELLS.items())


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on the faulty bars and ticks."""
    ticks, rows = records.faulty_ticks(spark, sf_dir), catalogue.faulty(spark, sf_dir)
    instruments = ticks.select("instrument").distinct()
    found = catalogue.findings(spark, sf_dir).unionByName(validation.gap_findings(rows, 60))
    sections = {"ohlcv_60m": reporting.section(found, rows, instruments, validation.expected(rows, 60)), "tick": reporting.section(validation.tick_findings(ticks), ticks, instruments)}
    return reporting.whole(instruments, *_PERIOD, sections)


@query(
    f"""WITH {_REPORT}, js AS (SELECT instrument, place, '{{"dataset":"' || dataset || '","status":"' || status || '"' || {_JSON_CELLS} || ',"first_timestamp":' || coalesce('"' || f || '"', 'null') || ',"last_timestamp":' || coalesce('"' || l || '"', 'null') || ',"issue_counts":{{' || coalesce(codes, '') || '}}}}' AS s FROM each)
SELECT instrument, '{{"instrument":"' || instrument || '","period":{{"start":"2024-01-01T00:00:00","end":"2026-12-31T00:00:00"}},"generated_at":null,"status":"' || any_value(overall) || '","sections":[' || string_agg(s, ',' ORDER BY place) || '],"notes":["{_NOTE}"]}}' AS report FROM js JOIN overall USING (instrument) GROUP BY 1"""
)
def report_json(spark, sf_dir):
    """Each instrument's report as one JSON object."""
    return reporting.as_json(_whole(spark, sf_dir))


def _lines(*pairs: tuple[str, str]) -> str:
    return " || ".join(f"chr(10) || '  {label:<16}: ' || {x}" for label, x in pairs)


@query(
    f"""WITH {_REPORT}, ls AS (SELECT instrument, place, chr(10) || chr(10) || CASE dataset WHEN 'tick' THEN 'Ticks' ELSE dataset END || '  [' || status || ']' || {_lines(('Records', 'n'))} || CASE WHEN expected IS NULL THEN '' ELSE {_lines(('Expected bars', "expected || ' (completeness ' || completeness_pct || '%)'"))} END
|| {_lines(('Duplicates', 'duplicates'), ('Out-of-order', 'out_of_order'), ('Schema invalid', 'schema_invalid'))} || CASE WHEN dataset = 'tick' THEN {_lines(('Invalid snapshot', 'invalid_ohlc'))} ELSE {_lines(('Invalid OHLC', 'invalid_ohlc'), ('Unexpected gaps', 'gaps'))} END
|| {_lines(('Out-of-session', 'outside_session'), ('Volume issues', 'volume_issues'))} AS s FROM each)
SELECT instrument, 'Instrument: ' || instrument || chr(10) || 'Period: 2024-01-01 00:00:00 → 2026-12-31 00:00:00' || string_agg(s, '' ORDER BY place) || chr(10) || chr(10) || 'Note: {_NOTE}' || chr(10) || chr(10) || 'Overall status: ' || any_value(overall) AS text FROM ls JOIN overall USING (instrument) GROUP BY 1"""
)
def report_text(spark, sf_dir):
    """The same for people."""
    return reporting.as_text(_whole(spark, sf_dir))


#: Buying sides of books that are an object, a text, a number, no JSON, or an array of odd elements.
_ODD = ((11, '{"price":1,"quantity":9999}'), (13, '"text"'), (17, "7"), (19, "[{"), (23, '[5,{"price":"2.5","quantity":"9000"}]'))
_IS_ODD = " OR ".join(f"sequence_number % {n} = 0" for n, _ in _ODD)


def odd_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with levels as JSON texts."""
    rows = catalogue.books(spark, sf_dir).withColumns({c: F.to_json(c) for c in variants.SIDES})
    buy = F.col("best_5_buy")
    for n, text in reversed(_ODD):
        buy = F.when(F.col("sequence_number") % n == 0, text).otherwise(buy)
    return rows.withColumn("best_5_buy", buy)


@query(
    f"""WITH {catalogue.BOOKS}, lv AS (SELECT instrument, sequence_number, side FROM levels WHERE size >= 2000 AND (side = 'SELL' OR NOT ({_IS_ODD})) UNION ALL SELECT instrument, sequence_number, 'BUY' FROM ticks WHERE sequence_number % 23 = 0 AND NOT ({_IS_ODD.rpartition(' OR ')[0]})),
w AS (SELECT sequence_number, count(*) FILTER (WHERE side = 'BUY') AS b, count(*) FILTER (WHERE side = 'SELL') AS s FROM lv GROUP BY 1)
SELECT instrument, time_bucket(INTERVAL '1 hour', timestamp) AS timestamp, CAST(sum(coalesce(b, 0)) AS BIGINT) AS walls_buy, CAST(sum(coalesce(s, 0)) AS BIGINT) AS walls_sell FROM ticks LEFT JOIN w USING (sequence_number) GROUP BY 1, 2"""
)
def walls_of_variants(spark, sf_dir):
    """Walls by hour in books whose levels may be any JSON: what is no array has none."""
    return bars.wall_counts(variants.books(variants.parsed(odd_books(spark, sf_dir))), "1 hour")


@query(
    f"""WITH {catalogue.TICKS} SELECT instrument, CASE WHEN sequence_number % 11 = 0 THEN 'object' WHEN sequence_number % 13 = 0 THEN 'string' WHEN sequence_number % 17 = 0 THEN 'number' WHEN sequence_number % 19 = 0 THEN NULL ELSE 'array' END AS kind, count(*) AS n FROM ticks GROUP BY 1, 2"""
)
def level_kinds(spark, sf_dir):
    """Which kinds of JSON an instrument's levels are."""
    rows = variants.parsed(odd_books(spark, sf_dir))
    return rows.select("instrument", variants.kind(F.col("best_5_buy")).alias("kind")).groupBy("instrument", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {catalogue.TICKS} SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n FROM ticks WHERE CAST(timestamp AS DATE) >= DATE '2024-01-20' OR CAST(timestamp AS DATE) = DATE '2024-01-10' GROUP BY 1")
def retention_partitions(spark, sf_dir):
    """A table of the catalog by day after old days are archived, verified and dropped, but for one that couldn't be verified: the
    partitions that the catalog lists, and their rows."""
    table = f"{partitions.database(spark)}.ticks"
    partitions.created(tables.ticks(spark, sf_dir).withColumn("trade_date", F.to_date("timestamp")), table, "trade_date")
    _, old = upkeep.split(spark.table(table).drop("trade_date"), "2024-01-26", 7)
    done = upkeep.archive(old, f"{tables.shared_folder(spark)}/archive")
    partitions.drop_days(spark, table, partitions.staged(done.withColumn("verified", F.col("verified") & (F.col("trade_date") != F.lit("2024-01-10").cast("date")))))
    partitions.compact(spark, table)
    listed = spark.sql(f"SHOW PARTITIONS {table}").select(F.split("partition", "=")[1].alias("day"))
    counts = spark.table(table).groupBy(F.col("trade_date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, "day", "left")


_LISTED = "SELECT p_partkey AS token, (['NSE', 'NFO', 'BSE', 'MCX', 'NCX'])[p_partkey % 5 + 1] AS exchange, p_name || '-' || p_partkey AS symbol FROM part"


@query(
    f"""WITH t AS ({_LISTED}), n AS (SELECT token, exchange, symbol || '!' AS symbol FROM t WHERE token % 9 = 0 UNION ALL SELECT token, 'BFO', symbol FROM t WHERE token % 50 = 0)
SELECT token, exchange, coalesce(n.symbol, t.symbol) AS symbol, CASE WHEN n.symbol IS NOT NULL THEN TIMESTAMP '2026-09-03 08:00:00' END AS updated_at FROM t FULL JOIN n USING (token, exchange)"""
)
def merged_instruments(spark, sf_dir):
    """A table of instruments by (token, exchange) after a batch was merged into the partitions that it touches."""
    table = f"{partitions.database(spark)}.instruments"
    rows = tables.listing(spark, sf_dir).select("token", "exchange", "symbol")
    keys = ["token", "exchange"]
    partitions.keyed(rows, table, keys)
    new = rows.where("token % 9 = 0").withColumn("symbol", F.concat("symbol", F.lit("!"))).union(rows.where("token % 50 = 0").withColumn("exchange", F.lit("BFO")))
    partitions.merge(spark, table, new, keys, ["symbol"], F.lit("2026-09-03 08:00:00").cast("timestamp_ntz"))
    return spark.table(table).drop("bucket")


@query(
    f"""WITH {records._MOVED}, s AS (SELECT CASE WHEN {records._DAY.format(t='timestamp')} AND minute(timestamp) % 5 = 0 AND second(timestamp) >= 10 AND hour(timestamp) * 60 + minute(timestamp) BETWEEN 560 AND 930 THEN date_trunc('minute', timestamp) END AS slot FROM ticks)
SELECT CAST(slot AS VARCHAR) AS slot, count(*) AS n FROM s GROUP BY 1"""
)
def due_slots(spark, sf_dir):
    """The slot whose bar may be fetched at the time of each tick, and how many ticks have it."""
    return records.moved(spark, sf_dir).select(calendar.due_slot(F.col("timestamp")).cast("string").alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {catalogue.TICKS} SELECT sequence_number, CASE sequence_number % 5 WHEN 1 THEN date_trunc('second', timestamp) + INTERVAL 330 MINUTE WHEN 2 THEN date_trunc('second', timestamp) WHEN 3 THEN date_trunc('second', timestamp) + INTERVAL 150 MINUTE WHEN 4 THEN NULL ELSE timestamp END AS timestamp FROM ticks"""
)
def iso_times(spark, sf_dir):
    """Times as text, with and without an offset, on the exchange's clock; what is no time is null."""
    at, n = F.col("timestamp"), F.col("sequence_number")
    text = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    cell = F.when(n % 5 == 1, F.concat(text, F.lit("Z"))).when(n % 5 == 2, F.concat(text, F.lit("+05:30"))).when(n % 5 == 3, F.concat(F.translate(text, "T", " "), F.lit("+0300"))).when(n % 5 == 4, F.concat(text, F.lit("?"))).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return tables.ticks(spark, sf_dir).select("sequence_number", contracts.local(cell).alias("timestamp"))


@query(f"WITH {catalogue.HOURS} SELECT instrument, row_number() OVER (PARTITION BY instrument ORDER BY timestamp) AS sequence_number, timestamp, open, high, low, close, CASE WHEN minute(timestamp) = 0 AND day(timestamp) % 2 = 0 THEN volume END AS volume FROM bars")
def candle_records(spark, sf_dir):
    """Positional records of text, some without their last cell, as named ones and in their types."""
    rows = catalogue.hours(spark, sf_dir).withColumn("sequence_number", F.expr("row_number() OVER (PARTITION BY instrument ORDER BY timestamp)").cast("bigint"))
    cells = [F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), *[F.col(c).cast("string") for c in ("open", "high", "low", "close")]]
    positional = F.when(F.dayofmonth("timestamp") % 2 == 0, F.array(*cells, F.col("volume").cast("string"))).otherwise(F.array(*cells))
    named = contracts.candles(rows.select("instrument", "sequence_number", positional.alias("candle")))
    return contracts.typed(named, contracts.BAR_5M).withColumn("volume", F.col("volume").cast("bigint"))


@query(f"SELECT instrument, sequence_number, array_to_string(reasons, ',') AS reasons, instrument AS of_row FROM ({SQL['raw_quarantine']})")
def quarantine_lines(spark, sf_dir):
    """Records with an error after they were appended to JSON lines, read again, each with the record as it came."""
    path = f"{tables.shared_folder(spark)}/quarantine"
    raw = catalogue.raw_bars(spark, sf_dir)
    contracts.write_quarantine(contracts.quarantine(raw, contracts.findings(raw, contracts.BAR_5M)), path)
    back = spark.read.schema("instrument string, sequence_number bigint, row string, reasons array<string>").json(path)
    return back.select("instrument", "sequence_number", F.array_join("reasons", ",").alias("reasons"), F.get_json_object("row", "$.instrument").alias("of_row"))


@query(f"WITH {streams._AGAIN} SELECT DISTINCT instrument, timestamp, sequence_number FROM dealt")
def stream_deduplicated(spark, sf_dir):
    """Ticks of a stream, each key once, forgotten after the watermark."""
    came = streams.repeated_stream(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    folder, once = tables.shared_folder(spark), stream.deduplicated(came, "2 days")
    sinks.run_available(once, folder, sinks.batches_at(folder))
    return sinks.stored(spark, folder, once.schema).select("instrument", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "sequence_number")


@query(f"WITH {catalogue._SUITE} SELECT instrument, CAST(day AS VARCHAR) AS day, side, minute, entry, round(pnl + 2, 6) AS pnl FROM trades WHERE name = 'FH_BREAK'")
def first_hour_trades(spark, sf_dir):
    """The trades of the first range alone, without costs."""
    found = breakouts.first_hour(bars.build(tables.ticks(spark, sf_dir), "5 minutes"), catalogue.ALL_DAY, buffer=breakouts.BUFFER, least=3)
    return found.select("instrument", F.col("day").cast("string").alias("day"), "side", "minute", "entry", F.round("pnl", 6).alias("pnl"))


@query(f"WITH {catalogue._OPTIONS} SELECT DISTINCT name, CAST(strike AS DOUBLE) AS strike FROM o WHERE token IN (SELECT token FROM c) AND name IN (SELECT name FROM o JOIN c USING (token) WHERE timestamp <= TIMESTAMP '1997-06-30')")
def strike_list(spark, sf_dir):
    """The strikes themselves of each name's next expiry, as of a day."""
    near = options.at_the_money(*catalogue.option_tables(spark, sf_dir), datetime(1997, 6, 30))
    return near.select("name", F.explode(F.col("strikes").cast("array<double>")).alias("strike"))


_FIELDS = contracts.BAR_5M
_ONE_OF = {name: ", ".join(repr(f.name) for f in _FIELDS.fields if test(f)) for name, test in (("any", lambda f: True), ("required", lambda f: f.required), ("price", lambda f: f.positive))}


@query(
    f"""SELECT field, code, count(*) AS n, CASE WHEN field = 'timestamp' THEN 'time' WHEN field IN ({_ONE_OF['any']}) THEN 'number' END AS kind, CASE WHEN field IN ({_ONE_OF['any']}) THEN field IN ({_ONE_OF['required']}) END AS required,
CASE WHEN field IN ({_ONE_OF['any']}) THEN field IN ({_ONE_OF['price']}) END AS price FROM ({SQL['raw_findings']}) GROUP BY 1, 2"""
)
def field_findings(spark, sf_dir):
    """How often each field breaks each rule, and what the contract says of it."""
    return contracts.by_field(contracts.findings(catalogue.raw_bars(spark, sf_dir), _FIELDS), _FIELDS)
