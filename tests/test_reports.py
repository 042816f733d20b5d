"""Tables by partition, levels of any JSON, and the report with its exit status."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL
from tickloom import report as program
from tickloom.operators import bars, calendar, partitions, reporting, upkeep, validation, variants

DAY = datetime(2026, 9, 3, 9, 15)


@pytest.fixture
def days(spark):
    """A table of five days of twenty rows each."""
    table = f"{partitions.database(spark)}.ticks"
    rows = spark.range(100).select("id", (F.lit(DAY) + F.make_dt_interval((F.col("id") % 5).cast("int"))).alias("timestamp"))
    partitions.created(rows.withColumn("trade_date", F.to_date("timestamp")), table, "trade_date")
    return table


def files(spark, table):
    return {r[0] for r in spark.table(table).select(F.input_file_name()).distinct().collect()}


def test_only_verified_days_are_dropped(spark, days):
    """A day that isn't verified, one that has got another row since, and one without a name stay, with their files."""
    verified = spark.createDataFrame([("2026-09-03", 20, True), ("2026-09-04", 20, False), ("2026-09-05", 19, True), (None, 20, True)], "d string, n bigint, verified boolean").select(F.col("d").cast("date").alias("trade_date"), "n", "verified")
    before = files(spark, days)
    assert partitions.drop_days(spark, days, verified) == ["2026-09-03"]
    assert partitions.listed(spark, days) == [f"trade_date=2026-09-0{k}" for k in range(4, 8)]
    assert spark.table(days).count() == 80 and files(spark, days) < before
    assert partitions.drop_days(spark, days, verified) == []


def test_retention_of_a_table(spark, days, tmp_path):
    done = partitions.retain(spark, days, "2026-09-07", 2, f"file://{tmp_path}/archive")
    assert sorted((str(r.trade_date), r.n, r.verified) for r in done.collect()) == [(f"2026-09-0{k}", 20, True) for k in (3, 4, 5)]
    assert partitions.listed(spark, days) == ["trade_date=2026-09-06", "trade_date=2026-09-07"]
    assert spark.read.parquet(f"file://{tmp_path}/archive").count() == 60


def test_compaction_in_place(spark, days):
    spark.range(6).repartition(3).select("id", F.lit(DAY).alias("timestamp"), F.lit("2026-09-03").cast("date").alias("trade_date")).write.insertInto(days)
    before = files(spark, days)
    assert [(str(r.trade_date), r.files) for r in partitions.compact(spark, days).collect()] == [("2026-09-03", 4)]
    after = files(spark, days)
    assert spark.table(days).count() == 106 and len(after) == 5 and len(after & before) == 4
    assert partitions.compact(spark, days).isEmpty() and files(spark, days) == after


def test_a_merge_leaves_other_partitions_alone(spark):
    table = f"{partitions.database(spark)}.instruments"
    columns = "token int, exchange string, symbol string"
    rows = [(k, "NSE", f"s{k}") for k in range(200)] + [(1, "BSE", "other"), (None, "NSE", "no token")]
    keys, at = ["token", "exchange"], F.lit(DAY)
    partitions.keyed(spark.createDataFrame(rows, columns), table, keys, 32)
    before = files(spark, table)
    new = [(1, "NSE", "a"), (1, "NSE", "b"), (500, "NSE", "new"), (None, "NSE", "x")]
    touched = partitions.merge(spark, table, spark.createDataFrame(new, columns), keys, ["symbol"], at, 32)
    assert 1 <= touched <= 3 and len(before & files(spark, table)) >= len(before) - touched
    got = sorted(((r.token, r.exchange, r.symbol, r.updated_at) for r in spark.table(table).collect()), key=str)
    want = [(k, e, s, None) for k, e, s in rows if (k, e) != (1, "NSE")] + [(1, "NSE", "b", DAY), (500, "NSE", "new", DAY), (None, "NSE", "x", DAY)]
    assert got == sorted(want, key=str)
    now = files(spark, table)
    assert partitions.merge(spark, table, spark.createDataFrame([], columns), keys, ["symbol"], at, 32) == 0 and files(spark, table) == now


def test_levels_of_any_json(spark):
    texts = {'[{"price":1.5,"quantity":6000},{"price":1.4,"quantity":1}]': 1, '{"price":1,"quantity":9000}': 0, "7": 0, '"x"': 0, "null": 0, "true": 0, "[{": 0, "[]": 0, None: 0, '[5,{"price":"2.5","quantity":"9000"},{"price":"x","quantity":[1]},null]': 1}
    rows = [(f"i{k}", k, DAY, 1.0, t, None) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "instrument string, sequence_number bigint, timestamp timestamp_ntz, ltp double, best_5_buy string, best_5_sell string")
    parsed = variants.parsed(frame)
    kinds = [r[0] for r in parsed.orderBy("sequence_number").select(variants.kind(F.col("best_5_buy"))).collect()]
    assert kinds == ["array", "object", "number", "string", "null", "boolean", None, "array", None, "array"]
    books = variants.books(parsed)
    assert [r.walls_buy for r in bars.wall_counts(books, "1 hour").orderBy("instrument").collect()] == list(texts.values())
    assert sorted((r.instrument, r.price, r.quantity) for r in bars.walls(books).collect()) == [("i0", 1.5, 6000), ("i9", 2.5, 9000)]


FINDING = "instrument string, sequence_number bigint, code string, severity string"
TICK = "instrument string, sequence_number bigint, timestamp timestamp_ntz, ltp double, high double, low double, volume double"


def whole(spark, codes, start=datetime(2026, 9, 3), end=datetime(2026, 9, 4), notes=None):
    rows = spark.createDataFrame([("a", k, DAY + timedelta(seconds=k, microseconds=k), 1.0, 1.0, 1.0, None) for k in range(3)], TICK)
    findings = spark.createDataFrame([("a", 1, c, "ERROR" if c == "missing_field" else "WARNING") for c in codes], FINDING)
    some = spark.createDataFrame([("a",), ("b",)], "instrument string")
    return reporting.whole(some, start, end, {"z": reporting.section(findings.limit(0), rows, some), "tick": reporting.section(findings, rows, some)}, notes)


@pytest.mark.parametrize(("codes", "status", "left"), [([], "PASS", 0), (["out_of_session"] * 2, "WARNING", 1), (["out_of_session", "missing_field"], "FAIL", 2)])
def test_json_and_exit_status(spark, codes, status, left):
    report = whole(spark, codes)
    a, b = (json.loads(r.report) for r in reporting.as_json(report).orderBy("instrument").collect())
    assert reporting.exit_status(report) == left
    assert a["status"] == status and b["status"] == "PASS" and a["generated_at"] is None and a["notes"] == []
    assert [s["dataset"] for s in a["sections"]] == ["tick", "z"]
    assert a["sections"][0]["issue_counts"] == {c: codes.count(c) for c in set(codes)}
    assert (a["sections"][0]["records"], b["sections"][0]["records"], b["sections"][0]["first_timestamp"], a["sections"][0]["expected_records"]) == (3, 0, None, None)
    assert (a["sections"][0]["first_timestamp"], a["sections"][0]["last_timestamp"]) == ("2026-09-03T09:15:00", "2026-09-03T09:15:02.000002")
    assert a["period"] == {"start": "2026-09-03T00:00:00", "end": "2026-09-04T00:00:00"}


def test_text_and_notes(spark):
    notes = spark.createDataFrame([("a", "cut short")], "instrument string, note string")
    a, b = (r.text for r in reporting.as_text(whole(spark, ["volume_regression"], end=datetime(2027, 2, 1), notes=notes)).orderBy("instrument").collect())
    assert a.startswith("Instrument: a\nPeriod: 2026-09-03 00:00:00 → 2027-02-01 00:00:00\n\nTicks  [WARNING]\n  Records         : 3\n")
    assert "  Volume issues   : 1" in a and "\n\nNote: cut short\n\nNote: The calendar has no holidays for 2027;" in a and a.endswith("\n\nOverall status: WARNING")
    assert "cut short" not in b and "Records         : 0" in b
    nothing = reporting.whole(spark.createDataFrame([("a",)], "instrument string"), DAY, DAY, {})
    assert "No datasets were validated." in reporting.as_text(nothing).first().text and reporting.exit_status(nothing) == 0
    assert reporting.exit_status(nothing.limit(0)) == reporting.UNUSABLE


def test_years_without_a_calendar():
    assert calendar.uncovered(datetime(2025, 12, 31), datetime(2027, 1, 1)) == [2025, 2027] and calendar.uncovered(DAY, DAY) == []


def test_the_first_ticks_alone(spark):
    ticks = spark.createDataFrame([(i, k, DAY - timedelta(hours=k)) for i, n in (("a", 5), ("b", 3)) for k in range(n)], "instrument string, sequence_number bigint, timestamp timestamp_ntz")
    rows, over = reporting.truncated(ticks, 3)
    assert sorted((r.instrument, r.sequence_number) for r in rows.collect()) == [("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 1), ("b", 2)]
    assert [r.note for r in reporting.truncation_notes(over, 3).collect()] == ["Tick validation covers the first 3 rows of the period only; counts below say nothing of the rest."]


def test_the_program(spark, capsys):
    """It prints the report and ends with its status; what isn't there is an error of its own."""
    asked = [SMALL, "--instrument", "click", "--from", "2024-01-02", "--to", "2024-01-09T12:00:00"]
    assert program.main([*asked, "--timeframes", "tick,1m,5m", "--max-ticks", "20", "--json"], spark) in (1, 2)
    said = json.loads(capsys.readouterr().out)
    assert [s["dataset"] for s in said["sections"]] == ["tick", "ohlcv_1m", "ohlcv_5m"] and said["sections"][0]["records"] == 20 and len(said["notes"]) == 2
    assert program.main([*asked, "--timeframes", "5m"], spark) in (1, 2) and "5m OHLCV  [" in capsys.readouterr().out
    assert program.main([*asked, "--timeframes", "2h"], spark) == 3 and "2h" in capsys.readouterr().err
    assert program.main([SMALL, "--instrument", "none", "--from", "2024-01-02", "--to", "2024-01-09"], spark) == 3
    with pytest.raises(SystemExit):
        program.main([SMALL, "--instrument", "click", "--from", "yesterday", "--to", "2024-01-09"], spark)


def test_archives_and_tables_agree(spark, days, tmp_path):
    """upkeep.archive() of a table's rows is verified against what the catalog holds."""
    done = upkeep.archive(spark.table(days).drop("trade_date"), f"file://{tmp_path}/a")
    assert done.where("verified").count() == 5 and validation.report(spark.createDataFrame([], FINDING), spark.table(days).select(F.lit("a").alias("instrument"), "timestamp")).first().n == 100
