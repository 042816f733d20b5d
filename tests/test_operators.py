"""What SQL doesn't show: loops over state, streams, archives, and the rules' edges."""

import json
import math
import os
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL
from tickloom.operators import access, bars, calendar, contracts, upkeep, validation, volatility
from tickloom.sources import tables
from tickloom.streaming import feed
from tickloom.streaming import ticks as stream

REPO = Path(__file__).resolve().parents[1]
DAY = datetime(2026, 9, 3)


def frame(spark, rows):
    kind = "instrument string, sequence_number bigint, timestamp timestamp_ntz, open double, high double, low double, close double, volume bigint"
    return spark.createDataFrame(rows, kind)


def at(clock, day=DAY):
    h, m = map(int, clock.split(":"))
    return day + timedelta(hours=h, minutes=m)


def session(minutes, n):
    return [("a", k, at("09:15") + timedelta(minutes=minutes * k), 100.0, 101.0, 99.0, 100.5, 1000) for k in range(n)]


@pytest.mark.parametrize(("minutes", "n"), [(5, 75), (1, 375)])
def test_a_full_session_has_no_findings(spark, minutes, n):
    rows = frame(spark, session(minutes, n))
    assert validation.row_findings(rows, minutes).union(validation.sequence_findings(rows)).isEmpty()
    assert validation.gaps(rows, minutes).isEmpty()


@pytest.mark.parametrize(("prices", "often"), [((105, 101, 99, 100), 1), ((100, 101, 99, 105), 1), ((100, 101, 101, 99), 1), ((99.5, 98, 99, 99.2), 2), ((100, 100, 100, 100), 0)])
def test_invariants_of_a_bar(spark, prices, often):
    got = validation.row_findings(frame(spark, [("a", 0, at("09:15"), *map(float, prices), 0)]), 5)
    assert [r.code for r in got.collect()] == ["ohlc_invariant"] * often


def test_gap_order_and_alignment(spark):
    def codes(*clocks):
        rows = frame(spark, [("a", k, at(c), 100.0, 101.0, 99.0, 100.5, 1) for k, c in enumerate(clocks)])
        found = validation.row_findings(rows, 5).union(validation.sequence_findings(rows))
        return sorted(r.code for r in found.collect()), [r.timestamp for r in validation.gaps(rows, 5).collect()]

    assert codes("09:15", "09:20", "09:30") == ([], [at("09:25")])
    assert codes("09:15", "09:25", "09:20") == (["out_of_order"], [])
    assert codes("09:15", "09:22") == (["timestamp_not_aligned"], [at("09:20")])
    assert codes("09:15", "09:15") == (["duplicate_timestamp"], [])


def test_session_boundaries(spark):
    rows = spark.createDataFrame([(at("09:14") + timedelta(seconds=59), False), (at("09:15"), True), (at("15:29") + timedelta(seconds=59), True), (at("15:30"), False), (at("10:00", DAY + timedelta(days=2)), False)], "timestamp timestamp_ntz, want boolean")
    assert rows.where(validation.in_session() != F.col("want")).isEmpty()


def test_window_bounds(spark):
    rows = frame(spark, session(5, 4))
    assert access.window(rows, at("09:20"), at("09:30")).count() == 2
    assert access.window(rows, at("09:20"), at("09:20")).isEmpty()
    with pytest.raises(ValueError):
        access.window(rows, at("09:20"), at("09:15"))
    assert [r.timestamp for r in access.completed(rows, at("09:27"), "5 minutes").orderBy("timestamp").collect()] == [at("09:15"), at("09:20")]


def test_close_to_close_volatility(spark):
    rows = frame(spark, [("a", k, at("09:15") + timedelta(minutes=5 * k), c, c, c, c, 1) for k, c in enumerate([100.0, 101.0, 100.0, 101.0, 100.0])])
    got = volatility.realised(rows, 5).orderBy("timestamp").collect()
    assert got[-1].close_close == pytest.approx(1.367944, rel=1e-5)
    assert got[-2].close_close is None


def test_implied_volatility_is_the_price_inverted():
    sigma = np.linspace(0.05, 2.0, 40)
    spot, strike, years = np.full(40, 100.0), np.linspace(80, 120, 40), np.full(40, 0.3)
    for call in (True, False):
        paid = volatility.price(spot, strike, years, sigma, np.full(40, call))
        got = volatility.implied(spot, strike, years, paid, np.full(40, call))
        good = ~np.isnan(got)
        assert good.mean() > 0.9 and np.allclose(volatility.price(spot, strike, years, got, call)[good], paid[good], atol=1e-6)
    assert np.isnan(volatility.implied(np.array([100.0]), np.array([100.0]), np.array([0.0]), np.array([5.0]), np.array([True])))[0]


def test_event_time(spark):
    anchor, received = 1788409800, datetime(2026, 9, 3, 11)
    rows = [(anchor * 1000, None), (None, anchor), (anchor * 1000, anchor - 3600), (None, 0), (-1, None)]
    df = spark.createDataFrame([(*r, received) for r in rows], "a bigint, b bigint, c timestamp_ntz")
    got = [(r.x.time, r.x.source) for r in df.select(stream.event_time(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()]
    ten = datetime(2026, 9, 3, 10)
    assert got == [(ten, "exchange"), (ten, "last_traded"), (ten, "exchange"), (received, "received"), (received, "received")]


def test_first_insert_wins_and_upsert_keeps_other_columns(spark):
    old = spark.createDataFrame([(1, "x", True), (2, "y", False)], "token int, kind string, active boolean")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "token int, kind string")
    assert sorted(map(tuple, upkeep.upsert(old, new, "token", ["kind"]).collect())) == [(1, "x", True), (2, "z", False), (3, "w", None)]
    arrived = spark.createDataFrame([(3, "b", 2), (3, "a", 1), (1, "c", 0)], "token int, kind string, n int")
    assert [tuple(r) for r in upkeep.insert_first(old, arrived, ["token"], "n").select("token", "kind").collect()] == [(3, "a")]


def test_upsert_of_repeated_keys_and_odd_names(spark):
    old = spark.createDataFrame([(1, "x", 1, 2), (None, "n", 3, 4)], "token int, kind string, _key int, there int")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (None, "z"), (5, None)], "token int, kind string")
    got = sorted(map(tuple, upkeep.upsert(old, new, "token", ["kind"]).collect()), key=str)
    assert got == sorted([(1, "b", 1, 2), (None, "n", 3, 4), (None, "z", None, None), (5, None, None, None)], key=str)


def test_only_verified_days_go(spark, tmp_path):
    rows = frame(spark, session(5, 10) + [("b", 1, at("10:00", DAY + timedelta(days=1)), 1.0, 1.0, 1.0, 1.0, None)])
    done = upkeep.archive(rows, f"{tmp_path}/a")
    assert sorted((str(r.trade_date), r.n, r.verified) for r in done.collect()) == [("2026-09-03", 10, True), ("2026-09-04", 1, True)]
    assert upkeep.purged(rows, done).isEmpty()
    less = done.withColumn("verified", F.col("n") > 5)
    assert [r.instrument for r in upkeep.purged(rows, less).collect()] == ["b"]
    kept, old = upkeep.split(rows, "2026-09-14", 7)
    assert (kept.count(), old.count()) == (0, 11)


def test_damaged_archives_are_not_verified(spark, tmp_path, monkeypatch):
    """A day that reads back with another cell fails, the others don't."""
    rows = frame(spark, session(5, 3) + [("b", 1, at("10:00", DAY + timedelta(days=1)), 1.0, 1.0, 1.0, 1.0, 5)])
    sums = upkeep._sums
    calls = []

    def damaged(x):
        calls.append(x)
        return sums(x if len(calls) > 1 else x.withColumn("close", F.when(F.col("instrument") == "b", 9.0).otherwise(F.col("close"))))

    monkeypatch.setattr(upkeep, "_sums", damaged)
    assert {str(r.trade_date): r.verified for r in upkeep.archive(rows, f"{tmp_path}/a").collect()} == {"2026-09-03": True, "2026-09-04": False}


def test_compaction_keeps_rows_in_fewer_files(spark, tmp_path):
    rows = frame(spark, session(5, 60)).withColumn("trade_date", F.to_date("timestamp"))
    rows.repartition(6).write.partitionBy("trade_date").parquet(f"{tmp_path}/a")
    (r,) = upkeep.compacted(spark, f"{tmp_path}/a", f"{tmp_path}/b").collect()
    assert r.before > r.after == 1 and spark.read.parquet(f"{tmp_path}/b").count() == 60


def test_csv_keeps_null_empty_and_quoted_cells(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, 'a "b", c'), (4, "two\nlines"), (5, "\\N.")]
    upkeep.write_csv(spark.createDataFrame(rows, "n int, s string"), f"{tmp_path}/c")
    assert sorted(map(tuple, upkeep.read_csv(spark, f"{tmp_path}/c", "n int, s string").collect())) == rows


def test_quarantine_lines_are_appended_whole(spark, tmp_path):
    raw = spark.createDataFrame([("a", 1, "2026-09-03T09:25:00", "100", "98", "99", "99.5", "900"), ("a", 2, "2026-09-03T09:30:00", "100", "101", "99", "100.5", "-1")], "instrument string, sequence_number bigint, timestamp string, open string, high string, low string, close string, volume string")
    found = contracts.findings(raw, contracts.BAR_5M)
    for _ in range(2):
        contracts.write_quarantine(contracts.quarantine(raw, found), f"{tmp_path}/q")
    got = [json.loads(line) for f in sorted(tmp_path.glob("q/part-*")) for line in f.read_text().splitlines()]
    assert sorted((g["sequence_number"], tuple(g["reasons"]), json.loads(g["row"])["high"], "quarantined_at" in g) for g in got) == [(1, ("ohlc_invariant",), "98", True)] * 2 + [(2, ("negative_value",), "101", True)] * 2


def test_holidays_and_special_sessions(spark):
    friday, monday, tuesday, sunday = (datetime(2026, 9, 11), datetime(2026, 9, 14), datetime(2026, 9, 15), datetime(2026, 2, 1))
    rows = frame(spark, [("a", 1, at("15:25", friday), 1.0, 1.0, 1.0, 1.0, 1), ("a", 2, at("09:15", tuesday), 1.0, 1.0, 1.0, 1.0, 1)])
    assert validation.gaps(rows, 5).isEmpty()
    assert validation.gaps(rows, 5, trading=lambda day: F.weekday(day) < 5).count() == 75
    times = spark.createDataFrame([(at("10:00", d),) for d in (friday, monday, tuesday, sunday)], "timestamp timestamp_ntz")
    assert [r[0] for r in times.select(validation.in_session()).collect()] == [True, False, True, True]
    codes = {r.code for r in validation.row_findings(frame(spark, [("a", 1, at("10:00", monday), 1.0, 1.0, 1.0, 1.0, 1)]), 5).collect()}
    assert codes == {"out_of_session"}


def test_a_bar_starts_on_the_microsecond(spark):
    rows = spark.createDataFrame([(at("09:20"),), (at("09:20") + timedelta(microseconds=1),), (at("09:10"),), (at("09:21"),)], "timestamp timestamp_ntz")
    assert [r[0] for r in rows.select(validation.aligned(5)).collect()] == [True, False, True, False]


def test_ticks_repeated_or_late_are_warnings_and_stay(spark):
    rows = spark.createDataFrame([("a", 1, at("10:00"), 5.0, 6.0, 4.0, 10), ("a", 2, at("10:00"), 5.0, 6.0, 4.0, 9), ("a", 3, at("09:59"), 5.0, 6.0, 4.0, 11), ("a", 4, at("10:01"), 7.0, 6.0, 4.0, 12), ("a", 5, at("10:02"), 5.0, 3.0, 4.0, 13)], "instrument string, sequence_number bigint, timestamp timestamp_ntz, ltp double, high double, low double, volume bigint")
    found = validation.tick_findings(rows)
    got = sorted((r.sequence_number, r.code, r.severity) for r in found.collect())
    assert got == [(2, "duplicate_timestamp", "WARNING"), (2, "volume_regression", "WARNING"), (3, "out_of_order", "WARNING"), (4, "ltp_outside_day_range", "WARNING"), (5, "ohlc_invariant", "ERROR")]
    assert [validation.screen(rows, found, m).count() for m in ("report", "reject")] == [5, 4]
    with pytest.raises(ValueError):
        validation.screen(rows, found, "drop")


def test_completeness_and_the_order_of_sections(spark):
    bars_ = frame(spark, [("a", k, at(c), 1.0, 1.0, 1.0, 1.0, 1) for k, c in enumerate(("09:15", "09:25", "09:30"))])
    found = validation.row_findings(bars_, 5).union(validation.sequence_findings(bars_)).unionByName(validation.gap_findings(bars_, 5))
    report = validation.report(found, bars_, validation.expected(bars_, 5))
    (r,) = report.collect()
    assert (r.gaps, r.expected, r.completeness_pct, r.errors, r.status) == (1, 4, 75.0, 0, "WARNING")
    clean, bad = report.withColumns({"status": F.lit("PASS")}), report.withColumns({"status": F.lit("FAIL")})
    got = validation.sections({"zeta": bad, "ohlcv_5m": report, "alpha": clean, "tick": clean}).orderBy("position").collect()
    assert [(x.dataset, x.overall) for x in got] == [("tick", "FAIL"), ("ohlcv_5m", "FAIL"), ("zeta", "FAIL"), ("alpha", "FAIL")]
    assert {x.overall for x in validation.sections({"tick": clean, "ohlcv_5m": report}).collect()} == {"WARNING"}
    (line,) = validation.summary(found, bars_, "ohlcv_5m").collect()
    assert line.line == "ohlcv_5m: 3 rows, 0 errors, 1 warnings [unexpected_gap=1]"


def plain_volumes(rows):
    out, day, last = [], "none yet", None
    for n, d, v in rows:
        if d != day:
            day, last = d, None
        if v is not None:
            if last is not None and v < last:
                out.append(n)
            last = v
    return out


@pytest.mark.parametrize("size", [2, 5, 10_000])
def test_falling_volumes_whatever_the_parts(spark, size):
    rows = [(n, None if n % 11 == 0 else at("10:00", DAY + timedelta(days=n // 17 % 2)), None if n % 3 == 0 or n % 40 < 15 else (n * 7) % 23) for n in range(200)]
    got = validation.volume_findings(spark.createDataFrame([("a", *r) for r in rows], "instrument string, sequence_number bigint, timestamp timestamp_ntz, volume bigint"), size)
    assert sorted(r.sequence_number for r in got.collect()) == plain_volumes([(n, t and t.date(), v) for n, t, v in rows])


TICKS = "instrument string, timestamp timestamp_ntz, sequence_number bigint, ltp double, quantity bigint"


def test_time_decides_and_sequence_numbers_restart(spark):
    day = DAY + timedelta(days=1)
    rows = spark.createDataFrame([("a", at("15:00"), 900, 1.0, 1), ("a", at("10:00", day), 5, 2.0, 1), ("a", at("10:00", day), 0, 3.0, 1), ("a", at("10:30", day), None, 4.0, 1), (None, None, None, None, None)], TICKS)
    got = {r.instrument: r.ltp for r in access.latest(rows).collect()}
    assert got == {"a": 4.0, None: None}
    assert [r.ltp for r in access.latest(rows.where("instrument = 'a'"), as_of=at("10:00", day)).collect()] == [2.0]
    built = bars.build(rows.where("instrument = 'a'"), "1 hour").orderBy("timestamp").collect()
    assert [(r.open, r.close, r.n) for r in built] == [(1.0, 1.0, 1), (3.0, 4.0, 3)]
    grid = spark.createDataFrame([("a", at("12:00", day)), ("a", at("09:00", day)), ("a", at("09:00"))], "instrument string, timestamp timestamp_ntz")
    assert {r.timestamp: r.ltp for r in access.as_of(grid, rows).collect()} == {at("12:00", day): 4.0, at("09:00", day): 1.0, at("09:00"): None}


def test_null_prices_open_no_bar(spark):
    rows = spark.createDataFrame([("a", at("10:00"), 1, None, None), ("a", at("10:05"), 2, 7.0, 3), ("a", at("10:06"), 3, None, 1)], TICKS)
    (r,) = bars.build(rows, "1 hour").collect()
    assert (r.open, r.close, r.high, r.volume, r.n) == (7.0, 7.0, 7.0, 4, 3)


def test_books_with_clashing_columns(spark):
    names = ["side", "place", "level", "low", "high", "at", "own", "part", "minute", "mine", "row", "price"]
    ticks = tables.ticks(spark, SMALL).limit(2000)
    plain = tables.books(ticks)
    odd = tables.books(ticks).withColumns({c: F.lit("?") for c in names})
    for fn in (bars.walls, bars.absorptions):
        assert sorted(map(tuple, fn(odd).collect())) == sorted(map(tuple, fn(plain).collect())) != []
    assert bars.walls(plain.limit(0)).isEmpty() and bars.absorptions(plain.limit(0)).isEmpty()
    none = plain.withColumns({"best_5_buy": F.lit(None).cast(plain.schema["best_5_buy"].dataType), "best_5_sell": F.lit(None).cast(plain.schema["best_5_buy"].dataType)})
    assert bars.walls(none).isEmpty() and bars.analytics(none, "1 hour").where("avg_spread <> 0").isEmpty()


def test_lookups(spark):
    some = spark.createDataFrame([(2, "Nifty", "N", "FUTIDX", True), (1, "NIFTY", "N", "OPTIDX", None), (3, None, None, None, True)], "token int, symbol string, name string, instrument_type string, is_active boolean")
    assert access.token_of(some, "nifty") == 1 and access.token_of(some, 7) == 7
    with pytest.raises(LookupError):
        access.token_of(some, "gold")
    assert {r.token for r in access.listed(some, symbols=["NIFTY"]).collect()} == {2} and access.listed(some).isEmpty()
    assert {r.token for r in access.filtered(some, text="if", active=True).collect()} == {2} and access.filtered(some).count() == 3
    rows = frame(spark, session(5, 4))
    assert access.inclusive(rows, at("09:20"), at("09:30")).count() == 3
    assert [r.note for r in access.truncated(rows, ["timestamp"], 4).collect()] == [None] * 4
    assert access.truncated(rows, ["timestamp"], 3).where("note IS NOT NULL").count() == 3
    assert {r.total for r in access.paged(rows, ["timestamp"], 1, 2).collect()} == {4} and access.page(rows, ["timestamp"], 9, 2).isEmpty()


def test_the_error_function():
    x = np.concatenate((np.linspace(-7, 7, 20001), [np.nan, np.inf, -np.inf, 0.0]))
    got, want = volatility.erf(x), np.array([math.erf(v) for v in x])
    assert np.nanmax(np.abs(got - want)) < 1e-14 and np.isnan(got[-4])


def test_estimators_by_name():
    with pytest.raises(ValueError):
        volatility.by_name("yang_zhang")


def test_packets_are_parsed_once(spark):
    lines = spark.createDataFrame([('{"token":"t","last_traded_price":"100","exchange_timestamp":"1"}',), ("no json",)], "value string")
    out = feed.sources(feed.parsed(feed.packets(lines), spark.createDataFrame([("t", "T")], "token string, instrument string")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and [(r.time_source, r.n) for r in out.collect()] == [("exchange", 1)]


def test_requests_without_a_trading_day_are_left_out(spark):
    rows = spark.createDataFrame([(1, datetime(2026, 9, 12), datetime(2026, 9, 14)), (2, datetime(2026, 9, 12), datetime(2026, 9, 15))], "token int, start timestamp_ntz, end timestamp_ntz")
    assert [r.token for r in calendar.open_fetches(rows).collect()] == [2]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert bars.widen(none.withColumn("n", F.lit(1)), "1 hour").isEmpty()
    assert volatility.realised(none, 5).isEmpty() and validation.volume_findings(none).isEmpty() and access.latest(none).isEmpty()
    assert validation.gaps(none, 5).isEmpty() and validation.sequence_findings(none).isEmpty()


def test_the_entry_module_works_without_the_text_operators(tmp_path):
    code = f"""
import sys, importlib.abc
class No(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "tickloom.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, No()); sys.path.insert(0, {str(REPO)!r})
import __spark_entry__ as e
assert e.queries() and e.oracle_sql() and not any(k.startswith("op1_") or k == "pipeline" for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_missing_libraries_are_no_missing_operators(tmp_path):
    code = f"""
import sys, importlib.abc
class No(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "tickloom.sources":
            raise ModuleNotFoundError("No module named 'xyz'", name="xyz")
sys.meta_path.insert(0, No()); sys.path.insert(0, {str(REPO)!r})
try:
    import __spark_entry__
except ImportError as e:
    assert e.name == "xyz"
else:
    raise SystemExit(1)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


@pytest.mark.parametrize(("per_batch", "left"), [(1, [2]), (10, [1, 2])])
def test_late_ticks_of_a_stream(spark, tmp_path, per_batch, left):
    """A tick whose bar ended before the watermark that the batch before began with is dropped; within a batch none is late."""
    kind = "instrument string, timestamp timestamp, sequence_number bigint, ltp double, quantity bigint"
    files = [[("a", at("12:00"), 1, 5.0, 1)], [("a", at("12:01"), 4, 5.0, 1)], [("a", at("09:00"), 2, 6.0, 1), ("a", at("12:00") + timedelta(seconds=-5), 3, 4.0, 1)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    parts = sorted((tmp_path / "in").glob("part-*"), key=lambda p: p.stat().st_mtime)
    for k, p in enumerate(parts):
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", per_batch).parquet(f"{tmp_path}/in")
    got = stream.bars_available_now(spark, source, "1 hour", f"file://{tmp_path}/run").orderBy("timestamp").collect()
    assert [r.timestamp.hour for r in got] == ([9, 11, 12] if left == [1, 2] else [11, 12])


def test_only_new_ticks_are_appended(spark):
    kind = "instrument string, timestamp timestamp_ntz, sequence_number bigint, ltp double"
    there = spark.createDataFrame([("a", at("10:00"), 1, 5.0), ("a", at("10:00"), None, 5.0)], kind)
    new = spark.createDataFrame([("a", at("10:00"), 1, 9.0), ("a", at("10:00"), None, 9.0), ("a", at("10:00"), 2, 1.0), ("a", at("10:00"), 2, 1.0)], kind)
    assert [(r.sequence_number, r.ltp) for r in stream.append_new(new, there).collect()] == [(2, 1.0)]


def test_a_stream_keeps_one_of_equal_ticks(spark, tmp_path):
    rows = [("a", at("10:00"), 1, 5.0), ("a", at("10:00"), 1, 5.0), ("a", at("10:00"), 2, 5.0), ("b", at("10:00"), 1, 5.0)]
    kind = "instrument string, timestamp timestamp, sequence_number bigint, ltp double"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
    out = stream.deduplicated(source).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
    out.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("instrument", "sequence_number").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("a", 2), ("b", 1)]
