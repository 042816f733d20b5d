"""Breakouts, raw contracts and windows in parts against fixed cases."""

from datetime import datetime, timedelta

import pytest

from tests.compare import SMALL
from tickloom.operators import breakouts, calendar, contracts, validation, volatility
from tickloom.plans import catalogue

DAY = datetime(2026, 9, 3)


def at(clock, day=DAY):
    h, m = map(int, clock.split(":"))
    return day + timedelta(hours=h, minutes=m)


def bars(spark, path):
    """Minute bars of one day: flat at 100 to 10:15, then as path (clock, close) says."""
    change, rows = dict(path), []
    price = 100.0
    for k in range(375):
        now = at("09:15") + timedelta(minutes=k)
        price = change.get(now.strftime("%H:%M"), price)
        rows.append(("a", now, price + 0.5, price - 0.5, price))
    return spark.createDataFrame(rows, "instrument string, timestamp timestamp_ntz, high double, low double, close double")


def test_a_stopped_breakout(spark):
    trades = breakouts.suite(bars(spark, [("10:20", 103.0), ("12:00", 99.0)])).collect()
    r = {t.name: t for t in trades}["FH_BREAK"]
    assert (r.side, r.minute, r.entry, r.stop, r.exit, r.reason) == ("LONG", 615, 103.0, 99.5, 99.5, "stop")
    assert (r.pnl, r.risk, r.mfe, r.mae) == (-5.5, 3.5, 0.5, 4.5)
    fade = {t.name: t for t in trades}["FH_FADE"]
    assert (fade.side, fade.stop, fade.reason) == ("SHORT", 103.5, "stop")
    back = {t.name: t for t in trades}["FH_RETEST"]
    assert (back.minute, back.entry, back.stop) == (720, 100.5, 100.0)


def test_a_breakout_held_to_the_close(spark):
    day = bars(spark, [("11:00", 97.0), ("15:00", 95.0), ("15:21", 200.0)])
    (r,) = breakouts.first_hour(day).collect()
    assert (r.side, r.entry, r.exit, r.reason, r.pnl) == ("SHORT", 97.0, 95.0, "eod", 2.0)
    assert breakouts.first_hour(day.limit(299)).isEmpty()


RAW = "instrument string, sequence_number bigint, timestamp string, open string, high string, low string, close string, volume string"


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (("2026-09-03T09:15:00", "100", "101", "99", "100.5", "1e2"), []),
        (("2026-09-03T09:15:00", " 100 ", "101", "99", "100.5", "0"), []),
        (("2026-09-03T09:15:00+05:30", "100", "101", "99", "100.5", "1"), ["timezone_inconsistent"]),
        (("2026-09-03T09:15:00Z", "100", "101", "99", "100.5", "1"), ["timezone_inconsistent"]),
        (("next week", "true", "101", "99", "NaN", "-1"), ["malformed_timestamp", "negative_value", "unexpected_type", "unexpected_type"]),
        (("", None, "101", "99", "100", "1"), ["malformed_timestamp", "missing_field"]),
        (("2026-09-03T09:22:00", "0", "98", "99", "100", "1"), ["non_positive_price", "ohlc_invariant", "ohlc_invariant", "ohlc_invariant", "timestamp_not_aligned"]),
        ((None,) * 6, ["missing_field"] * 6),
    ],
)
def test_raw_bars(spark, row, want):
    found = sorted(r.code for r in contracts.findings(spark.createDataFrame([("a", 1, *row)], RAW), contracts.BAR_5M).collect())
    assert found == want


def test_raw_ticks_and_empty_tables(spark):
    tick = spark.createDataFrame([("a", 1, "2026-09-03T10:00:00", "105", "100", "99", "1.5"), ("a", 2, "2026-09-05T10:00:00", "100", "98", "99", "2")], "instrument string, sequence_number bigint, timestamp string, ltp string, high string, low string, ltq string")
    found = sorted((r.sequence_number, r.code) for r in contracts.findings(tick, contracts.TICK).collect())
    assert found == [(1, "ltp_outside_day_range"), (1, "unexpected_type"), (2, "ohlc_invariant"), (2, "out_of_session")]
    assert contracts.findings(tick.limit(0), contracts.TICK).isEmpty()


def test_offsets_become_the_exchange_clock(spark):
    cells = spark.createDataFrame([("2026-09-03T03:45:00Z",), ("2026-09-03T09:15:00+05:30",), ("2026-09-03 09:15:00",), ("x",), (None,)], "c string")
    assert [r[0] for r in cells.select(contracts.local(cells.c)).collect()] == [at("09:15")] * 3 + [None] * 2


def test_due_slots(spark):
    times = [at("09:20") + timedelta(seconds=10), at("09:20") + timedelta(seconds=9), at("09:15") + timedelta(seconds=30), at("15:30") + timedelta(seconds=30), at("10:00", DAY + timedelta(days=2)) + timedelta(seconds=30)]
    rows = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    assert [r[0] for r in rows.select(calendar.due_slot(rows.t)).collect()] == [at("09:20"), None, None, at("15:30"), None]


def test_windows_in_parts_are_windows(spark):
    rows = catalogue.hours(spark, SMALL)
    whole, small = (sorted(map(tuple, volatility.realised(rows, 7, size).collect())) for size in (10**6, 8))
    assert len(whole) == rows.count() and repr(whole) == repr(small)
    bad = catalogue.faulty(spark, SMALL)
    whole, small = (sorted(map(tuple, validation.sequence_findings(bad, size=size).collect())) for size in (10**6, 3))
    assert whole and whole == small
