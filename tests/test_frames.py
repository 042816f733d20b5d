"""Rounding by exact value, frames in linear time, rules on order, and cells that look like marks, against plain Python."""

import math
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL
from tickloom.functions import ordered
from tickloom.functions.rounding import rounded
from tickloom.operators import bars, upkeep, validation, volatility
from tickloom.plans import catalogue
from tickloom.sources import tables

DAY = datetime(2026, 9, 3, 9, 15)


def test_tenths_of_all_multiples_of_a_twentieth(spark):
    """As Python's round(), over every multiple of 0.05 up to 100,000, however it was computed."""
    n = F.col("id").cast("double")
    got = spark.range(2_000_001).select("id", rounded(n / 20).alias("a"), rounded(n * 0.05).alias("b")).toPandas()
    assert got.a.tolist() == [round(k / 20, 1) for k in got.id.tolist()]
    assert got.b.tolist() == [round(k * 0.05, 1) for k in got.id.tolist()]


@pytest.mark.parametrize("digits", [0, 1, 2, 4, 6])
def test_rounding_is_pythons(spark, digits):
    r = random.Random(digits)
    xs = [0.25, 0.75, -0.25, 2.675, 24350.05, 24350.35, 1e15 + 0.3, 4.5e15, 1e300 / 10**digits, 5e-324, 0.05, 0.15, math.pi]
    xs += [r.uniform(-1e5, 1e5) for _ in range(3000)] + [(2 * r.randrange(10**6) + 1) / (2 * 10**digits) for _ in range(3000)]
    got = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").select("x", rounded(F.col("x"), digits).alias("y")).collect()
    assert all(y == (None if x is None else round(x, digits)) for x, y in got)


def test_extremes_ahead(spark):
    r = random.Random(5)
    rows = [(k, r.randrange(3000) if r.random() < 0.97 else None, float(r.randrange(100))) for k in "ab" for _ in range(700)] + [("c", 5, 1.0), ("c", 105, 2.0), ("c", 106, 0.0)]
    got = {(x.k, x.at): (x.low, x.high) for x in ordered.ahead(spark.createDataFrame(rows, "k string, at bigint, v double"), "k", "at", "v", 100).collect()}
    for k, at in {(k, at) for k, at, _ in rows if at is not None}:
        near = [v for j, t, v in rows if j == k and t is not None and at < t <= at + 100]
        assert got[k, at] == (min(near, default=None), max(near, default=None))
    assert len(got) == len({(k, at) for k, at, _ in rows if at is not None}) and got["c", 5] == (2.0, 2.0)


def frame(spark, rows):
    return spark.createDataFrame(rows, "instrument string, timestamp timestamp_ntz, open double, high double, low double, close double")


def plain_estimates(rows, n):
    """The four estimators of the last n rows, with exact sums."""
    o, h, low, c = zip(*[x[2:] for x in rows])
    out = []
    for k in range(len(rows)):
        if k + 1 < n:
            out.append((None,) * 4)
            continue
        span = range(k - n + 1, k + 1)
        rets = [math.log(c[i] / c[i - 1]) for i in span if i > k - n + 1]
        mean = math.fsum(rets) / len(rets)
        terms = (
            math.fsum((x - mean) ** 2 for x in rets) / len(rets),
            math.fsum(math.log(h[i] / low[i]) ** 2 for i in span) / n / (4 * math.log(2)),
            math.fsum(0.5 * math.log(h[i] / low[i]) ** 2 - (2 * math.log(2) - 1) * math.log(c[i] / o[i]) ** 2 for i in span) / n,
            math.fsum(math.log(h[i] / o[i]) * math.log(h[i] / c[i]) + math.log(low[i] / o[i]) * math.log(low[i] / c[i]) for i in span) / n,
        )
        out.append(tuple(math.sqrt(x) * volatility.ANNUAL if x >= 0 else None for x in terms))
    return out


@pytest.mark.parametrize("n", [2, 30, 375])
def test_estimators_by_running_sums(spark, n):
    """Within 1e-9 of exact sums, also after prices of another size; in parts that are smaller than the frame."""
    r = random.Random(n)
    price, rows = 100.0, []
    for k in range(1200):
        price *= math.exp(r.gauss(0, 1e-3 if k < 600 else 1e-5)) * (50 if k == 500 else 1)
        o, c = price * math.exp(r.gauss(0, 1e-4)), price
        rows.append(("a", DAY + timedelta(minutes=k), o, max(o, c) * (1 + r.random() * 1e-4), min(o, c) * (1 - r.random() * 1e-4), c))
    got = volatility.estimated(volatility.placed(frame(spark, rows), n, size=400), n, by="_key").where("own").orderBy("timestamp").select(*volatility.METHODS).collect()
    for have, want in zip(got, plain_estimates(rows, n), strict=True):
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(have, want))


def test_no_frame_grows(spark):
    """Neither plan holds a frame of rows or time around each row: all begin at their window's start, or are an offset."""
    rows = frame(spark, [("a", DAY, 1.0, 1.0, 1.0, 1.0)])
    plans = [volatility.realised(rows, 375), ordered.ahead(spark.range(3).selectExpr("1 AS k", "id AS at", "id AS v"), "k", "at", "v", 300)]
    for df in plans:
        frames = re.findall(r"specifiedwindowframe\(\w+, ([^,]+), ([^,]+?)\)", df._jdf.queryExecution().optimizedPlan().toString())
        assert frames and all(a.startswith("unboundedpreceding") or a == b for a, b in frames)


def test_option_bars_are_dealt_by_their_number(spark, monkeypatch):
    """More bars make more tasks, not larger ones, where Spark would put together keys and times that compress well."""
    monkeypatch.setattr(tables, "SHARE", 300, raising=False)
    bars_, history = tables.table(spark, SMALL, "lineitem").count(), catalogue.implied_history(spark, SMALL)
    most = history.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 3 * 300 < bars_ / 4
    # the premium's own groups, joins and numbers by token, and its join by name
    plan = catalogue.volatility_premium(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*), (\d+)\), (\w+)", plan)
    by_token = [(int(n), why) for keys, n, why in dealt if re.match(r"token#\d+L?(, timestamp#\d+|$)", keys)]
    assert by_token and all(n == -(-bars_ // 300) for n, _ in by_token)
    assert {re.sub(r"#\d+L?", "", keys) for keys, _, why in dealt if why == "REPARTITION_BY_NUM"} >= {"token", "name, timestamp", "token, _bucket"}


def test_flat_and_odd_prices(spark):
    rows = [("a", DAY + timedelta(minutes=k), 5.0, 5.0, 5.0, 5.0) for k in range(5)] + [("a", DAY + timedelta(minutes=9), math.inf, math.inf, 1.0, 1.0), ("a", None, 1.0, 1.0, 1.0, 1.0), ("a", DAY, None, 1.0, 1.0, 1.0)]
    got = volatility.realised(frame(spark, rows), 3).orderBy("timestamp").collect()
    assert [tuple(x)[2:] for x in got] == [(None,) * 4] * 2 + [(0.0,) * 4] * 3


TICK = "instrument string, sequence_number bigint, timestamp timestamp_ntz, ltp double, high double, low double, volume bigint, ltq bigint, open_interest bigint"


def plain_order(rows, volumes=True):
    """Codes of the rules on order, record by record."""
    out, seen, last, day, volume = [], {}, {}, {}, {}
    for name, n, at, *_, v, _, _ in sorted(rows, key=lambda x: x[1]):
        if at is not None:
            if (name, at) in seen:
                out.append((name, n, "duplicate_timestamp"))
            elif name in last and at < last[name]:
                out.append((name, n, "out_of_order"))
            seen[name, at] = last[name] = at
        if (at and at.date()) != day.get(name):
            volume[name], day[name] = None, at and at.date()
        if v is not None:
            if volumes and volume.get(name) is not None and v < volume[name]:
                out.append((name, n, "volume_regression"))
            volume[name] = v
    return sorted(out)


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_rules_on_order_in_parts(spark, size):
    r = random.Random(size)
    rows, at = [], DAY
    for n in range(300):
        at += timedelta(seconds=r.choice([0, 1, 1, 5, -3])) if r.random() < 0.98 else timedelta(days=1)
        rows.append((r.choice("ab"), n, at if r.random() < 0.9 else None, 1.0, 1.0, 1.0, r.choice([None, n, n, n - 7]), 1, 1))
    df = spark.createDataFrame(rows, TICK)
    got = sorted((x.instrument, x.sequence_number, x.code) for x in validation.in_order_findings(df, size=size).collect())
    assert got == plain_order(rows) and len({c for *_, c in got}) == 3
    assert sorted((x.instrument, x.sequence_number, x.code) for x in validation.in_order_findings(df, volumes=False, size=size).collect()) == plain_order(rows, volumes=False)


def test_quantities_and_the_switch_for_volumes(spark):
    rows = [("a", 1, DAY, 1.0, 1.0, 1.0, 50, -1, None), ("a", 2, DAY + timedelta(seconds=1), 1.0, 1.0, 1.0, 40, 1, -2)]
    df = spark.createDataFrame(rows, TICK)
    assert sorted((x.sequence_number, x.code) for x in validation.tick_findings(df).collect()) == [(1, "negative_value"), (2, "negative_value"), (2, "volume_regression")]
    assert sorted((x.sequence_number, x.code) for x in validation.tick_findings(df, volumes=False).collect()) == [(1, "negative_value"), (2, "negative_value")]
    assert validation.tick_findings(df.limit(0)).isEmpty()


def test_sections_in_the_order_given(spark):
    one = spark.createDataFrame([(1, "PASS")], "instrument int, status string")
    got = validation.sections({"z": one, "ohlcv_5m": one, "b": one, "tick": one}).orderBy("position").collect()
    assert [x.dataset for x in got] == ["tick", "ohlcv_5m", "z", "b"]


def test_a_number_as_instrument_without_rows_stays_null(spark):
    rows = spark.createDataFrame([(None, 1, DAY)], "instrument bigint, sequence_number bigint, timestamp timestamp_ntz")
    none = spark.createDataFrame([], "instrument bigint, sequence_number bigint, code string, severity string")
    assert [x.instrument for x in validation.report(none, rows).collect()] == [None]


def test_spread_of_ticks_without_levels(spark):
    levels = "array<struct<price: double, quantity: bigint>>"
    rows = [("a", 1, DAY, 10.0, [(9.9, 1)], [(10.05, 1)], 1, 1), ("a", 2, DAY, 10.0, [], [(10.05, 1)], 0, 0), ("a", 3, DAY, 10.0, None, None, 3, 1), ("b", 1, DAY, 1.0, None, None, 0, 0)]
    got = bars.analytics(spark.createDataFrame(rows, f"instrument string, sequence_number bigint, timestamp timestamp_ntz, ltp double, best_5_buy {levels}, best_5_sell {levels}, total_buy_qty bigint, total_sell_qty bigint"), "1 minute").orderBy("instrument").collect()
    assert [(x.avg_spread, x.max_spread, x.imbalance) for x in got] == [(0.15, 0.1, 0.1667), (0.0, 0.0, 0.0)]


def test_cells_like_the_mark_of_a_null(spark, tmp_path):
    rows = [("\\N", 1), ("\\\\N", 2), (None, 3), ("", 4), ("N", 5), ('"\\N"', 6), ("a\\N", 7), ("\\", 8), ("line\nbreak", None)]
    upkeep.write_csv(spark.createDataFrame(rows, "c string, n int"), str(tmp_path / "x"))
    assert sorted(map(tuple, upkeep.read_csv(spark, str(tmp_path / "x"), "c string, n int").collect()), key=str) == sorted(rows, key=str)


def test_days_of_one_digit(spark):
    names = "token string, symbol string, name string, exch_seg string, instrumenttype string, expiry string, strike string, lotsize string"
    rows = [("1", "s", "n", "NFO", "FUTIDX", e, "1", "1") for e in ("5JAN2027", "05JAN2027", "31dec2026", "31JUN2026", "115JAN2027", "JAN2027", None)]
    got = [str(x.expiry) for x in upkeep.cleaned(spark.createDataFrame(rows, names)).collect()]
    assert got == ["2027-01-05", "2027-01-05", "2026-12-31", "None", "None", "None", "None"]


def test_upsert_by_several_columns(spark):
    table = spark.createDataFrame([(1, "NSE", "a", None), (1, "BSE", "b", DAY), (2, None, "c", None)], "token int, exchange string, symbol string, updated_at timestamp_ntz")
    new = spark.createDataFrame([(1, "NSE", "A"), (1, "NSE", "AA"), (2, None, "C"), (2, None, "D"), (3, "NFO", "e")], "token int, exchange string, symbol string")
    at = DAY + timedelta(days=1)
    got = upkeep.upsert(table, new, ["token", "exchange"], ["symbol"], F.lit(at))
    want = [(1, "NSE", "AA", at), (1, "BSE", "b", DAY), (2, None, "c", None), (2, None, "D", at), (3, "NFO", "e", at)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
