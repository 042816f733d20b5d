"""Streams that are stopped and go on, sinks whose batch is repeated, and state that expires."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL
from tests.test_frames import plain_order
from tickloom.operators import bars, validation
from tickloom.plans import records, streams
from tickloom.sources import replay, tables
from tickloom.streaming import feed, ordered, sinks, walls

DAY = datetime(2026, 9, 3, 9, 15)
TICK = "instrument string, sequence_number bigint, timestamp timestamp_ntz, ltp double, high double, low double, volume bigint, arrived timestamp"


def written(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_findings_go_on_after_a_restart(spark, tmp_path):
    """Seven files, of which three come after the query was ended and begun again; late ticks, repeats of times long past, days that
    change. As the rules on the whole, record by record."""
    r, rows, at = random.Random(11), [], DAY
    for n in range(210):
        at += timedelta(seconds=r.choice([0, 1, 2, -40])) if r.random() < 0.97 else timedelta(hours=9)
        rows.append((r.choice(["a", "b", "c"]), n, at if r.random() < 0.93 else None, 5.0, 6.0, 4.0, r.choice([None, n, n - 9]), DAY + timedelta(seconds=n)))
    came, out = str(tmp_path / "came"), f"file://{tmp_path}/out"
    for part in (range(4), range(4, 7)):
        for k in part:
            written(spark, rows[30 * k : 30 * k + 30], TICK, came)
        sinks.run_available(ordered.findings(source(spark, TICK, came)), out, sinks.batches_at(out))
    frame = ordered.findings(source(spark, TICK, came))
    got = sorted((x.instrument, x.sequence_number, x.code, x.severity) for x in sinks.stored(spark, out, frame.schema).collect())
    want = sorted((x.instrument, x.sequence_number, x.code, x.severity) for x in validation.tick_findings(spark.createDataFrame(rows, TICK)).collect())
    assert got == want
    order = sorted((a, b, c) for a, b, c, _ in got if c in ("duplicate_timestamp", "out_of_order", "volume_regression"))
    assert order == plain_order([(i, n, t, 0, 0, 0, v, 0, 0) for i, n, t, *_, v, _ in rows]) and len({c for *_, c in order}) == 3


def test_state_of_times_expires(spark, tmp_path):
    """A time that comes again after more than a day of newer ones is no repetition to the stream any more; within a day it is."""
    came, out = str(tmp_path / "came"), f"file://{tmp_path}/out"
    times = [DAY, DAY + timedelta(hours=23), DAY, DAY + timedelta(hours=25), DAY]
    for n, t in enumerate(times):
        written(spark, [("a", n, t, 1.0, 1.0, 1.0, None, DAY + timedelta(hours=n))], TICK, came)
    frame = ordered.order_findings(source(spark, TICK, came))
    sinks.run_available(frame, out, sinks.batches_at(out))
    assert sorted((x.sequence_number, x.code) for x in sinks.stored(spark, out, frame.schema).collect()) == [(2, "duplicate_timestamp"), (4, "out_of_order")]


def test_judged_goes_on_from_its_state():
    """Whatever the cuts, the parts say what the whole says."""
    r = random.Random(2)
    time = np.array([ordered.MISSING if r.random() < 0.2 else 10**6 * r.randrange(50) + r.randrange(3) * 86_400_000_000 for _ in range(80)])
    volume = np.array([np.nan if r.random() < 0.3 else float(r.randrange(9)) for _ in range(80)])
    none = np.zeros(0, np.int64)
    whole = ordered.judged(time, volume, ordered.MISSING, ordered.MISSING, np.nan, none)
    for cut in (1, 7, 40, 79):
        a = ordered.judged(time[:cut], volume[:cut], ordered.MISSING, ordered.MISSING, np.nan, none)
        b = ordered.judged(time[cut:], volume[cut:], *a[3:], np.unique(time[:cut][time[:cut] != ordered.MISSING]))
        assert all((np.concatenate((x, y)) == z).all() for x, y, z in zip(a[:3], b[:3], whole[:3])) and np.array_equal(b[3:], whole[3:], equal_nan=True)


STORED = "instrument string, timestamp timestamp_ntz, sequence_number bigint, ltp double, quantity bigint, time_source string"


def test_a_repeated_batch_is_stored_once(spark, tmp_path):
    """The store fails after it has written, so its batch comes again under its number: rows and counts are those of one attempt."""
    came, out = str(tmp_path / "came"), f"file://{tmp_path}/out"

    def tick(n, day=0, source="exchange"):
        return ("a", DAY + timedelta(days=day, seconds=n), n, float(n), 1, source)

    written(spark, [tick(1), tick(1), tick(2, source="received")], STORED, came)
    written(spark, [tick(2), tick(3), tick(3, day=1, source="last_traded"), tick(1)], STORED, came)
    written(spark, [tick(3, day=1), tick(4, day=2, source="received")], STORED, came)
    store, failed = sinks.ticks_at(out), []

    def failing(batch, n):
        store(batch, n)
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("after the write, before the commit")

    with pytest.raises(Exception, match="after the write"):
        sinks.run_available(source(spark, STORED, came), out, failing)
    sinks.run_available(source(spark, STORED, came), out, failing)
    rows = sinks.stored(spark, out, source(spark, STORED, came).schema)
    assert failed == [1] and sorted((x.timestamp, x.sequence_number) for x in rows.collect()) == [(DAY + timedelta(days=d, seconds=n), n) for d, n in ((0, 1), (0, 2), (0, 3), (1, 3), (2, 4))]
    assert sorted(map(tuple, sinks.counts(spark, out).collect())) == [(0, 2, 1, 1), (1, 2, 2, 0), (2, 1, 1, 1)]


def test_nothing_is_stored_before_the_first_batch(spark, tmp_path):
    schema = spark.createDataFrame([], STORED).schema
    assert sinks.stored(spark, f"file://{tmp_path}/none", schema).isEmpty()


def test_the_stream_comes_in_order_and_whole(spark):
    rows = records.faulty_ticks(spark, SMALL)
    seen = []
    folder = tables.shared_folder(spark)
    came = tables.replayed(spark, rows, streams._tenth(rows), streams.BATCHES)
    sinks.run_available(came, folder, lambda b, n: seen.append((n, *b.agg(F.min("sequence_number"), F.max("sequence_number"), F.count("*")).first())))
    assert [n for n, *_ in seen] == list(range(10)) and sum(c for *_, c in seen) == rows.count() and all(a[2] < b[1] for a, b in zip(seen, seen[1:]))


def test_recorded_packets_come_once_over_restarts(spark, tmp_path):
    """Files of several row groups; some come after the query ended, one after a failure between write and commit."""
    came, out = tmp_path / "packets", f"file://{tmp_path}/out"
    came.mkdir()

    def record(name, numbers):
        lines = [f'{{"token":"t","sequence_number":{n},"last_traded_price":"{100 * n}","exchange_timestamp":"{1_700_000_000_000 + n}"}}' for n in numbers]
        pq.write_table(pa.table({"value": lines}), came / name, row_group_size=3)

    def go(store):
        tokens = spark.createDataFrame([("t", "T")], "token string, instrument string")
        schema = spark.createDataFrame([], "value string").schema
        ticks = feed.parsed(feed.packets(replay.stream(spark, f"file://{came}", schema)), tokens).select("instrument", "sequence_number", "ltp")
        sinks.run_available(ticks, out, store)
        return sorted(r.sequence_number for r in sinks.stored(spark, out, ticks.schema).collect())

    store, failed = sinks.batches_at(out), []

    def failing(batch, n):
        store(batch, n)
        if not failed:
            failed.append(n)
            raise RuntimeError("before the commit")

    record("0001.parquet", range(1, 8))
    record("_half.parquet", range(50, 60))
    assert go(store) == list(range(1, 8))
    assert go(store) == list(range(1, 8))
    record("0002.parquet", range(8, 10))
    record("0003.parquet", range(10, 20))
    with pytest.raises(Exception, match="before the commit"):
        go(failing)
    assert failed == [1] and go(failing) == list(range(1, 20))


def test_a_source_without_files_gives_nothing(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    frame = replay.stream(spark, f"file://{tmp_path}/none", spark.createDataFrame([], "value string").schema)
    sinks.run_available(frame, out, sinks.batches_at(out))
    assert sinks.stored(spark, out, frame.schema).isEmpty()


def test_extremes_ahead_against_a_plain_loop():
    """Ticks in any order, some at equal times, on the block's end and on the reach's; some prices that are no number."""
    r, end, reach = random.Random(4), 1000, 100
    for n in (0, 1, 5, 60):
        times = [r.choice([r.randrange(895, 1105), 900, 1000, 1100]) for _ in range(n)]
        prices = [r.choice([float("nan"), *map(float, range(9))]) for _ in range(n)]
        at = [*range(900, 1000)]
        low, high = walls.extremes(np.array(at), np.array(times, np.int64), np.array(prices, float), end, reach)
        for a, x, y in zip(at, low, high):
            seen = [p for t, p in zip(times, prices) if a < t <= a + reach]
            good = [p for p in seen if p == p]
            np.testing.assert_equal((x, y), (min(good, default=np.nan), max(good, default=np.nan) if len(good) == len(seen) else np.nan))


def test_absorptions_of_a_dense_stream(spark, tmp_path):
    """Many ticks of two instruments within each other's reach, numbers against time, null prices and instruments; the stream says
    what the whole says, without a join in which each wall meets each tick of its instrument."""
    r, came, out, rows = random.Random(9), str(tmp_path / "came"), f"file://{tmp_path}/out", []
    for n in range(1500):
        price = None if n % 50 == 0 else r.randrange(1, 400) / 20
        rows.append((r.choice(["a", "b", None]) if n % 40 == 0 else r.choice(["a", "b"]), DAY + timedelta(seconds=n * 0.9), 1500 - n if n % 7 else None, price, r.randrange(100)))
    rows.append(("", DAY + timedelta(days=1), None, None, None))
    schema = "instrument string, timestamp timestamp_ntz, sequence_number bigint, ltp double, quantity bigint"
    for k in (0, 600, 1100, 1500):
        end = {0: 600, 600: 1100, 1100: 1500}.get(k, 1501)
        books = tables.books(spark.createDataFrame(rows[k:end], schema)).withColumn("at", F.col("timestamp").cast("timestamp")).drop("timestamp")
        books.coalesce(1).write.mode("append").parquet(came)
    books = source(spark, books.schema, came)
    frame = walls.absorptions(books, books.select("instrument", "ltp", "at"))
    assert "Join" not in frame._jdf.queryExecution().logical().toString()
    sinks.run_available(frame, out, sinks.batches_at(out))
    columns = ["instrument", F.col("minute").cast("string"), "side", "wall", "price", "quantity", "move"]
    got = sorted(map(tuple, sinks.stored(spark, out, frame.schema).select(*columns).collect()))
    whole = bars.absorptions(tables.books(spark.createDataFrame(rows, schema)))
    assert got == sorted(map(tuple, whole.select(*columns).collect())) and len(got) > 500
