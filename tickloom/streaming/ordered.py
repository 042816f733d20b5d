"""The rules on the order of ticks while they come in: state by instrument that is kept between batches and expires.

A stream's ticks carry two clocks: timestamp, the exchange's, which may be late, repeated or missing, and arrived, which only goes on.
The watermark is on the second, so that a late tick is a finding and not lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import validation

FINDING = "instrument string, sequence_number bigint, code string"
#: Of an instrument: the last time, its day and the last known volume of that day's run, and the times seen, newest `KEEP` alone. Times
#: are in microseconds, days in days; a missing one is MISSING.
STATE = "last bigint, day bigint, volume double, seen binary"
MISSING = np.iinfo(np.int64).min
#: How long a time is remembered, by the exchange's clock; an instrument that has been silent as long, by arrival, is forgotten.
KEEP = pd.Timedelta(days=1)
_DAY = 86_400_000_000


def judged(time: np.ndarray, volume: np.ndarray, last: int, day: int, known: float, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int, float]:
    """For ticks of one instrument as they came (times in microseconds or MISSING, volumes or nan), after those that the state tells of:
    which repeat a time, which are before the time in front, which have a volume below the last of their run, and the new state."""
    there = time != MISSING
    repeated = np.zeros(len(time), bool)
    repeated[there] = pd.Series(np.concatenate((seen, time[there]))).duplicated().to_numpy()[len(seen) :]
    before = np.concatenate(([last], time))
    at = np.maximum.accumulate(np.where(np.concatenate(([True], there)), np.arange(len(time) + 1), 0))  # where the last time in front stands
    front = before[at[:-1]]
    late = there & (front != MISSING) & (time < front)
    days = np.where(there, time // _DAY, MISSING)
    run = np.cumsum(np.concatenate(([0], days != np.concatenate(([day], days[:-1])))))
    both = pd.DataFrame({"run": run, "volume": np.concatenate(([known], volume))})
    earlier = both.groupby("run")["volume"].transform(lambda v: v.ffill().shift()).to_numpy()[1:]
    fell = volume < earlier
    end = both.groupby("run")["volume"].last().iloc[-1]
    return repeated, late, fell, int(before[at[-1]]), int(days[-1]), float(end)


def _followed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("sequence_number", kind="stable")
    last, day, known, seen = state.get if state.exists else (MISSING, MISSING, float("nan"), b"")
    times = rows["time"].to_numpy(np.int64)
    seen = np.frombuffer(seen, np.int64)
    repeated, late, fell, last, day, known = judged(times, rows["volume"].to_numpy(np.float64), last, day, known, seen)
    times = np.union1d(seen, times[times != MISSING])
    state.update((last, day, known, times[times > times[-1] - KEEP // pd.Timedelta(microseconds=1)].tobytes() if len(times) else b""))
    state.setTimeoutTimestamp(int(rows["arrived_ms"].max()) + KEEP // pd.Timedelta(milliseconds=1))
    codes = [("duplicate_timestamp", repeated), ("out_of_order", late & ~repeated), ("volume_regression", fell)]
    for code, which in codes:
        if which.any():
            yield pd.DataFrame({"instrument": key[0], "sequence_number": rows["sequence_number"].to_numpy()[which], "code": code})


def order_findings(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """validation.in_order_findings() of a stream of ticks (instrument, sequence_number, timestamp, volume, arrived): each finding once,
    with the batch that its tick came in. Ticks of a batch are taken by sequence_number, batches as they come.

    A time is a repetition if the same instrument had it within the last day of the exchange's clock; the state of a busy instrument is
    8 bytes for each such time. Ticks without an arrival are never late; null instruments are one key.
    """
    micros = F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(int(MISSING)))
    volume = F.coalesce(F.col("volume").cast("double"), F.lit(float("nan")))
    asked = ticks.withWatermark("arrived", delay).select("instrument", "sequence_number", "arrived", micros.alias("time"), volume.alias("volume"), F.unix_millis("arrived").alias("arrived_ms"))
    found = asked.groupBy("instrument").applyInPandasWithState(_followed, FINDING, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumn("severity", validation.severity(F.col("code"), tick=True))


def findings(ticks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """validation.tick_findings() of a stream: the rules on a tick alone, and those on order."""
    return validation.tick_rules(ticks).unionByName(order_findings(ticks, delay))
