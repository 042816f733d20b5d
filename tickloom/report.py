"""The quality report as a program: `python -m tickloom.report FOLDER --instrument NAME --from TIME --to TIME [--timeframes tick,1m,5m] [--json]`.

It ends with 0 for PASS, 1 for WARNING, 2 for FAIL, and 3 for an instrument or a time frame that isn't there.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import access, bars, reporting, validation
from .sources import tables

#: The time frames and the data sets and minutes that they are.
FRAMES = {"tick": ("tick", 0), "1m": ("ohlcv_1m", 1), "5m": ("ohlcv_5m", 5)}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="python -m tickloom.report")
    parser.add_argument("folder", help="where the tables are")
    parser.add_argument("--instrument", "--symbol", required=True)
    parser.add_argument("--from", dest="start", type=datetime.fromisoformat, required=True, help="first time of the period")
    parser.add_argument("--to", dest="end", type=datetime.fromisoformat, required=True, help="the time that the period ends before")
    parser.add_argument("--timeframes", default="1m,5m", help="some of tick,1m,5m")
    parser.add_argument("--max-ticks", type=int, default=reporting.MOST_TICKS)
    parser.add_argument("--json", action="store_true")
    return parser


def assessed(ticks: DataFrame, instruments: DataFrame, start: datetime, end: datetime, frames: Sequence[str], most: int = reporting.MOST_TICKS, generated_at: datetime | None = None) -> DataFrame:
    """reporting.whole() of ticks (instrument, timestamp, sequence_number, ltp, quantity) and the bars built of them, from start to
    before end, for instruments (instrument). ValueError for an unknown time frame. Ticks have no day range or volume of the day here."""
    if unknown := [f for f in frames if f not in FRAMES]:
        raise ValueError(f"no time frame is called {', '.join(unknown)}; there are {', '.join(FRAMES)}")
    mine = access.window(ticks, start, end).join(instruments, "instrument", "left_semi")
    sections, notes = {}, None
    for frame in dict.fromkeys(frames):
        name, minutes = FRAMES[frame]
        if not minutes:
            rows, over = reporting.truncated(mine.withColumns({c: F.lit(None).cast("double") for c in ("high", "low", "volume")}), most)
            sections[name], notes = reporting.section(validation.tick_findings(rows), rows, instruments), reporting.truncation_notes(over, most)
            continue
        rows = ordered_bars(mine, minutes)
        found = validation.row_findings(rows, minutes).union(validation.sequence_findings(rows)).unionByName(validation.gap_findings(rows, minutes))
        sections[name] = reporting.section(found, rows, instruments, validation.expected(rows, minutes))
    return reporting.whole(instruments, start, end, sections, notes, generated_at)


def ordered_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """Bars of ticks, numbered by time; a bar's number is its place in minutes, so that no window holds an instrument's bars."""
    at = F.unix_micros(F.col("timestamp").cast("timestamp")) / (60_000_000 * minutes)
    return bars.build(ticks, f"{minutes} minutes").drop("n").withColumn("sequence_number", F.floor(at))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ticks = tables.ticks(spark, args.folder)
    wanted = spark.createDataFrame([(args.instrument,)], "instrument string")
    try:
        if ticks.join(wanted, "instrument", "left_semi").isEmpty():
            raise ValueError(f"no instrument is called {args.instrument!r}")
        frames = [x for part in args.timeframes.split(",") if (x := part.strip().lower())]
        report = assessed(ticks, wanted, args.start, args.end, frames, args.max_ticks, datetime.now().replace(microsecond=0)).cache()
        print((reporting.as_json(report) if args.json else reporting.as_text(report)).first()[1])
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return reporting.UNUSABLE
    return reporting.exit_status(report)


if __name__ == "__main__":
    sys.exit(main())
