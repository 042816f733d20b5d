"""Contracts on bars and ticks: findings as rows of instrument, sequence_number, code and severity.

Sessions are those of the exchange's calendar, with its holidays and special days; where a function has `trading`, another
calendar (day -> whether it's one) may be given. sequence_number is the place at which a record arrived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.rounding import rounded
from . import calendar

Calendar = Callable[[Column], Column]
#: The session in seconds of the day, the codes that warn, and those that do so for ticks.
OPEN, CLOSE = 9 * 3600 + 15 * 60, 15 * 3600 + 30 * 60
WARNINGS = ("out_of_session", "volume_regression", "unexpected_gap", "unknown_field", "ltp_outside_day_range")
TICK_WARNINGS = (*WARNINGS, "duplicate_timestamp", "out_of_order")
#: Counters of a report and the codes that count in them.
GROUPS = {"schema_invalid": ("missing_field", "unexpected_type", "malformed_timestamp", "timezone_inconsistent", "timestamp_not_aligned"), "invalid_ohlc": ("ohlc_invariant", "non_positive_price", "ltp_outside_day_range"), "volume_issues": ("negative_value", "volume_regression"), "duplicates": ("duplicate_timestamp",), "out_of_order": ("out_of_order",), "outside_session": ("out_of_session",), "gaps": ("unexpected_gap",)}


def second_of_day(ts: str | Column = "timestamp") -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts).cast("int")


def in_session(ts: str = "timestamp", trading: Calendar = calendar.trading) -> Column:
    """Trading days, 09:15:00 to before 15:30:00."""
    return trading(F.to_date(ts)) & (second_of_day(ts) >= OPEN) & (second_of_day(ts) < CLOSE)


def aligned(minutes: int, ts: str = "timestamp") -> Column:
    """Whether a bar may start then: a whole number of bars after (or before) the session's opening, to the microsecond."""
    whole = F.unix_micros(F.col(ts).cast("timestamp")) % 1_000_000 == 0
    return whole & (F.pmod(second_of_day(ts) - OPEN, F.lit(60 * minutes)) == 0)


def severity(code: Column, tick: bool = False) -> Column:
    return F.when(code.isin(*(TICK_WARNINGS if tick else WARNINGS)), "WARNING").otherwise("ERROR")


def row_rules(minutes: int, trading: Calendar = calendar.trading) -> list[tuple[str, Column]]:
    """Rules on a bar alone; a bar breaks each as often as it stands here."""
    prices = ["open", "high", "low", "close"]
    out: list[tuple[str, Column]] = []
    for c in ("timestamp", *prices, "volume"):
        out.append(("missing_field", F.col(c).isNull()))
    out += [("non_positive_price", F.col(c) <= 0) for c in prices]
    out += [("negative_value", F.col("volume") < 0), ("timestamp_not_aligned", ~aligned(minutes)), ("out_of_session", ~in_session(trading=trading))]
    most, least = F.greatest("open", "close"), F.least("open", "close")
    all_there = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    out += [("ohlc_invariant", all_there & x) for x in (F.col("high") < F.col("low"), F.col("high") < most, F.col("low") > least)]
    return out


def row_findings(bars: DataFrame, minutes: int, trading: Calendar = calendar.trading) -> DataFrame:
    """Findings of row_rules(): one pass, no shuffle. A rule whose cells are null isn't broken."""
    codes = F.array_compact(F.array(*[F.when(x, F.lit(code)) for code, x in row_rules(minutes, trading)]))
    return bars.select("instrument", "sequence_number", F.explode(codes).alias("code")).withColumn("severity", severity(F.col("code")))


#: A tick's quantities, none of which may be negative.
QUANTITIES = ("ltq", "volume", "total_buy_qty", "total_sell_qty", "open_interest")


def tick_rules(ticks: DataFrame, trading: Calendar = calendar.trading) -> DataFrame:
    """Findings on each tick alone: what is missing or not positive, quantities below zero (those that ticks have), a day's high below
    its low, a price outside of the day's range, times outside of sessions. One pass, no shuffle."""
    day = F.col("high") >= F.col("low")
    rules = [("missing_field", F.col(c).isNull()) for c in ("timestamp", "ltp")]
    rules += [("non_positive_price", F.col(c) <= 0) for c in ("ltp", "high", "low")] + [("negative_value", F.col(c) < 0) for c in QUANTITIES if c in ticks.columns]
    rules += [("out_of_session", ~in_session(trading=trading)), ("ohlc_invariant", ~day), ("ltp_outside_day_range", day & ~F.col("ltp").between(F.col("low"), F.col("high")))]
    codes = F.array_compact(F.array(*[F.when(x, F.lit(code)) for code, x in rules]))
    return ticks.select("instrument", "sequence_number", F.explode(codes).alias("code")).withColumn("severity", severity(F.col("code"), tick=True))


def tick_findings(ticks: DataFrame, trading: Calendar = calendar.trading, volumes: bool = True) -> DataFrame:
    """All findings on ticks (timestamp, ltp, high, low, volume): those of tick_rules(), falling volumes unless volumes is false, and,
    as warnings, repeated and late times. Ticks are numbered once for both rules on their order."""
    own = tick_rules(ticks, trading)
    return own.union(in_order_findings(ticks, volumes=volumes))


def _numbered(rows: DataFrame, size: int) -> DataFrame:
    """rows with k, their place among their instrument's, in parts of about `size` with the row in front of each part (own: not that
    one). instrument, sequence_number, timestamp, day and volume (null where rows have none) are enough for the rules on order."""
    volume = F.col("volume") if "volume" in rows.columns else F.lit(None).cast("double")
    each = rows.select("instrument", "sequence_number", "timestamp", F.to_date("timestamp").alias("day"), volume.alias("volume"))
    return ordered.parts(ordered.numbered(each, "instrument", "sequence_number", F.floor(F.col("sequence_number") / 100_000)), 1, size)


def in_order_findings(rows: DataFrame, tick: bool = True, sequence: bool = True, volumes: bool = True, size: int = 10_000) -> DataFrame:
    """The rules on order: sequence_findings() and volume_findings(), or one of them, over rows that are numbered once.

    An instrument is read in parts of about `size` records. What a part needs of those before it (the last time, the run that it
    begins in, and the last known volume with its run) comes from one row for each of them. Repeats are found by timestamp.
    """
    part = "PARTITION BY instrument, part ORDER BY k"
    front = f"OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    begins = F.expr(f"CASE WHEN own AND (lag(k) OVER ({part}) IS NULL OR NOT day <=> lag(day) OVER ({part})) THEN k END")
    each = _numbered(rows, size).withColumns({"begins": begins, "last_time": F.expr(f"last(timestamp, true) {front}")})
    # a run that began in an earlier part is null until the parts are joined
    each = each.withColumn("run", F.expr(f"max(begins) OVER ({part})")).withColumn("known", F.when(F.col("own") & F.col("volume").isNotNull(), F.struct("run", "volume")))
    each = each.withColumn("inside", F.expr(f"last(known, true) {front}")).where("own")
    before = "OVER (PARTITION BY instrument ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ends = each.groupBy("instrument", "part").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("k"))).alias(f"_{c}") for c in ("timestamp", "begins", "known")])
    ends = ends.withColumn("earlier_run", F.expr(f"last(_begins, true) {before}"))
    named = F.when(F.col("_known").isNotNull(), F.struct(F.coalesce("_known.run", "earlier_run").alias("run"), "_known.volume"))
    ends = ends.withColumn("_known", named).select("instrument", "part", "earlier_run", F.expr(f"last(_timestamp, true) {before}").alias("earlier_time"), F.expr(f"last(_known, true) {before}").alias("earlier"))
    each = each.join(ends, ["instrument", "part"])
    codes = []
    if volumes:
        run, own = F.coalesce("run", "earlier_run"), F.col("inside").isNotNull()
        of = F.when(own, F.coalesce("inside.run", "earlier_run")).otherwise(F.col("earlier.run"))
        least = F.when(own, F.col("inside.volume")).otherwise(F.col("earlier.volume"))
        codes.append(F.when((of == run) & (F.col("volume") < least), "volume_regression"))
    if sequence:
        # a record without a time is alone in its group
        each = each.withColumn("again", F.expr("row_number() OVER (PARTITION BY instrument, timestamp, CASE WHEN timestamp IS NULL THEN k END ORDER BY sequence_number)"))
        time = F.coalesce("last_time", "earlier_time")
        late = F.col("timestamp") < time if tick else F.col("timestamp") <= time
        codes.append(F.when(F.col("timestamp").isNotNull(), F.when(F.col("again") > 1, "duplicate_timestamp").when(late, "out_of_order")))
    found = each.select("instrument", "sequence_number", F.explode(F.array_compact(F.array(*codes))).alias("code"))
    return found.withColumn("severity", severity(F.col("code"), tick))


def sequence_findings(rows: DataFrame, tick: bool = False, size: int = 10_000) -> DataFrame:
    """Repeated timestamps, and timestamps before that of the record in front (for bars: or at it); rows arrive in the order of
    sequence_number. Both are errors of bars and warnings of ticks. A record without a time is passed over."""
    return in_order_findings(rows, tick, volumes=False, size=size)


def volume_findings(rows: DataFrame, size: int = 10_000) -> DataFrame:
    """Cumulative volumes below the last known one of the same run of a day (records that follow each other and have one day, or
    none). Null volumes are passed over."""
    return in_order_findings(rows, sequence=False, size=size)


def session_grid(days: DataFrame, minutes: int, trading: Calendar = calendar.trading) -> DataFrame:
    """days (day) -> timestamp: the starts of the bars of each trading day's session."""
    n = (CLOSE - OPEN) // (60 * minutes)
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(OPEN // 60) + F.col("k") * minutes)
    return days.where(trading(F.col("day"))).select("day", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select(at.alias("timestamp"))


def expected(bars: DataFrame, minutes: int, trading: Calendar = calendar.trading) -> DataFrame:
    """instrument, timestamp of the bars that belong between each instrument's first and last one, in trading sessions. Bars
    without a time don't count."""
    span = bars.where("timestamp IS NOT NULL").groupBy("instrument").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    days = span.select("instrument", "first", "last", F.explode(F.expr("sequence(CAST(first AS DATE), CAST(last AS DATE))")).alias("day")).where(trading(F.col("day")))
    n = (CLOSE - OPEN) // (60 * minutes)
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(OPEN // 60) + F.col("k") * minutes)
    grid = days.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("instrument", "first", "last", at.alias("timestamp"))
    return grid.where("timestamp BETWEEN first AND last").select("instrument", "timestamp")


def gaps(bars: DataFrame, minutes: int, trading: Calendar = calendar.trading) -> DataFrame:
    """instrument, timestamp of the bars of expected() that are missing."""
    return expected(bars, minutes, trading).join(bars.select("instrument", "timestamp"), ["instrument", "timestamp"], "left_anti")


def gap_findings(bars: DataFrame, minutes: int, trading: Calendar = calendar.trading) -> DataFrame:
    """gaps() as findings, which belong to no record."""
    return gaps(bars, minutes, trading).select("instrument", F.lit(None).cast("bigint").alias("sequence_number"), F.lit("unexpected_gap").alias("code"), F.lit("WARNING").alias("severity"))


def report(findings: DataFrame, rows: DataFrame, due: DataFrame | None = None) -> DataFrame:
    """One row for each instrument: its rows, errors, warnings, the counters of GROUPS, first and last time, and PASS, WARNING or
    FAIL. With due (instrument, ...; the rows of expected()), how many those are and the percentage that is there; null for
    an instrument without any. Findings on instruments without rows don't count."""
    counts = findings.groupBy("instrument").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"), *[F.count_if(F.col("code").isin(*codes)).alias(k) for k, codes in GROUPS.items()])
    sizes = rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    out = sizes.join(counts, "instrument", "left").fillna(0, ["errors", "warnings", *GROUPS])
    if due is not None:
        there = rounded(100.0 * (F.col("expected") - F.col("gaps")) / F.col("expected"), 2)
        out = out.join(due.groupBy("instrument").agg(F.count(F.lit(1)).alias("expected")), "instrument", "left").withColumn("completeness_pct", there)
    return out.withColumn("status", F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARNING").otherwise("PASS"))


#: The order of a report's sections; others follow as they are given.
SECTIONS = ("tick", "ohlcv_1m", "ohlcv_5m")


def sections(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports by data set as rows of one table, with position (1 for the first of an instrument's sections) and overall, the worst
    status of an instrument's sections. Data sets that weren't asked for have no row."""
    names = [x for x in SECTIONS if x in reports] + [x for x in reports if x not in SECTIONS]
    parts = [reports[x].withColumns({"dataset": F.lit(x), "_place": F.lit(k)}) for k, x in enumerate(names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    rank = "CASE status WHEN 'FAIL' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END"
    worst = F.element_at(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")), F.expr(f"max({rank}) OVER (PARTITION BY instrument)") + 1)
    return out.withColumns({"position": F.expr("row_number() OVER (PARTITION BY instrument ORDER BY _place)"), "overall": worst}).drop("_place")


def by_code(findings: DataFrame) -> DataFrame:
    """instrument, code, severity and how many findings."""
    return findings.groupBy("instrument", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


def summary(findings: DataFrame, rows: DataFrame, dataset: str) -> DataFrame:
    """instrument and line: 'dataset: n rows, e errors, w warnings [code=n, ...]', codes sorted; without findings no list."""
    codes = findings.groupBy("instrument", "code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "ERROR").alias("e"))
    each = codes.groupBy("instrument").agg(F.sum("e").alias("e"), F.sum(F.col("n") - F.col("e")).alias("w"), F.array_sort(F.collect_list(F.concat_ws("=", "code", "n"))).alias("codes"))
    out = rows.groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).join(each, "instrument", "left").fillna(0, ["e", "w"])
    tail = F.when(F.size("codes") > 0, F.concat(F.lit(" ["), F.array_join("codes", ", "), F.lit("]"))).otherwise("")
    return out.select("instrument", F.concat(F.lit(f"{dataset}: "), "n", F.lit(" rows, "), "e", F.lit(" errors, "), "w", F.lit(" warnings"), tail).alias("line"))


def serialised(findings: DataFrame) -> DataFrame:
    """instrument, sequence_number and finding: a JSON object with code, severity and record, in this order."""
    return findings.select("instrument", "sequence_number", F.to_json(F.struct("code", "severity", F.col("sequence_number").alias("record")), {"ignoreNullFields": "false"}).alias("finding"))


def screen(rows: DataFrame, findings: DataFrame, mode: str) -> DataFrame:
    """The rows to store: in mode 'report' all, in mode 'reject' those without an error; ValueError for others."""
    if mode not in ("report", "reject"):
        raise ValueError(f"mode is report or reject, not {mode!r}")
    return rows if mode == "report" else screened(rows, findings)


def screened(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """The rows without an error."""
    return rows.join(findings.where("severity = 'ERROR'").select("instrument", "sequence_number").distinct(), ["instrument", "sequence_number"], "left_anti")


def quarantined(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """instrument, sequence_number and reasons (the sorted codes, each once) of the rows with an error."""
    why = findings.where("severity = 'ERROR'").groupBy("instrument", "sequence_number").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("reasons"))
    return rows.join(why, ["instrument", "sequence_number"]).select("instrument", "sequence_number", "reasons")
