"""The whole quality report of a period: for each instrument its data sets in order, notes on what the counts leave out, as nested rows, JSON
and text, and the status that a program ends with."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from . import calendar, validation

#: What a program ends with, by the worst status; UNUSABLE if it was asked for what isn't there.
EXIT, UNUSABLE = {"PASS": 0, "WARNING": 1, "FAIL": 2}, 3
#: How data sets are called in the text.
LABELS = {"tick": "Ticks", "ohlcv_1m": "1m OHLCV", "ohlcv_5m": "5m OHLCV"}
#: Ticks of an instrument that are validated.
MOST_TICKS = 500_000
#: A section's cells and the columns of validation.report() that they are.
_CELLS = {
    "records": "n", "expected_records": "expected", "completeness_pct": "completeness_pct", "errors": "errors", "warnings": "warnings", "duplicates": "duplicates", "out_of_order": "out_of_order", "invalid_ohlc": "invalid_ohlc",
    "schema_invalid": "schema_invalid", "unexpected_gaps": "gaps", "out_of_session": "outside_session", "volume_issues": "volume_issues",
}


def iso(time: Column) -> Column:
    """A time as ISO 8601 says it, with microseconds only if there are some."""
    some = F.unix_micros(time.cast("timestamp")) % 1_000_000 != 0
    return F.when(some, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"))


def truncated(ticks: DataFrame, most: int = MOST_TICKS) -> tuple[DataFrame, DataFrame]:
    """The first `most` ticks of each instrument by time, and the instruments that have more. Ticks without a time come first."""
    each = ordered.numbered(ticks, "instrument", "timestamp", F.coalesce(F.to_date("timestamp"), F.lit("0001-01-01").cast("date")))
    over = each.where(F.col("k") > most).select("instrument").distinct()
    return each.where(F.col("k") <= most).drop("k"), over


def truncation_notes(over: DataFrame, most: int = MOST_TICKS) -> DataFrame:
    """instrument, note for those that truncated() cut."""
    return over.select("instrument", F.lit(f"Tick validation covers the first {most:,} rows of the period only; counts below say nothing of the rest.").alias("note"))


def calendar_note(start: datetime, end: datetime) -> str | None:
    """What to say of the years from start to end that the calendar doesn't have; None if it has all."""
    years = calendar.uncovered(start, end)
    if not years:
        return None
    return f"The calendar has no holidays for {', '.join(map(str, years))}; only weekends are left out there, so holidays of those years count as unexpected gaps."


def section(findings: DataFrame, rows: DataFrame, instruments: DataFrame, due: DataFrame | None = None) -> DataFrame:
    """validation.report() for each of instruments (instrument): one without rows has zeros and passes; with issue_counts, a map of codes
    in order."""
    codes = findings.groupBy("instrument", "code").agg(F.count(F.lit(1)).alias("n")).groupBy("instrument")
    counts = codes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("issue_counts"))
    found = validation.report(findings, rows, due)
    for c, kind in (("expected", "bigint"), ("completeness_pct", "double")):
        found = found if c in found.columns else found.withColumn(c, F.lit(None).cast(kind))
    out = instruments.select("instrument").join(found, "instrument", "left").join(counts, "instrument", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "errors", "warnings", *validation.GROUPS)}
    return out.withColumns(zero | {"status": F.coalesce("status", F.lit("PASS")), "issue_counts": F.coalesce("issue_counts", F.create_map().cast("map<string, bigint>"))})


def whole(instruments: DataFrame, start: datetime, end: datetime, sections: dict[str, DataFrame], notes: DataFrame | None = None, generated_at: datetime | None = None) -> DataFrame:
    """instrument, period, generated_at, status, sections and notes: one row for each of instruments (instrument). sections are section()s
    by data set, put in order as validation.sections() does; notes (instrument, note) come before the calendar's. Without sections
    an instrument passes."""
    names = [x for x in validation.SECTIONS if x in sections] + [x for x in sections if x not in validation.SECTIONS]
    period = F.struct(F.lit(start.isoformat()).alias("start"), F.lit(end.isoformat()).alias("end"))
    out = instruments.select("instrument").distinct()
    for k, name in enumerate(names):
        cells = [F.lit(name).alias("dataset"), "status", *[F.col(c).alias(to) for to, c in _CELLS.items()], iso(F.col("first")).alias("first_timestamp"), iso(F.col("last")).alias("last_timestamp"), "issue_counts"]
        out = out.join(sections[name].select("instrument", F.struct(*cells).alias(f"_{k}")), "instrument")
    every = F.array(*[f"_{k}" for k in range(len(names))])
    statuses = F.transform(every, lambda s: s["status"]) if names else F.array().cast("array<string>")
    status = F.when(F.array_contains(statuses, "FAIL"), "FAIL").when(F.array_contains(statuses, "WARNING"), "WARNING").otherwise("PASS")
    said = calendar_note(start, end)
    own = F.array(F.lit(said)) if said else F.array().cast("array<string>")
    if notes is not None:
        out = out.join(notes.groupBy("instrument").agg(F.array_sort(F.collect_list("note")).alias("_notes")), "instrument", "left")
        own = F.concat(F.coalesce("_notes", F.array().cast("array<string>")), own)
    at = F.lit(generated_at.isoformat() if generated_at else None).cast("string")
    return out.select("instrument", period.alias("period"), at.alias("generated_at"), status.alias("status"), every.alias("sections"), own.alias("notes"))


def as_json(report: DataFrame) -> DataFrame:
    """instrument and report, one JSON object a row, nulls written out."""
    return report.select("instrument", F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("report"))


def as_text(report: DataFrame) -> DataFrame:
    """instrument and text, for people."""

    def line(label: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"  {label:<16}: "), value)

    def lines(s: Column) -> Column:
        tick = s["dataset"] == "tick"
        named = F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[s["dataset"]], s["dataset"])
        due = F.when(s["expected_records"].isNotNull(), F.array(line("Expected bars", F.concat(s["expected_records"].cast("string"), F.lit(" (completeness "), s["completeness_pct"].cast("string"), F.lit("%)"))))).otherwise(F.array().cast("array<string>"))
        own = F.when(tick, F.array(line("Invalid snapshot", s["invalid_ohlc"].cast("string")))).otherwise(F.array(line("Invalid OHLC", s["invalid_ohlc"].cast("string")), line("Unexpected gaps", s["unexpected_gaps"].cast("string"))))
        return F.concat(
            F.array(F.lit(""), F.concat(named, F.lit("  ["), s["status"], F.lit("]")), line("Records", s["records"].cast("string"))),
            due,
            F.array(*[line(label, s[c].cast("string")) for label, c in (("Duplicates", "duplicates"), ("Out-of-order", "out_of_order"), ("Schema invalid", "schema_invalid"))]),
            own,
            F.array(*[line(label, s[c].cast("string")) for label, c in (("Out-of-session", "out_of_session"), ("Volume issues", "volume_issues"))]),
        )

    head = F.array(F.concat(F.lit("Instrument: "), F.col("instrument").cast("string")), F.concat(F.lit("Period: "), F.translate("period.start", "T", " "), F.lit(" → "), F.translate("period.end", "T", " ")))
    has = report.schema["sections"].dataType.elementType.typeName() == "struct"
    body = F.flatten(F.transform("sections", lines)) if has else F.array(F.lit(""), F.lit("No datasets were validated."))
    notes = F.flatten(F.transform("notes", lambda n: F.array(F.lit(""), F.concat(F.lit("Note: "), n))))
    tail = F.array(F.lit(""), F.concat(F.lit("Overall status: "), F.col("status")))
    return report.select("instrument", F.array_join(F.concat(head, body, notes, tail), "\n").alias("text"))


def exit_status(report: DataFrame) -> int:
    """What a program ends with that has made this report: by the worst status of its rows; UNUSABLE without rows."""
    worst = report.agg(F.max(F.create_map(*[F.lit(x) for pair in EXIT.items() for x in pair])[F.col("status")])).first()[0]
    return UNUSABLE if worst is None else worst
