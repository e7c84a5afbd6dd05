"""Date scalars. Clocks are arguments, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_between(later: Column, earlier: Column) -> Column:
    """Whole minutes, truncated towards zero."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.when(micros >= 0, F.floor(micros / 60_000_000)).otherwise(F.ceil(micros / 60_000_000)).cast("long")


def relative_date(text: Column, as_of: Column) -> Column:
    """today, yesterday, or "n hours / days / months ago" (30 days each); 30 days ago where it says nothing."""
    s = F.lower(text)
    n = F.regexp_extract(s, r"(\d+)", 1).try_cast("int")
    back = (
        F.when(s.contains("today") | s.contains("just posted"), F.lit(0))
        .when(s.contains("yesterday"), F.lit(24))
        .when(n.isNull(), F.lit(720))
        .when(s.contains("hour"), n)
        .when(s.contains("month"), n * 720)
        .otherwise(n * 24)
    )
    return F.timestamp_micros(F.unix_micros(as_of.cast("timestamp")) - back.cast("long") * 3_600_000_000)


def range_open(text: Column) -> Column:
    """First day of "May 19 - Aug 17, 2026" or "Aug 04 - 31, 2026"."""
    head = F.trim(F.get(F.split(text, " - "), F.lit(0)))
    year = F.regexp_extract(text, r"(\d{4})\s*$", 1)
    whole = F.when(head.rlike(r"\d{4}$"), head).otherwise(F.concat(head, F.lit(", "), year))
    return F.try_to_timestamp(whole, F.lit("MMM d, yyyy"))


def range_close(text: Column) -> Column:
    """Last day of such a range, at 23:59; the month is borrowed from the first half where it is missing."""
    tail = F.trim(F.get(F.split(text, " - "), F.lit(1)))
    month = F.regexp_extract(text, r"^\s*(\w+)", 1)
    whole = F.when(tail.rlike(r"^\d"), F.concat(month, F.lit(" "), tail)).otherwise(tail)
    return F.try_to_timestamp(whole, F.lit("MMM d, yyyy")) + F.expr("INTERVAL '23:59' HOUR TO MINUTE")


def date_or_timestamp(text: Column) -> Column:
    """An RFC 3339 instant, or a bare date as the end of that day."""
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.coalesce(day + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), text.try_cast("timestamp")))


def lenient_date(text: Column) -> Column:
    """"August 12, 2026" and bare dates at noon, "2026-11-12 19:04:13 UTC" as it stands."""
    noon = F.expr("INTERVAL '12' HOUR")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("MMMM d, yyyy")) + noon,
        F.try_to_timestamp(F.regexp_replace(text, " UTC$", ""), F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")) + noon,
    )


def days_left(closes_at: Column, as_of: Column) -> Column:
    """Whole days to a deadline, half a day rounding up."""
    return F.floor((F.unix_micros(closes_at.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / 86_400_000_000 + F.lit(0.5)).cast("int")


def deadline_label(closes_at: Column, as_of: Column) -> Column:
    n = days_left(closes_at, as_of)
    return (
        F.when(n < 0, F.lit("Closed"))
        .when(n == 0, F.lit("Closes today"))
        .when(n == 1, F.lit("Closes tomorrow"))
        .when(n <= 21, F.concat(F.lit("Closes in "), n.cast("string"), F.lit(" days")))
        .when(n.isNotNull(), F.concat(F.lit("Closes "), F.date_format(closes_at, "MMM d")))
    )


def deadline_soon(closes_at: Column, as_of: Column) -> Column:
    return F.coalesce(days_left(closes_at, as_of).between(0, 3), F.lit(False))


def event_date(closes_at: Column, ts: Column) -> Column:
    return F.coalesce(closes_at, ts)


def hour_bucket(as_of: Column) -> Column:
    return F.date_trunc("hour", as_of)
