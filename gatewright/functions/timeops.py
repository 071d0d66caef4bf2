"""Exchange time: instants of trading dates, alignment of events to sessions, gaps.

All functions expect the session time zone UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXECUTION_TZ = "America/New_York"
CLOSE_HOUR = 16
#: Dates before it are aligned as if they were this one.
CALENDAR_FLOOR = "1990-01-01"
ALIGNMENTS = ("acceptance", "period_end")


def utc_instant(df: DataFrame, name: str, at_close: bool = False) -> Column:
    """The column as a UTC instant.

    Zoned timestamps are instants already. Dates and zoneless timestamps are wall-clock times of
    the exchange; with at_close, midnight ones (row by row) stand for the close.
    """
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.TimestampType):
        return col
    wall = col.cast("timestamp")
    if at_close:
        close = wall + F.expr(f"INTERVAL {CLOSE_HOUR} HOURS")
        wall = close if isinstance(kind, T.DateType) else F.when(wall == F.date_trunc("day", wall), close).otherwise(wall)
    return F.to_utc_timestamp(wall, EXECUTION_TZ)


def fractional_days(later: Column, earlier: Column) -> Column:
    """Elapsed days, with fraction."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole 24-hour days, floored; not the count of midnights between."""
    return F.floor(fractional_days(later, earlier)).cast("long")


def effective_date(acceptance: Column) -> Column:
    """The exchange date on which an instant can first be acted on: the next one from the close on."""
    local = F.from_utc_timestamp(acceptance, EXECUTION_TZ)
    return F.date_add(local.cast("date"), (F.hour(local) >= CLOSE_HOUR).cast("int"))


def session_table(calendar: DataFrame, embargo_days: int, clip: bool = False) -> DataFrame:
    """(effective, signal_date) for each date from CALENDAR_FLOOR to the last session in calendar (d).

    signal_date is the session `embargo_days` after the first one on or after the date; where
    the calendar ends sooner it is null, or with `clip` the last session. One row a date: a
    dimension bounded by the calendar, so its windows need no partition.
    """
    sessions = calendar.select(F.col("d").cast("date").alias("d")).where("d IS NOT NULL").distinct()
    ordered = Window.orderBy("d")
    whole = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    target = F.lead("d", embargo_days).over(ordered)
    if clip:
        target = F.coalesce(target, F.max("d").over(whole))
    placed = sessions.select("d", target.alias("target"))
    days = placed.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a IS NOT NULL").select(
        F.explode(F.sequence(F.least("a", F.lit(CALENDAR_FLOOR).cast("date")), F.col("b"))).alias("effective")
    )
    here = F.when(F.col("d").isNotNull(), F.struct("d", "target"))
    found = days.join(placed, F.col("effective") == F.col("d"), "left")
    # Backwards in time, the session seen last is the next one; a frame that grows costs one step a date.
    following = F.last(here, ignorenulls=True).over(Window.orderBy(F.desc("effective")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.select("effective", following.alias("s")).select("effective", F.col("s.target").alias("signal_date"))


def align(
    df: DataFrame,
    calendar: DataFrame,
    alignment: str = "acceptance",
    embargo_days: int = 1,
    clip: bool = False,
    acceptance: str = "acceptance_datetime",
    period_end: str = "period_end",
) -> DataFrame:
    """df with signal_date: the session `embargo_days` after the first that could act on the acceptance.

    `period_end` alignment returns the period end itself and is wrong on purpose, for comparison.
    The join is by date against a calendar-sized table, so it needs no range join.
    """
    if alignment not in ALIGNMENTS:
        raise ValueError(f"unknown alignment {alignment!r}; known: {ALIGNMENTS}")
    if alignment == "period_end":
        return df.withColumn("signal_date", F.col(period_end).cast("date"))
    if isinstance(df.schema[acceptance].dataType, T.TimestampNTZType):
        raise ValueError(f"{acceptance} has no time zone; state one before aligning")
    sessions = session_table(calendar, embargo_days, clip).withColumnRenamed("effective", "_effective")
    day = effective_date(F.col(acceptance))
    day = F.when(day.isNotNull(), F.greatest(day, F.lit(CALENDAR_FLOOR).cast("date")))
    return df.withColumn("_effective", day).join(sessions, "_effective", "left").drop("_effective")


def weekdays(bounds: DataFrame) -> DataFrame:
    """Calendar (d) of Mondays to Fridays between the dates a and b of a one-row table."""
    return bounds.select(F.explode(F.sequence("a", "b")).alias("d")).where(F.weekday("d") < 5)
