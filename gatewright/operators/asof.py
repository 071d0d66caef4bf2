"""What is known at a date: scores carried until they are superseded or stale, and the universe of each rebalance date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.operators.panel import common_stocks, members_by_date

#: Months after which a score is stale: an annual report may come three months late.
STALE_MONTHS = 15


def _month_ended(day: Column) -> Column:
    """The last month that has ended on a day or before, by its first day."""
    return F.add_months(F.trunc(F.date_add(day, 1), "month"), -1)


def scores_as_of(signal: DataFrame, stale_months: int = STALE_MONTHS, last_month: str | None = None) -> DataFrame:
    """(month, symbol, score, signal_date): at the end of each month the last score of each symbol, if it is at most stale_months old.

    signal: (symbol, signal_date, score); rows without a score or a date are skipped, so they do not
    supersede. Of scores of one date the greatest counts. A score stands from the month of its date until
    the month before the next one's, or as long as signal_date + stale_months has not passed at the month's
    end, or until last_month. Each score is spread from its own row, over at most stale_months + 1 months; a
    window orders the months in which a symbol has scores, nothing else.
    """
    known = signal.where(F.col("score").isNotNull() & F.col("signal_date").isNotNull())
    last = known.groupBy("symbol", F.trunc("signal_date", "month").alias("first")).agg(F.max(F.struct("signal_date", "score")).alias("r"))
    following = F.lead("first").over(Window.partitionBy("symbol").orderBy("first"))
    until = F.least(F.add_months(following, -1), _month_ended(F.add_months(F.col("r.signal_date"), stale_months)), F.lit(last_month).cast("date"))
    spans = last.withColumn("until", until).where("first <= until")
    return spans.select(F.explode(F.expr("sequence(first, until, interval 1 month)")).alias("month"), "symbol", "r.score", "r.signal_date")


def _asked(dates: DataFrame, window_days: int) -> DataFrame:
    """(date, month): each date with the months that its window meets."""
    months = F.sequence(F.trunc(F.date_sub("date", window_days - 1), "month"), F.trunc("date", "month"), F.expr("interval 1 month"))
    return dates.select(F.col("date").cast("date").alias("date")).distinct().select("date", F.explode(months).alias("month"))


def _windowed(panel: DataFrame, dates: DataFrame, window_days: int) -> DataFrame:
    """panel (date, symbol, value) once for each asked date in whose window of days it lies, that date as `at`. Rows meet dates by month."""
    asked = _asked(dates, window_days).withColumnRenamed("date", "at")
    rows = panel.select("date", F.trunc("date", "month").alias("month"), "symbol", "value")
    return rows.join(asked, "month").where(F.col("date").between(F.date_sub("at", window_days - 1), F.col("at"))).select("at", "date", "symbol", "value")


def universe_by_date(
    adv: DataFrame, prices: DataFrame, membership: DataFrame, classifications: DataFrame, dates: DataFrame, top_n: int = 200, window_days: int = 365, index_name: str = "sp500", coverage: float = 0.5
) -> DataFrame:
    """(date, symbol, median_adv, place): of each date (date) the top_n members by median dollar volume over the window that ends there.

    Nothing after a date enters its list: members are those of the date, and volumes and prices those of
    the window_days up to it. A symbol is priced on over `coverage` of the dates of its window that have any
    price, and is ordinary equity. Medians are exact, and taken of one symbol's window, so no sort has
    more than window_days rows; a place is given within a date's list. Ties go by symbol.
    """
    members = members_by_date(membership, dates, index_name).join(common_stocks(classifications), "symbol", "left_semi")
    priced = _windowed(prices, dates, window_days).where("value IS NOT NULL")
    seen = priced.groupBy("at").agg(F.count_distinct("date").alias("n_dates"))
    have = priced.groupBy("at", "symbol").agg(F.count_distinct("date").alias("n"))
    covered = have.join(seen, "at").where(F.col("n") > coverage * F.col("n_dates")).select(F.col("at").alias("date"), "symbol")
    pool = members.join(covered, ["date", "symbol"], "left_semi")
    medians = _windowed(adv, dates, window_days).where("value IS NOT NULL").groupBy(F.col("at").alias("date"), "symbol").agg(F.median("value").alias("median_adv"))
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("median_adv"), "symbol"))
    return pool.join(medians, ["date", "symbol"]).select("date", "symbol", "median_adv", place.alias("place")).where(F.col("place") <= top_n)
