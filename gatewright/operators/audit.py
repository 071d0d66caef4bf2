"""Point-in-time audit: how long after publication each signal is traded."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.functions.timeops import align, fractional_days, utc_instant

DEFAULT_EMBARGO_DAYS = 1


def gap_rows(aligned: DataFrame, signal_date: str = "signal_date", acceptance: str = "acceptance_datetime") -> DataFrame:
    """aligned with gap: elapsed days from publication to the close at which the signal trades; null if either is missing."""
    return aligned.withColumn("gap", fractional_days(utc_instant(aligned, signal_date, at_close=True), utc_instant(aligned, acceptance)))


def exact_median(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """(by..., median): the exact median of a number in each group; nulls are left out.

    No task holds a group. Equal values are counted, counts are summed over buckets of `width`,
    and only the buckets that hold the two middle ranks are put in order.
    """
    return median_of_counts(rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), by, value, width)


def median_of_counts(counts: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """exact_median of rows that are counted already: counts (by..., value, _c), each value once in its group."""
    counts = counts.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(value) / width))
    group, ordered = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_b")
    sums = counts.groupBy(*by, "_b").agg(F.sum("_c").alias("_s"))
    laid = sums.select(*by, "_b", "_s", (F.sum("_s").over(ordered) - F.col("_s")).alias("_before"), F.sum("_s").over(group).alias("_n"))
    laid = laid.withColumns({"_low": F.floor((F.col("_n") - 1) / 2), "_high": F.floor(F.col("_n") / 2)})
    middle = laid.where((F.col("_before") <= F.col("_high")) & (F.col("_before") + F.col("_s") > F.col("_low"))).drop("_s", "_n")
    inside = counts.join(middle, [*by, "_b"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy(value))
    placed = inside.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_c"))
    at = lambda rank: F.max(F.when((F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_upto")), F.col(value)))
    return placed.groupBy(*by).agg(((at("_low") + at("_high")) / 2).alias("median"))


def audit(aligned: DataFrame, by: tuple[str, ...] = (), embargo_days: float = DEFAULT_EMBARGO_DAYS, **columns: str) -> DataFrame:
    """Per group: n, n_impossible (before publication), n_lookahead (within the embargo of elapsed days), pct_lookahead, median and least gap.

    A row without a gap counts in n only. The median is exact. Groups are those of non-null `by`.
    """
    keys = list(by) or ["_all"]
    rows = gap_rows(aligned, **columns)
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    # Rows are aligned and counted by gap once; that exchange serves the counts and the median.
    counted = rows.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("_c"))
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("_c"))), F.lit(0))
    n, late = F.coalesce(F.sum("_c"), F.lit(0)), of(F.col("gap") < embargo_days)
    counts = (counted.groupBy(*keys) if by else counted.groupBy()).agg(
        n.alias("n"), of(F.col("gap") < 0).alias("n_impossible"), late.alias("n_lookahead"), F.try_divide(late * 100.0, n).alias("pct_lookahead"), F.min("gap").alias("min_gap_days")
    )
    counts = counts if by else counts.withColumn("_all", F.lit(0))
    medians = median_of_counts(counted, keys, "gap", 1 / 24).withColumnRenamed("median", "median_gap_days")
    return counts.join(medians, keys, "left").select(*by, "n", "n_impossible", "n_lookahead", "pct_lookahead", "median_gap_days", "min_gap_days")


def twin_audit(filings: DataFrame, calendar: DataFrame, embargo_days: int = DEFAULT_EMBARGO_DAYS) -> DataFrame:
    """The audit of the naive and the honest alignment, side by side, in one aggregation. Filings that cannot be traded are left out."""
    honest = align(filings, calendar, embargo_days=embargo_days)
    both = honest.select(
        "acceptance_datetime",
        F.inline(
            F.array(
                F.struct(F.lit("acceptance").alias("alignment"), F.col("signal_date").alias("signal_date")),
                F.struct(F.lit("period_end").alias("alignment"), F.col("period_end").cast("date").alias("signal_date")),
            )
        ),
    )
    return audit(both.dropna(subset=["signal_date"]), ("alignment",), embargo_days)
