"""Portfolios that are held: value-weighted legs, how they drift, what is traded, and what that plausibly costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Plausible costs of a trade, a side, in basis points: from a dollar volume (of the period) on, from and to.
BANDS = ((0.0, 25.0, 100.0), (1e7, 10.0, 30.0), (1e8, 5.0, 15.0), (1e9, 2.0, 6.0))


def value_legs(ranked: DataFrame, held: DataFrame, n: int = 10) -> DataFrame:
    """(month, symbol, weight, ret): the top part by value, 1 in all, and less the bottom one by value.

    ranked: (month, symbol, decile); held: (month, symbol, ret, weight), returns of the month after. What has
    no return, or no value over 0, is not held.
    """
    own = ranked.where(F.col("decile").isin(1, n)).select("month", "symbol", "decile").join(held.where("ret IS NOT NULL AND weight > 0").select("month", "symbol", "ret", "weight"), ["month", "symbol"])
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("month", "decile"))
    return own.select("month", "symbol", F.when(F.col("decile") == n, share).otherwise(-share).alias("weight"), "ret")


def earned(legs: DataFrame) -> DataFrame:
    """(month, ret): what legs (month, symbol, weight, ret) earn in the month that follows."""
    return legs.groupBy("month").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))


def trades(legs: DataFrame) -> DataFrame:
    """(month, symbol, traded): the change of weight at each month's start but the first, after the holdings before have drifted.

    Over a month a holding of weight w that returns r becomes w (1 + r) of a capital that becomes 1 + R,
    R being what all of them earn. A month without one before it has no trades, like the first.
    """
    after = legs.join(earned(legs).withColumnRenamed("ret", "all"), "month").where("all > -1")
    drifted = after.select(F.add_months("month", 1).alias("month"), "symbol", (F.col("weight") * (1 + F.col("ret")) / (1 + F.col("all"))).alias("before"))
    both = legs.select("month", "symbol", "weight").join(drifted, ["month", "symbol"], "full")
    follows = legs.select("month").distinct().join(drifted.select("month").distinct(), "month", "left_semi")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    return both.join(follows, "month", "left_semi").select("month", "symbol", change.alias("traded"))


def turnover(traded: DataFrame) -> DataFrame:
    """(month, turnover): half of what is traded (month, symbol, traded)."""
    return traded.groupBy("month").agg((F.sum("traded") / 2).alias("turnover"))


def plausible_costs(traded: DataFrame, liquidity: DataFrame, bands: Sequence[tuple[float, float, float]] = BANDS) -> DataFrame:
    """(month, low_bps, high_bps, low_paid, high_paid): the cost of a month's trades by the band of liquidity (month, symbol, dollars) of each.

    Bands are (dollars from, bps from, bps to), by rising dollars; a symbol without known dollars is in the first.
    _bps are a side's cost of the average dollar traded, _paid what is paid for the month, as a share of capital.
    """
    dollars = F.coalesce(F.col("dollars").cast("double"), F.lit(0.0))
    low, high = F.lit(float(bands[0][1])), F.lit(float(bands[0][2]))
    for at, a, b in bands[1:]:
        low, high = F.when(dollars >= at, float(a)).otherwise(low), F.when(dollars >= at, float(b)).otherwise(high)
    priced = traded.join(liquidity.select("month", "symbol", "dollars"), ["month", "symbol"], "left").select("month", "traded", low.alias("low"), high.alias("high"))
    paid = priced.groupBy("month").agg(F.sum("traded").alias("t"), *[F.sum(F.col("traded") * F.col(c)).alias(c) for c in ("low", "high")])
    return paid.select("month", *[F.try_divide(c, F.col("t")).alias(f"{c}_bps") for c in ("low", "high")], *[(F.col(c) / 10_000).alias(f"{c}_paid") for c in ("low", "high")])


def realised_breakeven(legs: DataFrame, liquidity: DataFrame | None = None, bands: Sequence[tuple[float, float, float]] = BANDS) -> DataFrame:
    """One row: mean_gross, mean_turnover, breakeven_bps and, with liquidity, low_bps and high_bps, the plausible range of a side's cost.

    Return and turnover are of the same holdings, over the months that have trades.
    """
    traded = trades(legs)
    both = earned(legs).join(turnover(traded), "month").agg(F.avg("ret").alias("mean_gross"), F.avg("turnover").alias("mean_turnover"))
    out = both.withColumn("breakeven_bps", F.try_divide("mean_gross", 2 * F.col("mean_turnover")) * 10_000)
    if liquidity is None:
        return out
    cost = plausible_costs(traded, liquidity, bands).agg(F.avg("low_bps").alias("low_bps"), F.avg("high_bps").alias("high_bps"))
    return out.join(F.broadcast(cost))  # one row
