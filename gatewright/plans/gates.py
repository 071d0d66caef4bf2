"""The gates: look-ahead, data integrity, raw spread, neutral spread, break-even cost, deflated Sharpe, overfitting."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.operators.audit import audit
from gatewright.plans.forest import isolation_forest
from gatewright.plans.verdict import Context, Step

MONTHS = 12
NORMAL = NormalDist()


class Refused(ValueError):
    """A gate does not have what an honest answer needs."""


# Look-ahead.


def pit_gate(panel, signal, context: Context, embargo_days: float = 1) -> Step:
    """Passed if no row trades within the embargo. One action."""
    r = audit(signal.aligned, embargo_days=embargo_days).first()
    share = 0.0 if r.pct_lookahead is None else r.pct_lookahead
    days = lambda x: "none" if x is None else f"{x:.1f} d"
    detail = f"{r.n_lookahead} of {r.n} rows within the embargo ({share:.1f} %), {r.n_impossible} before publication; gaps: median {days(r.median_gap_days)}, least {days(r.min_gap_days)}"
    return Step("pit", r.n_lookahead == 0, detail)


# Integrity.

#: Price ratios of unadjusted splits, and how near to one counts.
SPLITS, NEAR = (0.1, 0.2, 0.25, 1 / 3, 0.5, 2.0, 3.0, 4.0, 5.0, 10.0), 0.01


def integrity_rules(cells: DataFrame, stale_rows: int = 5, by: str = "symbol", order: str = "date") -> DataFrame:
    """cells (symbol, date, px, volume) with ret, trailing volatility, and flags: split_tick, stale, odd_volume.

    A stale run is at least stale_rows equal prices in a row; odd volume is a price move without volume.
    """
    w = Window.partitionBy(by).orderBy(order)
    ratio = F.try_divide("px", F.lag("px").over(w))
    moved = F.coalesce((F.col("px") != F.lag("px").over(w)).cast("int"), F.lit(1))
    out = cells.withColumn("ratio", ratio).withColumn("ret", F.col("ratio") - 1).withColumn("run", F.sum(moved).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.lit(False)
    for s in SPLITS:
        near = near | (F.abs(F.col("ratio") / F.lit(s) - 1) < NEAR)
    return out.withColumns(
        {
            "trailing_vol": F.stddev_samp("ret").over(w.rowsBetween(-21, -1)),
            "split_tick": F.coalesce(near, F.lit(False)),
            "stale": F.count(F.lit(1)).over(Window.partitionBy(by, "run")) >= stale_rows,
            "odd_volume": F.coalesce((F.col("volume") == 0) & (F.col("ret") != 0), F.lit(False)),
        }
    ).drop("ratio", "run")


def isolation_features(cells: DataFrame) -> DataFrame:
    """cells (symbol, month, ret, volume, px, shares) with move (|ret| over its deviation in the 21 rows before) and share_change."""
    w = Window.partitionBy("symbol").orderBy("month")
    moved = cells.withColumns({"vol": F.stddev_samp("ret").over(w.rowsBetween(-21, -1)), "share_change": F.try_divide("shares", F.lag("shares").over(w)) - 1})
    return moved.withColumn("move", F.try_divide(F.abs("ret"), "vol")).drop("vol")


def material_flags(scores: DataFrame, flags: DataFrame, n: int = 10) -> DataFrame:
    """(month, symbol, flagged) of flags: flagged stays only where the cell changes its symbol's decile.

    scores: (month, symbol, score), each once. flags: (month, symbol, flagged, clean), clean being
    the score without the cell, null if there is none. Each cell is judged with all other scores as
    they are; one whose symbol loses its score, or has one only through the cell, changes a decile.
    """
    own = scores.where("score IS NOT NULL").select("month", "symbol", "score")
    asked = flags.join(own, ["month", "symbol"], "left").withColumn("clean", F.col("clean").cast("double"))
    # Both kinds of rows in one order: a clean score's rank is the number of scores before it.
    both = own.select("month", "symbol", F.col("score").cast("double").alias("at"), F.lit(1).alias("counts")).unionByName(
        asked.where("flagged AND clean IS NOT NULL").select("month", "symbol", F.col("clean").alias("at"), F.lit(0).alias("counts"))
    )
    month = Window.partitionBy("month")
    placed = both.withColumns({"before": F.sum("counts").over(month.orderBy("at", "symbol", "counts").rowsBetween(Window.unboundedPreceding, 0)) - F.col("counts"), "size": F.sum("counts").over(month)})
    moved = placed.where("counts = 0").select("month", "symbol", "before", "size")
    judged = asked.join(moved, ["month", "symbol"], "left").join(deciles(own, n).select("month", "symbol", "decile"), ["month", "symbol"], "left")
    rank = F.col("before") - (F.col("score") < F.col("clean")).cast("int")
    q, r = F.floor(F.col("size") / n), F.col("size") % n
    tile = F.when(rank < r * (q + 1), F.floor(rank / (q + 1))).otherwise(r + F.floor(F.try_divide(rank - r * (q + 1), q))) + 1
    changes = ~F.when(F.col("clean").isNull(), F.lit(None)).when(F.col("score").isNull(), F.lit(-1)).otherwise(tile).eqNullSafe(F.col("decile"))
    return judged.select("month", "symbol", (F.coalesce("flagged", F.lit(False)) & changes).alias("flagged"))


def flagged_exposure(weights: DataFrame, flags: DataFrame) -> DataFrame:
    """The share of absolute weight (date, symbol, weight) on flagged cells (date, symbol, flagged)."""
    held = weights.join(flags, ["date", "symbol"], "left")
    return held.agg(F.try_divide(F.sum(F.when(F.col("flagged"), F.abs("weight")).otherwise(0.0)), F.sum(F.abs("weight"))).alias("flagged_share"))


# Spreads.


def month_end_scores(signal: DataFrame) -> DataFrame:
    """(month, symbol, score): the last score of each symbol in each month, from (signal_date, symbol, score)."""
    known = signal.where(F.col("score").isNotNull() & F.col("signal_date").isNotNull())
    return known.groupBy("symbol", F.trunc("signal_date", "month").alias("month")).agg(F.max_by("score", F.struct("signal_date", "score")).alias("score"))


def deciles(scores: DataFrame, n: int = 10) -> DataFrame:
    """scores (month, symbol, score) with decile 1..n; ties by symbol. A month's cross-section is one window."""
    return scores.withColumn("decile", F.ntile(n).over(Window.partitionBy("month").orderBy("score", "symbol")))


def long_short(ranked: DataFrame, held: DataFrame, n: int = 10) -> DataFrame:
    """(month, ew, vw): return of the top less the bottom decile, equally and by weight.

    held: (month, symbol, ret, weight), returns of the month after the scores' month.
    """
    mine = ranked.where(F.col("decile").isin(1, n)).join(held, ["month", "symbol"])
    legs = mine.groupBy("month", "decile").agg(F.avg("ret").alias("ew"), F.try_divide(F.sum(F.col("ret") * F.col("weight")), F.sum("weight")).alias("vw"))
    side = lambda c: F.max(F.when(F.col("decile") == n, F.col(c))) - F.max(F.when(F.col("decile") == 1, F.col(c)))
    return legs.groupBy("month").agg(side("ew").alias("ew"), side("vw").alias("vw"))


def sharpe(series: DataFrame, column: str, per_year: int = MONTHS) -> DataFrame:
    return series.agg(F.try_divide(F.avg(column), F.stddev_samp(column)).alias("s")).select((F.col("s") * math.sqrt(per_year)).alias("sharpe"))


def sector_neutral(scores: DataFrame) -> DataFrame:
    """scores (month, symbol, score, sector) less the mean of their month and sector."""
    return scores.withColumn("score", F.col("score") - F.avg("score").over(Window.partitionBy("month", "sector")))


def neutralised(scores: DataFrame, exposures: list[str]) -> DataFrame:
    """scores (month, symbol, score, exposures...) with the residual of a least-squares fit on the exposures, month by month.

    Means and covariances of a month are aggregates; only they, one row a month, are solved in
    Python. Exposures that depend on each other share their weight, as by the pseudo-inverse.
    """
    k = range(len(exposures))
    x = [F.col(e).cast("double").alias(e) for e in exposures]
    clean = scores.dropna(subset=["score", *exposures]).select("month", "symbol", F.col("score").cast("double").alias("score"), *x)
    pairs = [(i, j) for i in k for j in k if i <= j]
    known = clean.groupBy("month").agg(
        F.avg("score").alias("y"), *[F.avg(e).alias(f"m{i}") for i, e in enumerate(exposures)],
        *[F.covar_pop(exposures[i], exposures[j]).alias(f"c{i}_{j}") for i, j in pairs], *[F.covar_pop(e, "score").alias(f"y{i}") for i, e in enumerate(exposures)],
    )

    def solved(batches):
        for pdf in batches:
            square = np.zeros((len(pdf), len(k), len(k)))
            for i, j in pairs:
                square[:, i, j] = square[:, j, i] = pdf[f"c{i}_{j}"]
            b = np.einsum("nij,nj->ni", np.linalg.pinv(square, hermitian=True), pdf[[f"y{i}" for i in k]].to_numpy(float).reshape(len(pdf), len(k)))
            level = pdf["y"] - (b * pdf[[f"m{i}" for i in k]].to_numpy(float).reshape(b.shape)).sum(1)
            yield pdf[["month"]].assign(level=level, b=list(b))

    fits = known.mapInPandas(solved, f"month {scores.schema['month'].dataType.simpleString()}, level double, b array<double>")
    fitted = sum((F.col("b")[i] * F.col(e) for i, e in enumerate(exposures)), F.col("level"))
    return clean.join(fits, "month").select("month", "symbol", (F.col("score") - fitted).alias("score"))


def hac_regression(series: DataFrame, y: str, xs: list[str], lags: int = 5, date: str = "date") -> dict[str, tuple[float, float, float]]:
    """name -> (coefficient, Newey-West error, t) for alpha and xs: y on a constant and xs over a dated series.

    Sums of products are aggregated in Spark; the driver solves a system of len(xs) + 1. The
    series is one row a date, so its lags need one window; it is kept for the second pass, not built again.
    """
    names = ["alpha", *xs]
    rows = series.dropna(subset=[y, *xs]).select(date, F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("alpha"), *[F.col(x).cast("double").alias(x) for x in xs]).persist()
    try:
        return _hac(rows, names, xs, lags, date)
    finally:
        rows.unpersist()


def _hac(rows: DataFrame, names: list[str], xs: list[str], lags: int, date: str) -> dict[str, tuple[float, float, float]]:
    k = len(names)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)], *[F.sum(F.col(a) * F.col("_y")).alias(f"y{i}") for i, a in enumerate(names)]).first()
    if sums["n"] <= k:
        raise Refused(f"{sums['n']} rows cannot fit {k} coefficients")
    products = np.array([[sums[f"x{i}_{j}"] for j in range(k)] for i in range(k)])
    scale = np.sqrt(np.diag(products))
    if not scale.all() or np.linalg.cond(products / np.outer(scale, scale)) > 1e12:
        raise Refused(f"{', '.join(xs)} depend on each other or on the constant")
    inverse = np.linalg.inv(products)
    beta = inverse @ np.array([sums[f"y{i}"] for i in range(k)])
    fitted = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, names)), F.lit(0.0))
    scores = rows.withColumn("_e", F.col("_y") - fitted).select(date, *[(F.col("_e") * F.col(c)).alias(f"u{i}") for i, c in enumerate(names)])
    w = Window.orderBy(date)
    lagged = scores.select(*[F.col(f"u{i}") for i in range(k)], *[F.lag(f"u{j}", lag).over(w).alias(f"l{lag}_{j}") for lag in range(1, lags + 1) for j in range(k)])
    cells = []
    for i in range(k):
        for j in range(k):
            total = F.col(f"u{i}") * F.col(f"u{j}")
            for lag in range(1, lags + 1):
                cross = F.col(f"u{i}") * F.col(f"l{lag}_{j}") + F.col(f"u{j}") * F.col(f"l{lag}_{i}")
                total = total + F.lit(1 - lag / (lags + 1)) * F.coalesce(cross, F.lit(0.0))
            cells.append(F.sum(total).alias(f"s{i}_{j}"))
    got = lagged.agg(*cells).first()
    middle = np.array([[got[f"s{i}_{j}"] for j in range(k)] for i in range(k)])
    errors = np.sqrt(np.diag(inverse @ middle @ inverse))
    return {c: (float(b), float(e), float(b / e) if e else math.nan) for c, b, e in zip(names, beta, errors)}


# Costs.


def turnover(weights: DataFrame) -> DataFrame:
    """(month, turnover): half the absolute change of weights (month, symbol, weight) from the month before; the first month is left out."""
    later = weights.select(F.add_months("month", 1).alias("month"), "symbol", F.col("weight").alias("before"))
    both = weights.join(later, ["month", "symbol"], "full")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    months = weights.select("month").distinct()
    follows = months.join(months.select(F.add_months("month", 1).alias("month")), "month", "left_semi")
    return both.join(follows, "month", "left_semi").groupBy("month").agg((F.sum(change) / 2).alias("turnover"))


def breakeven(gross: DataFrame, turned: DataFrame) -> DataFrame:
    """One row: mean_gross, mean_turnover, breakeven_bps, the cost per side at which the mean return is nil (a trade has two sides)."""
    g, t = gross.agg(F.avg("ret").alias("mean_gross")), turned.agg(F.avg("turnover").alias("mean_turnover"))
    return g.join(F.broadcast(t)).withColumn("breakeven_bps", F.try_divide("mean_gross", 2 * F.col("mean_turnover")) * 10_000)


# Deflated Sharpe ratio (Bailey and Lopez de Prado, 2014).


def expected_best(n_trials: int, variance: float) -> float:
    """The Sharpe ratio that the best of n_trials without skill is expected to show."""
    gamma = 0.5772156649015329
    return math.sqrt(variance) * ((1 - gamma) * NORMAL.inv_cdf(1 - 1 / n_trials) + gamma * NORMAL.inv_cdf(1 - 1 / (n_trials * math.e)))


def probabilistic_sharpe(ratio: float, against: float, n: int, skew: float, kurtosis: float) -> float:
    """The chance that the true ratio (per period) is over `against`; kurtosis is 3 for a normal series."""
    return NORMAL.cdf((ratio - against) * math.sqrt(n - 1) / math.sqrt(1 - skew * ratio + (kurtosis - 1) / 4 * ratio**2))


def moments(series: DataFrame, column: str) -> DataFrame:
    """One row: n, ratio (mean over deviation), skew, kurtosis (3 for a normal series)."""
    return series.agg(
        F.count(column).alias("n"), F.try_divide(F.avg(column), F.stddev_samp(column)).alias("ratio"), F.skewness(column).alias("skew"), (F.kurtosis(column) + 3).alias("kurtosis")
    )


def dsr_gate(series: DataFrame, column: str, context: Context, level: float = 0.95, per_year: int = MONTHS) -> Step:
    """N and the variance of (yearly) Sharpe ratios come from the ledger; below two completed trials it refuses."""
    if context.sharpe_variance is None or context.n_trials < 2:
        raise Refused(f"family {context.family!r} has too few completed trials to deflate")
    m = moments(series, column).first()
    best = expected_best(context.n_trials, context.sharpe_variance / per_year)
    chance = probabilistic_sharpe(m.ratio, best, m.n, m.skew, m.kurtosis)
    return Step("dsr", chance >= level, f"deflated Sharpe {chance:.3f} against the best of {context.n_trials}", m.ratio * math.sqrt(per_year))


# Probability of backtest overfitting (Bailey, Borwein, Lopez de Prado, Zhu).


def pbo_splits(returns: DataFrame, blocks: int = 16) -> DataFrame:
    """(mask, config, oos_rank): for each split of the blocks in halves, the configuration best in sample and its relative rank out of sample.

    returns: (config, block, ret), block from 0. Only counts and sums of a block leave it; each
    configuration becomes one row of them, on which the halves with the first block are expanded: what is
    not in one is in its complement, so both splits come from one row. A rank is the share of the other
    configurations that are below (one without a ratio is below all), counted, not sorted.
    """
    sums = returns.groupBy("config", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    cells = {f"{c}{i}": F.coalesce(F.max(F.when(F.col("block") == i, F.col(c))), F.lit(0)) for c in "nsq" for i in range(blocks)}
    wide = sums.groupBy("config").agg(*[v.alias(k) for k, v in cells.items()])
    masks = F.filter(F.sequence(F.lit(1), F.lit(2**blocks - 1), F.lit(2)), lambda m: F.bit_count(m) == blocks // 2)
    halves = wide.withColumn("mask", F.explode(masks))
    own = {c: sum((F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"{c}{i}")).otherwise(0) for i in range(1, blocks)), F.col(f"{c}0")) for c in "nsq"}
    split = halves.select("config", "mask", *[own[c].alias(c) for c in "nsq"], *[sum((F.col(f"{c}{i}") for i in range(1, blocks)), F.col(f"{c}0")).alias(f"all_{c}") for c in "nsq"])

    def ratio(n: Column, s: Column, q: Column) -> Column:
        return F.try_divide(F.try_divide(s, n), F.sqrt(F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))))

    there, rest = (F.col(c) for c in "nsq"), (F.col(f"all_{c}") - F.col(c) for c in "nsq")
    rated = split.select("config", "mask", ratio(*there).alias("here"), ratio(*rest).alias("there"))
    best = lambda a, b: F.max_by(F.struct("config", F.col(b).alias("out")), F.struct(a, "config"))
    won = rated.groupBy("mask").agg(best("here", "there").alias("w0"), best("there", "here").alias("w1"))
    below = lambda c, w: F.count_if((F.col(c) < F.col(f"{w}.out")) | (F.col(c).isNull() & F.col(f"{w}.out").isNotNull()))
    ranks = rated.join(won, "mask").groupBy("mask", "w0", "w1").agg(F.count(F.lit(1)).alias("n"), below("there", "w0").alias("r0"), below("here", "w1").alias("r1"))
    placed = lambda mask, w, r: F.struct(mask.cast("int").alias("mask"), F.col(f"{w}.config").alias("config"), F.when(F.col("n") > 1, F.col(r) / (F.col("n") - 1)).otherwise(0.0).alias("oos_rank"))
    return ranks.select(F.explode(F.array(placed(F.col("mask"), "w0", "r0"), placed(F.lit(2**blocks - 1) - F.col("mask"), "w1", "r1"))).alias("r")).select("r.*")


def pbo(splits: DataFrame) -> DataFrame:
    """One row: n_splits, pbo: the share of splits whose winner is below the median out of sample. Over 0.5, choosing has no skill."""
    return splits.agg(F.count(F.lit(1)).alias("n_splits"), F.avg((F.col("oos_rank") < 0.5).cast("int")).alias("pbo"))
