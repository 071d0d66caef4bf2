"""The seven gates as run_gauntlet takes them: each reads a Market, a Signal and the run's Context, and gives a Step.

What later gates need of earlier ones (the neutral ranks, the net series) goes by context.extras.
The caller puts there: "clean" (month, symbol, clean), scores without a suspect cell, for the
integrity gate, where a score rests on market cells; and "configs" (config, block, ret), the
returns of all configurations that were tried, for the overfitting gate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewright.operators.asof import scores_as_of
from gatewright.plans import gates, holdings
from gatewright.plans.gates import Refused
from gatewright.plans.verdict import Context, Step


@dataclass(frozen=True)
class Market:
    """held (month, symbol, ret, weight): returns of the month after a score's; cells (month, symbol, px, volume, shares);
    factors (month, one column a factor); traits (month, symbol, sector, one column an exposure)."""

    held: DataFrame
    cells: DataFrame
    factors: DataFrame
    traits: DataFrame
    #: Cost per side, in basis points, that trading in this universe plausibly has; without bands for all of it.
    cost_bps: float = 10.0
    #: Plausible costs by liquidity, see holdings.BANDS; the cells' px * volume tells the band of a trade.
    bands: tuple[tuple[float, float, float], ...] | None = None
    extras: dict = field(default_factory=dict)


def month_scores(signal) -> DataFrame:
    """(month, symbol, score) of a signal that can be used: at each month's end the last score, unless it is stale."""
    usable = signal.usable().select("signal_date", F.col("ticker").alias("symbol"), "score")
    return scores_as_of(usable).select("month", "symbol", "score")


def leg_weights(ranked: DataFrame, n: int = 10) -> DataFrame:
    """(month, symbol, weight): 1 over the size of the top decile, -1 over that of the bottom one."""
    size = F.count(F.lit(1)).over(Window.partitionBy("month", "decile"))
    side = F.when(F.col("decile") == n, 1.0).otherwise(-1.0)
    return ranked.where(F.col("decile").isin(1, n)).select("month", "symbol", (side / size).alias("weight"))


def signal_weights(scores: DataFrame) -> DataFrame:
    """(month, symbol, weight): scores (month, symbol, score) less their month's mean, as shares of all such distances. A month of equal scores has no weights."""
    month = Window.partitionBy("month")
    far = scores.where("score IS NOT NULL").withColumn("far", F.col("score") - F.avg("score").over(month))
    return far.select("month", "symbol", F.try_divide("far", F.sum(F.abs("far")).over(month)).alias("weight"))


def _ratio(series: DataFrame, column: str) -> float:
    found = gates.sharpe(series, column).first().sharpe
    if found is None:
        raise Refused(f"{column} has no Sharpe ratio: too few months, or no variation")
    return found


def _counted(step: Step, context: Context) -> Step:
    """The rule for a gate with a series of its own: what survives is its ratio, but never more than survived before. A higher one is told as found."""
    before = context.surviving_sharpe
    if before is None or step.sharpe is None or step.sharpe <= before:
        return step
    return step._replace(sharpe=before, found=step.sharpe)


def integrity_gate(panel: Market, signal, context: Context, limit: float = 0.1, anomaly: float = 0.75) -> Step:
    """Passed if at most `limit` of the weight by signal rests on cells that are flagged, by rule or by forest, and change a decile."""
    rules = gates.integrity_rules(panel.cells, order="month")
    forest = gates.isolation_forest(gates.isolation_features(rules.select("symbol", "month", "ret", "volume", "px", "shares")), ["ret", "volume", "move", "px", "share_change"], ["symbol", "month"])
    broken = rules.select("month", "symbol", (F.col("split_tick") | F.col("stale") | F.col("odd_volume")).alias("broken"))
    flags = broken.join(forest, ["month", "symbol"], "left").select("month", "symbol", (F.col("broken") | F.coalesce(F.col("anomaly") >= anomaly, F.lit(False))).alias("flagged"))
    scores = month_scores(signal)
    clean = context.extras.get("clean")
    clean = scores.select("month", "symbol", F.col("score").alias("clean")) if clean is None else clean
    material = gates.material_flags(scores, flags.join(clean, ["month", "symbol"], "left"))
    weights = signal_weights(scores).withColumnRenamed("month", "date")
    share = gates.flagged_exposure(weights, material.withColumnRenamed("month", "date")).first().flagged_share or 0.0
    return Step("integrity", share <= limit, f"{100 * share:.1f} % of the weight by signal rests on flagged cells that change a decile; {100 * limit:.0f} % may")


def raw_gate(panel: Market, signal, context: Context) -> Step:
    """The decile spread, by value; that of equal weights is told beside it. Passed above nil."""
    spread = gates.long_short(gates.deciles(month_scores(signal)), panel.held)
    context.extras["raw"] = spread
    value, equal = _ratio(spread, "vw"), _ratio(spread, "ew")
    return Step("raw", value > 0, f"by value {value:.2f}, equally weighted {equal:.2f}", value)


def neutral_scores(scores: DataFrame, traits: DataFrame) -> DataFrame:
    """Residuals on sector and all exposures together: both sides less their sector's mean, then a fit on the exposures."""
    exposures = [c for c in traits.columns if c not in ("month", "symbol", "sector")]
    both = scores.join(traits, ["month", "symbol"]).dropna(subset=["score", "sector", *exposures])
    group = Window.partitionBy("month", "sector")
    inner = both.select("month", "symbol", *[(F.col(c) - F.avg(c).over(group)).alias(c) for c in ("score", *exposures)])
    return gates.neutralised(inner, exposures) if exposures else inner


def orthogonalize_gate(panel: Market, signal, context: Context, lags: int = 3) -> Step:
    """Alpha of the raw spread over the factors, and the spread of scores neutral to sector and traits, which is what survives."""
    names = [c for c in panel.factors.columns if c != "month"]
    raw = context.extras["raw"].join(panel.factors, "month")
    alpha, _, t = gates.hac_regression(raw, "vw", names, lags=lags, date="month")["alpha"]
    ranked = gates.deciles(neutral_scores(month_scores(signal), panel.traits))
    spread = gates.long_short(ranked, panel.held)
    context.extras |= {"ranked": ranked, "spread": spread}
    found = _ratio(spread, "vw")
    return _counted(Step("orthogonalize", found > 0, f"monthly alpha {alpha:.4f} (t {t:.2f}) over {', '.join(names)}; neutral spread {found:.2f}", found), context)


def costs_gate(panel: Market, signal, context: Context) -> Step:
    """The cost per side at which the neutral spread earns nothing, given what it really trades, against the plausible range; what survives is the spread net of that range's upper end.

    Return and turnover are of the same holdings: legs by value, that drift with returns until the next month.
    """
    legs = holdings.value_legs(context.extras["ranked"], panel.held)
    bands = panel.bands or ((0.0, panel.cost_bps, panel.cost_bps),)
    liquidity = panel.cells.select("month", "symbol", (F.col("px") * F.col("volume")).alias("dollars"))
    b = holdings.realised_breakeven(legs, liquidity, bands).first()
    paid = holdings.plausible_costs(holdings.trades(legs), liquidity, bands)
    net = holdings.earned(legs).join(paid, "month", "left").select("month", (F.col("ret") - F.coalesce("high_paid", F.lit(0.0))).alias("net"))
    context.extras["net"] = net
    found = _ratio(net, "net")
    bound = math.inf if b.breakeven_bps is None else b.breakeven_bps
    low, high = (panel.cost_bps if x is None else x for x in (b.low_bps, b.high_bps))
    plausible = f"{high:.1f}" if low == high else f"{low:.1f} to {high:.1f}"
    detail = f"breaks even at {bound:.1f} bps a side, {plausible} are plausible for its liquidity; turnover {b.mean_turnover or 0:.2f}"
    return _counted(Step("costs", bound > high and found > 0, detail, found), context)


def dsr_gate(panel: Market, signal, context: Context) -> Step:
    """The net series against the best of as many trials as the ledger has."""
    return _counted(gates.dsr_gate(context.extras["net"], "net", context), context)


def pbo_gate(panel: Market, signal, context: Context, blocks: int = 16) -> Step:
    """Passed if the best configuration in sample is below the median out of sample in at most half of the splits."""
    if "configs" not in context.extras:
        raise Refused("without the returns of all configurations there is no telling how the best was chosen")
    found = gates.pbo(gates.pbo_splits(context.extras["configs"], blocks)).first()
    return Step("pbo", found.pbo <= 0.5, f"probability of overfitting {found.pbo:.2f} over {found.n_splits} splits")


GATES = {"pit": gates.pit_gate, "integrity": integrity_gate, "raw": raw_gate, "orthogonalize": orthogonalize_gate, "costs": costs_gate, "dsr": dsr_gate, "pbo": pbo_gate}
