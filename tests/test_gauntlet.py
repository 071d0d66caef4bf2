"""All seven gates over a synthetic signal, good and bad."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from gatewright.operators.lazy_prices import Signal
from gatewright.plans.gates import Refused
from gatewright.plans.gauntlet import GATES, Market, neutral_scores
from gatewright.plans.ledger import Ledger, Trial
from gatewright.plans.verdict import GATE_ORDER, run_gauntlet

MONTHS, SYMBOLS = 36, 40


def synthetic(spark, skill=0.02, seed=1, broken=()):
    """A signal whose scores foretell the next month's return by `skill`; cells of `broken` symbols do not move."""
    r = np.random.default_rng(seed)
    months = [datetime(2020 + k // 12, k % 12 + 1, 1).date() for k in range(MONTHS)]
    rows, held, cells, traits = [], [], [], []
    factors = [(m, float(a), float(b)) for m, (a, b) in zip(months, r.normal(0, 0.03, (MONTHS, 2)))]
    for s in range(SYMBOLS):
        px = 50.0
        for k, m in enumerate(months):
            score, size = r.normal(), r.normal()
            signal_date = datetime(m.year, m.month, 15).date()
            accepted = datetime(m.year, m.month, 10, 15, tzinfo=timezone.utc)
            rows.append((f"s{s:02}", f"a{s}-{k}", signal_date, accepted, float(score + 0.2 * size), False, True))
            held.append((m, f"s{s:02}", float(skill * score + r.normal(0, 0.03)), float(r.uniform(1, 2))))
            px = 7.0 if s in broken else px * float(np.exp(r.normal(0, 0.05)))
            cells.append((f"s{s:02}", m, px, float(r.uniform(1e5, 2e5)), 1e6))
            traits.append((m, f"s{s:02}", "xyz"[s % 3], float(size), float(r.normal())))
    aligned = spark.createDataFrame(rows, "ticker string, accession string, signal_date date, acceptance_datetime timestamp, score double, extraction_failed boolean, gap_ok boolean")
    market = Market(
        spark.createDataFrame(held, "month date, symbol string, ret double, weight double"), spark.createDataFrame(cells, "symbol string, month date, px double, volume double, shares double"),
        spark.createDataFrame(factors, "month date, mkt_rf double, smb double"), spark.createDataFrame(traits, "month date, symbol string, sector string, size double, momentum double"),
    )
    return Signal(aligned), market


def configs(spark, best=True):
    r = np.random.default_rng(3)
    rows = [(c, b, float(r.normal(0.5 if best and c == 2 else 0.0))) for c in range(5) for b in range(16) for _ in range(6)]
    return spark.createDataFrame(rows, "config int, block int, ret double")


@pytest.fixture
def ledger(tmp_path):
    ledger = Ledger(tmp_path / "ledger.jsonl")
    for i, s in enumerate((0.3, 0.5, 0.4)):
        ledger.complete(ledger.record(Trial("f", "s", {"n": i}, "u", "2020", "2022")), {"sharpe": s})
    return ledger


def go(signal, market, ledger, extras):
    return run_gauntlet("s", Trial("f", "s", {"n": 9}, "u", "2020", "2022"), market, signal, GATES, ledger, extras)


def test_a_skilled_signal_passes_seven_gates(spark, ledger):
    v = go(*synthetic(spark), ledger, {"configs": configs(spark)})
    assert [s.gate for s in v.steps] == list(GATE_ORDER) and v.survives, v.waterfall()
    by = {s.gate: s for s in v.steps}
    assert by["raw"].sharpe >= by["orthogonalize"].sharpe >= by["costs"].sharpe >= by["dsr"].sharpe > 1
    assert "breaks even at" in by["costs"].detail and "over mkt_rf, smb" in by["orthogonalize"].detail
    assert ledger.entries()[-1]["outcome"]["survives"] and v.n_trials == 4


def test_signals_die_where_they_should(spark, ledger):
    signal, market = synthetic(spark)
    with pytest.raises(Refused, match="configurations"):
        go(signal, market, ledger, {})
    dear = Market(market.held, market.cells, market.factors, market.traits, cost_bps=2000)
    assert go(signal, dear, ledger, {}).died_at == "costs"
    signal, market = synthetic(spark, skill=-0.02)
    assert go(signal, market, ledger, {}).died_at == "raw"


def test_alpha_on_broken_cells_dies_at_integrity(spark, ledger):
    """Half of the symbols have stale prices, and without those cells they have no score."""
    signal, market = synthetic(spark, broken=range(20))
    nothing = market.cells.selectExpr("month", "symbol", "CAST(NULL AS DOUBLE) AS clean").where("false")
    assert go(signal, market, ledger, {"clean": nothing}).died_at == "integrity"


def test_neutral_scores_carry_neither_sector_nor_traits(spark):
    signal, market = synthetic(spark)
    scores = market.traits.selectExpr("month", "symbol", "size * 3 + momentum + CASE sector WHEN 'x' THEN 5 ELSE 0 END AS score")
    assert neutral_scores(scores, market.traits).selectExpr("max(abs(score))").first()[0] < 1e-9


def test_annual_filings_rank_every_firm_every_month_through_seven_gates(spark, ledger):
    """One filing a year and firm: its score stands until the next one, so each month's deciles have all firms."""
    from gatewright.plans.gauntlet import month_scores

    r = np.random.default_rng(4)
    firms, years = 60, 5
    rows, held, cells, traits = [], [], [], []
    months = [datetime(2018 + k // 12, k % 12 + 1, 1).date() for k in range(12 * years)]
    factors = [(m, float(a), float(b)) for m, (a, b) in zip(months, r.normal(0, 0.03, (len(months), 2)))]
    for s in range(firms):
        name, px, known = f"f{s:02}", 40.0, {}
        for y in range(years):
            day = datetime(2018 + y, s % 12 + 1, 12)
            known[day.date().replace(day=1)] = score = float(r.normal())
            rows.append((name, f"{name}-{y}", day.date(), (day - timedelta(3)).replace(hour=15, tzinfo=timezone.utc), score, False, True))
        score = None
        for m in months:
            score = known.get(m, score)
            held.append((m, name, float(0.02 * (score or 0.0) + r.normal(0, 0.03)), float(r.uniform(1, 2))))
            px *= float(np.exp(r.normal(0, 0.05)))
            cells.append((name, m, px, float(r.uniform(1e5, 2e5)), 1e6))
            traits.append((m, name, "xyz"[s % 3], float(r.normal()), float(r.normal())))
    aligned = spark.createDataFrame(rows, "ticker string, accession string, signal_date date, acceptance_datetime timestamp, score double, extraction_failed boolean, gap_ok boolean")
    market = Market(
        spark.createDataFrame(held, "month date, symbol string, ret double, weight double"), spark.createDataFrame(cells, "symbol string, month date, px double, volume double, shares double"),
        spark.createDataFrame(factors, "month date, mkt_rf double, smb double"), spark.createDataFrame(traits, "month date, symbol string, sector string, size double, momentum double"), bands=((0.0, 5.0, 15.0), (5e6, 2.0, 8.0)),
    )
    ranked = {x.month: x["count"] for x in month_scores(Signal(aligned)).groupBy("month").count().collect()}
    assert all(ranked[m] == firms for m in months[11:])
    v = go(Signal(aligned), market, ledger, {"configs": configs(spark)})
    assert [s.gate for s in v.steps] == list(GATE_ORDER) and v.survives, v.waterfall()
    costs = v.steps[4]
    assert "are plausible for its liquidity" in costs.detail and "turnover 0." in costs.detail, "annual scores trade little"
