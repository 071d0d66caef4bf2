"""Scores as of month ends, universes by date, and portfolios that drift."""

from datetime import date

import pytest

from gatewright.operators.asof import scores_as_of, universe_by_date
from gatewright.plans import holdings
from gatewright.plans.gauntlet import Market, costs_gate, signal_weights
from gatewright.plans.verdict import Context, Step, Verdict


def month(y, m):
    return date(y, m, 1)


def test_scores_stand_until_superseded_or_stale(spark):
    rows = [("a", date(2020, 1, 31), 1.0), ("a", date(2021, 3, 5), 2.0), ("a", date(2021, 3, 5), 3.0), ("a", date(2021, 4, 2), None), ("a", None, 9.0), ("b", date(2020, 5, 20), 5.0), ("c", date(2020, 7, 31), 6.0)]
    signal = spark.createDataFrame(rows, "symbol string, signal_date date, score double")
    got = {}
    for r in scores_as_of(signal).collect():
        assert (r.symbol, r.month) not in got
        got[r.symbol, r.month] = (r.score, r.signal_date)
    months = [month(2020 + k // 12, k % 12 + 1) for k in range(36)]
    assert [got.get(("a", m), (None,))[0] for m in months] == [1.0] * 14 + [3.0] * 15 + [None] * 7
    assert [m for m in months if ("b", m) in got] == months[4:19], "15 months after the 20th, the month has not ended"
    assert [m for m in months if ("c", m) in got] == months[6:22], "2021-10-31 ends its month, as the last day that counts"
    assert {r.month for r in scores_as_of(signal, 15, "2020-09-01").where("symbol = 'b'").collect()} == set(months[4:9])
    assert scores_as_of(signal.where("false")).collect() == []


def test_an_annual_signal_ranks_every_firm_every_month(spark):
    rows = [(f"f{k:02}", date(2018 + y, k % 12 + 1, 10), float(k + y)) for k in range(24) for y in range(4)]
    months = scores_as_of(spark.createDataFrame(rows, "symbol string, signal_date date, score double")).groupBy("month").count().collect()
    assert {r["count"] for r in months if month(2019, 1) <= r.month <= month(2021, 12)} == {24}


def test_a_universe_knows_nothing_of_later_dates(spark):
    days = [date(2022 + k // 12, k % 12 + 1, 15) for k in range(24)]
    adv = [(d, s, float(v * (10 if d.year == 2023 and s == "D" else 1))) for d in days for s, v in zip("ABCDE", (5, 4, 3, 2, 1))]
    px = [r for r in adv if r[1] != "C" or r[0].month < 4]
    kind = "date date, symbol string, value double"
    member = spark.createDataFrame([(s, "sp500", date(2000, 1, 1), date(2022, 12, 31) if s == "A" else None) for s in "ABCDE"] + [("E", "other", date(2000, 1, 1), None)], "symbol string, index_name string, valid_from date, valid_to date")
    kinds = spark.createDataFrame([(s, "x", "EQUITY" if s != "B" else "ETF") for s in "ABCDE"], "symbol string, sector string, quoteType string")
    dates = spark.createDataFrame([(date(2022, 12, 31),), (date(2023, 12, 31),)], "date date")
    got = universe_by_date(spark.createDataFrame(adv, kind), spark.createDataFrame(px, kind), member, kinds, dates, 2, 300).collect()
    assert sorted((r.date.year, r.place, r.symbol, r.median_adv) for r in got) == [(2022, 1, "A", 5.0), (2022, 2, "D", 2.0), (2023, 1, "D", 20.0), (2023, 2, "E", 1.0)]


LEGS = [
    # Two months; a is twice as large as b, and earns 10 %; the short c earns 50 %.
    (month(2023, 1), "a", 10, 2.0, 0.1), (month(2023, 1), "b", 10, 1.0, 0.0), (month(2023, 1), "c", 1, 4.0, 0.5),
    (month(2023, 2), "a", 10, 1.0, 0.2), (month(2023, 2), "d", 1, 1.0, -0.1), (month(2023, 2), "x", 1, 0.0, 9.0), (month(2023, 2), "y", 10, 1.0, None),
    (month(2023, 4), "a", 10, 1.0, 0.0),
]


def frames(spark):
    ranked = spark.createDataFrame([(m, s, d) for m, s, d, _, _ in LEGS], "month date, symbol string, decile int")
    held = spark.createDataFrame([(m, s, r, w) for m, s, _, w, r in LEGS], "month date, symbol string, ret double, weight double")
    return ranked, held


def test_break_even_of_drifting_legs_by_hand(spark):
    legs = holdings.value_legs(*frames(spark))
    assert {(r.month.month, r.symbol): r.weight for r in legs.collect()} == pytest.approx({(1, "a"): 2 / 3, (1, "b"): 1 / 3, (1, "c"): -1.0, (2, "a"): 1.0, (2, "d"): -1.0, (4, "a"): 1.0})
    earned = {r.month.month: r.ret for r in holdings.earned(legs).collect()}
    assert earned == pytest.approx({1: 0.2 / 3 - 0.5, 2: 0.3, 4: 0.0}, abs=1e-12)
    capital = 1 + earned[1]
    traded = {(r.month.month, r.symbol): r.traded for r in holdings.trades(legs).collect()}
    want = {(2, "a"): abs(1 - 2 / 3 * 1.1 / capital), (2, "b"): 1 / 3 / capital, (2, "c"): 1.5 / capital, (2, "d"): 1.0}
    assert traded == pytest.approx(want, abs=1e-12)
    liquid = spark.createDataFrame([(month(2023, 2), "a", 500.0), (month(2023, 2), "b", 5.0)], "month date, symbol string, dollars double")
    row = holdings.realised_breakeven(legs, liquid, ((0.0, 20.0, 40.0), (100.0, 1.0, 2.0))).first()
    total = sum(want.values())
    assert row.mean_gross == pytest.approx(0.3, abs=1e-12) and row.mean_turnover == pytest.approx(total / 2, abs=1e-12)
    assert row.breakeven_bps == pytest.approx(0.3 / total * 10_000, abs=1e-9)
    assert row.low_bps == pytest.approx((want[2, "a"] + 20 * (total - want[2, "a"])) / total, abs=1e-9) and row.high_bps == pytest.approx(2 * row.low_bps, abs=1e-9)


def test_the_gate_sets_return_and_turnover_of_the_same_holdings_against_each_other(spark):
    months = [month(2023, k) for k in range(1, 7)]
    rows = [(m, s, d, w, 0.01 * (k % 3 + 1) if s == "a" else 0.0) for k, m in enumerate(months) for s, d, w in (("a", 10, 2.0), ("b" if k % 2 else "e", 10, 1.0), ("c", 1, 1.0))]
    ranked = spark.createDataFrame([r[:3] for r in rows], "month date, symbol string, decile int")
    held = spark.createDataFrame([(m, s, r, w) for m, s, _, w, r in rows], "month date, symbol string, ret double, weight double")
    cells = spark.createDataFrame([(s, m, 10.0, 1e6 if s == "a" else 1e3) for m in months for s in "abce"], "symbol string, month date, px double, volume double")
    context = Context(None, "f", 3, 0.1, surviving_sharpe=0.5, extras={"ranked": ranked})
    cheap = costs_gate(Market(held, cells, None, None, bands=((0.0, 10.0, 20.0), (1e6, 1.0, 3.0))), None, context)
    assert cheap.passed and cheap.sharpe == 0.5 < cheap.found and "10.0 to 20.0" not in cheap.detail and "are plausible for its liquidity" in cheap.detail
    dear = costs_gate(Market(held, cells, None, None, bands=((0.0, 10.0, 9000.0), (1e6, 1.0, 3.0))), None, context)
    assert not dear.passed
    row = holdings.realised_breakeven(holdings.value_legs(ranked, held)).first()
    assert f"breaks even at {row.breakeven_bps:.1f} bps" in cheap.detail


def test_a_rise_is_told_and_does_not_count(spark):
    v = Verdict("s", "f", 1, [Step("raw", True, "", 1.0), Step("orthogonalize", True, "", 1.0, 0.0, 1.4)])
    assert "found 1.40, which does not count" in v.waterfall() and v.surviving_sharpe == 1.0
    assert [r.found for r in v.frame(spark).collect()] == [None, 1.4]


def test_weights_by_signal(spark):
    scores = spark.createDataFrame([(month(2023, 1), s, x) for s, x in zip("abcd", (1.0, 2.0, 6.0, None))] + [(month(2023, 2), "a", 3.0)], "month date, symbol string, score double")
    got = {(r.month.month, r.symbol): r.weight for r in signal_weights(scores).collect()}
    assert got.pop((2, "a")) is None and got == pytest.approx({(1, "a"): -1 / 3, (1, "b"): -1 / 6, (1, "c"): 0.5})
