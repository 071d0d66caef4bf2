import json
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.operators.lazy_prices import Signal
from gatewright.plans import gates, runlog
from gatewright.plans.ledger import BrokenChain, Ledger, TooFewTrials, Trial, canonical, check_chain, hash_of, link_check, read_ledger, trial_counts
from gatewright.plans.verdict import GATE_ORDER, Context, MissingGate, Step, Verdict, fold, give_ups, run_gauntlet


def trial(family="f", n=0):
    return Trial(family, "s", {"n": n}, "u", "2020", "2021", recorded_at="t")


@pytest.fixture
def ledger(tmp_path):
    return Ledger(tmp_path / "ledger.jsonl")


def test_outcomes_are_not_trials(ledger):
    for i in range(3):
        ledger.complete(ledger.record(trial(n=i)), {"sharpe": float(i)})
    assert ledger.n_trials("f") == 3 and len(ledger.entries()) == 6
    assert ledger.sharpe_variance("f") == pytest.approx(1.0)


def test_abandoned_trials_count(ledger):
    ledger.record(trial(n=1))
    ledger.complete(ledger.record(trial(n=2)), {"sharpe": None})
    assert ledger.n_trials("f") == 2 and ledger.sharpes("f") == []


def test_variance_refuses_one_trial_and_families_are_apart(ledger):
    ledger.complete(ledger.record(trial("a")), {"sharpe": 1.0})
    ledger.record(trial("b"))
    assert ledger.n_trials("a") == ledger.n_trials("b") == 1
    with pytest.raises(TooFewTrials):
        ledger.sharpe_variance("a")


def test_the_latest_outcome_counts_once(ledger):
    i, j = ledger.record(trial(n=1)), ledger.record(trial(n=2))
    for k, v in ((i, 1.0), (j, 3.0), (i, 5.0)):
        ledger.complete(k, {"sharpe": v})
    assert sorted(ledger.sharpes("f")) == [3.0, 5.0]
    with pytest.raises(IndexError):
        ledger.complete(2, {})


def edited(ledger, change):
    entries = ledger.entries()
    change(entries)
    ledger.path.write_text("".join(canonical(e) + "\n" for e in entries))


@pytest.mark.parametrize(
    "change, at",
    [
        (lambda e: e[3]["trial"].update(note="x"), 3),
        (lambda e: e[5]["trial"].update(note="x"), 5),  # the last
        (lambda e: e.pop(), 5),  # a cut tail
        (lambda e: e.pop(2), 2),
        (lambda e: e.insert(0, e.pop(1)), 0),
    ],
)
def test_every_change_is_found(ledger, change, at):
    for i in range(6):
        ledger.record(trial(n=i))
    edited(ledger, change)
    with pytest.raises(BrokenChain, match=f"index {at}"):
        ledger.verify()
    with pytest.raises(BrokenChain):
        ledger.record(trial())


def test_a_rehashed_entry_breaks_the_next_link(ledger):
    for i in range(6):
        ledger.record(trial(n=i))

    def forge(e):
        e[3]["trial"]["note"] = "x"
        e[3]["entry_hash"] = hash_of(e[3])

    edited(ledger, forge)
    with pytest.raises(BrokenChain, match="index 4"):
        ledger.verify()


def test_appends_read_nothing_again_while_nothing_else_writes(ledger, monkeypatch):
    """Reads and hashes of a thousand appends, by count; another writer and a change of old bytes are both seen."""
    from gatewright.plans import ledger as module

    hashed, read = [], []
    plain, entries = module.hash_of, Ledger.entries
    monkeypatch.setattr(module, "hash_of", lambda e: hashed.append(1) or plain(e))
    monkeypatch.setattr(Ledger, "entries", lambda self: read.append(1) or entries(self))
    for i in range(500):
        k = ledger.record(trial(n=i))
        ledger.complete(k, {"sharpe": float(i)})
    assert len(hashed) == 1000 and len(read) <= 2
    other = Ledger(ledger.path)
    assert other.complete(0, {"sharpe": 1.0}) == 1000 and ledger.record(trial()) == 1001 and other.record(trial()) == 1002
    assert len(ledger.verify()) == 1003
    text = ledger.path.read_text()
    ledger.path.write_text(text.replace('"sharpe":41.0', '"sharpe":91.0'))
    with pytest.raises(BrokenChain, match="index 83"):
        ledger.record(trial())
    ledger.path.write_text(text)
    assert ledger.record(trial()) == 1003
    with pytest.raises(IndexError):
        ledger.complete(1000, {})


def test_ledger_as_a_table(spark, ledger):
    for i in range(3):
        ledger.complete(ledger.record(trial(n=i)), {"sharpe": float(i)})
    df = ledger.frame(spark)
    assert df.count() == 6
    flat = df.select("index", F.col("trial.family").alias("family"), "amends", F.get_json_object("outcome", "$.sharpe").cast("double").alias("sharpe"))
    assert tuple(trial_counts(flat).first()) == ("f", 3, 3, pytest.approx(1.0))
    assert tuple(link_check(df, F.col("entry_hash")).first()) == (6, None)
    assert tuple(link_check(df.withColumn("prev_hash", F.when(F.col("index") == 4, "x").otherwise(F.col("prev_hash"))), F.col("entry_hash")).first()) == (6, 4)
    assert sorted(map(str, read_ledger(spark, str(ledger.path)).select("index", "amends", "outcome", "trial.params", "entry_hash").collect())) == sorted(
        map(str, df.select("index", "amends", "outcome", "trial.params", "entry_hash").collect())
    )
    assert trial().fingerprint() == trial().fingerprint() != trial(n=1).fingerprint()
    check_chain([])


def passing(sharpes):
    return {g: (lambda panel, signal, context, g=g: Step(g, True, "fine", sharpes.get(g))) for g in GATE_ORDER}


def test_a_missing_gate_is_fatal_and_the_trial_counts(ledger):
    with pytest.raises(MissingGate, match="pit"):
        run_gauntlet("s", trial(), None, None, {}, ledger)
    assert ledger.n_trials("f") == 1


def test_gauntlet_passes_in_order(spark, ledger):
    v = run_gauntlet("s", trial(), None, None, passing({"raw": 1.5, "orthogonalize": 1.0, "costs": 0.4}), ledger)
    assert v.survives and [s.gate for s in v.steps] == list(GATE_ORDER) and v.headline_sharpe == 1.5 and v.surviving_sharpe == 0.4
    assert [s.give_up for s in v.steps if s.give_up is not None] == [pytest.approx(-0.5), pytest.approx(-0.6)]
    text = v.waterfall()
    assert "N=1 (from the ledger)" in text and "(-0.50)" in text and text.endswith("survives")
    assert ledger.entries()[1]["outcome"] == {"sharpe": 1.5, "surviving_sharpe": 0.4, "survives": True, "died_at": None}
    steps = v.frame(spark).withColumn("k", F.lit(1))
    assert tuple(fold(steps, "k").first()) == (1, True, None, 1.5, 0.4)
    assert [r.give_up for r in give_ups(steps.drop("give_up"), "k").orderBy("ordinal").collect()][3] == pytest.approx(-0.5)


def test_gauntlet_stops_where_it_fails(ledger):
    early = passing({"raw": 1.0}) | {"pit": lambda *a: Step("pit", False, "late")}
    v = run_gauntlet("s", trial(), None, None, early, ledger)
    assert (v.died_at, len(v.steps), v.headline_sharpe) == ("pit", 1, None) and "DIED" in v.waterfall() and "killed at pit" in v.waterfall()
    late = passing({"raw": 1.0}) | {"costs": lambda *a: Step("costs", False, "dear", 0.2)}
    v = run_gauntlet("s", trial(), None, None, late, ledger)
    assert (v.died_at, v.surviving_sharpe, v.n_trials) == ("costs", 1.0, 2)
    assert not Verdict("s", "f", 0).survives


def test_a_gate_may_not_raise_the_ratio(ledger):
    with pytest.raises(ValueError, match="raised"):
        run_gauntlet("s", trial(), None, None, passing({"raw": 1.0, "costs": 2.0}), ledger)


def test_pit_gate_names_both_counts(spark):
    df = spark.createDataFrame([(date(2022, 12, 31), "2023-02-15 21:50:00")], "signal_date date, a string").withColumn("acceptance_datetime", F.to_timestamp("a"))
    step = gates.pit_gate(None, Signal(df), None)
    assert not step.passed and "1 of 1" in step.detail and "1 before publication" in step.detail
    assert gates.pit_gate(None, Signal(df.limit(0)), None).passed


def test_deflated_sharpe(spark, ledger):
    assert gates.expected_best(10, 0.04) == pytest.approx(0.2 * 1.57464, abs=1e-3)
    assert gates.probabilistic_sharpe(0.1, 0.0, 101, 0.0, 3.0) == pytest.approx(gates.NORMAL.cdf(1 / np.sqrt(1.005)))
    rng = random.Random(1)
    series = spark.createDataFrame([(rng.gauss(0.02, 0.01),) for _ in range(100)], "ret double")
    with pytest.raises(gates.Refused):
        gates.dsr_gate(series, "ret", Context(ledger, "f", 1, None))
    step = gates.dsr_gate(series, "ret", Context(ledger, "f", 5, 0.1))
    assert step.passed and step.sharpe > 3


def test_regression_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, e = rng.normal(size=200), rng.normal(size=200)
    y = 0.1 + 0.5 * x + e
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "date int, x double, y double")
    got = gates.hac_regression(df, "y", ["x"], lags=4)
    z = np.column_stack([np.ones(200), x])
    inv = np.linalg.inv(z.T @ z)
    beta = inv @ z.T @ y
    u = z * (y - z @ beta)[:, None]
    s = u.T @ u + sum((1 - k / 5) * (u[k:].T @ u[:-k] + u[:-k].T @ u[k:]) for k in range(1, 5))
    error = np.sqrt(np.diag(inv @ s @ inv))
    for i, name in enumerate(("alpha", "x")):
        assert got[name][:2] == (pytest.approx(beta[i]), pytest.approx(error[i]))
    with pytest.raises(gates.Refused):
        gates.hac_regression(df.limit(2), "y", ["x"])


def test_spreads_and_costs(spark):
    m = [date(2023, k, 1) for k in (1, 2, 3)]
    scores = spark.createDataFrame([(m[0], f"s{i:02}", float(i)) for i in range(20)], "month date, symbol string, score double")
    ranked = gates.deciles(scores)
    assert {r.symbol for r in ranked.where("decile = 10").collect()} == {"s18", "s19"}
    held = spark.createDataFrame([(m[0], f"s{i:02}", i / 100, float(i + 1)) for i in range(20)], "month date, symbol string, ret double, weight double")
    r = gates.long_short(ranked, held).first()
    assert r.ew == pytest.approx(0.185 - 0.005) and r.vw == pytest.approx((0.18 * 19 + 0.19 * 20) / 39 - 0.01 * 2 / 3)
    w = spark.createDataFrame([(m[0], "a", 1.0), (m[0], "b", -1.0), (m[1], "a", 1.0), (m[1], "c", -1.0)], "month date, symbol string, weight double")
    assert [tuple(x) for x in gates.turnover(w).collect()] == [(m[1], 1.0)]
    b = gates.breakeven(spark.createDataFrame([(0.01,)], "ret double"), gates.turnover(w)).first()
    assert b.breakeven_bps == pytest.approx(50.0)
    last = gates.month_end_scores(spark.createDataFrame([(date(2023, 1, 5), "a", 1.0), (date(2023, 1, 25), "a", 2.0), (None, "a", 9.0)], "signal_date date, symbol string, score double"))
    assert [tuple(x) for x in last.collect()] == [("a", m[0], 2.0)]
    neutral = gates.sector_neutral(spark.createDataFrame([(m[0], "a", 1.0, "x"), (m[0], "b", 3.0, "x"), (m[0], "c", 9.0, "y")], "month date, symbol string, score double, sector string"))
    assert {r.symbol: r.score for r in neutral.collect()} == {"a": -1.0, "b": 1.0, "c": 0.0}
    line = spark.createDataFrame([(m[0], f"s{i}", 2.0 * i + 1, float(i)) for i in range(6)], "month date, symbol string, score double, size double")
    assert all(abs(r.score) < 1e-9 for r in gates.neutralised(line, ["size"]).collect())
    assert gates.sharpe(spark.createDataFrame([(0.01,), (0.03,)], "r double"), "r").first()[0] == pytest.approx(0.02 / np.std([0.01, 0.03], ddof=1) * 12**0.5)


def test_overfitting(spark):
    rng = np.random.default_rng(5)
    noise = [(c, b, float(rng.normal())) for c in range(6) for b in range(4) for _ in range(5)]
    df = spark.createDataFrame(noise, "config int, block int, ret double")
    splits = gates.pbo_splits(df, 4)
    assert splits.count() == 6
    best = {r.mask: r for r in splits.collect()}
    x = {(c, b): [v for k, j, v in noise if (k, j) == (c, b)] for c in range(6) for b in range(4)}
    ratio = lambda c, bs: np.mean(np.concatenate([x[c, b] for b in bs])) / np.std(np.concatenate([x[c, b] for b in bs]), ddof=1)
    for mask, r in best.items():
        inside, outside = [b for b in range(4) if mask >> b & 1], [b for b in range(4) if not mask >> b & 1]
        win = max(range(6), key=lambda c: ratio(c, inside))
        assert r.config == win and r.oos_rank == pytest.approx(sum(ratio(c, outside) < ratio(win, outside) for c in range(6)) / 5)
    skilled = df.withColumn("ret", F.col("ret") + F.when(F.col("config") == 3, 9.0).otherwise(0.0))
    assert gates.pbo(gates.pbo_splits(skilled, 4)).first().pbo == 0.0


def test_integrity(spark):
    px = [10.0, 5.0, 5.0, 5.0, 5.0, 6.0]
    df = spark.createDataFrame([("A", date(2023, 1, i + 1), p, 0.0 if i == 5 else 9.0) for i, p in enumerate(px)], "symbol string, date date, px double, volume double")
    got = gates.integrity_rules(df, stale_rows=4).orderBy("date").collect()
    assert [r.split_tick for r in got] == [False, True, False, False, False, False]
    assert [r.stale for r in got] == [False, True, True, True, True, False] and [r.odd_volume for r in got] == [False] * 5 + [True]
    rng = np.random.default_rng(0)
    cells = spark.createDataFrame([(i, float(v), None if i == 3 else float(rng.normal())) for i, v in enumerate([*rng.normal(size=200), 40.0])], "k int, a double, b double")
    top = gates.isolation_forest(cells, ["a", "b"], ["k"]).orderBy(F.desc("anomaly")).first()
    assert top.k == 200 and 0.5 < top.anomaly <= 1
    w = spark.createDataFrame([(1, "a", 3.0), (1, "b", -1.0)], "date int, symbol string, weight double")
    assert gates.flagged_exposure(w, spark.createDataFrame([(1, "b", True)], "date int, symbol string, flagged boolean")).first()[0] == 0.25


def test_run_log(spark, tmp_path):
    with runlog.run("good", tmp_path, top=3) as r:
        print("hello")
        r["outputs"].append("x.md")
        r["notes"].append("fine")
    meta = json.loads((r.folder / "meta.json").read_text())
    assert meta["status"] == "ok" and meta["params"] == {"top": 3} and meta["outputs"] == ["x.md"] and (r.folder / "stdout.log").read_text() == "hello\n"
    with pytest.raises(KeyError), runlog.run("bad", tmp_path) as r:
        raise KeyError("no")
    assert "KeyError" in json.loads((r.folder / "meta.json").read_text())["traceback"]
    assert [json.loads(x)["status"] for x in (tmp_path / "index.jsonl").read_text().splitlines()] == ["ok", "failed"]
