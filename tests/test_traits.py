"""Traits and factor legs against loops over plain rows."""

import math
import random
from datetime import date

import pytest

from gatewright.operators.traits import built_factors, traits


def months(n, start=2020):
    return [date(start + k // 12, k % 12 + 1, 1) for k in range(n)]


def test_momentum_skips_a_month_and_counts_months_not_rows(spark):
    m = months(30)
    r = random.Random(2)
    rets = {"a": {k: r.uniform(-0.2, 0.3) for k in range(30)}, "b": {k: r.uniform(-0.2, 0.3) for k in range(30) if k % 3}, "c": {k: -1.0 if k == 5 else 0.01 for k in range(30)}, "d": {k: None if k % 4 else 0.1 for k in range(30)}}
    rows = [(m[k], s, 2.0, 5.0, x) for s, own in rets.items() for k, x in own.items()]
    got = {(x.symbol, x.month): x for x in traits(spark.createDataFrame(rows, "month date, symbol string, px double, shares double, ret double")).collect()}
    for s, own in rets.items():
        for k in own:
            known = [own[j] for j in range(k - 11, k) if own.get(j) is not None]
            want = math.prod(1 + x for x in known) - 1 if len(known) >= 8 else None
            assert got[s, m[k]].mom == (None if want is None else pytest.approx(want, abs=1e-12)), (s, k)
            assert got[s, m[k]].str == own[k] and got[s, m[k]].size == pytest.approx(math.log(10)) and got[s, m[k]].value is None


def test_value_uses_the_last_book_equity_known(spark):
    m = months(5)
    cells = spark.createDataFrame([(x, "a", 4.0 if k else 0.0, 5.0, 0.0) for k, x in enumerate(m)], "month date, symbol string, px double, shares double, ret double")
    book = spark.createDataFrame([(m[0], "a", 10.0), (m[2], "a", None), (m[3], "a", 40.0), (date(2020, 4, 20), "a", -1.0), (m[0], "z", 1.0)], "month date, symbol string, equity double")
    got = [x.value for x in traits(cells, book).orderBy("month").collect()]
    assert got == [None, pytest.approx(math.log(0.5)), pytest.approx(math.log(0.5)), pytest.approx(math.log(2)), None], "a negative equity supersedes, and has no logarithm"


def tiles(rows, n):
    """ntile: the first len % n parts have one more."""
    q, extra = divmod(len(rows), n)
    out = {}
    for i, s in enumerate(rows):
        out[s] = i // (q + 1) + 1 if i < extra * (q + 1) else extra + (i - extra * (q + 1)) // q + 1
    return out


def test_factors_equal_a_plain_sort(spark):
    r = random.Random(5)
    rows = [(m, f"s{k:02}", r.choice([5.0, 7.0, 40.0, None]) if k % 9 == 0 else r.uniform(1, 100), None if r.random() < 0.05 else r.gauss(0, 0.1), r.gauss(0, 1), r.choice([1.0, 2.0, None])) for m in months(4) for k in range(23)]
    got = {x.month: x for x in built_factors(spark.createDataFrame(rows, "month date, symbol string, cap double, ret double, value double, str double"), {"hml": "value", "rev": "str"}, "value").collect()}
    mean = lambda xs: sum(xs) / len(xs)
    for m in months(4):
        own = [x for x in rows if x[0] == m and x[2] and x[3] is not None]
        by_cap = lambda xs: sum(x[2] * x[3] for x in xs) / sum(x[2] for x in xs)
        assert got[m].mkt == pytest.approx(by_cap(own))
        for name, at in (("hml", 4), ("rev", 5)):
            able = [x for x in own if x[at] is not None]
            half = tiles([x[1] for x in sorted(able, key=lambda x: (x[2], x[1]))], 2)
            part = tiles([x[1] for x in sorted(able, key=lambda x: (x[at], x[1]))], 10)
            cell = lambda h, low, high: [x for x in able if half[x[1]] == h and low <= part[x[1]] <= high]  # noqa: E731, B023
            side = lambda low, high: mean([by_cap(c) for h in (1, 2) if (c := cell(h, low, high))])  # noqa: E731, B023
            assert got[m][name] == pytest.approx(side(8, 10) - side(1, 3), abs=1e-12)
            if name == "hml":
                each = [mean([by_cap(c) for low, high in ((1, 3), (4, 7), (8, 10)) if (c := cell(h, low, high))]) for h in (1, 2)]
                assert got[m].smb == pytest.approx(each[0] - each[1], abs=1e-12)


def test_factors_read_their_cells_once(spark):
    given = spark.range(50).selectExpr("DATE'2020-01-01' AS month", "CAST(id AS STRING) AS symbol", "id + 1.0D AS cap", "id / 100 AS ret", "-id + 0.0D AS value", "id % 7 + 0.0D AS str")
    out = built_factors(given, {"hml": "value", "rev": "str", "again": "value"}, "value")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    row = out.first()
    assert out.columns == ["month", "mkt", "smb", "hml", "rev", "again"] and row.hml == row.again and row.hml < 0
