"""The materiality of flagged cells, and the features of the forest, against plain versions."""

import random
import statistics

from gatewright.plans import gates


def tiles(scores, n):
    """{symbol: tile} as ntile deals them."""
    order, q, r = sorted(scores, key=lambda s: (scores[s], s)), len(scores) // n, len(scores) % n
    sizes = [q + (i < r) for i in range(n)]
    return dict(zip(order, (i + 1 for i, size in enumerate(sizes) for _ in range(size))))


def test_a_flagged_cell_counts_only_if_it_changes_a_decile(spark):
    r = random.Random(2)
    rows, flags, want = [], [], {}
    for month, size in ((1, 7), (2, 23), (3, 40)):
        scores = {f"s{i:02}": float(r.randint(0, 30)) for i in range(size)}
        rows += [(month, s, x) for s, x in scores.items()]
        for s in scores:
            flagged, clean = r.random() < 0.7, r.choice([None, scores[s], scores[s] + 1, float(r.randint(0, 30))])
            flags.append((month, s, flagged, clean))
            after = tiles(scores | {s: clean}, 10).get(s) if clean is not None else None
            want[month, s] = flagged and after != tiles(scores, 10)[s]
    got = gates.material_flags(spark.createDataFrame(rows, "month int, symbol string, score double"), spark.createDataFrame(flags, "month int, symbol string, flagged boolean, clean double"))
    assert {(x.month, x.symbol): x.flagged for x in got.collect()} == want
    assert 0 < sum(want.values()) < sum(f[2] for f in flags)


def test_features_of_the_forest(spark):
    ret = [0.01, -0.02, 0.03, -0.5]
    cells = spark.createDataFrame([("a", m, x, 1.0, 2.0, 10.0 * m) for m, x in enumerate(ret, 1)], "symbol string, month int, ret double, volume double, px double, shares double")
    got = {x.month: x for x in gates.isolation_features(cells).collect()}
    assert got[1].move is None and got[1].share_change is None
    assert abs(got[4].move - 0.5 / statistics.stdev(ret[:3])) < 1e-9 and abs(got[4].share_change - 1 / 3) < 1e-9
