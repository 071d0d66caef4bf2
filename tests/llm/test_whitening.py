"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest

from gatewright.llm.whitening import deviations, fit_whitening, lanczos, whiten

SF = "/root/testdata/sf0.001"


def plain(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    v = c.T @ c / n
    values, found = np.linalg.eigh(v)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, dev, values[::-1], c @ found[:, ::-1], np.trace(v)


def held(rows, vectors):
    """Rows of whiten() against plain(), in order of vec_id."""
    n, dev, values, z, trace = plain(vectors)
    k = min(8, len(values))
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    for j in range(k):
        own = [r for r in rows if r.component == j + 1]
        got, want = np.array([r.whitened for r in own]), z[:, j] / np.sqrt(values[j])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert [int(r.deviation) for r in own] == dev and own[0].explained == pytest.approx(values[j] / trace, rel=1e-10)
        assert max(r.identity_error for r in own) < 1e-10


def test_query_equals_a_dense_one(spark):
    from gatewright.llm.queries import QUERIES

    given = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    got = QUERIES["op13_whitening"](spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint"
    held(got.orderBy("vec_id", "component").collect(), [r.embedding for r in given])


def test_rows_that_do_not_count(spark):
    r = np.random.default_rng(3)
    good = (r.normal(size=(60, 5)) * [9, 5, 3, 2, 1]).astype(np.float32).tolist()
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [math.nan, 0.0, 0.0, 0.0, 0.0], [0.0, math.inf, 0.0, 0.0, 0.0], [1.0, 2.0], [], [1e30, 0.0, 0.0, 0.0, 0.0]]
    rows = [(i, v, "x", 1) for i, v in enumerate(good)] + [(100 + i, v, None, 2) for i, v in enumerate(bad)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, component long")
    held(whiten(given, fit_whitening(given)).orderBy("vec_id", "component").collect(), good)
    twice = given.where("vec_id < 60").unionByName(given.where("vec_id < 60").selectExpr("CAST(NULL AS LONG) AS vec_id", "embedding", "n", "component"))
    got = whiten(twice, fit_whitening(twice)).collect()
    assert len(got) == 120 * 5 and sum(r.vec_id is None for r in got) == 300


def test_tables_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        given = spark.createDataFrame(rows, kind)
        assert whiten(given, fit_whitening(given)).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(5)], kind)
    got = whiten(line, fit_whitening(line)).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)
    assert sorted(abs(r.whitened) for r in got) == pytest.approx(sorted(abs(i - 2) / math.sqrt(2) for i in range(5)))


@pytest.mark.parametrize("spectrum", [[1.0] * 40, [5.0, 5.0, 5.0, 1.0] + [0.0] * 36, [0.0] * 40, [0.9**i for i in range(40)], [10.0**-i for i in range(40)], [3.0, 2.0]])
def test_lanczos_breakdowns_and_clusters(spectrum):
    d = len(spectrum)
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(d, d)))
    m = (q * spectrum) @ q.T
    values, vectors, told = lanczos(lambda b: m @ b, d, min(8, d), min(12, d))
    assert values == pytest.approx(sorted(spectrum, reverse=True)[:8], abs=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12 and np.abs(m @ vectors - vectors * values).max() < 1e-12
    assert told["passes"] <= -(-d // 12) + 1


def test_wide_vectors_stop_before_the_basis_is_full():
    d = 400
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(d, d)))
    m = (q * np.r_[np.arange(30, 10, -1.0), np.ones(d - 20)]) @ q.T
    values, vectors, told = lanczos(lambda b: m @ b, d, 8, 12)
    assert told["passes"] < 30 and np.abs(m @ vectors - vectors * values).max() < 1e-11


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[10**9, -(10**9)], [5, 7]], np.int64)
    n, s = 10**10, np.array([3 * 10**10 + 7, -1], np.int64)
    assert [int(v) for v in deviations(x, n, s)] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
