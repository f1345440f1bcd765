"""Whitening against a dense eigenvalue solver."""

import math

import numpy as np
import pytest

from sigweave.llm import whitening as w

ODD = "vec_id long, embedding array<float>, component string, n string, place int, extra string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "c", "n", 3, "e") for i, v in vectors], ODD)


def plain(vectors, most=32):
    """x, S and the leading pairs of the covariance, from the rows themselves."""
    rows = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    y = np.array([[float(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, turn = np.linalg.eigh(y.T @ y / n)
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return rows, n, deviations, y, values[::-1][:most], turn[:, ::-1][:, :most], values.sum()


def check(spark, vectors, solver=w.Solver(), components=32):
    rows, n, deviations, y, values, turn, trace = plain(vectors, components)
    got = w.whitened(frame(spark, vectors), solver=solver).toPandas()
    k = int((values > 1e-12 * trace).sum())
    assert len(got) == len(rows) * k and list(got.columns) == ["vec_id", "place", "extra", *w.RESULT]
    assert set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    want = (y @ turn / np.sqrt(np.maximum(values, 1e-300)))[:, :k]
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-7
    share = got.drop_duplicates("component").set_index("component").explained
    assert np.allclose([share[i + 1] for i in range(k)], values[:k] / trace, rtol=1e-9)
    exact = got.drop_duplicates("vec_id").set_index("vec_id").deviation
    assert [exact[i] for i, _ in rows] == deviations


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(400, 64)) * np.linspace(1, 3, 64)).astype(np.float32))]
    vectors += [(1000, None), (1001, [None] * 64), (1002, [float("nan")] * 64), (1003, [1.0] * 63 + [float("inf")]), (1004, [])]
    check(spark, vectors)


def test_fewer_dimensions_than_components_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 5)).astype(np.float32))]
    check(spark, vectors + [(100 + i, vectors[0][1]) for i in range(30)])


def test_dependent_dimensions_have_no_component(spark):
    rng = np.random.default_rng(3)
    few = np.round(rng.normal(size=(80, 6)) * 4)
    check(spark, [(i, v.tolist()) for i, v in enumerate(np.concatenate([few, few, -few], axis=1).astype(np.float32))])


@pytest.mark.parametrize("guards", [2, 8])
def test_a_narrow_block_with_close_eigenvalues(spark, guards):
    rng = np.random.default_rng(4)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 24)).astype(np.float32))]
    check(spark, vectors, w.Solver(components=4, guards=guards), components=4)


def test_odd_tables(spark):
    assert w.whitened(frame(spark, [])).count() == 0
    assert w.whitened(frame(spark, [(1, None), (2, [])])).count() == 0
    assert w.whitened(frame(spark, [(i, [0.5, 0.5]) for i in range(4)])).count() == 0
    odd = w.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.0, 0.0]), (4, [1.0, 1.0, 1.0]), (5, [1e30, 0.0])]))
    rows = odd.collect()
    assert {r.vec_id for r in rows} == {1, 2, None} and {r.component for r in rows} == {1, 2} and rows[0].n == 3


def test_residuals_that_stay_are_told(spark):
    rng = np.random.default_rng(5)
    rows = w.quantised(frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 12)).astype(np.float32))]), "embedding")
    with pytest.raises(w.NotCertified):
        w.fit(rows, w.Solver(components=3, guards=1, rounds=1))


def test_deviations_beyond_a_long_are_null():
    x = np.array([[0, 0], [10**9, 5]])
    assert w._deviations(x, 2, [10**9, 5]) == [10**18 + 25, 10**18 + 25]
    assert w._deviations(x, 10**6, [10**15, 0])[0] is None
