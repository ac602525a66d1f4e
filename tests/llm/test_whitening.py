import math

import numpy as np
import pytest

from cladeflow.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n int, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 5, "x") for i, v in rows], SCHEMA)


def expected(vectors):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("dims", [3, 40])
def test_against_a_plain_decomposition(spark, dims):
    rng = np.random.default_rng(dims)
    vectors = (rng.normal(size=(700, dims)) @ np.diag(np.linspace(0.3, 3, dims)) + 2).tolist()
    vectors += vectors[:100]
    got = whitening.whiten(table(spark, enumerate(vectors)).repartition(11)).toPandas()
    x, n, s, e, v = expected(vectors)
    k = min(16, dims)
    assert len(got) == len(vectors) * k and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    got = got.sort_values(["vec_id", "component"])
    assert (got.deviation.to_numpy().reshape(-1, k)[:, 0] == ((n * x - s) ** 2).sum(axis=1)).all()
    assert np.allclose(got.explained.to_numpy()[:k], e[:k] / e.sum(), rtol=1e-9)
    want, own = (x - s / n) @ v[:, :k] / np.sqrt(e[:k]), got.whitened.to_numpy().reshape(-1, k)
    sign = np.sign((want * own).sum(axis=0))
    assert np.abs(want * sign - own).max() < 1e-7


def test_merging_loses_nothing():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, size=(300, 9))
    whole, parts = whitening.summary(x), [whitening.summary(p) for p in np.array_split(x, 13)]
    while len(parts) > 1:
        parts = [whitening.merged(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    last = parts[0]
    square = lambda m: (m.s[:, None] * m.v).T @ (m.s[:, None] * m.v)
    assert last.n == 300 and last.sums.tolist() == whole.sums.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(square(last), square(whole), rtol=1e-12, atol=1e-6)


def test_edge_cases(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 5.0]), (None, [3.0, 1.0]), (3, None), (4, [1.0, None]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, []), (8, [4.0]), (9, [3e38, 1.0, 2.0]), (10, [-3e38, 7.0, 2.0]), (11, [1.0, 1.0, 2.0])]
    got = whitening.whiten(table(spark, rows)).collect()
    two = [r for r in got if r.n == 3 and r.vec_id in (1, 2, None)]
    assert len(two) == 8 and sorted({r.component for r in two}) == [1, 2] and all(r.identity_error < 1e-9 for r in got)
    assert {r.vec_id for r in got} == {None, 1, 2, 9, 10, 11}  # one distinct vector has no components
    assert all(r.deviation is None for r in got if r.vec_id in (9, 10)) and all(r.explained > 0 for r in got)
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None)])).count() == 0
