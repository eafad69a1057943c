import math

import numpy as np
import pytest

from tallyglass.llm import whitening as W


def brute(rows):
    """(kept rows, n, S, covariance, eigenvalues, vectors) with plain numpy."""
    good = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in good]
    fit = np.array(sorted({tuple(v) for _, v in x}))
    sums, n = fit.sum(axis=0), len(fit)
    spread = (fit - sums / n).T @ (fit - sums / n) / n
    values, vectors = np.linalg.eigh(spread)
    return x, n, sums, spread, values[::-1], vectors.T[::-1]


def random_rows(n, d, seed, mean=0.0):
    rng = np.random.default_rng(seed)
    data = (rng.standard_normal((n, d)) * np.linspace(1, 3, d) + mean).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(data)]


@pytest.mark.parametrize("mean", [0.0, 30_000.0])
def test_equals_a_dense_solver(spark, mean):
    rows = random_rows(300, 7, 3, mean)
    rows += [(900, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (901, None), (902, [1.0] * 6 + [None]), (903, [float("nan")] * 7), (904, [float("inf")] + [0.0] * 6), (905, []), (906, [1.0, 2.0])]
    schema = "vec_id long, embedding array<float>, component int, n string"
    out = W.whiten(spark.createDataFrame([(*r, 5, "x") for r in rows], schema)).toPandas()
    x, n, sums, spread, values, vectors = brute([r for r in rows if r[0] != 906])
    assert len(out) == 4 * len(x) and n == 300 and set(out["n"]) == {300}
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-9
    for k in range(4):
        part = out[out.component == k + 1]
        assert abs(part["explained"].iloc[0] / (values[k] / np.trace(spread)) - 1) < 1e-9
        want = {}
        for key, v in x:
            y = float((np.array(v) - sums / n) @ vectors[k] / math.sqrt(values[k]))
            want.setdefault(key, []).append((y, int(sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums)))))
        sign = None
        for key, got, deviation in zip(part["vec_id"], part["whitened"], part["deviation"]):
            y, exact = want[None if key != key else key][0]
            sign = sign or math.copysign(1, got * y)
            assert abs(got * sign - y) < 1e-7 and deviation == exact


def test_few_equal_and_missing_rows(spark):
    schema = "embedding long, v array<double>"
    assert W.whiten(spark.createDataFrame([], schema), "embedding", "v").columns[0] == "embedding"
    assert W.whiten(spark.createDataFrame([(1, None), (2, [])], schema), "embedding", "v").count() == 0
    one = W.whiten(spark.createDataFrame([(1, [0.5, -0.1])] * 3, schema), "embedding", "v").collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in one)
    line = W.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], schema), "embedding", "v").collect()
    assert sorted((r["component"], r["whitened"] and abs(r["whitened"]), r["explained"]) for r in line) == [(1, 1.0, 1.0), (1, 1.0, 1.0), (2, None, 0.0), (2, None, 0.0)]


def test_deviations_beyond_64_bits(spark):
    big = 1 << 50
    rows = [(1, [float(big)]), (2, [0.0]), (3, [float(-big)])]
    out = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["deviation"], r["deviation_text"]) for r in out} == {1: (None, str((3 * 256 * big) ** 2)), 2: (0, "0"), 3: (None, str((3 * 256 * big) ** 2))}


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 9, 30):
        for rank in (1, n):
            half = rng.standard_normal((n, rank))
            matrix = half @ half.T + (rng.random() < 0.5) * np.diag(rng.standard_normal(n))
            for shift in (-0.7, 0.3, 1.9):
                assert W.positive_pivots(matrix - shift * np.eye(n)) == int((np.linalg.eigvalsh(matrix) > shift).sum())


def test_close_and_equal_eigenvalues():
    rng = np.random.default_rng(6)
    turn, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    for spectrum in ([5, 5, 5, 1], [5, 5 - 1e-9, 2, 2], [1, 0, 0, 0], [3, 3, 3, 3]):
        values = np.r_[spectrum, np.zeros(8)]
        matrix = turn @ np.diag(values) @ turn.T
        matrix = (matrix + matrix.T) / 2
        pairs = W.Slicer(matrix).leading(4)
        vectors = np.array([v for _, v in pairs])
        assert np.allclose([v for v, _ in pairs], spectrum, atol=1e-12)
        assert np.allclose(vectors @ vectors.T, np.eye(4), atol=1e-10)
        assert all(np.linalg.norm(matrix @ v - e * v) < 1e-12 for e, v in pairs)
