"""Vector autoregressions against plain least squares."""

from __future__ import annotations

import numpy as np
import pytest

from brindle.operators import stats, var


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    out = {}
    for key in ("p", "q"):
        y = np.zeros((200, 3))
        for t in range(2, 200):
            y[t] = 0.4 * y[t - 1] + 0.2 * y[t - 2, [1, 2, 0]] * (key == "p") + rng.normal(size=3) + 3
        out[key] = y
    return out


def plain(y, p, top):
    """Residuals, coefficients and regressors by least squares, on the rows with `top` earlier ones."""
    x = np.column_stack([np.ones(len(y) - top)] + [y[top - k : len(y) - k] for k in range(1, p + 1)])
    b = np.linalg.lstsq(x, y[top:], rcond=None)[0]
    return y[top:] - x @ b, b, x


def frame(spark, series):
    rows = [(k, t, *map(float, r)) for k, y in series.items() for t, r in enumerate(y)]
    return spark.createDataFrame(rows, "key string, t int, a double, b double, c double").repartition(5)


def test_criteria(spark, series):
    got = {(r.key, r.lag): r for r in var.lag_criteria(frame(spark, series), ["a", "b", "c"], "t", ["key"], 4).collect()}
    assert len(got) == 8
    for (key, p), r in got.items():
        e, b, _ = plain(series[key], p, 4)
        n = len(e)
        det = np.linalg.slogdet(e.T @ e / n)[1]
        assert r.n == n == 196
        assert np.isclose(r.aic, det + 2 * b.size / n) and np.isclose(r.bic, det + np.log(n) * b.size / n) and np.isclose(r.hq, det + 2 * np.log(np.log(n)) * b.size / n)
        assert np.isclose(r.fpe, ((n + 3 * p + 1) / (n - 3 * p - 1)) ** 3 * np.exp(det))


@pytest.mark.parametrize("criterion", ["aic", "bic"])
def test_causality(spark, series, criterion):
    order = {r.key: [] for r in var.lag_criteria(frame(spark, series), ["a", "b", "c"], "t", ["key"], 4).collect()}
    for r in var.lag_criteria(frame(spark, series), ["a", "b", "c"], "t", ["key"], 4).collect():
        order[r.key].append((r[criterion], r.lag))
    got = var.causality(frame(spark, series), ["a", "b", "c"], "t", ["key"], 4, criterion).collect()
    assert len(got) == 6
    for r in got:
        assert r.lag == min(order[r.key])[1]
        e, b, x = plain(series[r.key], r.lag, 4)
        n, cause = len(e), "abc".index(r.cause)
        others, rows = [j for j in range(3) if j != cause], [1 + 3 * k + cause for k in range(r.lag)]
        s = (e.T @ e)[np.ix_(others, others)] / (n - 3 * r.lag - 1)
        inverse = np.linalg.inv(x.T @ x)[np.ix_(rows, rows)]
        c = np.concatenate([b[rows, j] for j in others])
        assert np.isclose(r.f, c @ np.linalg.solve(np.kron(s, inverse), c) / len(c)) and (r.d1, r.d2) == (len(c), 3 * (n - 3 * r.lag - 1))
        assert np.isclose(r.p_value, stats.f_upper(r.f, r.d1, r.d2))
        s = e.T @ e / n
        v = s[cause, cause] * s[np.ix_(others, others)] + np.outer(s[cause, others], s[cause, others])
        assert np.isclose(r.instant, n * s[cause, others] @ np.linalg.solve(v, s[cause, others]))
    for cause in "abc":
        own = [r for r in got if r.cause == cause]
        assert np.allclose([r.p_adjusted for r in own], stats.adjust_p([r.p_value for r in own]))

    assert min(r.p_value for r in got if r.key == "p") < 0.05


def test_short_and_odd_systems(spark):
    rows = [("few", t, float(t % 3), 1.0) for t in range(4)] + [("flat", t, 1.0, float(t % 5)) for t in range(30)] + [("holes", t, None if t % 2 else 1.0, 2.0) for t in range(30)]
    df = spark.createDataFrame(rows, "key string, t int, a double, b double")
    out = {(r.key, r.cause): r for r in var.causality(df, ["a", "b"], "t", ["key"], 2).collect()}
    assert {k for k, _ in out} == {"flat"} and var.causality(df.limit(0), ["a", "b"], "t", ["key"], 2).count() == 0
    with pytest.raises(ValueError):
        var.causality(df, ["a", "b"], "t", ["key"], 2, "r2")


@pytest.mark.parametrize("how", ["BH", "bonferroni"])
def test_adjusted(spark, how):
    p = [0.01, 0.04, 0.04, 0.2, 0.9, 0.03]
    df = spark.createDataFrame([("g", x) for x in p] + [("h", 0.5)], "g string, p double")
    got = sorted((r.p, r.q) for r in var.with_adjusted(df, "p", "q", ["g"], how).filter("g = 'g'").collect())
    assert np.allclose([q for _, q in got], [q for _, q in sorted(zip(p, stats.adjust_p(p, how), strict=True))])
