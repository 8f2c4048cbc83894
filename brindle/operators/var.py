"""Vector autoregressions of many small systems: lag moments summed by Spark, one row a system, and solved in tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T, Window

from brindle.operators.stats import chi2_upper, complete, f_upper

CRITERIA = ("aic", "hq", "bic", "fpe")


def lag_moments(df: DataFrame, names: Sequence[str], order: str, by: Sequence[str], max_lag: int) -> DataFrame:
    """by, n and moments: of each system, the sums of products of all values at lags 0 to max_lag, about their means.

    Rows are those with max_lag earlier ones and no missing value among all of these. moments is the upper triangle, row by
    row, of the matrix over lag 0 of all names, then lag 1 and so on. A system's rows pass through one task in order.
    """
    w = Window.partitionBy(*by).orderBy(order)
    z = [f"__z{lag}_{k}" for lag in range(max_lag + 1) for k in range(len(names))]
    lagged = df.select(*by, order, *(F.lag(F.col(n).cast("double"), lag).over(w).alias(f"__z{lag}_{k}") for lag in range(max_lag + 1) for k, n in enumerate(names)))
    used = complete(lagged, z)
    of_system = Window.partitionBy(*by)
    used = used.select(*by, *((F.col(c) - F.avg(c).over(of_system)).alias(c) for c in z))
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(z) for b in z[i:]]
    return used.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("moments"))


def _matrix(moments, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = np.array(moments, float)
    return np.maximum(out, out.T) if size == 1 else out + np.triu(out, 1).T


def fitted(m: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (k p by k), cross products of the residuals (k by k) and the inverse moments of the lags, of order p."""
    yy, xy, xx = m[:k, :k], m[k : k * (p + 1), :k], m[k : k * (p + 1), k : k * (p + 1)]
    inverse = np.linalg.pinv(xx) if p else np.zeros((0, 0))
    b = inverse @ xy
    return b, yy - xy.T @ b, inverse


def criteria(m: np.ndarray, k: int, n: int, p: int) -> dict[str, float]:
    """Of one order with a constant: Akaike, Hannan-Quinn, Schwarz and final prediction error."""
    det = math.log(max(np.linalg.det(fitted(m, k, p)[1] / n), 1e-300))
    size = k * (k * p + 1)
    per = k * p + 1
    return {
        "aic": det + 2 * size / n, "hq": det + 2 * math.log(math.log(n)) * size / n, "bic": det + math.log(n) * size / n,
        "fpe": ((n + per) / (n - per)) ** k * math.exp(det) if n > per else math.inf,
    }


def exclusion(m: np.ndarray, k: int, n: int, p: int, cause: int) -> tuple[float, int, int]:
    """F and its degrees of freedom: whether the lags of one variable have no part in the equations of the others."""
    b, rss, inverse = fitted(m, k, p)
    others = [j for j in range(k) if j != cause]
    rows = [lag * k + cause for lag in range(p)]
    sigma = (rss / (n - k * p - 1))[np.ix_(others, others)]
    v = np.kron(sigma, inverse[np.ix_(rows, rows)])
    c = b[np.ix_(rows, others)].T.ravel()
    d1 = len(c)
    return float(c @ np.linalg.pinv(v) @ c) / d1, d1, k * (n - k * p - 1)


def instantaneous(m: np.ndarray, k: int, n: int, p: int, cause: int) -> tuple[float, int]:
    """Chi-squared and its degrees of freedom: whether the residuals of one variable have no covariance with the others'."""
    s = fitted(m, k, p)[1] / n
    others = [j for j in range(k) if j != cause]
    c = s[cause, others]
    v = s[cause, cause] * s[np.ix_(others, others)] + np.outer(c, c)
    return float(n * c @ np.linalg.pinv(v) @ c), len(others)


def _solved(df: DataFrame, names: Sequence[str], order: str, by: Sequence[str], max_lag: int, columns: str, rows) -> DataFrame:
    k, by = len(names), list(by)
    schema = T.StructType([*(df.schema[b] for b in by), *T._parse_datatype_string(columns).fields])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(*key, *row) for *key, n, m in zip(*(f[b] for b in by), f["n"], f["moments"], strict=True) for row in rows(_matrix(m, k * (max_lag + 1)), int(n))]
            yield pd.DataFrame(found, columns=schema.names)

    return lag_moments(df, names, order, by, max_lag).mapInPandas(solve, schema)


def lag_criteria(df: DataFrame, names: Sequence[str], order: str, by: Sequence[str], max_lag: int) -> DataFrame:
    """by, lag (1 to max_lag), n, aic, hq, bic, fpe. All orders are fitted on the same rows; orders of no degree of freedom are left out."""
    k = len(names)

    def rows(m: np.ndarray, n: int):
        for p in range(1, max_lag + 1):
            if n > k * p + 1:
                yield p, n, *criteria(m, k, n, p).values()

    return _solved(df, names, order, by, max_lag, "lag int, n long, " + ", ".join(f"{c} double" for c in CRITERIA), rows)


def causality(df: DataFrame, names: Sequence[str], order: str, by: Sequence[str], max_lag: int = 4, criterion: str = "aic", adjust: str = "BH") -> DataFrame:
    """by, cause, lag, n, f, d1, d2, p_value, p_adjusted, instant, instant_p: Granger's test of each variable as the cause of all others.

    The order is that of the smallest criterion (ties: the smaller order). p values are adjusted over all systems, for each
    cause by itself. A system of too few rows for any order has no row.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    k, names = len(names), list(names)

    def rows(m: np.ndarray, n: int):
        orders = [p for p in range(1, max_lag + 1) if n > k * p + 1]
        if orders:
            p = min(orders, key=lambda p: (criteria(m, k, n, p)[criterion], p))
            for i, name in enumerate(names):
                f, d1, d2 = exclusion(m, k, n, p, i)
                chi, d = instantaneous(m, k, n, p, i)
                yield name, p, n, f, d1, d2, f_upper(f, d1, d2), chi, chi2_upper(chi, d)

    found = _solved(df, names, order, by, max_lag, "cause string, lag int, n long, f double, d1 int, d2 int, p_value double, instant double, instant_p double", rows)
    return with_adjusted(found, "p_value", "p_adjusted", ["cause"], adjust)


def with_adjusted(df: DataFrame, p: str, name: str, by: Sequence[str] = (), how: str = "BH") -> DataFrame:
    """df with p values adjusted within groups by Benjamini and Hochberg or Bonferroni. For a table of tests, not of data."""
    every = Window.partitionBy(*by)
    if how == "bonferroni":
        return df.withColumn(name, F.least(F.lit(1.0), F.col(p) * F.count(p).over(every)))
    # Of equal values the last rank counts.
    ranked = df.withColumn("__least", F.col(p) * F.count(p).over(every) / F.count(p).over(every.orderBy(p)))
    return ranked.withColumn(name, F.min("__least").over(every.orderBy(F.col(p).desc()))).drop("__least")
