"""Regression and diagnostics: Spark sums what grows with the rows, numpy solves what has the size of the model."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from brindle.functions.numbers import newey_west_lag


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, k: float) -> float:
    """Upper tail, by the series of the incomplete gamma function or its continued fraction."""
    if x <= 0:
        return 1.0
    a, z = k / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2
        d = 1 / (num * d + b)
        c = b + num / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


@dataclass
class Fit:
    """Coefficients of a least-squares fit; names begins with the constant."""

    names: list[str]
    y: str
    beta: np.ndarray
    xtx_inv: np.ndarray
    n: int
    rss: float
    tss: float

    @property
    def k(self) -> int:
        return len(self.names)

    @property
    def sigma2(self) -> float:
        return self.rss / (self.n - self.k)

    @property
    def r2(self) -> float:
        return 1 - self.rss / self.tss

    def fitted(self) -> Column:
        out = F.lit(float(self.beta[0]))
        for b, n in zip(self.beta[1:], self.names[1:], strict=True):
            out = out + F.lit(float(b)) * F.col(n)
        return out

    def leverage(self) -> Column:
        x = [F.lit(1.0), *(F.col(n) for n in self.names[1:])]
        out = F.lit(0.0)
        for i in range(self.k):
            for j in range(self.k):
                out = out + F.lit(float(self.xtx_inv[i, j])) * x[i] * x[j]
        return out

    def residuals(self, df: DataFrame) -> DataFrame:
        """The used rows with e (residual) and h (leverage)."""
        return complete(df, [self.y, *self.names[1:]]).withColumns({"e": F.col(self.y) - self.fitted(), "h": self.leverage()})


def complete(df: DataFrame, names: Sequence[str]) -> DataFrame:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double"))
    return df.filter(ok)


def cross_products(df: DataFrame, columns: Sequence[Column]) -> np.ndarray:
    """Sums of all products of two columns, in one pass."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*[F.sum((columns[i] * columns[j]).cast("double")).alias(f"s{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = 0.0 if v is None else v
    return out


def ols(df: DataFrame, y: str, x: Sequence[str]) -> Fit:
    """Least squares with a constant. Terms that earlier ones determine are dropped, as an aliased term is.

    Sums are taken around the columns' means, so that large means don't cost digits.
    """
    rows = complete(df, [y, *x])
    means = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate([*x, y])]).first()
    n = means[0]
    centred = [F.col(c) - F.lit(float(m or 0.0)) for c, m in zip([*x, y], means[1:], strict=True)]
    s = cross_products(rows, centred)
    keep: list[int] = []
    for i in range(len(x)):
        if s[i, i] <= 0:
            continue
        rest = s[i, i] - (s[i, keep] @ np.linalg.solve(s[np.ix_(keep, keep)], s[keep, i]) if keep else 0.0)
        if rest > 1e-10 * s[i, i]:
            keep.append(i)
    if n <= len(keep) + 1:
        raise ValueError(f"{n} rows for {len(keep) + 1} coefficients")
    inv = np.linalg.inv(s[np.ix_(keep, keep)]) if keep else np.zeros((0, 0))
    slope = inv @ s[keep, -1]
    m = np.array([float(v) for v in means[1:]])
    mx, my = m[keep], m[-1]
    full = np.zeros((len(keep) + 1, len(keep) + 1))
    full[1:, 1:] = inv
    full[0, 1:] = full[1:, 0] = -inv @ mx
    full[0, 0] = 1 / n + mx @ inv @ mx
    beta = np.concatenate([[my - slope @ mx], slope])
    return Fit(["(Intercept)", *(x[i] for i in keep)], y, beta, full, n, float(s[-1, -1] - slope @ s[keep, -1]), float(s[-1, -1]))


def robust_covariance(df: DataFrame, fit: Fit, kind: str = "HC3") -> np.ndarray:
    """HC0, HC1, HC3 or HC4: the scores' cross products are summed in Spark."""
    rows = fit.residuals(df)
    e2, h, n, k = F.col("e") * F.col("e"), F.col("h"), fit.n, fit.k
    w = {"HC0": e2, "HC1": e2 * (n / (n - k)), "HC3": e2 / ((1 - h) * (1 - h)), "HC4": e2 / F.pow(1 - h, F.least(F.lit(4.0), h * (n / k)))}[kind]
    root = F.sqrt(w)
    meat = cross_products(rows, [root, *(root * F.col(c) for c in fit.names[1:])])
    return fit.xtx_inv @ meat @ fit.xtx_inv


def newey_west(df: DataFrame, fit: Fit, order: str, lag: int | None = None, by: Sequence[str] = ()) -> np.ndarray:
    """Bartlett weights, no prewhitening, with the n / (n - k) adjustment."""
    lag = newey_west_lag(fit.n) if lag is None else lag
    rows = fit.residuals(df)
    scores = [F.col("e"), *(F.col("e") * F.col(c) for c in fit.names[1:])]
    w = Window.partitionBy(*by).orderBy(order)
    names = [f"u{i}" for i in range(fit.k)]
    late = {f"{n}_{l}": F.lag(n, l).over(w) for n in names for l in range(1, lag + 1)}
    rows = rows.select(order, *by, *[s.alias(n) for s, n in zip(scores, names, strict=True)]).withColumns(late)
    row = rows.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b if not l else f"{b}_{l}")), F.lit(0.0)).alias(f"{a}{b}{l}") for l in range(lag + 1) for a in names for b in names]).first()
    gammas = np.array(row, float).reshape(lag + 1, fit.k, fit.k)
    meat = gammas[0] + sum((1 - l / (lag + 1)) * (gammas[l] + gammas[l].T) for l in range(1, lag + 1))
    return fit.xtx_inv @ meat @ fit.xtx_inv * (fit.n / (fit.n - fit.k))


def coefficient_table(spark: SparkSession, fit: Fit, covariance: np.ndarray | None = None, kind: str = "OLS") -> DataFrame:
    """term, estimate, std_error, statistic, p_value, low, high (95 %), se_type."""
    cov = fit.xtx_inv * fit.sigma2 if covariance is None else covariance
    out = []
    for i, name in enumerate(fit.names):
        b, se = float(fit.beta[i]), float(np.sqrt(max(cov[i, i], 0)))
        t = b / se if se else float("nan")
        out.append((name, b, se, t, t_two_sided(t, fit.n - fit.k) if se else None, b - 1.96 * se, b + 1.96 * se, kind))
    return spark.createDataFrame(out, "term string, estimate double, std_error double, statistic double, p_value double, low double, high double, se_type string")


def vif(df: DataFrame, x: Sequence[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix."""
    rows = complete(df, x)
    means = rows.agg(*[F.avg(c) for c in x]).first()
    s = cross_products(rows, [F.col(c) - F.lit(float(m)) for c, m in zip(x, means, strict=True)])
    d = np.sqrt(np.diag(s))
    return dict(zip(x, np.diag(np.linalg.inv(s / np.outer(d, d))).tolist(), strict=True))


def breusch_pagan(df: DataFrame, fit: Fit) -> tuple[float, float]:
    """Studentised: n R2 of the squared residuals on the regressors, chi-square with k - 1."""
    aux = ols(fit.residuals(df).withColumn("e2", F.col("e") * F.col("e")), "e2", fit.names[1:])
    return fit.n * aux.r2, chi2_upper(fit.n * aux.r2, aux.k - 1)


def score_test(df: DataFrame, fit: Fit) -> tuple[float, float]:
    """Non-constant variance against the fitted values: half the explained sum of squares of e2 / mean(e2)."""
    scale = fit.rss / fit.n
    rows = fit.residuals(df).withColumns({"__f": fit.fitted(), "__u": F.col("e") * F.col("e") / scale})
    aux = ols(rows, "__u", ["__f"])
    stat = (aux.tss - aux.rss) / 2
    return stat, chi2_upper(stat, 1)


def durbin_watson(df: DataFrame, e: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("__d", F.col(e) - F.lag(e).over(w))
    return d.agg((F.sum(F.col("__d") * F.col("__d")) / F.sum(F.col(e) * F.col(e))).alias("durbin_watson"))


def breusch_godfrey(df: DataFrame, fit: Fit, order: str, lags: int = 1) -> tuple[float, float]:
    """n R2 of the residuals on the regressors and their own lags, which begin with zeros."""
    w = Window.partitionBy().orderBy(order)
    rows = fit.residuals(df).withColumns({f"e{l}": F.coalesce(F.lag("e", l).over(w), F.lit(0.0)) for l in range(1, lags + 1)})
    aux = ols(rows, "e", [*fit.names[1:], *(f"e{l}" for l in range(1, lags + 1))])
    return fit.n * aux.r2, chi2_upper(fit.n * aux.r2, lags)


def jarque_bera(df: DataFrame, x: str) -> DataFrame:
    return df.agg(F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")).withColumn("jarque_bera", F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4))


#: Quantiles of the Dickey-Fuller t with constant and trend, by sample size.
ADF_SIZES = (25, 50, 100, 250, 500, 100000)
ADF_P = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
ADF_T = (
    (-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15),
    (-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24),
    (-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28),
    (-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31),
    (-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32),
    (-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33),
)


def adf(df: DataFrame, x: str, order: str) -> tuple[float, float]:
    """Dickey-Fuller t with constant and trend and no lags; p by interpolation in the table, within 0.01 and 0.99."""
    w = Window.partitionBy().orderBy(order)
    rows = df.filter(F.col(x).isNotNull()).withColumns({"__t": F.row_number().over(w).cast("double"), "__l": F.lag(x).over(w)}).withColumn("__d", F.col(x) - F.col("__l"))
    fit = ols(rows, "__d", ["__l", "__t"])
    i = fit.names.index("__l")
    t = float(fit.beta[i] / math.sqrt(fit.xtx_inv[i, i] * fit.sigma2))
    at = [float(np.interp(fit.n, ADF_SIZES, [r[j] for r in ADF_T])) for j in range(len(ADF_P))]
    return t, float(np.interp(t, at, ADF_P))


def difference_if_needed(df: DataFrame, names: Sequence[str], order: str) -> DataFrame:
    """Adds d_<name> for the series whose unit root is not rejected at 5 % and that have over ten values."""
    w = Window.partitionBy().orderBy(order)
    need = [n for n in names if df.filter(F.col(n).isNotNull()).count() > 10 and adf(df, n, order)[1] > 0.05]
    return df.withColumns({f"d_{n}": F.col(n) - F.lag(n).over(w) for n in need})


def box_cox_power(df: DataFrame, y: str, x: Sequence[str], grid: Sequence[float] = tuple(np.round(np.arange(-2, 2.01, 0.1), 2))) -> tuple[float, float, list[tuple[float, float]]]:
    """The power of the largest profile likelihood on the grid, the shift that made y positive, and the profile."""
    rows = complete(df, [y, *x])
    low = rows.agg(F.min(y)).first()[0]
    shift = 1 - low if low <= 0 else 0.0
    rows = rows.withColumn("__y", F.col(y) + shift)
    n, logs = rows.agg(F.count("*"), F.sum(F.log("__y"))).first()
    cols = {f"__p{i}": (F.log("__y") if abs(p) < 1e-6 else (F.pow("__y", F.lit(float(p))) - 1) / float(p)) for i, p in enumerate(grid)}
    rows = rows.withColumns(cols)
    means = rows.agg(*[F.avg(c) for c in [*x, *cols]]).first()
    s = cross_products(rows, [F.col(c) - F.lit(float(m)) for c, m in zip([*x, *cols], means, strict=True)])
    k, profile = len(x), []
    for i, p in enumerate(grid):
        a = s[:k, k + i]
        rss = s[k + i, k + i] - a @ np.linalg.pinv(s[:k, :k]) @ a
        profile.append((float(p), float(-n / 2 * math.log(rss / n) + (p - 1) * logs)))
    return max(profile, key=lambda v: v[1])[0], float(shift), profile


def influence(df: DataFrame, fit: Fit) -> DataFrame:
    """Used rows with e, h, standardised residual, Cook's distance, DFFITS, and whether either marks the row."""
    rows, k, n = fit.residuals(df), fit.k, fit.n
    s2 = fit.sigma2
    standard = F.col("e") / F.sqrt(F.lit(s2) * (1 - F.col("h")))
    without = (F.lit(s2 * (n - k)) - F.col("e") * F.col("e") / (1 - F.col("h"))) / (n - k - 1)
    dffits = F.col("e") / F.sqrt(without * (1 - F.col("h"))) * F.sqrt(F.col("h") / (1 - F.col("h")))
    out = rows.withColumns({"fitted": fit.fitted(), "rstandard": standard, "dffits": dffits}).withColumn("cooks", F.col("rstandard") ** 2 * F.col("h") / (1 - F.col("h")) / k)
    return out.withColumns({"root_abs": F.sqrt(F.abs("rstandard")), "influential": (F.col("cooks") > 4 / n) | (F.abs("dffits") > 2 * math.sqrt(k / n))})


def trimmed_fit(df: DataFrame, fit: Fit) -> Fit:
    return ols(influence(df, fit).filter(~F.col("influential")), fit.y, fit.names[1:])


def ljung_box(df: DataFrame, x: str, order: str, lags: int = 10) -> tuple[float, float]:
    from brindle.operators.windows import autocorrelation

    n = df.filter(F.col(x).isNotNull()).count()
    acf = {r[0]: r[1] for r in autocorrelation(df, x, order, lags).collect()}
    q = n * (n + 2) * sum(acf[k] ** 2 / (n - k) for k in acf)
    return q, chi2_upper(q, lags)


def arch_lm(df: DataFrame, e: str, order: str, lags: int = 5) -> tuple[float, float]:
    """n R2 of squared residuals on their own lags."""
    w = Window.partitionBy().orderBy(order)
    rows = df.filter(F.col(e).isNotNull()).withColumn("__s", F.col(e) * F.col(e))
    rows = rows.withColumns({f"__s{l}": F.lag("__s", l).over(w) for l in range(1, lags + 1)})
    fit = ols(rows, "__s", [f"__s{l}" for l in range(1, lags + 1)])
    return fit.n * fit.r2, chi2_upper(fit.n * fit.r2, lags)


def granger(df: DataFrame, cause: str, effect: str, order: str, lags: int = 1) -> tuple[float, float]:
    """F and p of the lags of `cause` in a regression of `effect` on lags of both."""
    w = Window.partitionBy().orderBy(order)
    own, other = [f"__y{l}" for l in range(1, lags + 1)], [f"__x{l}" for l in range(1, lags + 1)]
    rows = df.withColumns({f"__y{l}": F.lag(effect, l).over(w) for l in range(1, lags + 1)} | {f"__x{l}": F.lag(cause, l).over(w) for l in range(1, lags + 1)})
    rows = complete(rows, [effect, *own, *other])
    full, less = ols(rows, effect, [*own, *other]), ols(rows, effect, own)
    d = full.k - less.k
    f = (less.rss - full.rss) / d / full.sigma2
    return f, f_upper(f, d, full.n - full.k)


def adjust_p(values: Sequence[float], how: str = "BH") -> list[float]:
    """Benjamini-Hochberg or Bonferroni."""
    n = len(values)
    if how == "bonferroni":
        return [min(1.0, p * n) for p in values]
    out, low = [0.0] * n, 1.0
    for rank, i in reversed(list(enumerate(sorted(range(n), key=values.__getitem__), 1))):
        low = min(low, values[i] * n / rank)
        out[i] = low
    return out


def minimise(f: Callable[[np.ndarray], float], start: Sequence[float], step: float = 0.1, rounds: int = 2000, close: float = 1e-10) -> np.ndarray:
    """Nelder and Mead's simplex from `start`; infinite values are walls."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + step * np.eye(n)[i] for i in range(n)]
    values = [f(x) for x in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < close and max(np.abs(x - points[0]).max() for x in points) < 1e-8:
            break
        middle = np.mean(points[:-1], axis=0)
        away = middle - points[-1]
        tried = middle + away
        v = f(tried)
        if v < values[0]:
            further = middle + 2 * away
            w = f(further)
            points[-1], values[-1] = (further, w) if w < v else (tried, v)
        elif v < values[-2]:
            points[-1], values[-1] = tried, v
        else:
            inner = middle + (0.5 if v < values[-1] else -0.5) * away
            w = f(inner)
            if w < min(v, values[-1]):
                points[-1], values[-1] = inner, w
            else:
                points = [points[0], *((x + points[0]) / 2 for x in points[1:])]
                values = [values[0], *(f(x) for x in points[1:])]
    return points[int(np.argmin(values))]


def _whitened(phi: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Rows of z, a series with AR errors of unit innovations, as independent ones, and the log of the determinant; None if phi is not stationary."""
    p = len(phi)
    companion = np.vstack([phi, np.eye(p)[:-1]]) if p > 1 else phi.reshape(1, 1)
    if np.abs(np.linalg.eigvals(companion)).max() >= 0.9999:
        return None
    # Autocovariances of the first p values: their state's covariance solves V = C V C' + E.
    unit = np.zeros(p * p)
    unit[0] = 1.0
    v = np.linalg.solve(np.eye(p * p) - np.kron(companion, companion), unit).reshape(p, p)
    root = np.linalg.cholesky(v)
    late = z[p:] - sum(phi[l] * z[p - 1 - l : len(z) - 1 - l] for l in range(p))
    return np.vstack([np.linalg.solve(root, z[:p]), late]), float(np.log(np.diag(root)).sum())


def ar_regression(y: np.ndarray, x: np.ndarray, p: int, start: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Regression with AR(p) errors by exact maximum likelihood: coefficients (the constant first), phi, innovation variance, log likelihood."""
    z, n = np.column_stack([np.ones(len(y)), x, y]), len(y)

    def fitted(phi: np.ndarray):
        white = _whitened(phi, z)
        if white is None:
            return None
        beta, *_ = np.linalg.lstsq(white[0][:, :-1], white[0][:, -1], rcond=None)
        rss = float(((white[0][:, -1] - white[0][:, :-1] @ beta) ** 2).sum())
        return beta, rss, -n / 2 * (math.log(2 * math.pi * rss / n) + 1) - white[1]

    loss = lambda phi: -found[2] if (found := fitted(phi)) else math.inf
    phi = minimise(loss, np.zeros(p) if start is None else start)
    beta, rss, likelihood = fitted(phi)
    return beta, phi, rss / n, likelihood


def arima_errors_ml(df: DataFrame, y: str, x: Sequence[str], order: str, p: int = 2, by: str | None = None) -> DataFrame:
    """Regression with AR(p) errors of each series by exact maximum likelihood: by, term, estimate.

    One series a group and task; rows with a null are left out. A series of too few rows gives nothing.
    """
    import pandas as pd

    names = ["(Intercept)", *x, *(f"ar{i + 1}" for i in range(p)), "sigma2", "log_likelihood"]
    key = by or "__all"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order).dropna(subset=[y, *x])
        if len(rows) <= len(x) + 2 * p + 2:
            return pd.DataFrame({key: pd.Series(dtype=object), "term": pd.Series(dtype=object), "estimate": pd.Series(dtype=float)})
        beta, phi, sigma2, likelihood = ar_regression(rows[y].to_numpy(float), rows[list(x)].to_numpy(float), p)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(names), "term": names, "estimate": [*beta, *phi, sigma2, likelihood]}).astype({key: object, "term": object})

    rows = df if by else df.withColumn(key, F.lit(0))
    out = rows.select(key, order, y, *x).groupBy(key).applyInPandas(one, f"{key} {dict(rows.dtypes)[key]}, term string, estimate double")
    return out if by else out.drop(key)


def garch_likelihood(returns: np.ndarray, a: float, b: float, nu: float | None) -> float:
    """Log likelihood of a GARCH(1,1) around the mean whose long-run variance is that of the returns; t errors of unit variance for a nu."""
    e2 = (returns - returns.mean()) ** 2
    var = h = e2.mean()
    w, total = var * (1 - a - b), 0.0
    front = -0.5 * math.log(2 * math.pi) if nu is None else math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    for v in e2:
        total += front - 0.5 * math.log(h) - (v / h / 2 if nu is None else (nu + 1) / 2 * math.log1p(v / h / (nu - 2)))
        h = w + a * v + b * h
    return total


def garch_params(returns: np.ndarray, student: bool = False) -> tuple[float, ...]:
    """omega, alpha, beta (and nu, if asked for Student's t errors) of a GARCH(1,1) by maximum likelihood, omega by the variance of the returns."""

    def loss(v: np.ndarray) -> float:
        a, b, nu = v[0], v[1], math.exp(v[2]) + 2 if student else None
        return math.inf if a < 0 or b < 0 or a + b >= 0.999 or (nu or 0) > 500 else -garch_likelihood(returns, a, b, nu)

    starts = [(0.05, 0.9), (0.2, 0.5), (0.1, 0.0)]
    found = min((minimise(loss, [*s, math.log(6.0)] if student else s, 0.05, 400, 1e-8) for s in starts), key=loss)
    omega = float((returns - returns.mean()).var() * (1 - found[0] - found[1]))
    return (omega, float(found[0]), float(found[1]), *((math.exp(found[2]) + 2,) if student else ()))


def garch(df: DataFrame, by: str, order: str, returns: str, student: bool = True) -> DataFrame:
    """GARCH(1,1) of each series, one series a group: by, omega, alpha, beta and, with Student's t errors, nu; null for fewer than eleven returns."""
    import pandas as pd

    names = ["omega", "alpha", "beta", *(["nu"] if student else [])]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(order)[returns].dropna().to_numpy(float)
        found = garch_params(r, student) if len(r) > 10 and r.std() > 0 else (float("nan"),) * len(names)
        return pd.DataFrame({by: [pdf[by].iloc[0]], **{n: [v] for n, v in zip(names, found, strict=True)}})

    kind = dict(df.dtypes)[by]
    return df.groupBy(by).applyInPandas(one, f"{by} {kind}, " + ", ".join(f"{n} double" for n in names))


def abnormal_returns(returns: DataFrame, market: DataFrame, events: DataFrame, by: str, date: str, r: str, m: str, estimation: tuple[int, int] = (-10, -1), window: tuple[int, int] = (-1, 1)) -> DataFrame:
    """Cumulative abnormal return of each event: by, event_day, car; the market model is fitted before the event."""
    from brindle.operators.joins import event_windows

    both = returns.join(market, date)
    before = event_windows(both, events, date, *estimation, by=[by])
    model = before.groupBy(by, "event_day").agg(F.regr_slope(r, m).alias("slope"), F.regr_intercept(r, m).alias("intercept"))
    around = event_windows(both, events, date, *window, by=[by]).join(model, [by, "event_day"])
    return around.groupBy(by, "event_day").agg(F.sum(F.col(r) - F.col("intercept") - F.col("slope") * F.col(m)).alias("car"))
