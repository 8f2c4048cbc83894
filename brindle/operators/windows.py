"""Ordered functions of series. Give `by` for many series; without it the series is one and must be short, such as a daily one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window


def over(order: str, by: Sequence[str] = ()):
    return Window.partitionBy(*by).orderBy(order)


def rows(order: str, first: int, last: int, by: Sequence[str] = ()):
    return over(order, by).rowsBetween(first, last)


def simple_return(x: Column, w) -> Column:
    """x / previous x - 1, null after a null."""
    return x / F.nullif(F.lag(x).over(w), F.lit(0.0)) - 1




def log_return(x: Column, w) -> Column:
    return F.log(x) - F.log(F.lag(x).over(w))


def lags(df: DataFrame, names: Sequence[str], order: str, k: Sequence[int] = (1, 2), by: Sequence[str] = ()) -> DataFrame:
    """<name>_lag<k>: the value k rows before."""
    w = over(order, by)
    return df.withColumns({f"{n}_lag{i}": F.lag(n, i).over(w) for n in names for i in k})


def first_difference(df: DataFrame, names: Sequence[str], order: str, by: Sequence[str] = ()) -> DataFrame:
    w = over(order, by)
    return df.withColumns({f"d_{n}": F.col(n) - F.lag(n).over(w) for n in names})


def trailing_sum(x: str, order: str, width: int = 4, least: int = 2, by: Sequence[str] = ()) -> Column:
    """Sum of the non-null values of `width` rows if there are at least `least`."""
    w = rows(order, 1 - width, 0, by)
    return F.when(F.count(x).over(w) >= least, F.sum(x).over(w))


def forward_fill(x: str, order: str, by: Sequence[str] = ()) -> Column:
    return F.last(x, ignorenulls=True).over(rows(order, Window.unboundedPreceding, 0, by))


def rolling_sd(x: str, order: str, width: int = 5, by: Sequence[str] = ()) -> Column:
    """Of full windows only."""
    w = rows(order, 1 - width, 0, by)
    return F.when(F.count(x).over(w) == width, F.stddev_samp(x).over(w))


def forward_sd(x: str, order: str, width: int = 5, by: Sequence[str] = ()) -> Column:
    """Of the next `width` rows, the present one not among them."""
    w = rows(order, 1, width, by)
    return F.when(F.count(x).over(w) == width, F.stddev_samp(x).over(w))


def autocorrelation(df: DataFrame, x: str, order: str, most: int) -> DataFrame:
    """lag, acf: autocovariances around the whole mean over the variance, as the usual estimator has it."""
    w = over(order)
    base = df.filter(F.col(x).isNotNull()).withColumn("__d", F.col(x) - F.avg(x).over(Window.partitionBy()))
    parts = base.select("__d", *[(F.col("__d") * F.lag("__d", k).over(w)).alias(f"p{k}") for k in range(1, most + 1)])
    sums = parts.agg(F.sum(F.col("__d") * F.col("__d")).alias("v"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, most + 1)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"p{k}") / F.col("v")).alias("acf")) for k in range(1, most + 1)])).alias("e")).select("e.lag", "e.acf")


def expanding_forecast(df: DataFrame, y: str, x: str, order: str, share: float = 0.8) -> DataFrame:
    """One-step forecasts of y by the line through all earlier points, for the rows after the first `share`.

    The sums of the line run along, so each refit costs nothing more.
    """
    past = rows(order, Window.unboundedPreceding, -1)
    s = {n: F.sum(c).over(past) for n, c in {"n": F.lit(1.0), "sx": F.col(x), "sy": F.col(y), "sxx": F.col(x) * F.col(x), "sxy": F.col(x) * F.col(y)}.items()}
    out = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns(s | {"__r": F.row_number().over(over(order)), "__n": F.count("*").over(Window.partitionBy())})
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    out = out.withColumn("slope", slope).withColumn("forecast", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n") + F.col("slope") * F.col(x))
    return out.filter(F.col("__r") > F.floor(F.lit(share) * F.col("__n"))).select(order, y, "forecast")


def forecast_quality(df: DataFrame, y: str, forecast: str) -> DataFrame:
    """rmse and the share of forecasts of the right sign."""
    e = F.col(y) - F.col(forecast)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg((F.signum(y) == F.signum(forecast)).cast("double")).alias("directional_accuracy"))


def padded_return(df: DataFrame, x: str, order: str, name: str = "ret", by: Sequence[str] = ()) -> DataFrame:
    """Return of the series after nulls were filled with the value before them."""
    filled = df.withColumn("__x", forward_fill(x, order, by))
    return filled.withColumn(name, simple_return(F.col("__x"), over(order, by))).drop("__x")
