"""Daily means, shares, summaries and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def daily_means(df: DataFrame, date: Column, names: Sequence[str] | None = None) -> DataFrame:
    """date and <name>_mean of the numeric columns; rows without a date go."""
    names = names or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.withColumn("date", date).filter("date IS NOT NULL").groupBy("date").agg(*[F.avg(n).alias(f"{n}_mean") for n in names])


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Value and count, largest first, ties by value."""
    out = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return out.limit(most) if most else out


def shares(df: DataFrame, column: str) -> DataFrame:
    """value_counts with the share of all rows."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Rate at which two signs agree, and counts; what is not positive is negative."""
    return df.agg(
        F.avg((a == b).cast("double")).alias("agreement"), F.count_if(a & b).alias("both_positive"), F.count_if(~a & ~b).alias("both_negative"), F.count_if(a != b).alias("disagree")
    )


def summary(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sample standard deviation, min and max."""
    c = F.col(column)
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def prevalence(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """For each column: the share of rows above 0 and the mean."""
    long = df.select(*names).unpivot([], list(names), "emotion", "value")
    return long.groupBy("emotion").agg(F.avg((F.col("value") > 0).cast("double")).alias("share"), F.avg("value").alias("mean_count"))


def by_keyword(df: DataFrame, keyword: str, score: str, other: str) -> DataFrame:
    return df.groupBy(keyword).agg(F.bround(F.avg(score), 2).alias("mean_score"), F.count("*").alias("n"), F.bround(F.avg(other), 2).alias("mean_other")).orderBy(F.desc("mean_score"), keyword)


def weighted_mean(df: DataFrame, by: Sequence[str], score: Column, weight: Column, name: str = "weighted_sentiment") -> DataFrame:
    return df.groupBy(*by).agg((F.sum(score * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias(name))


def missing_shares(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(F.col(n).isNull().cast("double")).alias(n) for n in names])


def span(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (from 0) and count of equal-width bins between the smallest and the largest value, which is in the last."""
    lo = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(bins - 1))
    return df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(lo)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


#: A group of more rows gets its quartiles from a sketch, whose ranks are right to one part in SKETCH.
EXACT_ROWS = 1_000_000
SKETCH = 10_000


def quartiles(df: DataFrame, by: str, column: str, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """by, q1, median, q3, n_exact: interpolated from all values in groups of at most exact_rows values.

    In larger groups they are values whose rank is off by at most 1 / SKETCH of the rows, from summaries that each task
    makes and that are merged; exact ones need all different values of a group in one task. n_exact is the number of values,
    null where the sketch was taken.
    """
    at = [0.25, 0.5, 0.75]
    sizes = df.groupBy(by).agg(F.count(column).alias("n_exact"), F.percentile_approx(column, at, SKETCH).alias("about"))
    small = sizes.filter(F.col("n_exact") <= exact_rows).select(F.col(by).alias("__by"))
    exact = df.join(small, F.col(by).eqNullSafe(F.col("__by")), "left_semi").groupBy(F.col(by).alias("__by")).agg(F.percentile(column, at).alias("q"), F.lit(True).alias("known"))
    both = sizes.join(exact, F.col(by).eqNullSafe(F.col("__by")), "left")
    values = [F.when(F.col("known"), F.col("q")[i]).otherwise(F.col("about")[i].cast("double")).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    return both.select(by, *values, F.when(F.col("known"), F.col("n_exact")).alias("n_exact"))


def removal_report(df: DataFrame, flags: Sequence[tuple[str, Column]]) -> DataFrame:
    """rows_in, what each stage removes of the rows the earlier ones left, rows_out; one pass.

    flags: for each stage in order whether it removes a row.
    """
    left, aggs = F.lit(True), [F.count("*").alias("rows_in")]
    for name, drop in flags:
        aggs.append(F.count_if(left & drop).alias(f"removed_{name}"))
        left = left & ~drop
    return df.agg(*aggs, F.count_if(left).alias("rows_out"))


def profile(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(F.col(text).isNull().cast("double")).alias("null_rate"), F.avg(F.length(text)).alias("mean_length"))
