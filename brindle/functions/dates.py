"""Dates and times as Spark columns; the session's time zone is UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The orders in which a date string is read.
FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "M/d/yyyy H:mm", "M/d/yyyy", "d.M.yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy",
)
EXCEL_ORIGIN = "1899-12-30"
UNITS = {"d": 86400, "h": 3600, "m": 60, "s": 1}


def utc_date(df: DataFrame, column: str) -> Column:
    """The UTC date of a string, timestamp or number of epoch seconds; what can't be read is null."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.NumericType):
        return F.to_date(F.timestamp_seconds(c))
    if isinstance(kind, T.StringType):
        return F.to_date(F.try_to_timestamp(c))
    return F.to_date(c)


def date_column(df: DataFrame) -> str | None:
    """The first column named created_at, timestamp, date or datetime, whatever its case."""
    return next((c for c in df.columns if c.lower() in ("created_at", "timestamp", "date", "datetime")), None)


def parse_date(c: Column) -> Column:
    """The first format that fits, then a serial day number of a spreadsheet, else null."""
    read = [F.to_date(F.try_to_timestamp(c, F.lit(f))) for f in FORMATS]
    n = c.try_cast("double")
    return F.coalesce(*read, F.date_add(F.lit(EXCEL_ORIGIN).cast("date"), F.when(n.between(1, 200000), F.floor(n)).cast("int")))


def ago_seconds(c: Column, now: int) -> Column:
    """30d, 12h, 5m, 10s before `now` (epoch seconds); a plain number is itself; else null."""
    unit = F.regexp_extract(c, r"^(\d+)([dhms])$", 2)
    amount = F.regexp_extract(c, r"^(\d+)([dhms])$", 1)
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return F.when(unit != "", F.lit(now) - amount.try_cast("long") * table[unit]).otherwise(c.try_cast("double").cast("long"))


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row a month, both ends included: month (its first day)."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(trunc(date'{first}', 'month'), trunc(date'{last}', 'month'), interval 1 month)")).alias("month"))


def days(spark: SparkSession, first: str, n: int) -> DataFrame:
    return spark.range(n).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))


def month_bounds(month: Column) -> tuple[Column, Column]:
    """Epoch seconds of a month's start and of the next month's start, in UTC."""
    start = F.date_trunc("month", month.cast("timestamp"))
    return F.unix_timestamp(start), F.unix_timestamp(F.add_months(start.cast("date"), 1).cast("timestamp"))


def day_bounds(day: Column) -> tuple[Column, Column]:
    """First and last second of a day as ISO strings."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:59:59Z"))


def recent_windows(spark: SparkSession, now: str, days_back: int = 7, least_seconds: int = 600) -> DataFrame:
    """Day-long windows of the last days up to `now`, without one shorter than least_seconds."""
    end = F.lit(now).cast("timestamp")
    out = spark.range(days_back).select((end - F.make_dt_interval(F.col("id").cast("int") + 1)).alias("a"))
    out = out.select(F.date_trunc("day", F.col("a") + F.make_dt_interval(F.lit(1))).alias("start"))
    out = out.select("start", F.least(F.col("start") + F.make_dt_interval(F.lit(1)), end).alias("end"))
    return out.filter(F.unix_timestamp("end") - F.unix_timestamp("start") >= least_seconds)


def to_utc(c: Column, zone: str) -> Column:
    return F.to_utc_timestamp(c, zone)


def any_of(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first of names that df has."""
    return next((n for n in names if n in df.columns), None)
