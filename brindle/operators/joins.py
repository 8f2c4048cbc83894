"""As-of, fill, calendar, interval and bookkeeping joins, written so that Catalyst picks the join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from brindle.sources.shared import rounds

#: Rows of a block of the order, within which a value is carried forward by one task.
BLOCK_ROWS = 200_000


def carried(df: DataFrame, value: str, on: str, then: Sequence[str] = (), by: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with `value` replaced by its last non-null value up to the row, within `by`, in the order of `on` (date, time or number) and `then`.

    A table of more than block_rows rows is dealt by range of `on` and `then` to blocks of about equal numbers of rows, as a
    sample has it, and written; within a block a window carries on, and what earlier blocks end with is carried from block
    to block. So one key, or a table without one, is spread over many tasks, however its times are spread.
    """
    order = [F.col(on), *map(F.col, then)]
    last = lambda *more: F.last(value, ignorenulls=True).over(Window.partitionBy(*by, *more).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = -(-df.count() // block_rows)
    if blocks <= 1:
        return df.withColumn(value, last())
    with rounds(df.sparkSession) as write:
        rows = write(df.repartitionByRange(blocks, *order).withColumn("__b", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "__b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__end"))
    before = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(earlier)).filter("__before IS NOT NULL")
    before = before.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__b").alias("__block"), "__before")
    same = F.col("__b") == F.col("__block")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = rows.withColumn(value, last("__b")).join(before, same, "left")
    return out.withColumn(value, F.coalesce(value, "__before")).select(*df.columns)


def asof_backward(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """left with the values of the last right row at or before it, within `by`; that row's nulls stay nulls.

    Both sides are put one after the other and the last right row is carried on. Of right rows at the same
    place the values that sort last count.
    """
    values = list(values)
    hold = F.struct(*values)
    l = left.select(*left.columns, F.lit(None).cast(right.select(hold.alias("h")).schema["h"].dataType).alias("__h"), F.lit(1).alias("__side"))
    r = right.select(*[c for c in (*by, on)], hold.alias("__h"), F.lit(0).alias("__side"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__last", F.col("__h"))
    out = carried(both, "__last", on, ["__side", "__h"], by)
    return out.filter("__side = 1").select(*left.columns, *[F.col(f"__last.{v}").alias(v) for v in values])


def exact_then_ffill(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """left join on equal keys, then the last non-null value is carried forward; keys without a left row are lost."""
    out = left.join(right.select(*by, on, *values), [*by, on], "left")
    for v in values:
        out = carried(out, v, on, (), by)
    return out


def outer_align(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Full outer join by label; rows whose values are all null go."""
    out = a.join(b, on, "full")
    return out.na.drop("all", subset=[c for c in out.columns if c != on])


def unseen(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    return df.join(state.select(key).distinct(), key, "left_anti")


def without_heavy_authors(df: DataFrame, author: str, day: Column, most: int = 30) -> DataFrame:
    """Without the rows of authors who have a day of more than `most` posts."""
    heavy = df.groupBy(author, day.alias("__d")).count().filter(F.col("count") > most).select(author).distinct()
    return df.join(heavy, author, "left_anti")


def spine_gaps(spine: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return spine.join(present.select(key).distinct(), key, "left_anti")


def completeness(spine: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """expected, present and the rounded percentage."""
    seen = present.select(key).distinct().withColumn("__p", F.lit(1))
    out = spine.join(seen, key, "left").agg(F.count("*").alias("expected"), F.count("__p").alias("present"))
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("present") / F.nullif("expected", F.lit(0))).cast("long"))


def trading_days(df: DataFrame, ts: str, calendar: DataFrame, zone: str = "America/New_York", close: str = "16:00:00", date: str = "trading_date") -> DataFrame:
    """The trading day a UTC time counts for: that day before the close, else the strictly next one; null past the end.

    calendar has `day`, the trading days. Every calendar day from a little before the first to the last
    gets its next trading day once, so the rows join that table by equality.
    """
    span = calendar.agg(F.date_sub(F.min("day"), 400).alias("lo"), F.max("day").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("date"))
    marked = span.join(calendar.select(F.col("day").alias("date"), F.col("day").alias("open")), "date", "left")
    after = Window.orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    table = marked.select(F.col("date").alias("__d"), "open", F.min("open").over(after).alias("__next"))
    local = F.from_utc_timestamp(ts, zone)
    late = F.date_format(local, "HH:mm:ss") >= close
    out = df.withColumn("__d", F.to_date(local)).join(table, "__d", "left")
    return out.withColumn(date, F.when(late | F.col("open").isNull(), F.col("__next")).otherwise(F.col("open"))).drop("__d", "open", "__next")


def event_windows(series: DataFrame, events: DataFrame, day: str, before: int, after: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the series from `before` to `after` trading days around each event: event_day, offset and the row.

    Days are numbered, and each event lists the numbers it covers, so the join is by equality.
    """
    w = Window.partitionBy(*by).orderBy(day)
    numbered = series.withColumn("__n", F.row_number().over(w))
    at = events.join(numbered.select(*by, F.col(day).alias("event_day"), "__n"), [*by, "event_day"])
    span = at.select(*by, "event_day", F.posexplode(F.sequence(F.col("__n") + before, F.col("__n") + after)).alias("__p", "__n"))
    return span.join(numbered, [*by, "__n"]).withColumn("offset", F.col("__p") + before).drop("__n", "__p")
