"""What paged pulls return, as queries over a table of posts; and a data source that pages through one."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def keyset_pages(df: DataFrame, time: str, key: Sequence[str] = (), page: int = 100, max_pages: int = 10) -> DataFrame:
    """The newest page * max_pages rows of each key: what paging by `before = oldest time so far` collects."""
    w = Window.partitionBy(*key).orderBy(F.desc(time)) if key else None
    if w is None:
        return df.orderBy(F.desc(time)).limit(page * max_pages)
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= page * max_pages).drop("__r")


def first_keyword_limit(df: DataFrame, id_: str, keyword: str, order: Column, time: str, limit: int) -> DataFrame:
    """Each post under the first keyword (by `order`) that finds it, and at most `limit` new posts a keyword, newest first."""
    first = df.withColumn("__o", order).withColumn("__r", F.row_number().over(Window.partitionBy(id_).orderBy("__o"))).filter("__r = 1")
    top = Window.partitionBy(keyword).orderBy(F.desc(time), id_)
    return first.withColumn("__r", F.row_number().over(top)).filter(F.col("__r") <= limit).drop("__r", "__o")


def liked_posts(df: DataFrame, likes: str, text: str, created: str, least: int) -> DataFrame:
    """Posts of at least `least` likes, their text cut to 100 characters, the date as the first ten."""
    return df.filter(F.col(likes) >= least).withColumns({text: F.substring(text, 1, 100), "date": F.substring(created, 1, 10)})


def daily_rounds(days: DataFrame, queries: DataFrame, per_day: int = 100, page: int = 25) -> DataFrame:
    """day, query, turn: pulls of a day deal out the queries in turn until per_day articles are asked for."""
    turns = -(-per_day // page)
    n = F.count("*").over(Window.partitionBy("day"))
    at = F.row_number().over(Window.partitionBy("day").orderBy("ord"))
    plan = days.crossJoin(F.broadcast(queries)).withColumns({"n": n, "at": at})
    turn = F.explode(F.expr(f"sequence(at, greatest({turns}, at), n)"))
    return plan.withColumn("turn", turn).filter(F.col("turn") <= turns).select("day", "query", "turn")


class Wait(Exception):
    """Raised by a fetch that was refused: seconds is how long the service asks to wait, None if it does not say."""

    def __init__(self, seconds: float | None = None):
        super().__init__(seconds)
        self.seconds = seconds


def retrying(fetch: Callable, tries: int = 5, base: float = 2.0, sleep: Callable[[float], None] = time.sleep, login: Callable[[], None] | None = None) -> Callable:
    """fetch, tried up to `tries` times: after the n-th failure it waits as long as Wait says, else base ** n seconds.

    A PermissionError logs in again first, if a login is given. What the last try raises goes through.
    """

    def again(*args, **kwargs):
        for n in range(1, tries + 1):
            try:
                return fetch(*args, **kwargs)
            except (Wait, OSError) as e:
                if n == tries:
                    raise
                if isinstance(e, PermissionError) and login:
                    login()
                asked = e.seconds if isinstance(e, Wait) else None
                sleep(base**n if asked is None else asked)

    return again


class PagedSource(DataSource):
    """`paged`: reads a table in keyset pages through a fetch function, one partition a key.

    Options: fetch ("module:function", called with key, before and size, returning (id, time, text) rows,
    newest first), keys (comma-separated), page, max_pages, tries (5; see retrying). A pull ends on an empty page.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "key string, id string, time double, text string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.fetch, self.keys = options["fetch"], options["keys"].split(",")
        self.page, self.max_pages = int(options.get("page", 100)), int(options.get("max_pages", 10))
        self.tries = int(options.get("tries", 5))

    def partitions(self):
        return [InputPartition(k) for k in self.keys]

    def read(self, partition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.fetch.partition(":")
        fetch, before, seen = retrying(getattr(importlib.import_module(module), function), self.tries), None, set()
        for _ in range(self.max_pages):
            rows = fetch(partition.value, before, self.page)
            if not rows:
                return
            for id_, time, text in rows:
                if id_ not in seen:
                    seen.add(id_)
                    yield partition.value, id_, float(time), text
            before = min(r[1] for r in rows)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
