"""A streaming source that polls a service in windows of time, one partition a key."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from brindle.sources.paging import retrying


def named(path: str):
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function)


class PollingSource(DataSource):
    """`polled`: what a service has got since the last look, as a stream.

    Options: fetch ("module:function", called with key, after, upto, skip and size, returning up to size rows (id, time,
    text) with after < time <= upto in the order of time and id, the first skip of them left out), newest
    ("module:function", called with a key, returning the time of its newest row or None), keys (comma-separated), page
    (rows a call), tries (see retrying), committed (optional "module:function", called with the offsets that are done).
    All functions get a last argument, the option `service`, if it is given.

    Offsets are a time for each key, so a window that was read once is the same window after a restart: no row is lost or
    repeated, if rows don't change and none comes with a time that has been read past.
    """

    @classmethod
    def name(cls) -> str:
        return "polled"

    def schema(self) -> str:
        return "key string, id string, time double, text string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PollingReader(self.options)


class _Span(InputPartition):
    def __init__(self, key: str, after: float | None, upto: float):
        self.key, self.after, self.upto = key, after, upto


class _PollingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.options = {k: options[k] for k in ("fetch", "newest", "keys") if k in options} | {k: options[k] for k in ("page", "tries", "committed", "service") if k in options}
        self.keys = self.options["keys"].split(",")

    def _call(self, option: str, *args):
        more = (self.options["service"],) if "service" in self.options else ()
        return retrying(named(self.options[option]), int(self.options.get("tries", 5)))(*args, *more)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {k: t for k in self.keys if (t := self._call("newest", k)) is not None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(k, start.get(k), t) for k, t in sorted(end.items()) if k not in start or start[k] < t]

    def read(self, partition: _Span) -> Iterator[tuple]:
        page, got = int(self.options.get("page", 100)), 0
        while True:
            rows = self._call("fetch", partition.key, partition.after, partition.upto, got, page)
            for id_, time, text in rows:
                yield partition.key, str(id_), float(time), text
            got += len(rows)
            if len(rows) < page:
                return

    def commit(self, end: dict) -> None:
        if "committed" in self.options:
            self._call("committed", json.dumps(end, sort_keys=True))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PollingSource)


# A service that is a Parquet file or folder of events: event types are keys, event ids and times the rows.


def _events(path: str):
    import pyarrow.dataset as ds

    return ds.dataset(path.removeprefix("file://"), format="parquet")


def _seconds(key: str, path: str, columns: list[str]):
    """The rows of a key, and their times in seconds."""
    import numpy as np
    import pyarrow.compute as pc

    rows = _events(path).to_table(columns=columns, filter=pc.field("event_type") == key)
    return rows, rows.column("ts").to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6


def newest_event(key: str, path: str) -> float | None:
    times = _seconds(key, path, ["ts"])[1]
    return float(times.max()) if len(times) else None


@lru_cache(maxsize=1)
def _window(key: str, after: float | None, upto: float, path: str):
    """The ids, times and props of a window in their order; it is read and sorted once for all of its pages, as its rows don't change."""
    import numpy as np

    rows, times = _seconds(key, path, ["event_id", "ts", "props"])
    ids = rows.column("event_id").to_numpy()
    at = np.flatnonzero((times <= upto) & (times > (-np.inf if after is None else after)))
    at = at[np.lexsort((ids[at], times[at]))]
    return ids[at], times[at], rows.column("props").combine_chunks().cast("large_string").take(at)


def fetch_events(key: str, after: float | None, upto: float, skip: int, size: int, path: str) -> list[tuple]:
    page = slice(skip, skip + size)
    ids, times, props = _window(key, after, upto, path)
    if len(ids) <= skip + size:
        _window.cache_clear()  # a worker that lives on does not hold the window
    return list(zip(ids[page].tolist(), times[page].tolist(), props[page].to_pylist(), strict=True))
