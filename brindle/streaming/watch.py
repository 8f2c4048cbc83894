"""Watching streams: what each batch did, and stopping a query once its work is complete."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Keeps a line for each batch of all queries of a session, and tells waiters when one has ended a batch or itself."""

    def __init__(self):
        self.rows: list[dict] = []
        self.ended: dict[str, str | None] = {}
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        with self.news:
            self.rows.append({"query": p["id"], "batch": p["batchId"], "rows": p["numInputRows"], "at": p["timestamp"]})
            self.news.notify_all()

    def onQueryIdle(self, event) -> None:
        with self.news:
            self.news.notify_all()

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended[str(event.id)] = event.exception
            self.news.notify_all()


def stop_when(query: StreamingQuery, progress: Progress, complete: Callable[[], bool], timeout: float) -> bool:
    """Stops a running query once `complete` holds, which is looked at after every batch and at least every second.

    The batch that is running then is finished first. Whether it was complete in time; the query is stopped either way.
    """
    end = time.monotonic() + timeout
    while query.isActive and time.monotonic() < end:
        if complete():
            break
        with progress.news:
            progress.news.wait(min(1.0, max(0.01, end - time.monotonic())))
    done = complete()
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.05)
    query.stop()
    return done


def watched(spark: SparkSession) -> Progress:
    progress = Progress()
    spark.streams.addListener(progress)
    return progress


def all_present(read: Callable[[], DataFrame], column: str, wanted: Iterable) -> Callable[[], bool]:
    """Whether every wanted value occurs in a column of a table that a stream writes; a table that is not there yet has none."""
    wanted = set(wanted)

    def complete() -> bool:
        try:
            rows = read()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return not wanted
            raise
        return rows.filter(rows[column].isin(*wanted)).select(column).distinct().count() == len(wanted)

    return complete
