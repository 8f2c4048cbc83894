"""Submissions that are looked at again for new comments, with state that ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ThreadProcessor(StatefulProcessor):
    """For each submission: the ids of its comments so far, how many there were and when the last one came.

    A timer ends this state when no new comment has come for `keep` microseconds of event time.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "comment string", "at long")
        self.thread = handle.getValueState("thread", "n long, last long")

    def _end(self) -> None:
        self.seen.clear()
        self.thread.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values(["at", "comment"])
        n, last = self.thread.get() if self.thread.exists() else (0, None)
        # Comments of this batch are kept here until it ends; those whose thread ends within it never reach the store.
        out, kept, stored = [], {}, n > 0
        for comment, at in zip(rows["comment"].tolist(), rows["at"].tolist(), strict=True):
            if last is not None and at - last > self.keep:
                if stored:
                    self._end()
                n, kept, stored = 0, {}, False
            if comment in kept or (stored and self.seen.containsKey((comment,))):
                continue
            n, last = n + 1, at if n == 0 else max(at, last)
            kept[comment] = at
            out.append((key[0], comment, at, n, n == 1))
        for comment, at in kept.items():
            self.seen.updateValue((comment,), (at,))
        if out:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.thread.update((n, last))
            self.handle.registerTimer((last + self.keep) // 1000 + 1)  # milliseconds
        yield pd.DataFrame(out, columns=["submission", "comment", "at", "n", "is_first"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._end()
        yield pd.DataFrame({"submission": pd.Series([], dtype=object), "comment": pd.Series([], dtype=object), "at": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64"), "is_first": pd.Series([], dtype=bool)})


def new_comments(stream: DataFrame, submission: str, comment: str, ts: str, keep: str = "7 days", late: str = "1 hour") -> DataFrame:
    """submission, comment, ts, n, is_first of every comment that its submission has not had yet.

    n counts the comments of a submission as long as its state lives: until none has come for `keep` of event time. is_first
    marks the one that began it; all others were found when the submission was looked at again. Rows later than the
    watermark are dropped. The state is kept by RocksDB, so a submission's comments need not fit in memory; those of one
    batch do. Null submissions or comments are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    micros = int(spark.range(1).select(F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00 UTC' + INTERVAL {keep})")).first()[0])
    rows = stream.withWatermark(ts, late).filter(F.col(submission).isNotNull() & F.col(comment).isNotNull())
    rows = rows.select(F.col(submission).cast("string").alias("submission"), F.col(comment).cast("string").alias("comment"), F.unix_micros(ts).alias("at"), ts)
    found = rows.groupBy("submission").transformWithStateInPandas(ThreadProcessor(micros), "submission string, comment string, at long, n long, is_first boolean", "append", "eventTime")
    return found.select("submission", "comment", F.timestamp_micros("at").alias("ts"), "n", "is_first")
