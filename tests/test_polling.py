"""Reply trees, polling as a stream, comments that are looked for again, watching a stream to its end."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators import trees
from brindle.sources import polling
from brindle.sources.paging import Wait
from brindle.streaming import streams as R, threads, watch


def brute_tree(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            parent[i] = min(parent[i], p) if parent.get(i) is not None and p is not None else p if parent.get(i) is None else parent[i]
    out = {}
    for i in parent:
        path = [i]
        while parent[path[-1]] in parent and len(path) <= len(parent):
            path.append(parent[path[-1]])
        circle = len(path) > len(parent)
        n = sum(1 for p in parent.values() if p == i)
        out[i] = (parent[i], None, None, None, n) if circle else (parent[i], path[-1], len(path) - 1, path[-2] if len(path) > 1 else None, n)
    return out


def tree_of(spark, rows):
    df = spark.createDataFrame(rows, "id string, parent string").withColumns({x: F.lit(1) for x in ("at", "hops", "root", "done")})
    return {r.id: (r.parent, r.root, r.depth, r.top, r.n_replies) for r in trees.reply_tree(df).collect()}


def test_reply_tree_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(f"n{i}", f"n{rng.randrange(i)}" if i and rng.random() < 0.95 else None) for i in range(300)]
    rows += [(f"c{i}", f"c{i - 1}") for i in range(200)]  # a long chain whose root's parent was deleted
    rows += [("x", "y"), ("y", "z"), ("z", "x"), ("on", "x"), ("self", "self"), (None, "n1"), ("n5", "n0"), ("n5", None)]
    assert tree_of(spark, rows) == brute_tree(rows)
    assert tree_of(spark, []) == {} and tree_of(spark, [("a", "b"), ("b", "a")]) == {"a": ("b", None, None, None, 1), "b": ("a", None, None, None, 1)}


# A service in files: one a key, a row a line; calls may fail first.


def _rows(key, folder):
    try:
        return [json.loads(x) for x in open(f"{folder}/{key}")]
    except FileNotFoundError:
        return []


def newest(key, folder):
    return max((r[1] for r in _rows(key, folder)), default=None)


def fetch(key, after, upto, skip, size, folder):
    rows = sorted((r for r in _rows(key, folder) if r[1] <= upto and (after is None or r[1] > after)), key=lambda r: (r[1], r[0]))
    return rows[skip : skip + size]


def committed(offsets, folder):
    with open(f"{folder}/committed", "a") as f:
        f.write(offsets + "\n")


def add(folder, key, rows):
    with open(f"{folder}/{key}", "a") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def polled(spark, folder):
    polling.register(spark)
    return spark.readStream.format("polled").options(fetch="test_polling:fetch", newest="test_polling:newest", committed="test_polling:committed", keys="a,b,none", page="3", service=str(folder)).load()


def test_polling_goes_on_where_it_stopped(spark, tmp_path):
    service, out, check = tmp_path / "service", f"{tmp_path.as_uri()}/out", f"{tmp_path.as_uri()}/check"
    service.mkdir()
    add(service, "a", [(f"a{i}", i // 2, f"text {i}") for i in range(10)])  # two at a time
    run = lambda: R.run_once(polled(spark, service), check, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/n={n}"))
    ids = lambda: sorted(r.id for r in spark.read.parquet(out).collect())
    run()
    assert ids() == sorted(f"a{i}" for i in range(10))
    run()  # nothing new
    assert len(ids()) == 10
    add(service, "b", [("b0", 1, "x")])
    add(service, "a", [(f"a{i}", i, "y") for i in range(10, 14)])

    def broken(df, n):
        df.write.mode("overwrite").parquet(f"{out}/n={n}")
        raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        R.run_once(polled(spark, service), check, broken)
    add(service, "a", [("a99", 99, "later")])  # comes before the restart, but after the window that failed
    run()
    run()
    assert ids() == sorted([f"a{i}" for i in range(14)] + ["a99", "b0"])
    done = [json.loads(x) for x in open(service / "committed")]
    assert done and all(x.get("a", 0) <= y.get("a", 0) for x, y in zip(done[:-1], done[1:], strict=True))


tries = []


def refusing(key):
    tries.append(key)
    if len(tries) < 3:
        raise Wait(0)
    return 7.0


def test_polling_tries_again():
    reader = polling.PollingSource({"fetch": "test_polling:fetch", "newest": "test_polling:refusing", "keys": "a"}).streamReader(None)
    assert reader.initialOffset() == {} and reader.latestOffset() == {"a": 7.0} and len(tries) == 3
    spans = lambda x, y: [(p.key, p.after, p.upto) for p in reader.partitions(x, y)]
    assert spans({}, {"a": 7.0}) == [("a", None, 7.0)] and spans({"a": 7.0}, {"a": 7.0, "b": 1.0}) == [("b", None, 1.0)]


def test_new_comments_and_the_end_of_state(spark, tmp_path):
    start, schema = datetime(2024, 1, 1), "sub string, com string, ts timestamp"
    folder = tmp_path / "in"
    folder.mkdir()
    batches = [
        [("s", "c1", 0), ("s", "c2", 1), ("t", "c1", 0), ("s", "c1", 0), (None, "c", 0), ("s", None, 0)],
        [("s", "c2", 2), ("s", "c3", 3)],  # looked at again: c2 is known, c3 is new
        [("u", "c1", 100)],  # time goes on
        [("u", "c2", 101)],  # timers run
        [("s", "c1", 101), ("u", "c1", 101)],  # s has been forgotten, u not
    ]
    out, query, sizes = [], None, []
    for n, rows in enumerate(batches):
        spark.createDataFrame([(s, c, start + timedelta(hours=h)) for s, c, h in rows], schema).coalesce(1).write.mode("append").parquet(folder.as_uri())
        stream = spark.readStream.schema(schema).parquet(folder.as_uri())
        found = threads.new_comments(stream, "sub", "com", "ts", "6 hours", "1 hour")
        query = R.run_once(found, f"{tmp_path.as_uri()}/check", lambda df, _: out.extend(df.collect()))
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None)
    got = [(r.submission, r.comment, r.n, r.is_first) for r in sorted(out, key=lambda r: (r.ts, r.submission, r.comment))]
    assert got == [("s", "c1", 1, True), ("t", "c1", 1, True), ("s", "c2", 2, False), ("s", "c3", 3, False), ("u", "c1", 1, True), ("s", "c1", 1, True), ("u", "c2", 2, False)]
    assert max(x for x in sizes if x is not None) > sizes[-1]


def test_watcher_stops_when_complete(spark, tmp_path):
    source, out = tmp_path / "in", f"{tmp_path.as_uri()}/out"
    source.mkdir()
    wanted = [f"2024-{m:02}" for m in range(1, 5)]
    progress = watch.watched(spark)
    stream = spark.readStream.schema("month string, n int").option("maxFilesPerTrigger", 1).parquet(source.as_uri())
    query = stream.writeStream.option("checkpointLocation", f"{tmp_path.as_uri()}/check").trigger(processingTime="100 milliseconds").format("parquet").start(out)
    complete = watch.all_present(lambda: spark.read.schema("month string, n int").parquet(out), "month", wanted)
    try:
        assert not complete()
        for i, m in enumerate(wanted):
            if i == 3:
                assert not watch.stop_when(query, progress, lambda: len([r for r in progress.rows if r["rows"]]) > 9, 0.2) and not query.isActive
                query = stream.writeStream.option("checkpointLocation", f"{tmp_path.as_uri()}/check").trigger(processingTime="100 milliseconds").format("parquet").start(out)
            spark.createDataFrame([(m, i)], "month string, n int").coalesce(1).write.mode("append").parquet(source.as_uri())
        assert watch.stop_when(query, progress, complete, 60) and not query.isActive
    finally:
        spark.streams.removeListener(progress)
    assert complete() and sum(r["rows"] for r in progress.rows) == 4 and len({r["batch"] for r in progress.rows if r["rows"]}) == 4


def test_a_window_is_read_once_for_all_of_its_pages(spark, tmp_path, monkeypatch):
    rows = [(i, "a" if i % 3 else "b", datetime(2024, 1, 1) + timedelta(minutes=i % 50), f"p{i}") for i in range(100)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz, props string").coalesce(1).write.parquet(path)
    reads, read = [], polling._seconds
    monkeypatch.setattr(polling, "_seconds", lambda *a: reads.append(a) or read(*a))
    got = [polling.fetch_events("a", None, float("inf"), at, 10, path) for at in range(0, 80, 10)]
    assert [len(p) for p in got] == [10] * 6 + [6, 0]
    want = sorted(((r[2] - datetime(1970, 1, 1)).total_seconds(), r[0], r[3]) for r in rows if r[1] == "a")
    assert [(t, i, p) for i, t, p in sum(got, [])] == want and len(reads) <= 2


def test_comments_of_ended_threads_are_not_stored():
    import pandas as pd

    class Store(dict):
        puts = 0

        def exists(self):
            return "v" in self

        def get(self):
            return self["v"]

        def update(self, v):
            self["v"] = v

        def updateValue(self, k, v):
            Store.puts += 1
            self[k] = v

        def containsKey(self, k):
            return k in self

    class Handle:
        getMapState = getValueState = lambda self, *_: Store()
        listTimers, deleteTimer, registerTimer = (lambda self: []), (lambda self, t: None), (lambda self, t: None)

    p = threads.ThreadProcessor(10)
    p.init(Handle())
    rows = pd.DataFrame({"comment": [f"c{i // 2}" for i in range(200)], "at": [100 * (i // 2) for i in range(200)]})
    (first,), (again,) = list(p.handleInputRows(("s",), iter([rows]), None)), list(p.handleInputRows(("s",), iter([rows.tail(1)]), None))
    assert len(first) == 100 and first["is_first"].all() and not len(again) and Store.puts == 1
