"""Nearest neighbours by inner product over balanced posting lists.

Vectors get one more component, sqrt(M**2 - |x|**2) with M the largest norm, so that the largest inner
product is the smallest Euclidean distance. A sample, which grows with the table up to a bound, is halved
again and again at the median of a direction, which gives lists of equal size; their means are the
centroids. Every distinct vector goes to the list of its nearest centroid and, if it lies near a border, to
further ones. Centroids are found through a neighbour graph held in memory. A query reads the lists whose
centroid is at most `ratio` times as far as the nearest; the ratio is fitted on the sample, to find `target`
of its neighbours.

Lists are dealt to buckets by their real sizes: short ones share a bucket, a long one is cut into several,
and a bucket that very many queries read is read in several groups of them. So a task holds a bounded number
of vectors and queries, however large the table or a list is.

Equal vectors are one entry with their smallest k + 1 ids, which is all that k neighbours can need.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from .common import read_table, scratch, staged

K = 20
#: Vectors (in expectation) that the centroids are fitted on: one in SAMPLE_SHARE, within these bounds. A list needs eight of them.
SAMPLE_SHARE, LEAST_SAMPLE, MOST_SAMPLE = 32, 8_192, 131_072
#: Vectors of the sample that fit the ratio, and the share of their neighbours to be found.
PROBES = 256
TARGET = 0.95
#: Rows of a list that the number of lists aims at.
LIST_ROWS = 256
#: A vector goes to up to COPIES lists whose centroids are at most BORDER times as far as the nearest.
COPIES = 4
BORDER = 1.015
DEGREE = 16
#: Vectors, and queries, of a task.
BUCKET_ROWS = 8192
QUERY_ROWS = 8192


def centroids_of(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of `lists` parts of equal size (a power of two), by halving."""
    parts = [np.arange(len(x))]
    rng = np.random.default_rng(7)
    while 2 * len(parts) <= lists and min(map(len, parts)) >= 4:
        halves = []
        for p in parts:
            y = x[p]
            a, b = y[rng.choice(len(p), 2, replace=False)]
            for _ in range(6):
                near = ((y - a) ** 2).sum(1) < ((y - b) ** 2).sum(1)
                if near.all() or not near.any():
                    break
                a, b = y[near].mean(0), y[~near].mean(0)
            order = np.argsort(y @ (b - a), kind="stable")
            halves += [p[order[: len(p) // 2]], p[order[len(p) // 2 :]]]
        parts = halves
    return np.array([x[p].mean(0) for p in parts])


class CentroidGraph:
    """Centroids with the edges to their nearest ones; finds the nearest centroids of many points at once."""

    def __init__(self, centroids: np.ndarray):
        self.c = np.ascontiguousarray(centroids, np.float32)
        self.norms = (self.c.astype(np.float64) ** 2).sum(1).astype(np.float32)
        n = len(self.c)
        near = []
        for at in range(0, n, 512):
            d = self.norms[None, :] - 2 * self.c[at : at + 512] @ self.c.T
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            near.append(np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE, max(1, n - 1))])
        self.edges = np.concatenate(near)
        # Long edges keep the graph connected.
        rng = np.random.default_rng(11)
        self.edges = np.concatenate([self.edges, rng.integers(0, n, (n, 4)), ((np.arange(n) + 1) % n)[:, None]], axis=1)
        self.entries = rng.permutation(n)[: max(8, int(np.sqrt(n)))]

    def search(self, q: np.ndarray, most: int, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of up to `most` nearest centroids of each row, nearest first."""
        n, rows = len(self.c), np.arange(len(q))[:, None]
        most = min(most, n)
        q = q.astype(np.float32)
        own = (q.astype(np.float64) ** 2).sum(1).astype(np.float32)
        seen, last = np.zeros((len(q), n), bool), np.zeros((len(q), n), np.int16)
        seen[:, self.entries] = True
        ids = np.broadcast_to(self.entries, (len(q), len(self.entries)))
        dist = self.norms[self.entries][None, :] - 2 * q @ self.c[self.entries].T
        done = np.zeros(ids.shape, bool)
        while True:
            ids, dist, done = self._best(ids, dist, done, most)
            todo = np.where(done, np.inf, dist)
            pick = np.argsort(todo, axis=1, kind="stable")[:, :beam]
            open_ = np.isfinite(todo[rows, pick])
            if not open_.any():
                break
            done = done.copy()
            done[rows, pick] = True
            nb = np.where(np.repeat(open_, self.edges.shape[1], axis=1), self.edges[ids[rows, pick]].reshape(len(q), -1), self.entries[0])
            fresh = ~seen[rows, nb]
            # The same neighbour twice in a row counts once: the place that wrote last.
            last[rows, nb] = np.arange(nb.shape[1], dtype=np.int16)
            fresh &= last[rows, nb] == np.arange(nb.shape[1], dtype=np.int16)
            seen[rows, nb] = True
            d = np.where(fresh, self.norms[nb] - 2 * np.matmul(self.c[nb], q[:, :, None])[:, :, 0], np.inf)
            ids, dist, done = np.concatenate([ids, nb], 1), np.concatenate([dist, d], 1), np.concatenate([done, ~fresh], 1)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        return ids, np.sqrt(np.maximum(dist + own[:, None], 0))

    @staticmethod
    def _best(ids, dist, done, most):
        if ids.shape[1] <= most:
            return ids, dist, done
        keep = np.argpartition(dist, most - 1, axis=1)[:, :most]
        return np.take_along_axis(ids, keep, 1), np.take_along_axis(dist, keep, 1), np.take_along_axis(done, keep, 1)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0))[:, None]], axis=1)


def aimed(q: np.ndarray, largest: float) -> np.ndarray:
    """Queries at the length of the largest vector: their length does not change which rows are nearest."""
    q = q.astype(np.float64)
    q = q / np.sqrt((q**2).sum(1))[:, None] * largest
    return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


class ListIndex:
    """Where rows go and where queries look."""

    def __init__(self, sample: np.ndarray, largest: float, rows: int, target: float = TARGET):
        self.largest, self.copies, self.border = largest, COPIES, BORDER
        lists = 1 << max(0, int(np.log2(max(1, min(rows / LIST_ROWS, len(sample) / 8)))))
        x = lifted(sample, largest)
        self.graph = CentroidGraph(centroids_of(x, lists))
        self.ratio, self.first = 1.0, 1
        if lists > 1:
            self._fit_ratio(sample, target, rows)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and their lists: the nearest one and, for rows near a border, those beyond it."""
        ids, dist = self.graph.search(lifted(x, self.largest), self.copies + 2)
        near = dist[:, : self.copies] <= self.border * dist[:, :1]
        row, at = np.nonzero(near)
        return row, ids[row, at]

    def looks(self, q: np.ndarray) -> list[np.ndarray]:
        """The lists that each query reads."""
        points, out = aimed(q, self.largest), [None] * len(q)
        todo, most = np.arange(len(q)), self.first
        while len(todo):
            ids, dist = self.graph.search(points[todo], most)
            near = dist <= self.ratio * dist[:, :1]
            full = near.all(axis=1) & (most < len(self.graph.c))
            for i in np.flatnonzero(~full):
                out[todo[i]] = ids[i][near[i]]
            todo, most = todo[full], most * 2
        return out

    def _fit_ratio(self, sample: np.ndarray, target: float, rows: int) -> None:
        probes = np.unique(np.linspace(0, len(sample) - 1, PROBES).astype(np.int64))
        q, x = sample[probes].astype(np.float64), sample.astype(np.float64)
        score = q @ x.T
        score[np.arange(len(probes)), probes] = -np.inf
        # As near as K of all rows are these of the sample.
        k = min(len(sample) - 1, max(2, -(-K * len(sample) // rows)))
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        where: dict[int, list[int]] = {}
        wanted = np.unique(best)
        for at in range(0, len(wanted), 1024):
            for i, j in zip(*self.places(sample[wanted[at : at + 1024]]), strict=True):
                where.setdefault(int(wanted[at + i]), []).append(int(j))
        points, c = aimed(q, self.largest), self.graph.c.astype(np.float64)
        dist = np.sqrt(np.maximum((points**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * points @ c.T, 0))
        need = np.array([min(dist[a, j] for j in where[b]) / max(dist[a].min(), 1e-12) for a in range(len(probes)) for b in best[a].tolist()])
        self.ratio = float(np.quantile(need, target)) * (1 + 1e-6)
        self.first = int(np.quantile((dist <= self.ratio * dist.min(1, keepdims=True)).sum(1), 0.9)) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


class Buckets:
    """Where the entries of each list are: `parts` buckets from the bucket `first` on."""

    def __init__(self, sizes: dict[int, int], lists: int, rows: int = BUCKET_ROWS):
        self.first, self.parts = np.zeros(lists, np.int64), np.ones(lists, np.int64)
        bucket, held = 0, 0
        for i in range(lists):
            n = sizes.get(i, 0)
            if held and held + n > rows:
                bucket, held = bucket + 1, 0
            self.first[i] = bucket
            held += n
            if n > rows:
                self.parts[i] = -(-n // rows)
                bucket, held = bucket + self.parts[i], 0

    def of(self, lists: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The bucket of each entry (list, node)."""
        with np.errstate(over="ignore"):
            mixed = (nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[lists] + (mixed % self.parts[lists].astype(np.uint64)).astype(np.int64)

    def read(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that hold some of these lists, and for each such pair the list."""
        parts = self.parts[lists]
        begin = np.cumsum(parts) - parts
        return np.repeat(self.first[lists] - begin, parts) + np.arange(int(parts.sum())), np.repeat(lists, parts)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v: distinct rows of finite, non-zero vectors, floats as they are and other numbers as doubles."""
    v = F.col(vector_col)
    if df.select(v).schema[0].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(finite & F.exists("v", lambda x: x != 0)).distinct()


def search_lists(df: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank (from 1), id, score for the rows for which is_query(id column) is true.

    Candidates are all valid rows but those of the query's own id; ties of score go to the smaller id.
    Vectors that are null, zero, or hold null or non-finite components take no part, and rows of null id
    neither; repeated rows count once. Vectors of different lengths have no inner product: each meets those of
    its own length, of which there is one index each. An id with several different vectors is a candidate with
    each of them, and as a query has one list, with the best score of each candidate. Fewer than k candidates
    give fewer rows.
    """
    spark = df.sparkSession
    with scratch(spark):
        rows = staged(valid_vectors(df, id_col, vector_col), "vectors")
        lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
        found = [staged(_search(rows.filter(F.size("v") == n) if len(lengths) > 1 else rows, is_query, k), "found", keep=True) for n in lengths]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    each = reduce(DataFrame.union, found).groupBy("query_id", "id", "node").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "node"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _search(rows: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, id, node, score: the k best of each query's vector among rows (id, v) of one length."""
    spark = rows.sparkSession
    element = rows.schema["v"].dataType.elementType.simpleString()
    # Spark limits each group before the shuffle, so a vector of very many rows sends k + 1 a task.
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    # Ids may repeat with other vectors, so entries have numbers of their own; they are written before they are used.
    nodes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("node"), "v", "ids")
    nodes = staged(nodes, "nodes")
    total, largest = nodes.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    sample = min(MOST_SAMPLE, max(LEAST_SAMPLE, total // SAMPLE_SHARE))
    drawn = nodes.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(min(1.0, sample / total) * (1 << 30))).select(F.col("ids")[0].alias("id"), "v").toArrow().sort_by("id")
    if not len(drawn):
        drawn = nodes.select("v").limit(1).toArrow()
    index = ListIndex(_matrix(drawn.column("v").combine_chunks()), float(np.sqrt(largest)), total)
    shared = spark.sparkContext.broadcast(index)
    copies = index.copies

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                i, lists = shared.value.places(_matrix(part.column("v")))
                i = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), part.column("node").take(i), part.column("v").take(i)], names=["list", "node", "v"])

    placed = staged(nodes.select("node", "v").mapInArrow(place, f"list int, node long, v array<{element}>"), "postings")
    # One number a list: at most an eighth of the sample.
    sizes = {r[0]: r[1] for r in placed.groupBy("list").count().collect()}
    buckets = spark.sparkContext.broadcast(Buckets(sizes, len(index.graph.c)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = buckets.value.of(b.column("list").to_numpy(), b.column("node").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *b.columns], names=["bucket", *b.schema.names])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, bucket, lists = [], [], []
                for i, found in enumerate(shared.value.looks(_matrix(part.column("v")))):
                    by, of = buckets.value.read(found)
                    for x in np.unique(by):
                        rows.append(i)
                        bucket.append(x)
                        lists.append(of[by == x].tolist())
                i = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(lists, pa.list_(pa.int32())), part.column("node").take(i), part.column("v").take(i)], names=["bucket", "lists", "node", "v"])

    def nearest(key, members: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64())])
        if not len(members) or not len(queries):
            return schema.empty_table()
        x, q = (_matrix(t.column("v").combine_chunks()).astype(np.float64) for t in (members, queries))
        node, of, asked = members.column("node").to_numpy(), members.column("list").to_numpy(), queries.column("node").to_numpy()
        wanted = queries.column("lists").combine_chunks()
        pair_q = np.repeat(np.arange(len(q)), np.diff(wanted.offsets.to_numpy()))
        pair_l = wanted.flatten().to_numpy()
        # Of each query the best so far: one list after the other is merged in, so memory holds one list's scores.
        # A vector may come as often as it was placed.
        hold = copies * (k + 1) + 8
        top, where = np.full((len(q), hold), -np.inf), np.full((len(q), hold), -1)
        for one in np.unique(pair_l):
            mine, who = np.flatnonzero(of == one), pair_q[pair_l == one]
            for at in range(0, len(who), 512) if len(mine) else ():
                some = who[at : at + 512]
                score = np.concatenate([top[some], q[some] @ x[mine].T], axis=1)
                from_ = np.concatenate([where[some], np.broadcast_to(mine, (len(some), len(mine)))], axis=1)
                keep = np.argpartition(-score, hold - 1, axis=1)[:, :hold]
                top[some], where[some] = np.take_along_axis(score, keep, 1), np.take_along_axis(from_, keep, 1)
        got_q, slot = np.nonzero(where >= 0)
        got_x = where[got_q, slot]
        score = np.concatenate([np.zeros(0), *((q[got_q[i : i + 65536]] * x[got_x[i : i + 65536]]).sum(1) for i in range(0, len(got_q), 65536))])
        order = np.lexsort((node[got_x], -score, got_q))
        got_q, got_x, score = got_q[order], got_x[order], score[order]
        # A vector that is in several lists comes right after itself.
        fresh = np.concatenate([np.ones(min(1, len(got_q)), bool), (got_q[1:] != got_q[:-1]) | (node[got_x[1:]] != node[got_x[:-1]])])
        got_q, got_x, score = got_q[fresh], got_x[fresh], score[fresh]
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(got_q)), bool), got_q[1:] != got_q[:-1]]))
        rank = np.arange(len(got_q)) - np.repeat(begin, np.diff(np.append(begin, len(got_q))))
        keep = rank <= k
        return pa.table({"query": asked[got_q[keep]], "node": node[got_x[keep]], "score": score[keep]}, schema=schema)

    asked = staged(rows.filter(is_query(F.col("id"))).join(nodes.select("v", "node"), "v").select("id", "node"), "asked")
    queries = nodes.select("node", "v").join(asked.select("node").distinct(), "node", "left_semi")
    routed = staged(queries.mapInArrow(look, f"bucket long, lists array<int>, node long, v array<{element}>"), "routed")
    groups = routed.groupBy("bucket").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
    members = placed.mapInArrow(deal, f"bucket long, list int, node long, v array<{element}>").join(groups, "bucket").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    readers = routed.join(groups, "bucket").withColumn("group", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
    found = members.drop("groups").groupBy("bucket", "group").cogroup(readers.drop("groups").groupBy("bucket", "group")).applyInArrow(nearest, "query long, node long, score double")
    # The same vector may come from several lists: equal rows have one rank. Spark limits each group before the shuffle.
    best = F.dense_rank().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    hits = found.withColumn("r", best).filter(F.col("r") <= k + 1).select("query", "node", "score").distinct()
    hits = hits.join(nodes.select("node", "ids"), "node").select("query", "score", "node", F.explode("ids").alias("id"))
    lists = hits.groupBy("query").agg(F.collect_list(F.struct("score", "id", "node")).alias("f")).select("query", F.slice(F.array_sort("f", _by_score("id")), 1, k + 1).alias("f"))
    own = asked.join(lists, asked["node"] == lists["query"]).select("id", F.slice(F.filter("f", lambda e: e["id"] != F.col("id")), 1, k).alias("f"))
    return own.select(F.col("id").alias("query_id"), F.explode("f").alias("e")).select("query_id", F.col("e.id").alias("id"), F.col("e.node").alias("node"), F.col("e.score").alias("score"))


def _by_score(then: str):
    def compare(a, b):
        return (
            F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a[then] < b[then], -1).when(a[then] > b[then], 1).otherwise(0)
        )

    return compare


def brute_force(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, k: int = K) -> pd.DataFrame:
    """What an exact search gives; for tests and for measuring recall."""
    x = x.astype(np.float64)
    out = []
    for q in query_ids:
        score = (x * x[ids == q][0]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out += [(int(q), r + 1, int(ids[i]), float(score[i])) for r, i in enumerate(order)]
    return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])


def op4_ann_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every row whose vec_id is divisible by 20."""
    found = search_lists(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
