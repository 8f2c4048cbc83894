"""Sharding by Karmarkar-Karp differencing: shards of nearly equal bytes, groups of rows kept whole.

Rows of one group (here: of equal text) stay in one shard. Group sizes are summed with map-side
combine. Each task then takes the groups of its partition in blocks of at most `block` and runs k-way
differencing on them: every group starts as a partial partition of k subsets (itself and k-1 empty
ones); the two partial partitions of the largest spread are combined, the largest subset of one with
the smallest of the other, until one is left. What a block leaves is again a partial partition, of k
sums. Tasks go on differencing with these, many blocks at a time, until at most `most` are left; the driver
differences those, which fixes the shard of every (block, subset). What the driver gets does not grow with
the table; texts, groups and rows never reach it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window

from .common import read_table, scratch, staged, utf8_size

BLOCK = 1 << 15
#: Partial partitions that the driver gets at most, and that a task combines (in expectation).
MOST = 4096


def differencing(parts: Sequence[Sequence[int]]) -> list[list[int]]:
    """Combine partial partitions (each k sums) to one.

    Returns for each of them the subset of the result that each of its sums went to. Ties of spread go
    to the earlier part, ties of sums to the lower subset, so the result depends on the input only.
    """
    if not len(parts):
        return []
    k, n = len(parts[0]), len(parts)
    heap = []
    kept: dict[int, list[tuple[int, int]]] = {}  # of each open node: (sum, subset), smallest first
    for i, sums in enumerate(parts):
        kept[i] = sorted((s, j) for j, s in enumerate(sums))
        heap.append((kept[i][0][0] - kept[i][-1][0], i))
    heapq.heapify(heap)
    made: list[tuple[int, int, list[int], list[int]]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        x, y = kept.pop(a), kept.pop(b)
        to_a, to_b, sums = [0] * k, [0] * k, []
        for new, ((s, i), (t, j)) in enumerate(zip(x, reversed(y), strict=True)):
            to_a[i] = to_b[j] = new
            sums.append((s + t, new))
        sums.sort()
        node = n + len(made)
        made.append((a, b, to_a, to_b))
        kept[node] = sums
        heapq.heappush(heap, (sums[0][0] - sums[-1][0], node))
    place: dict[int, list[int]] = {n + len(made) - 1 if made else 0: list(range(k))}
    for node in range(n + len(made) - 1, n - 1, -1):
        a, b, to_a, to_b = made[node - n]
        up = place.pop(node)
        place[a] = [up[j] for j in to_a]
        place[b] = [up[j] for j in to_b]
    return [place[i] for i in range(n)]


def block_partition(sizes: Sequence[int], k: int) -> tuple[list[int], list[int]]:
    """The subset of each size, and the k sums."""
    places = differencing([(s, *[0] * (k - 1)) for s in sizes])
    subset, sums = [to[0] for to in places], [0] * k
    for s, j in zip(sizes, subset, strict=True):
        sums[j] += s
    return subset, sums


def shard_by_bytes(df: DataFrame, group_key, size, shards: int = 16, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """df with `shard` (int) and `slot` (long, gapless from 0 in each shard).

    group_key and size are columns: rows of equal non-null group_key share a shard, and so do the rows
    whose group_key is null. Sizes must not be negative or null. An empty table gives an empty result;
    a group larger than a fair share makes a shard of its own that is larger than the others. Columns
    of df named shard or slot are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    with scratch(spark):
        keyed = staged(df.withColumns({"__group": F.coalesce(group_key.cast("string"), F.lit("~")), "__size": size.cast("long")}), "sized")
        groups = keyed.groupBy("__group").agg(F.sum("__size").alias("__bytes"))

        def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task, n = TaskContext.get().partitionId(), 0

            def blocks():
                held, rows = [], 0
                for b in batches:
                    while b.num_rows:
                        held.append(b.slice(0, block - rows))
                        b = b.slice(held[-1].num_rows)
                        rows += held[-1].num_rows
                        if rows == block:
                            yield held
                            held, rows = [], 0
                if held:
                    yield held

            for held in blocks():
                table = pa.Table.from_batches(held)
                sizes = table.column("__bytes").to_pylist()
                subset, _ = block_partition(sizes, shards)
                yield pa.RecordBatch.from_arrays(
                    [table.column("__group").combine_chunks(), table.column("__bytes").combine_chunks(), pa.array([(task << 24) + n] * len(sizes), pa.int64()), pa.array(subset, pa.int32())],
                    names=["__group", "__bytes", "__block", "__subset"],
                )
                n += 1

        grouped = staged(
            groups.sortWithinPartitions(F.desc("__bytes"), "__group").mapInArrow(by_block, "__group string, __bytes long, __block long, __subset int"), "groups"
        )
        where = _subset_shards(grouped.select("__block", F.array(*[F.when(F.col("__subset") == j, F.col("__bytes")).otherwise(0) for j in range(shards)]).alias("__sums")), shards, most)
        where = where.select("__block", F.posexplode("__shards").alias("__subset", "shard"))
        # A third of the rows may be of one group: this is a plain equi-join, of which Spark splits large partitions.
        placed = keyed.join(grouped.select("__group", "__block", "__subset"), "__group").join(where, ["__block", "__subset"])
        return number_rows(placed.drop("__group", "__size", "__block", "__subset"), shards)


def _subset_shards(sums: DataFrame, k: int, most: int) -> DataFrame:
    """__block, __shards: the shard of each of the k subsets of each block, from rows (__block, __sums) that add up by block."""
    spark, levels = sums.sparkSession, []

    def added(rows: DataFrame) -> DataFrame:
        total = rows.groupBy("__block").agg(*[F.sum(F.col("__sums")[j]).alias(f"s{j}") for j in range(k)])
        return staged(total.select("__block", F.array(*[F.col(f"s{j}") for j in range(k)]).alias("__sums")), "sums")

    def combined(table: pa.Table) -> pa.Table:
        table = table.sort_by("__block")
        places = differencing(table.column("__sums").to_pylist())
        return table.append_column("__to", pa.array(places, pa.list_(pa.int32()))).select(["__block", "__parent", "__sums", "__to"])

    def went(j: int):
        """The sum of what went to the subset j."""
        return F.aggregate(F.zip_with("__sums", "__to", lambda s, t: F.when(t == j, s).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)

    left = added(sums)
    while (n := left.count()) > most:
        parent = F.pmod(F.xxhash64("__block"), F.lit(-(-n // most)))
        level = staged(left.withColumn("__parent", parent).groupBy("__parent").applyInArrow(combined, "__block long, __parent long, __sums array<long>, __to array<int>"), "level")
        levels.append(level)
        new = F.array(*[went(j) for j in range(k)])
        left = added(level.select(F.col("__parent").alias("__block"), new.alias("__sums")))
    rows = sorted(left.collect())
    where = spark.createDataFrame([(r[0], to) for r, to in zip(rows, differencing([r[1] for r in rows]), strict=True)], "__block long, __shards array<int>")
    for level in reversed(levels):
        up = where.select(F.col("__block").alias("__parent"), F.col("__shards").alias("__up"))
        where = level.join(up, "__parent").select("__block", F.transform("__to", lambda t: F.col("__up")[t]).alias("__shards"))
    return where


def number_rows(df: DataFrame, shards: int) -> DataFrame:
    """Add slot, the row's number in its shard: each task counts its own rows, then the tasks' counts are added up."""
    schema = T.StructType([*df.schema.fields, T.StructField("__task", T.IntegerType()), T.StructField("__at", T.LongType())])
    names = df.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            shard = b.column("shard").to_numpy(zero_copy_only=False)
            at = np.empty(len(shard), np.int64)
            for s in np.unique(shard):
                mine = np.flatnonzero(shard == s)
                at[mine] = seen[s] + np.arange(len(mine))
                seen[s] += len(mine)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(shard), task, np.int32)), pa.array(at)], names=[*names, "__task", "__at"])

    counted = staged(df.mapInArrow(count, schema), "counted", keep=True)
    before = Window.partitionBy("shard").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = staged(counted.groupBy("__task", "shard").count().select("__task", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base")), "bases", keep=True)
    return counted.join(bases, ["__task", "shard"]).withColumn("slot", F.col("__base") + F.col("__at")).drop("__task", "__at", "__base")


def op1_shard_kk(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, law `bytes`; groups are equal texts, of which the null texts are one."""
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", (utf8_size(F.col("text")) + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.sha2("text", 256).alias("__text"),
    )
    out = shard_by_bytes(rows, F.col("__text"), F.col("size"), shards=16)
    return out.select(
        "doc_id", F.col("size").cast("long").alias("size"), F.col("text_crc32").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
