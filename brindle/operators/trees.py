"""Reply trees from parent ids, by pointer doubling: the number of rounds follows the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brindle.sources.shared import rounds


def reply_tree(df: DataFrame, id_: str = "id", parent: str = "parent") -> DataFrame:
    """id, parent, root, depth, top and n_replies of every distinct id.

    A row without a parent, or whose parent is not in the table, is a root of depth 0. top is the ancestor of depth 1 (null
    for roots), n_replies the number of direct answers. Rows without id are left out; of several rows of one id the
    smallest parent counts; rows that answer each other in a circle, and what hangs on it, have no root, depth or top.
    """
    spark = df.sparkSession
    ids = df.filter(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(F.min(parent).alias("parent"))
    with rounds(spark) as write:
        nodes = write(ids)
        known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
        replies = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_replies"))
        # at: the ancestor that is known so far, hops above; below: the one before it on the way.
        state = nodes.join(known, "parent", "left").select(
            "id", F.when(F.col("known"), F.col("parent")).otherwise(F.col("id")).alias("at"), F.when(F.col("known"), 1).otherwise(0).alias("hops"), F.col("id").alias("below"),
        ).withColumn("done", F.col("hops") == 0)
        state, left, reach = write(state), None, 1
        while True:
            open_ = state.filter(~F.col("done")).count()
            # A path of n hops is known after log n rounds; who is then open hangs on a circle.
            if not open_ or (left == open_ and reach > open_):
                break
            left, reach = open_, reach * 2
            step = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"), F.col("below").alias("then"), F.col("done").alias("ends"))
            moved = state.filter(~F.col("done")).join(step, "at").select(
                "id", F.col("next").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), F.when(F.col("more") == 0, F.col("below")).otherwise(F.col("then")).alias("below"), F.col("ends").alias("done"),
            )
            state = write(state.filter("done").unionByName(moved))
        found = F.col("done")
        out = nodes.join(state, "id").join(replies.withColumnRenamed("parent", "id"), "id", "left").select(
            "id", "parent", F.when(found, F.col("at")).alias("root"), F.when(found, F.col("hops")).alias("depth"),
            F.when(found & (F.col("hops") > 0), F.col("below")).alias("top"), F.coalesce("n_replies", F.lit(0)).alias("n_replies"),
        )
        return write(out)


def threads(tree: DataFrame) -> DataFrame:
    """root, n, n_top (answers to the root itself), depth of every root of reply_tree's rows."""
    return tree.filter("root IS NOT NULL").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") == 1).alias("n_top"), F.max("depth").alias("depth"))
