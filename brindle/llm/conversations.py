"""The prefix trie of conversations, with totals of its subtrees by leaf-peeling message passing.

A node is a sequence of turns that some conversation begins with; it is told by its smallest member and its depth. Every
node waits with the number of its children that have not finished and the exclusive or of their names. A node without any
is finished: it sends its totals to its parent, which counts it off. A node that waits for one child only knows that child
by its name. If this child itself waits for one only, its part is added at once and the node waits for the grandchild
instead, so chains halve with every round, and the number of rounds follows the logarithm of the nodes, not the longest
conversation. Peeling ends when the root has finished. Each round is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import read_table, scratch, small_batches, staged, utf8_size

#: A conversation inherits fewer turns than this.
HEADS = 9
GROUP = 5
_EMPTY_SHA = hashlib.sha256().hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ord (from 1), turn_id (a digest of role and text), bytes (of the text in UTF-8).

    Turns come by turn, null first, ties by role and text. Null roles and texts are empty. Rows without conv_id belong to no
    conversation. One conversation is sorted by one task, which spills; it is never held as a whole.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turn_id = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("ord"), turn_id.alias("turn_id"), utf8_size(F.col("text")).alias("bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation, and its turns (conv_id, depth, turn_id, bytes) after it has got the head of its group's first one.

    Conversation c takes the first h turns of c - c % GROUP and its own ones after its first h, where h is the checksum of c modulo HEADS.
    """
    c, h = F.col("conv_id"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = sizes.filter(c % GROUP == 0).select(c.alias("first"), F.col("n").alias("first_n"))
    members = sizes.select(c, "n", h.alias("h"), (c - c % GROUP).alias("first")).join(first, "first", "left")
    members = members.withColumn("got", F.least("h", F.coalesce("first_n", F.lit(0))))
    own = turns.join(members.select("conv_id", "h", "got"), "conv_id").filter("ord > h").select("conv_id", (F.col("got") + F.col("ord") - F.col("h")).alias("depth"), "turn_id", "bytes")
    heads = turns.filter((c % GROUP == 0) & (F.col("ord") < HEADS)).withColumnRenamed("conv_id", "first")
    inherited = heads.join(members.select("conv_id", "h", "first"), "first").filter("ord <= h").select("conv_id", F.col("ord").alias("depth"), "turn_id", "bytes")
    length = (F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")
    return members.select("conv_id", length), own.unionByName(inherited)


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, depth, turn_id, bytes) with node and parent: 128 bits of what has been said so far."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, node = None, b""
        for b in batches:
            nodes, parents = [], []
            for c, turn in zip(b.column("conv_id").to_pylist(), b.column("turn_id").to_pylist(), strict=True):
                if c != conv:
                    conv, node = c, b""
                parents.append(node)
                node = hashlib.blake2b(node + turn, digest_size=16).digest()
                nodes.append(node)
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("depth"), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), b.column("bytes")],
                names=["conv_id", "depth", "node", "parent", "bytes"],
            )

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return ordered.mapInArrow(chain, "conv_id long, depth long, node binary, parent binary, bytes long")


def member_digests(ends: DataFrame) -> DataFrame:
    """ends (node, conv_id) to node, ends_sha256: of the decimal ids, ascending, joined by commas.

    Ids are sorted over all tasks; a task makes pieces of them, and those of a node are digested one after the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple[bytes, int, list[str]]] = []
            for node, c in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if not rows or rows[-1][0] != node:
                    rows.append((node, c, []))
                rows[-1][2].append(str(c))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.int64()), pa.array([",".join(x[2]) for x in rows], pa.string())],
                names=["node", "first", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        for b in batches:
            nodes, digests = [], []
            for x, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if x == node:
                    sha.update(b",")
                else:
                    if node is not None:
                        nodes.append(node)
                        digests.append(sha.hexdigest())
                    node, sha = x, hashlib.sha256()
                sha.update(ids.encode())
            yield _digests(nodes, digests)
        if node is not None:
            yield _digests([node], [sha.hexdigest()])

    parts = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node binary, first long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node binary, ends_sha256 string")


def _digests(nodes: list[bytes], digests: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])


def trie_nodes(members: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, rest, own_tokens, ends_sha256 of every node; rest is the exclusive or of its children's conv_id.

    members: (conv_id, length); paths: their prefixes, of which those of the full length are where a conversation ends.
    """
    top = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    nodes = paths.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
    )
    root = top.select(F.lit(b"").alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = staged(nodes.unionByName(root), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.bit_xor("conv_id").alias("rest"))
    ended = paths.join(members.withColumnRenamed("length", "depth"), ["conv_id", "depth"], "left_semi").select("node", "conv_id")
    turnless = members.filter("length = 0").select(F.lit(b"").alias("node"), "conv_id")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    all_of = nodes.join(children, "node", "left").join(member_digests(ended.unionByName(turnless)), "node", "left").join(above, "parent", "left")
    return all_of.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("rest", F.lit(0)).alias("rest"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("own_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
    )


def peeled(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, n_leaves, saved_tokens: of every node, the childless nodes and the sum of own_tokens in its subtree."""
    done, one = F.col("remaining") == 0, F.col("remaining") == 1
    state = nodes.select(
        "conv_id", "depth", "parent_conv_id", F.col("n_children").alias("remaining"), "rest", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        F.col("own_tokens").alias("saved_tokens"), F.col("rest").alias("for_conv"), (F.col("depth") + 1).alias("for_depth"),
    )
    rounds = [staged(state, "round")]
    while not rounds[-1].filter(~done).isEmpty():
        finished, waiting = rounds[-1].filter(done), rounds[-1].filter(~done)
        # To parents that count; to nodes that wait for this one only.
        counts = finished.groupBy(F.col("parent_conv_id").alias("to_conv"), (F.col("depth") - 1).alias("to_depth")).agg(
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("n"), F.bit_xor("conv_id").alias("names"))
        totals = finished.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("names"))
        news = counts.withColumn("alone", F.lit(False)).unionByName(totals.withColumn("alone", F.lit(True)))
        heard = waiting.withColumns({
            "alone": one, "to_conv": F.when(one, F.col("for_conv")).otherwise(F.col("conv_id")), "to_depth": F.when(one, F.col("for_depth")).otherwise(F.col("depth")),
        }).join(news, ["to_conv", "to_depth", "alone"], "left")
        got = lambda x: F.coalesce(x, F.lit(0))
        rest = F.col("rest").bitwiseXOR(got("names"))
        heard = heard.select(
            "conv_id", "depth", "parent_conv_id", (F.col("remaining") - got("n")).alias("remaining"), rest.alias("rest"), (F.col("n_leaves") + got("leaves")).alias("n_leaves"),
            (F.col("saved_tokens") + got("saved")).alias("saved_tokens"), F.when(F.col("alone"), F.col("for_conv")).otherwise(rest).alias("for_conv"), "for_depth",
        )
        rounds.append(staged(_shortened(heard, one), "round"))
    return reduce(DataFrame.unionByName, [r.filter(done) for r in rounds]).select("conv_id", "depth", "n_leaves", "saved_tokens")


def _shortened(heard: DataFrame, one: Column) -> DataFrame:
    """Nodes that wait for one which itself waits for one take that one's part and wait for what it waits for."""
    next_ = heard.filter(one).select(
        F.col("conv_id").alias("at_conv"), F.col("depth").alias("at_depth"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"),
        F.col("for_conv").alias("then_conv"), F.col("for_depth").alias("then_depth"),
    )
    met = heard.join(next_, one & (F.col("for_conv") == F.col("at_conv")) & (F.col("for_depth") == F.col("at_depth")), "left")
    return met.select(
        "conv_id", "depth", "parent_conv_id", "remaining", "rest", (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), F.coalesce("then_conv", "for_conv").alias("for_conv"), F.coalesce("then_depth", "for_depth").alias("for_depth"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """A row for every distinct beginning of the rebuilt conversations (see rebuilt and ordered_turns), the textless root among them.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. An empty table has no root. Repeated rows are turns of their own; other columns don't matter.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    with scratch(spark):
        members, turns = rebuilt(staged(ordered_turns(conversations), "turns"))
        members, paths = staged(members, "members"), staged(prefixes(turns), "paths")
        nodes = staged(trie_nodes(members, paths), "trie")
        out = nodes.join(peeled(nodes), ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
        return staged(out, "peeled", keep=True)


def op11_trie_peeling(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations. See conversation_trie for odd input."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"))
