"""Exact, keyed and near-duplicate removal."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from brindle.sources.shared import rounds


def keep_first(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first in `order`. Null keys are equal to each other."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def keep_last(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last row of each key by `order` (columns in descending order); null keys go."""
    return keep_first(df.filter(F.col(key).isNotNull()), [key], order)


def exact_dedup(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """The first row of each text as read; missing texts are one text."""
    return keep_first(df, [F.coalesce(F.col(text), F.lit("nan"))], order)


def dedup_by_id_or_url(df: DataFrame, order: Sequence[str], id_: str = "id", url: str = "url") -> DataFrame:
    """By id, or by url where no row has an id."""
    return keep_first(df, [url if df.filter(F.col(id_).isNotNull()).isEmpty() else id_], order)


def word_set(c: Column) -> Column:
    """Distinct lower-case white-space tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda t: t != ""))


def _token_sets(df: DataFrame, id_: str, text: str) -> DataFrame:
    """id, digest and w of every row: the sorted 64-bit hashes of its word set, and 128 bits of those."""
    w = F.sort_array(F.transform(word_set(F.col(text)), lambda t: F.xxhash64(t)))
    rows = df.select(F.col(id_).alias("id"), w.alias("w"))
    return rows.withColumn("digest", F.md5(F.array_join(F.transform("w", lambda h: h.cast("string")), ",").cast("binary")))


#: Words of 64 bits in the sketch of a token set, and in the one of a part.
SKETCH, FOLDED = 16, 4
#: Keys of a set, each of the least tokens of so many of its SKETCH slices.
KEYS = 4
#: Tokens of a part at most, or about: larger sets are cut by the hash of the token.
PART = 512
#: Sets are compared in blocks of about BLOCK by BLOCK sets at most, and of about so many tokens a side.
BLOCK, BLOCK_TOKENS = 1024, 1 << 20


def _slots_apart(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, c: n + c)


def _most_apart(threshold: float, size: Column) -> Column:
    """Tokens in which two sets of this size together differ at most, if they are near."""
    return F.lit((1 - threshold) / (1 + threshold)) * size + 1e-9


def _held(pairs: DataFrame, groups: DataFrame, sets: DataFrame, write) -> DataFrame:
    """id, w of the different sets that are in a pair; the token sets of all other rows stay where they are.

    groups has id and digest of the different sets, sets holds the sets themselves, which may repeat.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    met = write(groups.select("id", "digest").join(ids, "id", "left_semi"))
    return write(sets.join(met, ["id", "digest"], "left_semi").groupBy("id", "digest").agg(F.first("w").alias("w")))


def _verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    side = lambda s: held.select(F.col("id").alias(s), F.col("w").alias(f"w{s}"))
    both = F.size(F.array_intersect("wa", "wb"))
    jaccard = both / (F.size("wa") + F.size("wb") - both)
    return pairs.join(side("b"), "b").join(side("a"), "a").withColumn("jaccard", jaccard).filter(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


#: Slots that tokens are counted in for the order of a prefix filter; what the driver gets is this many counts, whatever the input.
RARITY_SLOTS = 1 << 16


def _rarity(sets: DataFrame) -> np.ndarray:
    """The size class (half powers of two) of the count of each slot's tokens; counts by slot are summed before the shuffle.

    Any common order of tokens gives exact results; only how many rows meet follows from it.
    """
    slot = F.pmod("t", F.lit(RARITY_SLOTS)).cast("int")
    out = np.zeros(RARITY_SLOTS, np.uint8)
    for at, n in sets.select(F.explode("w").alias("t")).groupBy(slot).count().collect():
        out[at] = int(2 * math.log2(1 + n))
    return out


def _xored(at: np.ndarray, tokens: np.ndarray, rows: int, words: int) -> np.ndarray:
    """For each row and each of words * 64 slots whether an odd number of its tokens fall there."""
    out = np.zeros(rows * words, np.uint64)
    np.bitwise_xor.at(out, at * words + ((tokens >> 6) & (words - 1)), np.uint64(1) << (tokens & 63).view(np.uint64))
    return out.reshape(rows, words).view(np.int64)


def _classes(n: np.ndarray) -> np.ndarray:
    """k: sets of n tokens are cut into 2^k parts."""
    return np.ceil(np.log2(np.maximum(n, PART) / PART)).astype(np.int64)


def _parts_of(row: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """k, and of each part of a set: the set, its sketch, where its head begins and ends in the tokens that are yielded last.

    row and tokens are in order of the sets, and rare tokens come first. A pair is met with k of the larger set, which the
    smaller one has, too. Near sets x and y differ in at most d = (1 - t) / (1 + t) (|x| + |y|) tokens, so in one of 2^k parts in
    d / 2^k at most, and there the first common token has at most as many before it. If there is none, both parts are short.
    """
    fit = sizes >= threshold / (1 - threshold) - 1e-9
    low, high = _classes(sizes), _classes(np.floor(sizes / threshold + 1e-9))
    for k in range(int(high.max(initial=0)) + 1):
        mine = fit & (low <= k) & (k <= high)
        if not mine.any():
            continue
        number = np.cumsum(mine) - 1
        sets = np.flatnonzero(mine)
        chosen = mine[row]
        t = tokens[chosen]
        part = (number[row[chosen]] << k) + ((t >> 40) & ((1 << k) - 1))
        order = np.argsort(part, kind="stable")
        part, t = part[order], t[order]
        count = np.bincount(part, minlength=len(sets) << k)
        begin = np.cumsum(count) - count
        n = np.repeat(sizes[sets], 1 << k)
        # In a set that is whole, at most (1 - t) n tokens are not in the other one.
        most = n - np.ceil(threshold * n - 1e-9).astype(np.int64) if k == 0 else np.floor(((1 - threshold) / threshold * n + 1e-9) / (1 << k)).astype(np.int64)
        keep = np.arange(len(t)) - begin[part] <= most[part]
        # Short parts meet in a token that is none, after their own.
        short = np.flatnonzero((count <= most) & (k > 0))
        head = np.concatenate([t[keep] ^ (k * 0x5851F42D4C957F2D & (1 << 62) - 1), (short & ((1 << k) - 1)) * 0x2545F4914F6CDD1D + k])
        at = np.concatenate([part[keep], short])
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(count)))
        yield k, np.repeat(sets, 1 << k), _xored(part, t, len(count), FOLDED), ends, head[order]


PARTS = f"array<struct<k: int, {', '.join(f'f{i}: bigint' for i in range(FOLDED))}, head: array<bigint>>>"


def _heads(sets: DataFrame, threshold: float) -> DataFrame:
    """id (the smallest), digest, size, s, keys and parts of the different sets that may be near others.

    s: for each of 1,024 slots whether an odd number of tokens fall there. Two sets differ in at least as many tokens as their
    sketches do in slots, so a pair can be ruled out without its sets. keys: sets of similarity j have each one in common with
    about j^4. parts: k, sketch and head (first tokens, rare ones first) of the set, or of each of its parts if it is large.
    """
    rarity = _rarity(sets)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = b.column("w")
            sizes, tokens = w.value_lengths().to_numpy().astype(np.int64), w.flatten().to_numpy()
            row = np.repeat(np.arange(len(w)), sizes)
            sketch = _xored(row, tokens, len(w), SKETCH)
            least = np.full(len(w) * SKETCH, np.iinfo(np.int64).max)
            np.minimum.at(least, row * SKETCH + ((tokens >> 6) & (SKETCH - 1)), tokens)
            least = least.view(np.uint64).reshape(len(w), KEYS, SKETCH // KEYS)
            keys = np.zeros((len(w), KEYS), np.uint64) + np.arange(KEYS, dtype=np.uint64)
            for i in range(SKETCH // KEYS):
                keys = (keys ^ least[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(32)
            order = np.lexsort((tokens, rarity[tokens & (RARITY_SLOTS - 1)], row))
            found = list(_parts_of(row, tokens[order], sizes, threshold))
            owner = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
            columns = [pa.array(np.concatenate([np.zeros(0, np.int32), *(np.full(len(x[1]), x[0], np.int32) for x in found)]))]
            columns += [pa.array(np.concatenate([np.zeros(0, np.int64), *(x[2][:, i] for x in found)])) for i in range(FOLDED)]
            ends, base = [np.zeros(1, np.int64)], 0
            for x in found:
                ends.append(x[3] + base)
                base += len(x[4])
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *(x[4] for x in found)]))))
            parts = pa.StructArray.from_arrays(columns, names=["k", *(f"f{i}" for i in range(FOLDED)), "head"]).take(pa.array(np.argsort(owner, kind="stable")))
            lists = lambda v, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), v)
            each = [lists(pa.array(v.reshape(-1).view(np.int64)), np.full(len(w), v.shape[1])) for v in (sketch, keys)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("digest"), pa.array(sizes.astype(np.int32)), *each, lists(parts, np.bincount(owner, minlength=len(w)))], names=["id", "digest", "size", "s", "keys", "parts"])

    rows = sets.select("id", "digest", "w").mapInArrow(heads, f"id {sets.schema['id'].dataType.simpleString()}, digest string, size int, s array<bigint>, keys array<bigint>, parts {PARTS}")
    return rows.groupBy("digest").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("size", "s", "keys", "parts")])


def _close(pairs: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches leave it open that they are near."""
    side = lambda x: own.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"), F.col("size").alias(f"n{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.filter(_slots_apart(F.col("sa"), F.col("sb")) <= _most_apart(threshold, F.col("na") + F.col("nb"))).select("a", "b")


def _stars(buckets: DataFrame) -> DataFrame:
    """a, b: the smallest id of each bucket of (id, key) with every other one."""
    first = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    return buckets.join(first, "key").filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def _across(own: DataFrame, cells: DataFrame, threshold: float, write) -> DataFrame:
    """The pairs of sets of different cells that sketches leave open; sets without a cell are cells of their own.

    The sketch of a part goes with every token of its head, so that pairs are ruled out where they meet and hardly any is shuffled.
    """
    folded = [f"f{i}" for i in range(FOLDED)]
    # Written, so that both sides of the join below are one plain scan and share its shuffle.
    placed = write(own.join(cells, "id", "left").select("id", "size", F.coalesce("representative", "id").alias("cell"), "parts"))
    rows = placed.select("id", "size", "cell", F.explode("parts").alias("part"))
    head = rows.select("id", "size", "cell", "part.k", *[f"part.{f}" for f in folded], F.posexplode("part.head").alias("at", "t"))
    a, b = head.alias("a"), head.alias("b")
    near = (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.cell") != F.col("b.cell")) & (F.col("a.k") == F.col("b.k"))
    near = near & (F.least("a.size", "b.size") >= threshold * F.greatest("a.size", "b.size"))
    most = _most_apart(threshold, F.col("a.size") + F.col("b.size")) / F.expr("shiftleft(1, a.k)")
    apart = sum((F.bit_count(F.col(f"a.{f}").bitwiseXOR(F.col(f"b.{f}"))) for f in folded), F.lit(0))
    # A short part's own mark stands behind its tokens, which are no more than `most` of its own set.
    open_ = near & (apart <= most) & ((F.col("a.k") > 0) | (F.col("a.at") + F.col("b.at") <= most))
    met = write(a.join(b, open_).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct())
    return write(_close(met, own, threshold))


def _common(left: pa.ListArray, right: pa.ListArray) -> np.ndarray:
    """How many tokens each set of the left has in common with each of the right."""
    at = [np.repeat(np.arange(len(x)), x.value_lengths().to_numpy()) for x in (left, right)]
    _, token, n = np.unique(np.concatenate([x.flatten().to_numpy() for x in (left, right)]), return_inverse=True, return_counts=True)
    # A token of one set alone is common to none.
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[token]
    sides = [(row[c >= 0], c[c >= 0]) for row, c in zip(at, np.split(column, [len(at[0])]), strict=True)]
    sides = [(row[order], c[order]) for (row, c) in sides for order in [np.argsort(c, kind="stable")]]
    out = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int((n > 1).sum()), 2048):
        x, y = (np.zeros((len(t), 2048), np.float32) for t in (left, right))
        for m, (row, c) in zip((x, y), sides, strict=True):
            part = slice(*np.searchsorted(c, (begin, begin + 2048)))
            m[row[part], c[part] - begin] = 1
        out += x @ y.T
    return out.astype(np.int64)


def _within(cells: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """a, b, jaccard of the near pairs within a cell: its sets are sent to blocks and compared there, so a pair costs no row before it is known to be near."""
    sizes = held.select("id", F.size("w").alias("n")).join(cells, "id").groupBy("representative").agg(F.count("*").alias("n"), F.sum("n").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    rows = cells.join(sizes.filter("n > 1").select("representative", blocks.alias("blocks")), "representative")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("id", "representative", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = held.schema["id"].dataType.simpleString()

    def near(t: pa.Table) -> pa.Table:
        own, ids = t.column("own").to_numpy(), t.column("id").combine_chunks()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        w = t.column("w").combine_chunks()
        both = _common(w.take(pa.array(left)), w.take(pa.array(right)))
        n = w.value_lengths().to_numpy()
        jaccard = both / (n[left][:, None] + n[right][None, :] - both)
        x, y = np.nonzero((jaccard >= threshold) & ((i != j) | (np.arange(len(left))[:, None] < np.arange(len(right))[None, :])))
        return pa.table({"x": ids.take(pa.array(left[x])), "y": ids.take(pa.array(right[y])), "jaccard": jaccard[x, y]})

    found = rows.join(held.select("id", "w"), "id").groupBy("representative", "i", "j").applyInArrow(near, f"x {kind}, y {kind}, jaccard double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def _near(df: DataFrame, id_: str, text: str, threshold: float, write) -> tuple[DataFrame, DataFrame]:
    """id and digest of the different sets, the smallest id of each; a, b and jaccard of those that are near.

    Sets that are linked through the smallest of a bucket make a cell. Within cells all are compared in blocks, so that a set
    is sent with its block and not with each of its pairs; between cells, those that meet in a prefix and have close sketches.
    """
    sets = write(_token_sets(df, id_, text))
    heads = write(_heads(sets, threshold))
    own = heads.filter(F.size("parts") > 0)
    stars = _close(_stars(own.select("id", F.explode("keys").alias("key"))), own, threshold)
    # One pair a set is enough: what no cell holds is met between cells.
    stars = write(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    held = _held(stars, heads, sets, write)
    links = write(_verified(stars, held, threshold).select("a", "b"))
    cells = write(_smallest_linked(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), links, write))
    near = write(_within(cells, held, threshold))
    across = _across(own, cells, threshold, write)
    if not across.isEmpty():
        near = near.unionByName(write(_verified(across, _held(across, heads, sets, write), threshold)))
    return heads.select("id", "digest"), near


def near_dup_pairs(df: DataFrame, id_: str, text: str, threshold: float = 0.85) -> DataFrame:
    """a < b, jaccard of all pairs of different token sets of at least this similarity, exactly (tokens by 64 bits of hash).

    Prefix filtering: with tokens in order of rarity, two sets of similarity t share one of the first
    (1 - t) n + 1 tokens of each, so only rows that meet in such a token, with enough tokens left and sketches that are close
    enough, are compared. Equal sets are compared once, through the smallest id of each. Sets of fewer than t / (1 - t) tokens are near none but
    themselves, so short texts that share a frequent word are not compared.
    """
    with rounds(df.sparkSession) as write:
        return write(_near(df, id_, text, threshold, write)[1])


def near_dedup(df: DataFrame, id_: str, text: str, threshold: float = 0.85) -> DataFrame:
    """The rows that are the smallest neighbour (or self) of some row.

    Rows are neighbours if their token sets are equal or near; the rule is not transitive: with a near b,
    b near c, but a not near c, both a and b stay.
    """
    with rounds(df.sparkSession) as write:
        groups, near = _near(df, id_, text, threshold, write)
        low = near.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("low"))
        keep = write(groups.select("id").join(low, "id", "left").select(F.coalesce("low", "id").alias(id_)).distinct())
    return df.join(keep, id_, "left_semi")


def _band_keys(permutations: int, bands: int):
    """A function of an array of 64-bit hashes: for each band a hash of its least values under random affine permutations; null for an empty array."""
    rng = np.random.default_rng(7)
    odd, plus = (rng.integers(0, 1 << 63, permutations, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, permutations, np.uint64))
    fold = rng.integers(0, 1 << 63, permutations // bands, np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf("array<long>")
    def keys(sets: pd.Series) -> pd.Series:
        sizes = np.array([len(x) for x in sets], np.int64)
        full = np.flatnonzero(sizes)
        h = np.concatenate([np.asarray(sets.iloc[i], np.int64) for i in full]).view(np.uint64) if len(full) else np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)
        out = pd.Series([None] * len(sets), dtype=object)
        if not len(full):
            return out
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        found = np.zeros((bands, len(full)), np.uint64)
        for k in range(permutations):
            x = h * odd[k] + plus[k]
            x ^= x >> np.uint64(32)
            least = np.minimum.reduceat(x, first)
            found[k // (permutations // bands)] += least * fold[k % (permutations // bands)]
        for i, row in zip(full, np.ascontiguousarray(found.T).view(np.int64), strict=True):
            out.iloc[i] = row
        return out

    return keys


def minhash_groups(df: DataFrame, id_: str, text: str, threshold: float = 0.85, permutations: int = 128, bands: int = 16) -> DataFrame:
    """id_, representative of every row with an id: rows of near or equal word sets, directly or through others, have one, the smallest id.

    A set's signature is the least hash of its words under each permutation. Sets that agree in a whole band share a
    bucket; each is compared, exactly, with the smallest id of the bucket only, so a cluster of n gives n pairs a band, not
    n squared. A pair at the threshold shares a band with probability 0.994 (16 bands of 8). Links that this leaves out are found
    exactly, by the prefix filter, between the sets that are not connected yet.
    """
    with rounds(df.sparkSession) as write:
        sets = write(_token_sets(df.filter(F.col(id_).isNotNull()), id_, text))
        keyed = sets.select("id", "digest", F.transform(_band_keys(permutations, bands)(F.col("w")), lambda k, b: F.xxhash64(b, k)).alias("keys"))
        groups = write(keyed.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys")))
        pairs = write(_stars(write(groups.select("id", F.explode("keys").alias("key")))))
        links = write(_verified(pairs, _held(pairs, groups, sets, write), threshold).select("a", "b"))
        # Every link is followed: from each set to the smallest one that is linked to it, then over what is linked still.
        of_set = write(_smallest_linked(groups.select("id"), links, write))
        own = write(_heads(sets, threshold)).filter(F.size("parts") > 0)
        across = _across(own, of_set, threshold, write)
        if not across.isEmpty():
            more = write(_verified(across, _held(across, groups, sets, write), threshold).select("a", "b"))
            of_set = write(_smallest_linked(groups.select("id"), links.unionByName(more), write))
        return write(sets.select("id", "digest").join(groups.select("digest", F.col("id").alias("first")), "digest").join(of_set.withColumnRenamed("id", "first"), "first").select(F.col("id").alias(id_), "representative"))


def _smallest_linked(ids: DataFrame, links: DataFrame, write) -> DataFrame:
    """id, representative: the smallest id that links lead to. Each round names every set by the smallest name met, then shortens the way."""
    both = write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    name = write(ids.select("id", F.col("id").alias("representative")))
    while True:
        met = both.join(name.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("representative").alias("met"))
        lower = name.join(met, "id", "left").select("id", F.least("representative", F.coalesce("met", "representative")).alias("to"), "representative")
        jump = name.select(F.col("id").alias("to"), F.col("representative").alias("further"))
        new = write(lower.join(jump, "to").select("id", F.least("to", "further").alias("new"), "representative"))
        if new.filter("new <> representative").isEmpty():
            return name
        name = new.select("id", F.col("new").alias("representative"))
