"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A document is the multiset of its shingles of five words (of all its words, if it has fewer). Every
shingle sends Poisson points, at the rate of its weight, to random slots of the signature; a slot keeps
the shingle of its earliest point, so two signatures agree in a slot with the probability Jaccard
similarity of the weights. Points later than the time by which all slots are filled can't change
anything: generation stops at a time limit that nearly always suffices and goes on only where a slot is
still empty.

Equal word sequences are one node from the start. Nodes whose signatures agree in a whole band share a
bucket. A pair that shares one is a link if the estimate from its signatures leaves the similarity possible
and the exact similarity reaches the threshold; this holds for all buckets, whatever their size. First each
bucket (each block of a large one) gives the maximum spanning forest of its estimates, and a large one pairs
its first node with all others; these pairs are compared exactly, and linked nodes form components. Then the
members of a bucket that lie outside its main component are compared, by signature, with all its members in
other components, in blocks of bounded size; of those that have a pair which the estimate leaves possible,
the shingles come to the block too, and such pairs are compared exactly there, so that it gives out links only.
So a group of near copies costs a few pairs for each copy, and every two nodes that meet in a bucket are
connected or have been compared.

A node stands for 128 bits of a digest of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import arrow_rows, read_table, scratch, small_batches, staged, word_chunks

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 40
ROWS = 6
#: Expected number of empty slots at the time limit is exp(-SLACK).
SLACK = 4.0
BATCH_WORDS = 100_000
#: Buckets are compared by signature in blocks of about BLOCK by BLOCK nodes at most.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 21
#: Pairs whose estimate is this many standard errors below the threshold are left out: of pairs at the
#: threshold 3 in a million, of nearer ones fewer.
ERRORS = 4.5
#: Words that a task remembers, of so many bytes at most.
REMEMBERED = 150_000
LONGEST = 64
#: Rows in a batch to Python that hold the shingles of a text or two.
PAIRS = 250

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator."""
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """Hashes of words, remembered as long as the object lives: a task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            self[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        """One hash for each word of the text."""
        if len(self) > REMEMBERED:
            self.clear()
        found = [np.fromiter(map(self.__getitem__, words), _U, len(words)) for words in word_chunks(text)]
        return np.concatenate([np.zeros(0, _U), *found])


def digest_of(words: np.ndarray) -> tuple[int, int]:
    raw = hashlib.md5(words.tobytes()).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def shingles(words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and how often each occurs. At least one word is needed."""
    k = min(size, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h ^ words[i : i + n]) if i else words[:n]
        h = np.sort(mix(h + _U(k)))
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.diff(np.append(first, n))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = BANDS * ROWS, slack: float = SLACK) -> np.ndarray:
    """One row of `slots` shingle hashes for each weighted set."""
    out = np.zeros((len(sets), slots), _U)
    todo = np.arange(len(sets))
    while len(todo):
        doc = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        h = np.concatenate([sets[i][0] for i in todo])
        w = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        total = np.bincount(doc, w)
        limit = (slots / total * (np.log(slots) + slack))[doc]
        best = np.full(len(todo) * slots, np.inf)
        owner = np.zeros(len(todo) * slots, _U)
        t = np.zeros(len(h))
        count, step = 0, 2
        with np.errstate(over="ignore"):
            while len(h):
                c = np.arange(count, count + step, dtype=_U)
                x = mix(h[:, None] ^ mix(c * _U(2) + _U(1))[None, :])
                at = t[:, None] + np.cumsum(-np.log((x >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / w[:, None], axis=1)
                ok = at < limit[:, None]
                slot = ((mix(x) >> _U(32)) * _U(slots)) >> _U(32)
                key = (doc[:, None] * slots + slot.astype(np.int64))[ok]
                when = at[ok]
                np.minimum.at(best, key, when)
                won = when == best[key]
                owner[key[won]] = np.broadcast_to(h[:, None], ok.shape)[ok][won]
                more = ok[:, -1]
                h, w, t, doc, limit = h[more], w[more], at[more, -1], doc[more], limit[more]
                count += step
                step = min(64, step * 2)
        full = np.isfinite(best).reshape(len(todo), slots).all(axis=1)
        out[todo[full]] = owner.reshape(len(todo), slots)[full]
        todo = todo[~full]
        slack += 4.0
    return out


def band_keys(sigs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sigs.reshape(len(sigs), bands, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix(np.arange(bands, dtype=_U)), parts.shape[:2])
        for r in range(rows):
            key = mix(key ^ parts[:, :, r])
    return key.astype(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two multisets given as ascending distinct hashes and counts."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    p, q = x[i].astype(np.float64), y[j].astype(np.float64)
    only_x, only_y = x.sum() - p.sum(), y.sum() - q.sum()
    total = 0.0
    ratio = p / q
    for t in np.unique(ratio):
        total += p[ratio == t].sum() / (only_x + t * only_y + np.maximum(p, t * q).sum())
    return float(total)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, h1, h2 (digest of the words), size (shingles), keys, sig for every row; all from h1 on are null where there are no words.

    sig has the lowest byte of every slot's shingle.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            ids, hashes, texts = b.column("doc_id"), b.column("text_hash"), b.column("text")
            at = 0
            while at < b.num_rows:
                begin, n, sets, digests, where = at, 0, [], [], []
                while at < b.num_rows and n < BATCH_WORDS:
                    words = known.of(texts[at].as_py())
                    digests.append(digest_of(words) if len(words) else (None, None))
                    if len(words):
                        where.append(at - begin)
                        sets.append(shingles(words))
                        n += len(words)
                    at += 1
                keys, sigs, sizes = ([None] * len(digests) for _ in range(3))
                if sets:
                    slots = signatures(sets)
                    for i, k, sig, (h, _) in zip(where, band_keys(slots), slots.astype(np.uint8), sets, strict=True):
                        keys[i], sigs[i], sizes[i] = k, sig.tobytes(), len(h)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, at - begin), hashes.slice(begin, at - begin), *(pa.array(x, pa.int64()) for x in zip(*digests, strict=True)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["doc_id", "text_hash", "h1", "h2", "size", "keys", "sig"],
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sketch, "doc_id long, text_hash long, h1 long, h2 long, size long, keys array<long>, sig binary")


def _shingle_sets(texts: DataFrame) -> DataFrame:
    """node, sig, hashes, counts of rows (node, sig, text); counts is null where every shingle occurs once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, hashes, counts = b.slice(at, 256), [], []
                for text in part.column("text").to_pylist():
                    h, n = shingles(known.of(text))
                    hashes.append(h.view(np.int64))
                    counts.append(None if int(n.sum()) == len(n) else n.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("sig"), pa.array(hashes, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["node", "sig", "hashes", "counts"]
                )

    return texts.select("node", "sig", "text").mapInArrow(sets, "node long, sig binary, hashes array<long>, counts array<int>")


def least_estimate(similarity: float) -> float:
    """The estimate below which a pair is left out."""
    return similarity - ERRORS * float(np.sqrt(similarity * (1 - similarity) / (BANDS * ROWS)))


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint8).reshape(len(sigs), BANDS * ROWS)


def _estimate(same: np.ndarray) -> np.ndarray:
    """Similarity by the number of slots that agree; one in 256 agrees by chance."""
    return (same / (BANDS * ROWS) - 1 / 256) / (1 - 1 / 256)


def _similarities(hashes: pa.Array, counts: pa.Array, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """The exact similarity of the sets at x and y, or 0 where a bound shows that it is below `similarity`; no counts are all ones."""
    at, h = hashes.offsets.to_numpy(), hashes.values.to_numpy().view(_U)
    plain, out = counts.is_null().to_numpy(zero_copy_only=False), np.zeros(len(x))
    weights = lambda i, n: np.ones(n, np.int32) if plain[i] else counts[i].values.to_numpy()
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = h[at[i] : at[i + 1]], h[at[j] : at[j + 1]]
        if plain[i] and plain[j]:
            # Equal weights bound the similarity by the ratio of the numbers of shingles.
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                out[k] = both / (len(a) + len(b) - both)
        else:
            out[k] = probability_jaccard(a, weights(i, len(a)), b, weights(j, len(b)))
    return out


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links among the pairs (a, b).

    b is joined first: a may be the smallest node of many pairs, and by then its rows are wide, so that
    Spark splits them.
    """
    side = lambda s: sets.select(F.col("node").alias(s), F.col("sig").alias(f"s{s}"), F.col("hashes").alias(f"h{s}"), F.col("counts").alias(f"c{s}"))
    least = least_estimate(similarity)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keep = batch.num_rows, _estimate((_matrix(batch.column("sa")) == _matrix(batch.column("sb"))).sum(1)) >= least
            near = np.flatnonzero(keep)
            hashes, counts = (pa.concat_arrays([batch.column(f"{c}a"), batch.column(f"{c}b")]) for c in "hc")
            keep[near] = _similarities(hashes, counts, near, near + n, similarity) >= similarity
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    wide = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "ha", "ca", "sb", "hb", "cb")
    with arrow_rows(pairs.sparkSession, PAIRS):
        return staged(wide.mapInArrow(check, "a long, b long"), "verified")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the links (a, b), by large and small stars in turn.

    Each round is written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = staged(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "stars")
        # Done when every node but the smallest ones has one edge, to a smallest one.
        ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select(F.col("v").alias("u"), F.lit(0), F.lit(1)).distinct())
        if ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR (out > 0 AND in > 0)").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _forest(p: np.ndarray, q: np.ndarray, weight: np.ndarray) -> list[int]:
    """Of edges between the parts p and q: a maximum spanning forest, ties to the first edge."""
    order = np.argsort(-weight, kind="stable")
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    left, chosen = len(np.union1d(p, q)) - 1, []
    for i in order.tolist():
        x, y = root(int(p[i])), root(int(q[i]))
        if x != y:
            up[x] = y
            chosen.append(i)
            left -= 1
            if not left:
                break
    return chosen


def _near(left: pa.Table, right: pa.Table, least: float, band: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both tables that are of different parts and whose estimate is `least` or more, and the estimate; with a band, only pairs that share no earlier one."""
    (a, p), (b, q) = ((t.column("node").to_numpy(), t.column("part").to_numpy()) for t in (left, right))
    also = right.column("apart").to_numpy(zero_copy_only=False)
    s, t = (_matrix(x.column("sig").combine_chunks()) for x in (left, right))
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(a), 64):
        x = s[at : at + 64]
        same = np.zeros((len(x), len(b)), np.int16)
        # A pair of two rows that are both outside the main part is met twice.
        open_ = (p[at : at + 64, None] != q[None, :]) & (~also[None, :] | (a[at : at + 64, None] < b[None, :]))
        for k in range(0, BANDS, 8):
            agree = x[:, None, k * ROWS : (k + 8) * ROWS] == t[None, :, k * ROWS : (k + 8) * ROWS]
            same += agree.sum(2, dtype=np.uint8)
            if band is not None and k < band:
                open_ &= ~agree[:, :, : (band - k) * ROWS].reshape(len(x), len(b), -1, ROWS).all(3).any(2)
        estimate = _estimate(same)
        i, j = np.nonzero(open_ & (estimate >= least))
        found.append((i + at, j, estimate[i, j]))
    i, j, weight = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, weight


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    """Pairs, the smaller node first."""
    return pa.RecordBatch.from_arrays([pa.array([min(x, y) for x, y in found], pa.int64()), pa.array([max(x, y) for x, y in found], pa.int64())], names=["a", "b"])


def _blocks_in(batches: Iterator[pa.RecordBatch], twos: bool = False) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """Block after block of rows that are sorted by (key, i, j), one in memory at a time.

    If asked, blocks of two rows within a batch, most of all, come together: the batch, and where they begin.
    """
    held: list[pa.Table] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        at = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), len(t)]
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        if twos and len(spans) > 2:
            # The first and the last block of a batch may go on in others.
            yield t, np.array([x for x, y in spans[1:-1] if y - x == 2], np.int64)
            spans = [spans[0], *(s for s in spans[1:-1] if s[1] - s[0] != 2), spans[-1]]
        for x, y in spans:
            name = tuple(at[:, x].tolist())
            if held and name != last:
                yield pa.concat_tables(held), None
                held = []
            held.append(t.slice(x, y - x))
            last = name
    if held:
        yield pa.concat_tables(held), None


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _blocks(n: str, shingles: str | None = None) -> Column:
    by_nodes = F.ceil(F.col(n) / BLOCK)
    return (F.greatest(by_nodes, F.ceil(F.col(shingles) / BLOCK_SHINGLES)) if shingles else by_nodes).cast("int")


def _own(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def _every(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), blocks - 1))


def _first_pairs(shared: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs that connect what is near in each block of each bucket, and of buckets of several blocks the first node with all others."""
    least = least_estimate(similarity)

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for t, twos in _blocks_in(batches, True):
            node = t.column("node").to_numpy()
            if twos is not None:
                sig = t.column("sig").combine_chunks()
                first, second = (_matrix(sig.take(pa.array(x))) for x in (twos, twos + 1))
                near = twos[_estimate((first == second).sum(1)) >= least]
                found += zip(node[near].tolist(), node[near + 1].tolist(), strict=True)
            else:
                i, j, weight = _near(t, t, least)
                found += ((int(node[i[k]]), int(node[j[k]])) for k in _forest(node[i], node[j], weight)) if len(i) else ()
            if len(found) > 10_000:
                yield _pair_batch(found)
                found = []
        yield _pair_batch(found)

    rows = shared.join(nodes.select("node", "sig"), "node")
    rows = rows.select("key", _own(_blocks("n")).alias("i"), F.lit(0).alias("j"), "node", F.col("node").alias("part"), F.lit(True).alias("apart"), "sig")
    stars = shared.filter((F.col("n") > BLOCK) & (F.col("node") != F.col("first"))).select(F.col("first").alias("a"), F.col("node").alias("b"))
    return _by_block(rows).mapInArrow(forests, "a long, b long").union(stars).distinct()


def _open_links(shared: DataFrame, found: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between different components among the nodes of one bucket.

    Members outside the bucket's largest component are cut into blocks by `i`, all members by `j`, of at most
    about BLOCK nodes and BLOCK_SHINGLES shingles.
    """
    least = least_estimate(similarity)
    placed = shared.select("key", "band", "node").join(found, "node", "left").withColumn("part", F.coalesce("component", "node")).join(nodes.select("node", "sig", "size"), "node")
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum("size").alias("w"))
    main = sizes.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.sum("c").alias("n"), F.sum("w").alias("w"), F.max("c").alias("main_n"), F.max_by("w", F.struct("c", "part")).alias("main_w"), F.count("*").alias("parts"))
    main = main.filter("parts > 1").select(
        "key", "main", _blocks("n", "w").alias("columns"), F.greatest(F.ceil((F.col("n") - F.col("main_n")) / BLOCK), F.ceil((F.col("w") - F.col("main_w")) / BLOCK_SHINGLES)).cast("int").alias("rows")
    )
    members = placed.join(main, "key").withColumn("apart", F.col("part") != F.col("main"))
    rest = ("key", "band", "node", "part", "apart", "sig")
    left = members.filter("apart").select(F.lit(0).alias("side"), _own(F.col("rows")).alias("i"), _every(F.col("columns")).alias("j"), *rest)
    right = members.select(F.lit(1).alias("side"), _every(F.col("rows")).alias("i"), _own(F.col("columns")).alias("j"), *rest)

    def sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side = t.column("side").to_numpy()
        return np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    def open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have a pair which the estimate leaves possible."""
        for t, _ in _blocks_in(batches):
            left, right = sides(t)
            i, j, _ = _near(t.take(pa.array(left)), t.take(pa.array(right)), least, t.column("band")[0].as_py()) if len(left) and len(right) else ([], [], [])
            if len(i):
                yield from t.take(pa.array(np.union1d(left[i], right[j]))).combine_chunks().to_batches()

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _blocks_in(batches):
            left, right = sides(t)
            i, j, _ = _near(t.take(pa.array(left)), t.take(pa.array(right)), least, t.column("band")[0].as_py())
            x, y = left[i], right[j]
            exact = _similarities(t.column("hashes").combine_chunks(), t.column("counts").combine_chunks(), x, y, similarity)
            x, y, exact = x[exact >= similarity], y[exact >= similarity], exact[exact >= similarity]
            if len(x):
                node, part = t.column("node").to_numpy(), t.column("part").to_numpy()
                yield _pair_batch([(int(node[x[k]]), int(node[y[k]])) for k in _forest(part[x], part[y], exact)])

    both = left.unionByName(right)
    some = staged(_by_block(both).mapInArrow(open_rows, both.schema), "open")
    with arrow_rows(shared.sparkSession, PAIRS):
        return staged(_by_block(some.join(sets.select("node", "hashes", "counts"), "node")).mapInArrow(links, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the nodes that have a near copy, and (doc_id, text_hash, node) of all rows.

    docs needs doc_id (long) and text. Null texts and texts without a word have a null node: they are
    near copies of nothing. Repeated rows share a node. A text of any length is one row; its shingles are in
    memory at once.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = staged(_sketches(docs), "sketches")
    one = F.min(F.struct("doc_id", "text_hash", "size", "keys", "sig")).alias("r")
    nodes = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(one).select("h1", "h2", F.monotonically_increasing_id().alias("node"), "r.*")
    # Written before it is used, so the numbers stay.
    nodes = staged(nodes, "nodes")
    named = rows.select("doc_id", "text_hash", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"], "left").select("doc_id", "text_hash", "node")
    members = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    buckets = members.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.min("node").alias("first")).filter("n > 1")
    shared = staged(members.join(buckets, "key"), "shared")
    pairs = staged(_first_pairs(shared, nodes, similarity), "pairs")

    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "sig", F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    sets = staged(_shingle_sets(texts), "sets")
    n, different = sets.agg(F.count("*"), F.countDistinct("node")).first()
    if n != different:  # repeated rows
        sets = staged(sets.groupBy("node").agg(F.min(F.struct("sig", "hashes", "counts")).alias("s")).select("node", "s.*"), "sets")

    links = _verify(pairs, sets, similarity)
    found = staged(components(links), "components")
    more = _open_links(shared, found, nodes, sets, similarity)
    if not more.isEmpty():
        found = staged(components(links.union(more)), "components")
    return found, named


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, class_id, class_size, kept for every row.

    class_id is the smallest doc_id of the row's class (null if all are null). kept marks the row of that
    id, of several the one of the smallest text_hash; repeated rows are marked alike. Rows without words
    are alone, with their own doc_id, and kept.
    """
    with scratch(docs.sparkSession):
        found, rows = near_duplicates(docs, similarity)
        named = staged(rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named", keep=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    # Written first: Spark splits the rows of a large component only where both sides of the join come as they are.
    least = staged(named.filter("component IS NOT NULL").groupBy("component").agg(first, F.count("*").alias("class_size")), "classes")
    alone = F.col("component").isNull()
    return named.join(least, "component", "left").select(
        "doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))).alias("kept"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the near copies: of each class the kept row stays, whole, once if it is repeated.

    Rows without words all stay.
    """
    with scratch(docs.sparkSession):
        first = classes(docs, similarity).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("class_size").alias("__size"))
        first = staged(first.groupBy("__id", "__hash").agg(F.max("__size").alias("__size")), "kept", keep=True)
    out = docs.withColumn("__at", F.xxhash64("text")).join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__hash")))
    single = out.filter("__size = 1").select(*docs.columns)
    # Only here can the kept row stand twice.
    several = out.filter("__size > 1").dropDuplicates(["__id", "__hash"]).select(*docs.columns)
    return single.unionByName(several)


def op7_neardup_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, and whether it is the one that stays."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_representative"))
