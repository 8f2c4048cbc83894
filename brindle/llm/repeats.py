"""Passages that occur more than once, found by fixed-block anchors.

The reference blocks are the words 0 to 17, 18 to 35 and so on of every text. A window of 35 words holds at least one
whole block of its own text, so if the window occurs elsewhere, that block is met there too, by one of the 18-word
windows that roll over every word. So blocks are the index, and every rolling window is a probe: both are dealt to
buckets by their hash, and a block whose words any other window has is a hit. A hit is extended by up to 17 words to
each side, which gives the 35-word windows that hold it; those are dealt to buckets by 95 bits of hash, and the ones
that occur twice are kept. Kept windows that touch are one maximal repeat, however long.

No pairs are made. A chunk of documents sends each hash once, with a sign if it has it several times, so a passage in
every document costs a row a chunk. A bucket answers with one bit for each hash of a chunk, in the order they came,
which is ascending; the chunk, which makes the same hashes again from its texts, knows which they were. The texts are
shuffled once: the three passes over a chunk read the same exchange, but its rows may come in another order each time,
so nothing that one pass tells another goes by their place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import read_table, utf8_size
from .wordtable import Words, one_array, window_hashes

WINDOW = 35
#: Bytes of text in a chunk, and of texts whose windows make a bucket.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20

_U = np.uint64
_SEEDS, _FACTORS = (0x5EED, 0xF00D), (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_LOW = _U(0xFFFFFFFF)
_ASKS, _SAYS = "chunk long, bucket long, low binary, high binary", "chunk long, bucket long, bits binary"


def _packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


class Chunk:
    """The words of some texts, the windows of them that are asked about, and what the answers mean."""

    def __init__(self, texts, window: int, buckets: int):
        self.texts = one_array(texts)
        self.words = Words(self.texts)
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets
        n = len(self.words)
        doc = np.repeat(np.arange(len(self.texts)), np.diff(self.words.doc))
        self.place = np.arange(n) - self.words.doc[doc]  # within its text
        self.left = self.words.doc[doc + 1] - np.arange(n)  # words from here to the end of the text
        self.hash = self.words.hashes(_SEEDS[0])

    def bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> _U(32)) * _U(self.buckets)) >> _U(32)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rolling windows as bucket and 32 bits, ascending (bit 0: a block is among them, bit 1: there are several); the blocks' starts and codes."""
        starts = np.flatnonzero(self.left >= self.block)
        h = window_hashes(self.hash, self.block, _FACTORS[0])[starts]
        code = (self.bucket(h) << _U(32)) | (h & _LOW & ~_U(3))
        own = self.place[starts] % self.block == 0
        blocks, block_codes = starts[own], code[own]
        code = np.sort(code | own.astype(_U))
        plain = code & ~_U(3)
        new = np.ones(len(plain), bool)
        new[1:] = plain[1:] != plain[:-1]
        first = np.flatnonzero(new)
        last = first + np.diff(np.append(first, len(plain))) - 1
        return code[last] | (last > first).astype(_U) * _U(2), blocks, block_codes

    def hits(self, probes, block_codes: np.ndarray, answers: pa.Table) -> np.ndarray:
        """For each block whether its words are met elsewhere."""
        found = []
        for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            own = probes[slice(*np.searchsorted(probes, np.array([bucket, bucket + 1], _U) << _U(32)))]
            found.append(own[_unpacked(bits, len(own))] & ~_U(3))
        return np.isin(block_codes, np.concatenate(found)) if found else np.zeros(len(block_codes), bool)

    def extended(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of hits: the windows that hold one, by start; of the distinct ones 64 and 32 bits, ascending (bit 0 of the latter: there are several); the place of each window among those."""
        hit = np.zeros(len(self.words) + self.block, bool)
        hit[blocks] = True
        at = np.flatnonzero(self.left >= self.window)
        at = at[hit[at + (-self.place[at]) % self.block]]
        low = window_hashes(self.hash, self.window, _FACTORS[0])[at]
        high = window_hashes(self.words.hashes(_SEEDS[1]), self.window, _FACTORS[1])[at] & _LOW & ~_U(1)
        order = np.lexsort((high, low))
        low, high = low[order], high[order]
        new = np.ones(len(at), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.flatnonzero(new)
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(new) - 1
        several = np.diff(np.append(first, len(at))) > 1
        return at, low[first], high[first] | several.astype(_U), place

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """The words within the windows that start there."""
        step = np.zeros(len(self.words) + 1, np.int64)
        step[starts] += 1
        step[starts + self.window] -= 1
        return np.cumsum(step[:-1]) > 0


def _rows(chunk: int, bucket: np.ndarray, low: np.ndarray, high: np.ndarray | None) -> dict:
    """A row for each bucket of the chunk; bucket ascends."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    ends = [*first[1:], len(bucket)]
    parts = list(zip(first, ends, strict=False))
    return {
        "chunk": [chunk] * len(parts), "bucket": [int(bucket[x]) for x, _ in parts], "low": [low[x:y].tobytes() for x, y in parts],
        "high": [high[x:y].tobytes() if high is not None else b"" for x, y in parts],
    }


_PA_ASKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])
_PA_SAYS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


def _answer(asks: pa.Table, wanted: np.ndarray) -> pa.Table:
    """wanted: a bit for each hash of all asks, in their order. Asks without any get no row."""
    chunks, buckets, sizes = asks.column("chunk").to_pylist(), asks.column("bucket").to_pylist(), [len(x) for x in asks.column("high" if len(asks) and len(asks.column("high")[0].as_py()) else "low").to_pylist()]
    rows, at = [], 0
    for chunk, bucket, size in zip(chunks, buckets, sizes, strict=True):
        bits = wanted[at : at + size // 4]
        at += size // 4
        if bits.any():
            rows.append({"chunk": chunk, "bucket": bucket, "bits": _packed(bits)})
    return pa.Table.from_pylist(rows, _PA_SAYS)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()])


def _match_blocks(asks: pa.Table) -> pa.Table:
    """Of one bucket: which blocks of each chunk another window of the corpus has."""
    code = _joined(asks.column("low"), "<u4")
    order = np.argsort(code & ~np.uint32(3), kind="stable")
    s = code[order]
    first = np.flatnonzero(np.concatenate([[True], (s[1:] | 3) != (s[:-1] | 3)]))
    several = np.diff(np.append(first, len(s))) > 1
    several |= np.bitwise_or.reduceat(s, first) & 2 > 0
    group = np.repeat(several, np.diff(np.append(first, len(s))))
    wanted = np.empty(len(s), bool)
    wanted[order] = group & (s & 1 > 0)
    return _answer(asks, wanted)


def _match_windows(asks: pa.Table) -> pa.Table:
    """Of one bucket: which windows of each chunk occur again, there or elsewhere. Rows without a bucket pass."""
    if asks.column("bucket")[0].as_py() < 0:
        return asks.select(["chunk", "bucket"]).append_column("bits", asks.column("low")).cast(_PA_SAYS)
    low, high = _joined(asks.column("low"), "<u8"), _joined(asks.column("high"), "<u4")
    order = np.lexsort((high | 1, low))
    x, y = low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | ((y[1:] | 1) != (y[:-1] | 1))]))
    sizes = np.diff(np.append(first, len(x)))
    several = (sizes > 1) | (np.bitwise_or.reduceat(y, first) & 1 > 0)
    wanted = np.empty(len(x), bool)
    wanted[order] = np.repeat(several, sizes)
    return _answer(asks, wanted)


_SPANS = "array<struct<first:long,last:long>>"
_PA_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id (of id_col's type), n_words, spans, kept: a row for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. spans are the maximal repeats as disjoint ranges of word positions: all
    words in a window of `window` words that starts anywhere else too, in the same text or another. kept is the other
    words, joined by one blank. Null and empty texts have no words; texts of fewer words than a window have no spans;
    repeated rows repeat each other; null ids stay null; other columns of docs don't matter; an empty table gives no
    rows. A text is in memory as a whole, with some forty bytes for each word.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(utf8_size(F.col("text")))).first()[0] or 0
    chunks, buckets = -(-size // CHUNK_BYTES) or 1, -(-size // BUCKET_BYTES) or 1
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    by_chunk = rows.groupBy("chunk")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def probe(t: pa.Table) -> pa.Table:
        codes, _, _ = Chunk(t.column("text"), window, buckets).probes()
        return pa.table(_rows(t.column("chunk")[0].as_py(), codes >> _U(32), (codes & _LOW).astype("<u4"), None), _PA_ASKS)

    def extend(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t) or not len(answers):
            return _PA_ASKS.empty_table()
        c, chunk = Chunk(t.column("text"), window, buckets), t.column("chunk")[0].as_py()
        codes, blocks, block_codes = c.probes()
        hits = c.hits(codes, block_codes, answers)
        _, low, high, _ = c.extended(blocks[hits])
        asked = _rows(chunk, c.bucket(low), low.astype("<u8"), high.astype("<u4"))
        # Which of the distinct codes of blocks were hits is told to the last pass.
        _, at = np.unique(block_codes, return_index=True)
        told = {"chunk": [chunk], "bucket": [-1 - chunk % buckets], "low": [_packed(hits[at])], "high": [b""]}
        return pa.table({k: asked[k] + told[k] for k in asked}, _PA_ASKS)

    def cut(t: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(t.column("text"), window, buckets)
        gone = np.zeros(len(c.words), bool)
        if len(answers) > 1:
            said = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
            _, blocks, block_codes = c.probes()
            distinct, of_block = np.unique(block_codes, return_inverse=True)
            at, low, _, place = c.extended(blocks[_unpacked(said.pop(min(said)), len(distinct))[of_block]])
            repeated, of = np.zeros(len(low), bool), c.bucket(low)
            for bucket, bits in said.items():
                x, y = np.searchsorted(of, [bucket, bucket + 1])
                repeated[x:y] = _unpacked(bits, y - x)
            gone = c.covered(at[repeated[place]])
        return _kept(t, c, gone)

    hits = by_chunk.applyInArrow(probe, _ASKS).groupBy("bucket").applyInArrow(_match_blocks, _SAYS)
    asked = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(extend, _ASKS)
    repeated = asked.groupBy("bucket").applyInArrow(_match_windows, _SAYS)
    return by_chunk.cogroup(repeated.groupBy("chunk")).applyInArrow(cut, f"doc_id {kind}, n_words long, spans {_SPANS}, kept string")


def _kept(t: pa.Table, c: Chunk, gone: np.ndarray) -> pa.Table:
    """What is left of each text without the words that are gone."""
    doc = c.words.doc
    edge = np.zeros(len(gone) + 1, bool)
    edge[doc] = True  # a span ends with its text
    first = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
    last = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]])))
    owner = np.searchsorted(doc, first, side="right") - 1
    begun = doc[owner]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(first, doc).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(first - begun), pa.array(last - begun)], names=["first", "last"]),
    )
    # Arrow's words, without the empty ones between blanks, are the same.
    words = pc.ascii_split_whitespace(c.texts).flatten()
    words = words.filter(pc.not_equal(words, "")).filter(pa.array(~gone))
    before = np.concatenate([[0], np.cumsum(~gone)])[doc]
    kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(before), words), pa.scalar(" ", pa.large_string()))
    return pa.table([t.column("doc_id"), pa.array(np.diff(doc).astype(np.int64)), spans, kept.cast(pa.string())], names=["doc_id", "n_words", "spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col and text_col without the words of repeats; texts of which nothing is left are empty."""
    return find_repeats(docs, id_col, text_col, window).select(F.col("doc_id").alias(id_col), F.col("kept").alias(text_col))


def op13_repeats_anchor(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words in windows of 35 that occur again, digest of the other words. See find_repeats for odd input."""
    found = find_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
