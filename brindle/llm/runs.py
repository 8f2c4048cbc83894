"""Runs: stretches of words that repeat with a period, found from the longest-previous-factor array.

The suffix arrays of a batch of texts are made together by prefix doubling: ranks of all suffixes by 1, 2, 4 words and so
on, where only suffixes that still share a rank are sorted again. A run of period q and at least max(24, 3q) words
repeats 16 words or more at a distance of q, so a text without two equal stretches of 16 words is done after four
rounds. For the others the suffix array is finished and gives the array of longest common prefixes, that gives the
longest previous factor of every word, and this the blocks of the Lempel-Ziv factorisation, each with an earlier
occurrence of its words.

A run touches the border of a block or lies strictly inside one. Those at a border are found by Main's extensions: for
every period, how far words q apart agree to the left and to the right of the border, by four prefix functions over the
two blocks at it. Those inside a block are copies of runs in its earlier occurrence, which are met in order of start.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import gathered, read_table, small_batches
from .wordtable import one_array

MIN_WORDS = 24
MIN_PERIODS = 3
BATCH_BYTES = 2 << 20

_U = np.uint64


def shared_words(min_words: int, min_periods: int) -> int:
    """Words that any run shares at least with those a period later."""
    return min(max(min_words - q, (min_periods - 1) * q) for q in range(1, min_words + 1))


def suffix_ranks(codes: np.ndarray, ends: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each word's suffix among all, texts in order; which texts repeat `enough` words. Only the ranks of those are complete.

    codes: a number for each word; ends: for each text, the number of words up to its end.
    """
    n = len(codes)
    sizes = np.diff(np.concatenate([[0], ends]))
    doc = np.repeat(np.arange(len(ends)), sizes)
    end = np.repeat(ends, sizes)
    rank = np.zeros(n, np.int64)
    rank, active = _regroup(rank, np.arange(n), (doc.astype(_U) << _U(32)) | codes.astype(_U))
    k, repeats = 1, np.zeros(len(ends), bool)
    while len(active):
        if 2 * k > enough and not repeats.any():
            repeats[doc[active]] = True
        then = np.where(active + k < end[active], rank[np.minimum(active + k, n - 1)] + 1, 0)
        rank, active = _regroup(rank, active, (rank[active].astype(_U) << _U(32)) | then.astype(_U))
        k *= 2
    return rank, repeats


def _regroup(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after the active suffixes of each rank are told apart by key; those that still share one. A rank is the number of smaller suffixes."""
    order = np.argsort(key)
    at, key = active[order], key[order]
    old, here = rank[at], np.arange(len(at))
    group, part = np.ones(len(at), bool), np.ones(len(at), bool)
    group[1:] = old[1:] != old[:-1]
    part[1:] = key[1:] != key[:-1]
    part |= group
    rank[at] = old + np.maximum.accumulate(np.where(part, here, 0)) - np.maximum.accumulate(np.where(group, here, 0))
    return rank, at[~part | ~np.append(part[1:], True)]


def common_prefixes(x: list[int], order: list[int], rank: list[int]) -> list[int]:
    """At r, the words that suffix r shares with the one before it, by rank; x ends with a value of its own."""
    n, h = len(order), 0
    out = [0] * (n + 1)
    for i in range(n):
        r = rank[i]
        if not r:
            h = 0
            continue
        j = order[r - 1]
        while x[i + h] == x[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out


def previous_factors(order: list[int], rank: list[int], shared: list[int]) -> tuple[list[int], list[int]]:
    """For each word, how many words from it on occur earlier too, and where. Uses up shared.

    From the last word to the first, each is taken out of the list of suffixes by rank: what is left began earlier.
    """
    n = len(order)
    before, after = list(range(-1, n)), [*range(1, n + 1), 0]
    size, source = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        p, q = before[r], after[r]
        a, b = shared[r], shared[q]
        if a >= b:
            if a:
                size[i], source[i] = a, order[p]
            shared[q] = b
        else:
            size[i], source[i] = b, order[q]
            shared[q] = a
        before[q] = p
        after[p] = q
    return size, source


def prefix_function(s: list[int]) -> list[int]:
    """At i, how many items from i on equal those from the start on."""
    n = len(s)
    out = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i], left, right = k, i, i + k
    return out


def border_runs(x: list[int], n: int, at: int, last: int, before: int, after: int, min_words: int, min_periods: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that touch the border `at` between blocks of `before` and `after` words and end in the second one.

    Such a run starts less than `before` words and a period ahead of the border, or else the first block had been longer.
    What reaches further on either side is met at another border.
    """
    top = min((before + after) // (min_periods - 1), n)
    low, high = max(0, at - before - top - 1), min(n, last + 1)
    right, left = x[at:high], x[low:at][::-1]
    # How far x[at:] agrees with x[at + q:] and with x[at - q:]; how far x[:at] agrees backwards with x[:at - q] and x[:at + q].
    right_ahead = prefix_function(right) if right else []
    left_behind = prefix_function(left)
    far, near = max(low, at - top), min(n, at + top)
    right_behind = prefix_function([*right, -2, *x[far:high]])
    left_ahead = prefix_function([*left, -2, *x[low:near][::-1]])
    for q in range(1, top + 1):
        found = []
        if q < len(right):
            found.append((at - left_ahead[len(left) + 1 + near - at - q], at + q + right_ahead[q]))
        if q < len(left):
            found.append((at - q - left_behind[q], at + right_behind[len(right) + 1 + at - q - far]))
        elif q == len(left):
            found.append((low, at + right_behind[len(right) + 1 + at - q - far]))
        for start, end in found:
            if at <= end <= last and end - start >= max(min_words, min_periods * q) and (start > low or not low):
                yield start, end, q


def all_runs(codes: np.ndarray, rank: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, by start and period. codes: its words as numbers from 0; rank: of its suffixes."""
    n, enough = len(codes), shared_words(min_words, min_periods)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    x, order, rank = [*codes.tolist(), -1], order.tolist(), rank.tolist()
    size, source = previous_factors(order, rank, common_prefixes(x, order, rank))
    # A stretch with its smallest period; buckets by start.
    found: dict[tuple[int, int], int] = {}
    starts: list[int] = []
    bucket: dict[int, list[tuple[int, int]]] = {}

    def add(start: int, end: int, q: int) -> None:
        known = found.get((start, end))
        if known is None:
            if start not in bucket:
                insort(starts, start)
            bucket.setdefault(start, []).append((start, end))
        if known is None or q < known:
            found[start, end] = q

    at, before = 0, 0
    while at < n or before:
        block = (size[at] or 1) if at < n else 0
        end = at + block
        if at and before + block >= enough:
            for run in border_runs(x, n, at, end, before, block, min_words, min_periods):
                add(*run)
        if block >= enough:
            shift = at - source[at]
            k = bisect_right(starts, source[at])
            while k < len(starts) and starts[k] + shift < end:
                for s, e in list(bucket[starts[k]]):
                    if e + shift < end:
                        add(s + shift, e + shift, found[s, e])
                k += 1
        at, before = end, block
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one text in ten, by the checksum of its id, which word stands at each place: from one on, the same few again and again."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


_RUN = "struct<start:long,length:long,period:long>"
_PA_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS,
    rearranged: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """doc_id (of id_col's type), runs, best, collapsed: a row for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`. A run has min_words words and min_periods periods at least; runs come by start, then
    period; best is the one of most periods (ties: smallest start, then period), null without runs. collapsed is the text's
    words, joined by one blank, without those that a run has after its first period. Null and empty texts have no words and
    no runs; repeated rows and null ids are kept as they are; other columns of docs don't matter; an empty table gives no
    rows. rearranged may give another order of the words, by id and their number. A text is in memory as a whole, with
    some 500 bytes for each word if it repeats itself.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, enough = rows.schema["doc_id"].dataType.simpleString(), shared_words(min_words, min_periods)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, "text", BATCH_BYTES):
            split = pc.ascii_split_whitespace(one_array(b.column("text")))
            words, lists = split.flatten(), split.offsets.to_numpy()
            real = pc.not_equal(words, "")
            bounds = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[lists - lists[0]]
            words = words.filter(real)
            if rearranged:
                place = np.arange(len(words))
                for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    new = rearranged(b.column("doc_id")[i].as_py(), int(y - x))
                    if new is not None:
                        place[x:y] = x + new
                words = words.take(pa.array(place))
            codes = words.dictionary_encode().indices.to_numpy()
            rank, repeats = suffix_ranks(codes, bounds[1:], enough)
            runs, best, keep = [[]] * b.num_rows, [None] * b.num_rows, np.ones(len(words), bool)
            for i in np.flatnonzero(repeats):
                x, y = bounds[i], bounds[i + 1]
                found = all_runs(codes[x:y], rank[x:y] - x, min_words, min_periods)
                for s, n, q in found:
                    keep[x + s + q : x + s + n] = False
                    if best[i] is None or n * best[i]["period"] > best[i]["length"] * q:
                        best[i] = {"start": s, "length": n, "period": q}
                runs[i] = [{"start": s, "length": n, "period": q} for s, n, q in found]
            kept = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)])[bounds]), words.filter(pa.array(keep)))
            text = pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, pa.list_(_PA_RUN)), pa.array(best, _PA_RUN), text], names=["doc_id", "runs", "best", "collapsed"])

    return rows.mapInArrow(scan, f"doc_id {kind}, runs array<{_RUN}>, best {_RUN}, collapsed string")


def op12_runs_lpf(spark, sf_dir: str) -> DataFrame:
    """Per document, of which one in ten is made periodic: its runs, the strongest, digests of all and of the rest. See find_runs for odd input."""
    found = find_runs(read_table(spark, sf_dir, "documents"), rearranged=planted_period)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
