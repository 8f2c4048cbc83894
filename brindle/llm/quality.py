"""Quality classifier without hand labels: a weak-label model trains a hashed linear scorer.

Overlapping heuristics vote on every document: good, bad, or no vote. The vote patterns of all documents
are counted in Spark; on those counts, expectation-maximisation estimates each heuristic's rate of each
vote on good and on bad documents and the share of good ones, and so the posterior of every pattern. A
bounded sample of documents with these posteriors as soft labels trains a logistic scorer over hashed
words, word shapes and binned statistics, and the scorer's probability decides for every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import byte_chunks, read_table, small_batches

DIMENSIONS = 1 << 16
#: Documents that the scorer is fitted on at most, drawn by a hash of id and text.
SAMPLE = 6_000
THRESHOLD = 0.5
FEW_WORDS = 20
#: Words among which repetition counts as monotony.
WINDOW = 50
#: Bytes of text that are described at a time; a longer text is described by itself, in some thirty times its bytes.
CHUNK_BYTES = 2 << 20

_NAMES = ("symbols", "capitals", "top_word", "repeated_pairs", "monotony", "repeated_lines", "open_lines", "word_length", "bare_tokens", "marked_words", "symbol_runs")
# Kinds of bytes (1 white space, 2 capital, 3 small letter, 4 symbol), ends of closed lines, signs of marked words.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91], _KIND[97:123] = 2, 3
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,'-"]] = 4
_TERMINAL = pa.array([".", "!", "?", "…", '"', "”", "»", ":", ";", "。", "！", "？"])
_MARKED, _BARE, _TWO_SYMBOLS = r"[#$%&*+<=>@^_`{|}~\\/]", r"^[^\p{L}\p{N}]*$", r"[^\p{L}\p{N}_\s.\-]{2}"
_TWICE, _RUN = re.compile(r"([^\w\s.-])\1"), re.compile(r"([^\w\s])\1+")


def _bools(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, once each."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def _per(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, n)


def _share(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """x / base, 0 where there is no base."""
    return np.divide(x, base, out=np.zeros(len(x)), where=base > 0)


def shapes(words: pa.Array) -> pa.Array:
    """Small letters as a, capitals as A, other letters as x, digits as 9, all else as it is; a run counts once, of other signs twice."""
    for kind, by in ((r"[\p{Ll}]+", "a"), (r"[\p{Lu}\p{Lt}]+", "A"), (r"[\p{Lo}\p{Lm}]+", "x"), (r"\p{N}+", "9")):
        words = pc.replace_substring_regex(words, kind, by)
    signs = _bools(pc.match_substring_regex(words, _TWO_SYMBOLS.replace("\\-", "").replace(".", "")))
    if signs.any():
        at = np.flatnonzero(signs)
        short = pa.array([_RUN.sub(r"\1\1", x) for x in words.take(pa.array(at)).to_pylist()], pa.string())
        words = pc.replace_with_mask(words, pa.array(signs), short)
    return words


def _hashed(words: pa.Array, salt: bytes) -> np.ndarray:
    begin = zlib.crc32(salt)
    return np.array([zlib.crc32(x, begin) for x in words.cast(pa.binary()).to_pylist()], np.int64) % DIMENSIONS


class Described:
    """Of some texts: number of words, statistics (shares over the whole text, 0 where they have no base), and hashed features.

    `doc`, `index` and `value` are the features: log counts of hashed words and of their shapes, each to unit
    length, and the binned statistics.
    """

    def __init__(self, texts: pa.Array, features: bool = True):
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        raw, ends = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        kinds = _KIND[raw[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        white, upper, lower, symbols = (np.diff(np.concatenate([[0], np.cumsum(kinds == k)])[ends]) for k in (1, 2, 3, 4))
        doc, code, words = self._encoded(pc.utf8_split_whitespace(texts))
        self.words = _per(doc, n).astype(np.int64)
        v, count = max(1, len(words)), np.maximum(self.words, 1)
        lists = np.cumsum(self.words) - self.words
        pairs = np.flatnonzero(doc[1:] == doc[:-1])
        # A chunk is small or one text, so the three numbers fit in 64 bits.
        pair = _distinct((doc[pairs] * v + code[pairs]) * v + code[pairs + 1])
        windows = np.cumsum(-(-self.words // WINDOW))
        window = (windows - -(-self.words // WINDOW))[doc] + (np.arange(len(doc)) - lists[doc]) // WINDOW
        fresh = np.searchsorted(windows, _distinct(window * v + code) // v, side="right")
        used, times = np.unique(doc * v + code, return_counts=True)
        used_doc, used_word = used // v, used % v
        most = np.zeros(n)
        np.maximum.at(most, used_doc, times)
        line_doc, line, lines = self._encoded(pc.split_pattern(texts, "\n"), trim=True)
        line_count = _per(line_doc, n)
        closed = _bools(pc.is_in(pc.utf8_slice_codeunits(lines, -1), _TERMINAL)) if len(lines) else np.zeros(0, bool)
        bare, marked, twice = (_bools(pc.match_substring_regex(words, p)) for p in (_BARE, _MARKED, _TWO_SYMBOLS))
        maybe = np.flatnonzero(twice)
        twice[maybe] = [bool(_TWICE.search(x)) for x in words.take(pa.array(maybe)).to_pylist()]
        of_words = lambda x: _per(used_doc, n, times * x[used_word])
        stats = {
            "symbols": symbols / np.maximum(1, np.diff(ends) - white),
            "capitals": upper / np.maximum(1, upper + lower),
            "top_word": most / count,
            "repeated_pairs": np.where(self.words > 1, 1 - _per(pair // (v * v), n) / np.maximum(1, self.words - 1), 0.0),
            "monotony": np.where(self.words > 0, 1 - _per(fresh, n) / count, 0.0),
            "repeated_lines": 1 - _share(_per(_distinct(line_doc * max(1, len(lines)) + line) // max(1, len(lines)), n), line_count) - (line_count == 0),
            "open_lines": 1 - _share(_per(line_doc, n, closed[line]), line_count) - (line_count == 0),
            "word_length": of_words(pc.utf8_length(words).to_numpy().astype(np.float64)) / count,
            "bare_tokens": of_words(bare) / count,
            "marked_words": of_words(marked) / count,
            "symbol_runs": of_words(twice) / count,
        }
        self.stats = np.stack([stats[k] for k in _NAMES], 1) if n else np.zeros((0, len(_NAMES)))
        if features:
            self._features(n, words, used_doc, used_word, times)

    @staticmethod
    def _encoded(lists: pa.Array, trim: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of the strings of each list that are not empty: its list, its number, and the strings by number."""
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat, doc = lists.flatten(), np.repeat(np.arange(len(lists)), np.diff(offsets))
        flat = pc.utf8_trim_whitespace(flat) if trim else flat
        solid = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(solid).dictionary_encode()
        return doc[_bools(solid)], coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def _features(self, n: int, words: pa.Array, used_doc: np.ndarray, used_word: np.ndarray, times: np.ndarray) -> None:
        lower, shape = pc.utf8_lower(words).dictionary_encode(), shapes(words).dictionary_encode()
        docs, indexes, values = [], [], []
        for coded, salt in ((lower, b"w"), (shape, b"s")):
            hashed = _hashed(coded.dictionary, salt)[coded.indices.to_numpy()]
            key, back = np.unique(used_doc * DIMENSIONS + hashed[used_word], return_inverse=True)
            value = np.log1p(np.bincount(back, times, len(key)))
            doc = key // DIMENSIONS
            docs.append(doc)
            indexes.append(key % DIMENSIONS)
            values.append(value / np.sqrt(_per(doc, n, value * value))[doc])
        steps = np.where(np.array(_NAMES) == "word_length", 1, 20)
        bins = np.clip((self.stats * steps).astype(np.int64), 0, 20)
        table = np.array([[zlib.crc32(f"b{k}={i}".encode()) % DIMENSIONS for i in range(21)] for k in _NAMES])
        docs.append(np.repeat(np.arange(n), len(_NAMES)))
        indexes.append(table[np.arange(len(_NAMES))[None, :], bins].ravel())
        values.append(np.full(bins.size, 0.5))
        doc, index, value = (np.concatenate(x) for x in (docs, indexes, values))
        order = np.argsort(doc, kind="stable")
        self.doc, self.index, self.value = doc[order], index[order].astype(np.int32), value[order].astype(np.float32)


#: Of each heuristic: votes good up to the first value and bad from the second on. Fixed values.
LABELLERS: dict[str, tuple[float, float]] = {
    "symbols": (0.06, 0.15),
    "capitals": (0.15, 0.40),
    "top_word": (0.12, 0.20),
    "repeated_pairs": (0.15, 0.40),
    "monotony": (0.40, 0.60),
    "repeated_lines": (0.10, 0.30),
    "open_lines": (0.25, 0.60),
    "word_length": (8.0, 12.0),
    "bare_tokens": (0.05, 0.20),
    "marked_words": (0.05, 0.20),
    "symbol_runs": (0.05, 0.15),
}
GOOD, BAD, NONE = 0, 1, 2
#: Votes (bad, good) that each labeller is taken to have cast beforehand on good and on bad documents: few, so the data overrule them.
BEFORE = ((1.0, 9.0), (1.0, 1.0))


_GOOD_TO, _BAD_FROM = (np.array([LABELLERS[k][i] for k in _NAMES]) for i in (0, 1))
_POWERS = 3 ** np.arange(len(LABELLERS))


def votes(described: Described) -> np.ndarray:
    """A row of one vote of each labeller for each text; shares of fewer than 20 words say nothing."""
    found = np.where(described.stats <= _GOOD_TO, GOOD, np.where(described.stats >= _BAD_FROM, BAD, NONE))
    found[described.words < FEW_WORDS] = NONE
    return found


def pattern(found: np.ndarray) -> np.ndarray:
    """A number for each row of votes."""
    return np.asarray(found) @ _POWERS


class LabelModel:
    """Rates of right votes on good and on bad documents, by expectation-maximisation over vote patterns.

    A missing vote says nothing, so documents without any vote have the share of good documents as posterior.
    """

    def __init__(self, counts: dict[int, int], rounds: int = 500):
        k = len(LABELLERS)
        codes = sorted(counts)
        weight = np.array([counts[c] for c in codes], np.float64)
        table = np.array([[c // 3**i % 3 for i in range(k)] for c in codes], np.int64).reshape(len(codes), k)
        # rates[y, j]: of the votes of labeller j on documents that are good (y = 0) or bad (1), the share of bad votes
        self.prior, self.rates = 0.5, np.full((2, k), 0.5)
        if not len(codes):
            return
        bad, good = table == BAD, table == GOOD
        # To begin with, one bad vote outweighs good ones, as each heuristic knows one kind of bad text only.
        post = np.where(bad.any(axis=1), 0.2, np.where(good.any(axis=1), 0.9, 0.5))
        voted = bad.any(axis=1) | good.any(axis=1)
        for _ in range(rounds):
            p, q = weight * post * voted, weight * (1 - post) * voted
            self.prior = float((p.sum() + 1) / (p.sum() + q.sum() + 2))
            for y, w in enumerate((p, q)):
                self.rates[y] = (w @ bad + BEFORE[y][0]) / (w @ (bad | good) + sum(BEFORE[y]))
            new = self._posterior(table)
            if np.abs(new - post).max() < 1e-9:
                break
            post = new

    def _posterior(self, table: np.ndarray) -> np.ndarray:
        log = [np.log(p) + (table == BAD) @ np.log(self.rates[y]) + (table == GOOD) @ np.log(1 - self.rates[y]) for y, p in enumerate((self.prior, 1 - self.prior))]
        return 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))

    def posteriors(self, found: np.ndarray) -> np.ndarray:
        """Probability, for each row of votes, that the document is good."""
        return self._posterior(np.asarray(found))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller's votes, the expected share of right ones."""
        right = self.prior * (1 - self.rates[0]) + (1 - self.prior) * self.rates[1]
        return dict(zip(LABELLERS, right.tolist(), strict=True))


class Scorer:
    """Logistic regression over hashed features of texts with labels from 0 to 1."""

    def __init__(self, doc: np.ndarray, index: np.ndarray, value: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5):
        self.weights, self.bias, n = np.zeros(DIMENSIONS), 0.0, len(labels)
        if not n:
            return
        value = value.astype(np.float64)
        # Both classes weigh the same, however rare one is.
        share = labels.mean()
        weigh = np.where(labels >= 0.5, 0.5 / max(share, 0.02), 0.5 / max(1 - share, 0.02))
        g2, b2 = np.full(DIMENSIONS, 1e-8), 1e-8
        for _ in range(rounds):
            margin = np.bincount(doc, value * self.weights[index], n) + self.bias
            off = weigh * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels) / n
            grad = np.bincount(index, value * off[doc], DIMENSIONS) + decay * self.weights
            g2 += grad * grad
            b2 += off.sum() ** 2
            self.weights -= rate * grad / np.sqrt(g2)
            self.bias -= rate * off.sum() / np.sqrt(b2)

    def score(self, described: Described) -> np.ndarray:
        margin = np.bincount(described.doc, described.value * self.weights[described.index], len(described.words)) + self.bias
        return np.where(described.words > 0, 1 / (1 + np.exp(-np.clip(margin, -50, 50))), 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """The weak-label model over all documents and the scorer from at most `sample` of them.

    The sample is the documents of the smallest hashes of id and text, of repeated rows one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for b in batches:
            for at, rows in byte_chunks(b.column(0), CHUNK_BYTES):
                found, n = np.unique(pattern(votes(Described(b.column(0).slice(at, rows), False))), return_counts=True)
                for p, k in zip(found.tolist(), n.tolist(), strict=True):
                    seen[p] = seen.get(p, 0) + k
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    # At most 3**11 patterns reach the driver.
    small_batches(docs.sparkSession)
    counts = docs.select(text_col).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counts = {r[0]: r[1] for r in counts}
    model = LabelModel(counts)
    total = sum(counts.values())
    nothing = np.zeros(0)
    if not total:
        return model, Scorer(nothing, nothing, nothing, nothing)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, rows in byte_chunks(b.column("text"), CHUNK_BYTES):
                x = Described(b.column("text").slice(at, rows))
                offsets = pa.array(np.searchsorted(x.doc, np.arange(rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (x.index, x.value)]
                yield pa.RecordBatch.from_arrays([b.column("h").slice(at, rows), *lists, pa.array(model.posteriors(votes(x)))], names=["h", "at", "value", "label"])

    # The hash passes a share that holds the sample nearly surely, or a larger one where rows are repeated; of its hashes,
    # which are not many more, the smallest are taken.
    share, low, taken = min(1.0, (sample + 6 * sample**0.5 + 36) / total), F.pmod("h", F.lit(1 << 30)), []
    hashed = docs.select(F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"), F.col(text_col).alias("text"))
    while True:
        drawn = hashed.filter(low < int(share * (1 << 30)))
        taken = sorted((r[0] % (1 << 30), r[0]) for r in drawn.select("h").distinct().collect())[:sample]
        if len(taken) >= sample // 2 or share >= 1:
            break
        share = min(1.0, 8 * share)
    some = drawn.filter((low < taken[-1][0]) | ((low == taken[-1][0]) & (F.col("h") <= taken[-1][1]))).dropDuplicates(["h"])
    table = some.mapInArrow(describe, "h long, at array<int>, value array<float>, label double").toArrow().sort_by("h").combine_chunks()
    at, value = (table.column(c).combine_chunks() for c in ("at", "value"))
    size = np.diff(at.offsets.to_numpy())
    return model, Scorer(np.repeat(np.arange(len(table)), size), at.flatten().to_numpy(), value.flatten().to_numpy(), table.column("label").to_numpy())


def score_documents(docs: DataFrame, model: LabelModel, scorer: Scorer, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_bad_votes, n_good_votes, posterior and quality_score (each with the prefix).

    Null texts are read as empty ones; a text without words gets the score 0. Columns of these names are
    replaced.
    """
    small_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast((model, scorer))
    added = [T.StructField(prefix + n, t()) for n, t in (("n_bad_votes", T.IntegerType), ("n_good_votes", T.IntegerType), ("posterior", T.DoubleType), ("quality_score", T.DoubleType))]
    docs = docs.drop(*[f.name for f in added])
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = known.value
        for b in batches:
            for at, rows in byte_chunks(b.column(text_col), CHUNK_BYTES):
                part = b.slice(at, rows)
                x = Described(part.column(text_col))
                v = votes(x)
                columns = [pa.array((v == BAD).sum(1).astype(np.int32)), pa.array((v == GOOD).sum(1).astype(np.int32)), pa.array(model.posteriors(v)), pa.array(scorer.score(x))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, *(f.name for f in added)])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *added]))


def keep_quality(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns as they are."""
    return score_documents(docs, *fit(docs), prefix="__").filter(F.col("__quality_score") >= threshold).select(*docs.columns)


def op5_quality_weak(spark, sf_dir: str) -> DataFrame:
    """Votes, posterior, score and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, *fit(docs))
    return scored.select("doc_id", "n_bad_votes", "n_good_votes", "posterior", "quality_score", (F.col("quality_score") >= THRESHOLD).alias("keep"))
