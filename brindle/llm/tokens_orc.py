"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on the document id.

Documents are dealt to files by ranges of their id and sorted, so file after file and row after row they
come in ascending order; each row holds its ids and the number of ids before it in its file. ORC encodes
the ids as run-length integers, keeps min and max of every 10,000 rows and, for doc_id, a Bloom filter;
a reader opens stripes in parallel and skips those whose index excludes an id.

All ids come from the library's encoding of texts, by a tokenizer as its file has it. The tokenizer of the
given file always splits words before a single blank that is followed by anything but white space, so the
texts of a batch are cut there, each distinct piece is encoded once, and the ids of the pieces are joined.
Texts with other blanks (before white space or at the end), texts with an added token of the tokenizer, and
all texts of tokenizers that split words otherwise are encoded whole.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window

from .common import gathered, read_table, shared_dir, small_batches, staged

END = 0
#: Bytes of text that are encoded at a time, and pieces in one text that the library gets.
CHUNK_BYTES = 8 << 20
JOINED = 2_000
#: Bytes of pieces and their ids that a worker keeps from one chunk to the next.
KEPT_BYTES = 48 << 20
#: Bytes of text for each file on average, at most.
FILE_BYTES = 256 << 20
# A blank before white space (by any library's list of it) or at the end.
LONE_BLANK = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
STRIPE_BYTES = 16 << 20
#: before: the ids before the row in its file; n: its own number of ids.
SCHEMA = "doc_id long, file int, before long, n long, ids array<int>"

ORC_OPTIONS = {
    "compression": "zstd", "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": "10000", "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


class TextEncoder:
    """Ids of whole texts, many at a time."""

    _open: dict[str, TextEncoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # Whether an id's token begins with a blank, which a byte-level vocabulary shows as U+0120.
        self.blank = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.blank[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = self._splits_at_blanks()
        self.known: tuple[pa.Array, np.ndarray, np.ndarray] = (pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def _splits_at_blanks(self) -> bool:
        described = json.loads(self.tokenizer.to_str())
        split = described["pre_tokenizer"] or {}
        return described["normalizer"] is None and described["truncation"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", False) and not split["add_prefix_space"]

    @classmethod
    def at(cls, path: str) -> TextEncoder:
        """The worker's own encoder."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a blank and each piece, one after the other, and how many each has."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for at in range(0, len(pieces), JOINED):
            part = pieces.slice(at, JOINED)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), " ")[0].as_py()
            found = self._library([" " + joined])[0]
            begins = np.flatnonzero(self.blank[found])
            if len(begins) != len(part) or begins[0]:
                raise ValueError("the tokenizer does not split words at blanks")
            ids.append(found)
            sizes.append(np.diff(np.append(begins, len(found))).astype(np.int32))
        return np.concatenate(ids), np.concatenate(sizes)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, how many each of them has, and which of them are the given distinct ones."""
        known, ids, sizes = self.known
        at = pc.index_in(pieces, value_set=known)
        missing = at.is_null()
        new = pieces.filter(missing)
        rows, missing = pc.fill_null(at, 0).to_numpy().astype(np.int64), missing.to_numpy(zero_copy_only=False)
        rows[missing] = len(known) + np.arange(len(new))
        more_ids, more_sizes = self._new_pieces(new)
        ids, sizes = np.concatenate([ids, more_ids]), np.concatenate([sizes, more_sizes])
        if known.nbytes + new.nbytes + ids.nbytes + sizes.nbytes <= KEPT_BYTES:
            self.known = (pa.concat_arrays([known, new]), ids, sizes)
        elif new.nbytes + more_ids.nbytes + more_sizes.nbytes <= KEPT_BYTES:
            self.known = (new, more_ids, more_sizes)
        return ids, sizes, rows

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.cut:
            odd = pc.match_substring_regex(texts, LONE_BLANK)
            for token in self.added:
                odd = pc.or_(odd, pc.match_substring(texts, token))
        else:
            odd = pa.array(np.ones(len(texts), bool))
        lists = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], lists.flatten()
        first = np.zeros(len(flat), bool)
        first[offsets[:-1]] = True
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        # The first piece has no blank before it; an odd text is one whole piece.
        heads = pc.if_else(odd, texts, flat.take(pa.array(offsets[:-1]))).dictionary_encode()
        ids, counts, rows = self._pieces(rest.dictionary)
        whole = self._library(heads.dictionary.to_pylist())
        table = np.concatenate([ids, *whole, np.array([end_id], np.int32)])
        sizes = np.concatenate([counts, np.array([len(x) for x in whole], np.int64), np.ones(1, np.int64)])
        starts = np.cumsum(sizes) - sizes
        # Piece numbers of the texts in order, the end after each text.
        docs = len(texts)
        what = np.empty(len(flat) + docs, np.int64)
        place = np.arange(len(flat)) + np.repeat(np.arange(docs), np.diff(offsets))
        piece = np.empty(len(flat), np.int64)
        piece[~first] = rows[rest.indices.to_numpy()]
        piece[first] = len(counts) + heads.indices.to_numpy()
        what[place] = piece
        ends = offsets[1:] + np.arange(docs)
        what[ends] = len(sizes) - 1
        n = sizes[what]
        before = np.cumsum(n) - n
        out = table[np.repeat(starts[what] - before, n) + np.arange(int(n.sum()))]
        stop = (before + n)[ends]
        return out, np.diff(np.append(0, stop))


def file_count(docs: DataFrame, text_col: str) -> int:
    """By the bytes of all texts, and at least as many as the session shuffles into."""
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END) -> DataFrame:
    """Rows of SCHEMA, sorted by id in each partition.

    Null ids come first; rows of equal id are in the order of their text (null first). Null and empty
    texts have the end id only. A text is encoded at once, however long, which takes some twelve times its
    bytes of memory. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The text is part of the range, so that repeated ids can't crowd one file.
    ordered = rows.withColumn("__h", F.xxhash64("text")).repartitionByRange(file_count(rows, "text"), "doc_id", "__h").sortWithinPartitions("doc_id", "__h", "text").drop("__h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, file, before = TextEncoder.at(tokenizer_path), TaskContext.get().partitionId(), 0
        for part in gathered(batches, "text", CHUNK_BYTES):
            ids, n = encoder.encode(part.column("text"), end_id)
            ends = np.cumsum(n)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.full(len(n), file, np.int32)), pa.array(before + ends - n), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(ids))],
                names=["doc_id", "file", "before", "n", "ids"],
            )
            before += int(ends[-1])

    return ordered.mapInArrow(encode, SCHEMA)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, **columns) -> None:
    encode_documents(docs, tokenizer_path, **columns).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, ids, start: the number of ids of all documents before it, over all files."""
    rows = spark.read.schema(SCHEMA).orc(path)
    files = staged(rows.groupBy("file").agg(F.sum("n").alias("n"), F.max(F.col("before") + F.col("n")).alias("end")), "files")
    wrong = files.filter("n <> end").first()
    if wrong:
        raise ValueError(f"file {wrong[0]} holds {wrong[1]} ids, its rows count {wrong[2]}")
    # One row a file, not of documents.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(bases, "file").select("doc_id", "ids", (F.col("base") + F.col("before")).alias("start"))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_tokens_orc(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Write all documents' ids as ORC in the shared folder, read them back, digest them."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    path = f"{shared_dir(spark)}-tokens"
    write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path, path)
    return digests(read_tokens(spark, path))
