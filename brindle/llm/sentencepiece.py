"""Unigram encoding and decoding with the pieces of a SentencePiece model.

Blanks become the marker U+2581, one marker is put in front, and the best segmentation is the one with
the largest sum of the pieces' log scores (Viterbi); of equal sums the one whose last piece begins
earliest. Pieces are looked up in a double-array trie. A character that no piece covers costs ten less
than the worst piece and becomes its UTF-8 bytes. Decoding joins pieces and bytes, turns markers into
blanks and drops the one in front.

The given models were made by merging and score a piece by its rank, not by its probability; such ranks
are taken as log probabilities under Zipf's law (the k-th piece has the probability 1/k over the sum of
all). Models with log probabilities keep them.

No piece of more than one character but a run of markers has a marker anywhere except in front, and none
has a newline, so the best segmentation of a text joins those of its parts between these places; parts
are segmented once, many at a time, and remembered. For the same reason a part is cut at every place that
no piece reaches across, so text without blanks goes fast too; very long texts are segmented in windows that
end at such places. A run of one letter that no place parts is one window, however long.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import read_table, small_batches

MARK = "▁"
UNKNOWN_COST = 10.0
#: Parts that a worker remembers (twice as many for a time), of so many characters at most.
REMEMBERED = 200_000
LONGEST = 64
#: Characters that are segmented at a time.
WINDOW = 1 << 18


class DoubleArray:
    """A trie over code points in two arrays: child c of node n is base[n] + c, if check there is n."""

    def __init__(self, words: dict[str, int]):
        chars = sorted({ord(c) for w in words for c in w})
        self.chars = np.array(chars, np.int64)
        code = {c: i + 1 for i, c in enumerate(chars)}
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, v in words.items():
            node = 0
            for c in word:
                k = code[ord(c)]
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][k]
            value[node] = v
        size = len(children) + 2 * len(chars) + 2
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        place, free, todo = {0: 0}, 1, [0]
        for node in todo:
            at = place.pop(node)
            self.value[at] = value[node]
            kids = np.array(sorted(children[node]), np.int64)
            if not len(kids):
                continue
            while self.check[free] >= 0:
                free += 1
            base = max(1 - int(kids[0]), free - int(kids[0]))
            while True:
                end = base + int(kids[-1])
                if end >= len(self.check):
                    self._grow(end + 1)
                taken = self.check[base + kids] >= 0
                if not taken.any():
                    break
                base += 1
            self.base[at] = base
            self.check[base + kids] = at
            for k in kids.tolist():
                place[children[node][k]] = base + k
                todo.append(children[node][k])

    def _grow(self, least: int) -> None:
        more = max(least, 2 * len(self.check)) - len(self.check)
        self.base = np.append(self.base, np.zeros(more, np.int32))
        self.check = np.append(self.check, np.full(more, -1, np.int32))
        self.value = np.append(self.value, np.full(more, -1, np.int32))

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Of code points: the trie's own numbers, 0 for characters it doesn't have."""
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, at + 1, 0)

    def matches(self, codes: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the positions where a word of this length starts, and its value. room: places up to the part's end."""
        start, node, n = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(start):
            c = codes[start + n]
            child = self.base[node] + c
            child = np.where((c > 0) & (child < len(self.check)), child, 0)
            ok = (child > 0) & (self.check[child] == node)
            start, node, n = start[ok], child[ok].astype(np.int64), n + 1
            hit = self.value[node] >= 0
            if hit.any():
                yield n, start[hit], self.value[node[hit]]
            more = room[start] > n
            start, node = start[more], node[more]


class Unigram:
    """Pieces with log scores; encodes and decodes."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown_id: int = 0):
        """pieces: '' for what no text becomes (controls, bytes); byte_ids: the piece of each byte value."""
        # Multiples of 2**-20 add up without rounding, so equal sums are equal wherever they stand in a text.
        self.scores = np.round(np.array(scores, np.float64) * 2.0**20) / 2.0**20
        self.trie = DoubleArray({p: i for i, p in enumerate(pieces) if p})
        real = [i for i, p in enumerate(pieces) if p]
        self.unknown_score = float(self.scores[real].min()) - UNKNOWN_COST
        self.byte_ids, self.unknown_id = byte_ids, unknown_id
        self.bytes = [p.replace(MARK, " ").encode() for p in pieces]
        for value, i in byte_ids.items():
            self.bytes[i] = bytes([value])
        self.byte_set = np.zeros(len(pieces), bool)
        self.byte_set[list(byte_ids.values())] = True
        inner = [p for p in pieces if len(p) > 1]
        self.longest = max(map(len, pieces), default=1)
        # Where these do not hold for a model, its texts are not cut at that place.
        self.cut_marks = not any(MARK in p.lstrip(MARK) or (p.startswith(MARK + MARK) and p.strip(MARK)) for p in inner)
        self.cut_lines = self.cut_marks and not any("\n" in p for p in inner)
        self.known: tuple[dict[str, bytes | None], dict] = ({}, {})

    @classmethod
    def from_model(cls, path: str) -> Unigram:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        pieces = ["" if i in special or sp.is_byte(i) else sp.id_to_piece(i) for i in range(n)]
        scores = [float(sp.get_score(i)) for i in range(n)]
        used = [scores[i] for i in range(n) if pieces[i]]
        if all(s == round(s) for s in used):
            total = sum(1 / (1 - s) for s in used)
            scores = [-float(np.log1p(-s) + np.log(total)) if pieces[i] else 0.0 for i, s in enumerate(scores)]
        return cls(pieces, scores, byte_ids, sp.unk_id())

    def segment(self, parts: list[str]) -> list[bytes]:
        """Ids (little-endian int32) of each part, which has its markers already; none is empty."""
        text = "".join(parts)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])
        begins = ends - np.array([len(p) for p in parts])
        part = np.repeat(np.arange(len(parts)), ends - begins)
        offset = np.arange(len(points)) - begins[part]
        room = ends[part] - np.arange(len(points))
        found = [(np.arange(len(points)), np.ones(len(points), np.int64), np.full(len(points), -1), np.full(len(points), self.unknown_score))]
        for n, start, piece in self.trie.matches(self.trie.codes(points), room):
            found.append((start, np.full(len(start), n), piece.astype(np.int64), self.scores[piece]))
        start, size, piece, score = (np.concatenate(x) for x in zip(*found, strict=True))
        # The best path goes through every place that no piece reaches across: parts are cut there.
        own = part[np.flatnonzero(fresh := self._uncovered(start, size, len(points)) | (offset == 0))]
        begins = np.flatnonzero(fresh)
        ends, part = np.append(begins[1:], len(points)), np.cumsum(fresh) - 1
        offset = np.arange(len(points)) - begins[part]
        # Sixteen bits are sorted by counting.
        order = np.argsort(offset[start].astype(np.uint16) if offset.max() < 1 << 16 else offset[start], kind="stable")
        start, size, piece, score = start[order], size[order], piece[order], score[order]
        bound = np.searchsorted(offset[start], np.arange(int(offset.max()) + 2))
        # State k + part is the place after k characters; a part of n characters has n + 1 places.
        place = start + part[start]
        best = np.full(len(points) + len(own), -np.inf)
        best[begins + np.arange(len(own))] = 0.0
        back, took = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int64)
        for lo, hi in zip(bound[:-1], bound[1:], strict=True):
            a = place[lo:hi]
            b = a + size[lo:hi]
            total = best[a] + score[lo:hi]
            # A known one-character piece and the unknown edge end at the same place: the better one comes last.
            if hi - lo > 1:
                by = np.argsort(total, kind="stable")
                a, b, total, what = a[by], b[by], total[by], piece[lo:hi][by]
            else:
                what = piece[lo:hi]
            ok = total > best[b]
            best[b[ok]], back[b[ok]], took[b[ok]] = total[ok], a[ok], what[ok]
        on = np.zeros(len(best), bool)
        first = begins + np.arange(len(own))
        at = ends + np.arange(len(own))
        while len(at):
            on[at] = True
            at = back[at]
            more = at > first
            at, first = at[more], first[more]
        where = np.flatnonzero(on)
        ids = took[where]
        owner = np.searchsorted(ends + np.arange(len(own)), where)
        counts = np.bincount(own[owner], minlength=len(parts))
        if (ids < 0).any():
            # Characters without a piece: spelled out in bytes.
            flat, grown = [], np.zeros(len(parts), np.int64)
            for o, w, i in zip(owner.tolist(), where.tolist(), ids.tolist(), strict=True):
                if i >= 0:
                    new = [i]
                else:
                    raw = chr(int(points[w - o - 1])).encode("utf-8", "surrogatepass")
                    new = [self.byte_ids[x] for x in raw] if len(self.byte_ids) == 256 else [self.unknown_id]
                flat += new
                grown[own[o]] += len(new)
            ids, counts = np.array(flat, np.int64), grown
        data = ids.astype("<i4").tobytes()
        stop = (np.cumsum(counts) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]

    @staticmethod
    def _uncovered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        """Of n places: whether no match (start, size) reaches across."""
        cover = np.bincount(start + 1, minlength=n + 2) - np.bincount(start + size, minlength=n + 2)
        return np.cumsum(cover)[:n] == 0

    def _windows(self, part: str) -> Iterator[str]:
        """A part cut at places that no piece reaches across, into windows of about WINDOW characters."""
        at = 0
        while len(part) - at > WINDOW:
            size = WINDOW
            while True:
                window = part[at : at + size]
                points = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                found = [(s, np.full(len(s), n)) for n, s, _ in self.trie.matches(self.trie.codes(points), len(points) - np.arange(len(points)))]
                start, length = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
                # Near the window's end, pieces may reach on.
                cuts = np.flatnonzero(self._uncovered(start, length, len(points))[: max(0, len(points) - self.longest)])
                if at + size >= len(part) or (len(cuts) and cuts[-1]):
                    break
                size *= 2
            if at + size >= len(part) and not (len(cuts) and cuts[-1]):
                break
            yield part[at : at + int(cuts[-1])]
            at += int(cuts[-1])
        yield part[at:]

    def _learn(self, new: set[str]) -> None:
        (known, old), todo = self.known, []
        for p in new:
            if len(p) > LONGEST:
                continue
            if p in old:
                known[p] = old[p]
            elif not p or MARK in p:
                known[p] = None
            else:
                todo.append(p)
        for at in range(0, len(todo), 5_000):
            part = todo[at : at + 5_000]
            known.update(zip(part, self.segment([p if p[0] == "\n" else MARK + p for p in part]), strict=True))

    def _whole(self, text: str) -> bytes:
        """A text with runs of blanks or markers, cut where it may be."""
        text = MARK + text.replace(" ", MARK)
        parts = re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if self.cut_lines else f"{MARK}+[^{MARK}]*", text) if self.cut_marks else [text]
        out, held, chars = [], [], 0
        for part in parts:
            for piece in self._windows(part) if len(part) > WINDOW else (part,):
                if held and chars + len(piece) > WINDOW:
                    out += self.segment(held)
                    held, chars = [], 0
                held.append(piece)
                chars += len(piece)
        return b"".join(out + (self.segment(held) if held else []))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text as little-endian int32; none for null and empty texts."""
        if not self.cut_lines:
            return [self._whole(t) if t else b"" for t in texts]
        if len(self.known[0]) > REMEMBERED:
            self.known = ({}, self.known[0])
        # A part is a word (with the marker before it left out) or a newline with the letters after it.
        cut = [t.replace("\n", " \n").split(" ") if t and t[0] != "\n" else None for t in texts]
        new: set[str] = set()
        for parts in cut:
            if parts:
                new.update(set(parts).difference(self.known[0]))
        if new:
            self._learn(new)
        known, out = self.known[0], []
        for text, parts in zip(texts, cut, strict=True):
            if not text:
                out.append(b"")
            elif parts is None:
                out.append(self._whole(text))
            else:
                try:
                    out.append(b"".join(map(known.__getitem__, parts)))
                except (TypeError, KeyError):  # a part remembered as None, or too long to be
                    out.append(self._whole(text))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        data = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_path: str, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with ids array<int>, n_pieces, n_byte_pieces, ids_crc32 and round_trip (each with the prefix).

    round_trip: decoding the ids gives the text back, character for character (markers in the text come
    back as blanks, so such a text is false). Null and empty texts have no ids; null counts as a round
    trip. The model is read on the driver and broadcast; columns of these names are replaced.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Unigram.from_model(model_path))
    kinds = (("ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("n_byte_pieces", T.LongType()), ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType()))
    added = [T.StructField(prefix + n, t) for n, t in kinds]
    docs = docs.drop(*[f.name for f in added])
    names = docs.columns

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(text_col).to_pylist()
                ids = m.encode(texts)
                n = [len(x) // 4 for x in ids]
                ends = np.cumsum([0, *n]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                n_bytes = [int(m.byte_set[np.frombuffer(x, "<i4")].sum()) for x in ids]
                trip = [m.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends), values), pa.array(n, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(trip, pa.bool_())],
                    names=[*names, *(f.name for f in added)],
                )

    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, *added]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece_unigram(spark, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Ids of every document, and whether they decode to the text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, model_path or default_model()).select("doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip", "ids")
