"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton of all items is built once on the driver and broadcast; documents stream through it word
by word. At each word it holds the longest suffix read so far that occurs in any item, so a match of
`window` words or more covers every window that ends there, and the state tells which items hold it.

Once built, an automaton is flat arrays: the edges of all states in a row, those of a state by word. Items
whose words exceed `part_words` are dealt to several automata of at most that many words (plus one item).
Each is a pass of its own over the texts, which writes the spans of texts that it hits by the text's digest;
the last pass meets them by a join. So what is broadcast has a fixed bound however large the benchmark grows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WORD_BYTES, read_table, small_batches, staged, word_chunks

WINDOW = 10
PART_WORDS = 1_000_000
#: A document of which spans cover at least this share of the words is rejected as a whole.
MAX_COVERAGE = 0.5


class ItemAutomaton:
    """Generalised suffix automaton over word sequences, with the items that own each state's strings."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        owners: list[set[str]] = [set()]
        short: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            last = 0
            path = []
            for w in words:
                last = self._extend(last, self.words.setdefault(w, len(self.words)), owners)
                path.append(last)
            # A clone made later takes over shorter strings only, so the prefix states keep the item.
            if len(words) >= window:
                for state in path:
                    owners[state].add(item)
            elif words:
                short.setdefault(last, []).append((len(words), item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for s in order:
            # Shorter strings than a window are never asked for.
            if self.length[self.link[s]] >= window:
                owners[self.link[s]] |= owners[s]
        # The state of the last `window` words is the ancestor whose strings include that length.
        self.owners: list[frozenset[str]] = [frozenset()]
        owned, known = array("i", bytes(4 * len(self.link))), {self.owners[0]: 0}
        up = array("i", bytes(4 * len(self.link)))
        for s in reversed(order):
            up[s] = s if self.length[self.link[s]] < window <= self.length[s] else up[self.link[s]] if self.length[s] >= window else 0
            if up[s] == s:
                one = frozenset(owners[s])
                if one not in known:
                    known[one] = len(self.owners)
                    self.owners.append(one)
                owned[s] = known[one]
        for s in order:
            if self.length[s] >= window:
                owned[s] = owned[up[s]]
        self.owned = owned
        # Whole short items end at a state or at one of its ancestors.
        self.shorts: list[tuple[tuple[int, str], ...]] = [()]
        self.short = array("i", bytes(4 * len(self.link)))
        for s in reversed(order):
            above = self.short[self.link[s]]
            if s in short:
                self.shorts.append(tuple(short[s]) + self.shorts[above])
                above = len(self.shorts) - 1
            self.short[s] = above
        self.has_short = bool(short)
        self._flatten()

    def _flatten(self) -> None:
        """Edges of a state s: those from first[s] to first[s + 1], by word."""
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.first, self.word, self.target = array("i", [0]), array("i"), array("i")
        self.root = array("i", (self.next[0][c] for c in range(len(self.words))))
        for s, edges in enumerate(self.next):
            for c in sorted(edges) if s else ():
                self.word.append(c)
                self.target.append(edges[c])
            self.first.append(len(self.word))
            self.next[s] = None
        del self.next

    def _new(self, length: int, link: int, nxt: dict[int, int], owners: list, owned: set) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        owners.append(owned)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int, owners: list) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), owners, set())
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int, owners: list) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w, owners)
        cur = self._new(self.length[last] + 1, 0, {}, owners, set())
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w, owners)
        return cur

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """Number of words; disjoint ascending [first, last] word spans that are hit; items that occur."""
        link, length, first, word, target, root, owned, short = self.link, self.length, self.first, self.word, self.target, self.root, self.owned, self.short
        code_of, window, has_short = self.words.get, self.window, self.has_short
        spans: list[list[int]] = []
        found: set[int] = set()
        items: set[str] = set()
        state = size = at = 0
        for words in word_chunks(text):
            for i, w in enumerate(words, at):
                c = code_of(w)
                if c is None:
                    state = size = 0
                    continue
                while state:
                    low, high = first[state], first[state + 1]
                    if high - low > 1:
                        low = bisect_left(word, c, low, high)
                    if low < high and word[low] == c:
                        state = target[low]
                        size += 1
                        break
                    state = link[state]
                    size = length[state]
                else:
                    state, size = root[c], 1
                if size >= window:
                    _add(spans, i - size + 1, i)
                    found.add(owned[state])
                if has_short:
                    for n, item in self.shorts[short[state]]:
                        if n <= size:
                            _add(spans, i - n + 1, i)
                            items.add(item)
            at += len(words)
        return at, spans, items.union(*map(self.owners.__getitem__, found))


def _add(spans: list[list[int]], first: int, last: int) -> None:
    while spans and spans[-1][0] >= first:
        spans.pop()
    if spans and spans[-1][1] >= first - 1:
        spans[-1][1] = last
    else:
        spans.append([first, last])


def _parts(benchmark: DataFrame, id_col: str, text_col: str, part_words: int) -> Iterator[list]:
    """Items with their words, in lists of at most part_words words and one item; rows come one at a time."""
    part, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("string"), text_col).toLocalIterator():
        words = [w for c in word_chunks(row[1]) for w in c]
        part.append((row[0], words))
        size += len(words)
        if size >= part_words:
            yield part
            part, size = [], 0
    if part:
        yield part


_SPANS = "array<struct<first:long,last:long>>"
_PA_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def find_spans(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, part_words: int = PART_WORDS, carry_text: bool = True, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: T.StructType | None = None,
) -> DataFrame:
    """All columns of docs (without the text if not carry_text) and n_words, spans, items.

    Null and empty texts have no words and no spans; an item without words never occurs; repeated rows
    are kept as they are. spans are disjoint ranges of word positions, ascending; items are item ids as
    strings, sorted. All items of null id are one item without a name: its words count, it stands first as
    a null and is left out of digests. Columns of docs named like the three new ones are replaced. finish
    makes rows of another schema of these, batch by batch.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    parts = _parts(benchmark, item_col, item_text_col, part_words)
    docs = docs.drop("n_words", "spans", "items")
    # Without any item, an automaton of nothing matches nothing. One automaton is built and held at a time.
    now, more = next(parts, []), next(parts, None)
    earlier = []
    key = F.unhex(F.md5(F.col(text_col).cast("binary")))
    while more is not None:
        hit = _scan(docs.select(key.alias("__key"), text_col), sc.broadcast(ItemAutomaton(now, window)), text_col, False, False).filter("size(spans) > 0")
        earlier.append(staged(hit.dropDuplicates(["__key"]).select("__key", "spans", "items"), "spans"))
        now, more = more, next(parts, None)
    if earlier:
        # One row a part.
        hit = reduce(DataFrame.unionByName, earlier).groupBy("__key").agg(*(F.flatten(F.collect_list(x)).alias(x) for x in ("spans", "items")))
        none = {"spans": F.array().cast(_SPANS), "items": F.array().cast("array<string>")}
        docs = docs.withColumn("__key", key).join(hit, "__key", "left").drop("__key").withColumns({x: F.coalesce(x, none[x]) for x in none})
    df = _scan(docs, sc.broadcast(ItemAutomaton(now, window)), text_col, carry_text, bool(earlier), finish, schema)
    return df if carry_text or text_col not in df.columns else df.drop(text_col)


def _scan(df: DataFrame, automaton, text_col: str, carry_text: bool, merge: bool, finish=None, schema: T.StructType | None = None) -> DataFrame:
    added = T.StructType.fromJson(T._parse_datatype_string(f"n_words long, spans {_SPANS}, items array<string>").jsonValue())
    keep = [f for f in df.schema.fields if f.name not in added.names and (carry_text or f.name != text_col)]
    names = [f.name for f in keep]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gsa = automaton.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                counts, spans, items = [], [], []
                for k, text in enumerate(part.column(text_col)):
                    n, s, i = gsa.scan(text.as_py())
                    if merge:
                        s = merged(s, [[x["first"], x["last"]] for x in part.column("spans")[k].as_py()])
                        i = i.union(part.column("items")[k].as_py())
                    counts.append(n)
                    spans.append([{"first": x, "last": y} for x, y in s])
                    items.append(sorted(i, key=lambda x: (x is not None, x or "")))
                out = pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in names), pa.array(counts, pa.int64()), pa.array(spans, _PA_SPANS), pa.array(items, pa.list_(pa.string()))],
                    names=[*names, *added.names],
                )
                yield finish(out) if finish else out

    return df.mapInArrow(scan, schema if finish else T.StructType([*keep, *added.fields]))


def merged(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between those words."""
    data = text.encode("utf-8", "surrogatepass")
    flat = data.translate(WORD_BYTES)
    out, kept, at, n, todo = [], 0, 0, 0, list(spans)
    size = len(flat)
    begun = None
    while todo and at < size:
        while at < size and flat[at] == 0x20:
            at += 1
        end = flat.find(b" ", at)
        end = size if end < 0 else end
        if n == todo[0][0]:
            begun = at
        if n == todo[0][1]:
            out.append(data[kept:begun])
            kept = end
            todo.pop(0)
        n += 1
        at = end
    out.append(data[kept:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def remove_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, text_col: str = "text", length_col: str | None = "n_chars",
) -> DataFrame:
    """docs with every matched span of `window` words or more (or whole shorter item) cut out of the text.

    Documents of which the spans cover max_coverage of the words or more go; the others keep all their
    columns, and length_col, if they have it, counts the characters of the new text. Null texts stay.
    """
    columns = docs.columns
    own = {c: f"__own_{c}" for c in ("n_words", "spans", "items") if c in columns}
    docs = docs.withColumnsRenamed(own)
    fields = docs.schema.fields
    names = [f.name for f in fields]

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = [], []
        for text, n, spans in zip(b.column(text_col).to_pylist(), b.column("n_words").to_pylist(), b.column("spans").to_pylist(), strict=True):
            hit = sum(s["last"] - s["first"] + 1 for s in spans)
            keep.append(not spans or hit < max_coverage * n)
            texts.append(cut_spans(text, [(s["first"], s["last"]) for s in spans]) if spans and keep[-1] else text)
        columns = [pa.array(texts, pa.string()) if x == text_col else b.column(x) for x in names]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    # The scan cuts right away: one Python worker a task.
    df = find_spans(docs, benchmark, text_col, window=window, finish=cut, schema=T.StructType(fields))
    out = df.withColumnsRenamed({v: k for k, v in own.items()}).select(*columns)
    if length_col in out.columns:
        kind = dict(out.dtypes)[length_col]
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return out


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Per document: words, words inside benchmark windows, items found. See find_spans for odd input."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, read_table(spark, sf_dir, "benchmark"), carry_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
