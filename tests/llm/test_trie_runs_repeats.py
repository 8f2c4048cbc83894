"""Conversation trie, periodic runs and recurring passages against brute force and odd input."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import conversations, queries, repeats, runs
from brindle.llm.wordtable import Words, one_array, window_hashes
from conftest import SF
from oracle import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_trie_peeling", "op12_runs_lpf", "op13_repeats_anchor"])
def test_sql_on_more_rows(spark, name):
    assert same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) > 0


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Words


def test_words_of_many_texts():
    import pyarrow as pa

    texts = [None, "", " a\tb\x1cc\x0bd\x85e f  ", "x", "\n\n", "y z", "日本 語\r\n" * 3, "w" * 1000 + " " + "w" * 1000 + " " + "w" * 999, "z"]
    w = Words(one_array(pa.chunked_array([pa.array(texts[:4], pa.string()), pa.array(texts[4:], pa.string())])))
    found = [w.data[x:y].tobytes().decode() for x, y in zip(w.first, w.last, strict=True)]
    assert found == [x for t in texts for x in WORD.findall(t or "")]
    assert np.diff(w.doc).tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = w.hashes(1)
    assert len(set(zip(found, h.tolist(), strict=True))) == len(set(found)) == len(set(h.tolist())) and set(h.tolist()).isdisjoint(w.hashes(2).tolist())
    x = np.array([3, 1, 2, 3, 1, 2, 7], np.uint64)
    got = window_hashes(x, 3, 0x9E3779B97F4A7C15)
    assert got[0] == got[3] and len(set(got.tolist())) == 4 and len(window_hashes(x, 8, 3)) == 0


# 11. Conversation prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if whole[c] == k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_trie_against_brute_force(spark):
    rng, rows = random.Random(1), []
    for c in range(40):
        rows += [(c, rng.choice([t, t, None]), rng.choice(["u", None]), rng.choice(["a", "bé", None])) for t in range(rng.randint(0, 12))]
    rows += [(c, t, "u", "x") for c in range(1000, 1030) for t in range(c - 995)]  # each the beginning of the next
    rows += [(2000, t, "u", "y") for t in range(150)] + [(None, 1, "u", "a")] * 20
    rows += [(c, t, "u", f"common {t}") for c in range(3000, 3300, 5) for t in range(3)]  # copies
    df = spark.createDataFrame(rows, CONVERSATIONS)
    assert rows_of(conversations.conversation_trie(df)) == brute_trie(rows)
    clash = df.withColumns({x: F.lit(1) for x in ("depth", "node", "parent", "n", "h", "ord", "bytes")}).repartition(5)
    assert rows_of(conversations.conversation_trie(clash)) == brute_trie(rows)


def test_peeling_takes_few_rounds_on_a_long_chain(spark, monkeypatch):
    rows = [(0, t, "u", str(t)) for t in range(1000)] + [(5, t, "u", str(t)) for t in range(700)]
    names, staged = [], conversations.staged
    monkeypatch.setattr(conversations, "staged", lambda df, name, **k: names.append(name) or staged(df, name, **k))
    assert rows_of(conversations.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS))) == brute_trie(rows)
    assert names.count("round") < 25  # of 1,001 nodes in a row


def test_trie_odd_tables(spark):
    assert conversations.conversation_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert conversations.conversation_trie(spark.createDataFrame([(None, 1, "u", "a")], CONVERSATIONS)).count() == 0
    rows = [(7, 1, "u", "a"), (7, 1, "u", "a"), (-3, None, None, None), (8, 2, "u", "é" * 100_000)]
    assert rows_of(conversations.conversation_trie(spark.createDataFrame(rows, CONVERSATIONS))) == brute_trie_truncated(rows)


def brute_trie_truncated(rows):
    """For negative ids the remainder has the sign of the id, as in SQL."""
    assert -3 - int(np.fmod(-3, 5)) == 0 and 0 not in [r[0] for r in rows]
    return brute_trie(rows)


# 12. Periodic runs


def brute_runs(x, min_words, min_periods):
    n, found = len(x), {}
    for q in range(1, n // min_periods + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j - i + q >= max(min_words, min_periods * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_against_brute_force():
    rng, total = random.Random(1), 0
    for _ in range(2500):
        min_words, min_periods = rng.choice([2, 4, 6, 24]), rng.choice([2, 3, 3])
        n, k = rng.randint(1, rng.choice([12, 40, 120])), rng.choice([1, 2, 2, 3, 5])
        x = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
            for i in range(a + p, rng.randint(a, n)):
                x[i] = x[i - p]
        if rng.random() < 0.3:
            x = (x + x + [9] + x)[:300]
        codes = np.array(x)
        rank, repeated = runs.suffix_ranks(codes, np.array([n := len(x)]), runs.shared_words(min_words, min_periods))
        want = brute_runs(x, min_words, min_periods)
        assert (runs.all_runs(codes, rank, min_words, min_periods) if repeated[0] else []) == want
        total += len(want)
    assert total > 5000


def test_factors_and_prefixes():
    x = [0, 1, 0, 1, 0, 0, 1, 0]
    rank, _ = runs.suffix_ranks(np.array(x), np.array([8]), 1)
    order = np.argsort(rank).tolist()
    assert order == sorted(range(8), key=lambda i: x[i:])
    size, source = runs.previous_factors(order, rank.tolist(), runs.common_prefixes([*x, -1], order, rank.tolist()))
    assert size == [0, 0, 3, 2, 1, 3, 2, 1]
    assert all(x[i : i + k] == x[j : j + k] and j < i for i, (k, j) in enumerate(zip(size, source, strict=True)) if k)
    assert runs.prefix_function([1, 1, 2, 1, 1, 1]) == [6, 1, 0, 2, 2, 1] and runs.shared_words(24, 3) == 16


def test_runs_of_documents(spark):
    line = "one two three four five "
    texts = [None, "", " \n", "a", "a " * 23, "a " * 24, "a\t" * 30_000, f"x {line * 6}y", f"{line * 6}stop {line * 6}", "c d " * 12 + "e " + "c d " * 12, " ".join(f"w{i}" for i in range(4000)), f"{line * 6}", f"{line * 6}"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, line * 6), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("runs", "best", "collapsed", "start")})
    got = sorted((r.doc_id if r.doc_id is not None else -1, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in runs.find_runs(df).collect())
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        found = brute_runs(w, 24, 3) if len(w) < 29_000 else [(0, 30_000, 1)]
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        want.append((-1 if i is None else i, found, best, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)
    assert runs.find_runs(df.limit(0)).count() == 0 and sum(len(x[1]) for x in want) >= 9


def test_planted_periods():
    for i in range(400):
        h = zlib.crc32(str(i).encode())
        got = runs.planted_period(i, 50)
        if h % 10:
            assert got is None
        else:
            g = h // 10
            a, p = g % 50, 1 + (50 - g % 50) // (3 + g % 8)
            assert got.tolist() == [a + (k - a) % p if k >= a else k for k in range(50)]
    assert runs.planted_period(None, 5) is None and runs.planted_period(next(i for i in range(100) if not zlib.crc32(str(i).encode()) % 10), 0) is None


# 13. Recurring passages


def brute_repeats(rows, window):
    seen, split = defaultdict(int), [WORD.findall(t or "") for _, t in rows]
    for w in split:
        for s in range(len(w) - window + 1):
            seen[tuple(w[s : s + window])] += 1
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {k for s in range(len(w) - window + 1) if seen[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        spans = [[k, k] for k in sorted(gone) if k - 1 not in gone]
        for x in spans:
            while x[1] + 1 in gone:
                x[1] += 1
        out.append((-1 if i is None else i, len(w), spans, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def found_repeats(df, window=repeats.WINDOW):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, [list(x) for x in r.spans], r.kept) for r in repeats.find_repeats(df, window=window).collect())


@pytest.mark.parametrize("sizes", [(1 << 22, 1 << 23), (3_000, 5_000)])
@pytest.mark.parametrize("window", [35, 6, 1])
def test_repeats_against_brute_force(spark, monkeypatch, sizes, window):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", sizes[0])
    monkeypatch.setattr(repeats, "BUCKET_BYTES", sizes[1])
    rng = random.Random(window)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    texts = [None, "", " \n ", "a", "b " * 34, "c " * 35, "d " * 36]
    for _ in range(150):
        parts = [[word() for _ in range(rng.randrange(60))] for _ in range(3)]
        texts.append(" ".join(parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared) * rng.randrange(2) + parts[2]))
    texts += texts[-3:] * 2 + [" ".join(shared[4] * 20)]
    rows = [*enumerate(texts), (None, texts[-1]), (5, texts[5]), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("chunk", "bucket", "spans", "kept", "bits")})
    assert found_repeats(df.repartition(7), window) == brute_repeats(rows, window)


def test_repeats_odd_tables(spark):
    df = spark.createDataFrame([("x", None), ("y", ""), (None, None)], "name string, body string")
    assert rows_of(repeats.find_repeats(df, "name", "body").select("doc_id", "n_words", "kept")) == sorted([("x", 0, ""), ("y", 0, ""), (None, 0, "")], key=str)
    assert repeats.find_repeats(df.limit(0), "name", "body").count() == 0
    long = " ".join(str(i) for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long[:1000] + " end"), (3, "0 1 2 3")], "doc_id long, text string")
    assert [x[:3] for x in found_repeats(df)] == [(1, 300_000, [[0, 276]]), (2, 279, [[0, 276]]), (3, 4, [])]
    assert rows_of(repeats.remove_repeats(df).filter("doc_id > 1")) == [(2, "27 end"), (3, "0 1 2 3")]


def test_repeats_on_several_executors():
    """Rows of a chunk come in another order in each pass, as blocks of a shuffle are fetched in any order."""
    import subprocess
    import sys
    import tempfile

    root = str(__import__("pathlib").Path(__file__).resolve().parents[2])
    code = """
import random, sys
sys.path[:0] = [sys.argv[1], sys.argv[1] + "/tests", sys.argv[1] + "/tests/llm"]
from pyspark.sql import SparkSession
from brindle.llm import repeats
from test_trie_runs_repeats import brute_repeats, found_repeats
conf = {"spark.ui.enabled": "false", "spark.executor.memory": "700m", "spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": "file://" + sys.argv[2]}
b = SparkSession.builder.master("local-cluster[3,1,1024]")
for k, v in conf.items():
    b = b.config(k, v)
spark = b.getOrCreate()
repeats.CHUNK_BYTES, repeats.BUCKET_BYTES = 30_000, 50_000
rng = random.Random(5)
word = lambda: f"w{rng.randrange(3000)}"
shared = [[word() for _ in range(n)] for n in (34, 35, 60)]
rows = [(i, " ".join([word() for _ in range(rng.randrange(60))] + rng.choice(shared) * (i % 3 == 0) + [word() for _ in range(60)])) for i in range(1000)]
assert found_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(30)) == brute_repeats(rows, 35)
"""
    with tempfile.TemporaryDirectory() as folder:
        env = __import__("os").environ | {"PYTHONPATH": root}
        out = subprocess.run([sys.executable, "-c", code, root, folder], capture_output=True, text=True, timeout=300, env=env)
    assert out.returncode == 0, out.stderr[-2000:]


# What workers hold


def test_automaton_of_a_million_words_is_small():
    import pickle
    import subprocess
    import sys

    from brindle.llm.decontaminate import ItemAutomaton

    rng = np.random.default_rng(1)
    words = np.minimum(rng.zipf(1.3, 1_000_000), 300_000)
    items = [(str(i), [b"w%d" % w for w in words[at : at + 200]]) for i, at in enumerate(range(0, len(words), 200))]
    data = pickle.dumps(ItemAutomaton(items))
    held = "import pickle, resource, sys; sys.path.insert(0, sys.argv[1]); import brindle.llm.decontaminate; m = lambda: int(open('/proc/self/statm').read().split()[1]) * 4096; a = m(); x = pickle.load(sys.stdin.buffer); print(m() - a)"
    root = str(__import__("pathlib").Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", held, root], input=data, capture_output=True, check=True)
    assert int(out.stdout) < 150e6, int(out.stdout)


def test_long_words_are_not_remembered():
    from brindle.llm.neardup import LONGEST, WordHashes

    known = WordHashes()
    first = known.of(f"{'x' * 10_000} short {'y' * LONGEST}")
    assert len(known) == 2 and first.tolist() == known.of(f"{'x' * 10_000} short {'y' * LONGEST}").tolist()


def test_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    from brindle.llm.common import BATCH_BYTES, small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    small_batches(spark)
    df = spark.range(0, 60, 1, 1).withColumn("t", F.repeat(F.lit("word "), 200_000))
    got = df.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 60 and max(r["size"] for r in got) <= BATCH_BYTES + 1_100_000
