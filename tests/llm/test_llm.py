"""The operators against brute force, libraries and odd input, on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import ann, decontaminate, htmltext, langid, neardup, quality, queries, sentencepiece, shard, tokens_orc, warc
from brindle.llm.common import byte_chunks, gathered, read_table, word_chunks
from conftest import SF, SF_SMALL
from oracle import same

ODD = [None, "", " ", "x", "x", "Ein Wort.\n\nZwei  Worte", "!!! ### ...", "日本語 текст", "a " * 30_000, "the same words again and again " * 40]


def documents(spark, texts, **extra):
    rows = [(i, t, None if t is None else "en") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def words(text):
    return [w.decode() for c in word_chunks(text) for w in c]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert same(queries.queries()[name](spark, SF_SMALL), queries.oracle_sql()[name], SF_SMALL) > 0


def test_words_in_chunks():
    text = "Ab-c dÉ 1_2 " * 50
    assert [w for c in word_chunks(text, chunk=64) for w in c] == [w for c in word_chunks(text) for w in c]
    assert words("Ab-c dÉ 1_2") == ["ab", "c", "dÉ", "1", "2"]


# 1. Sharding


def test_differencing_is_exact_on_the_textbook_case():
    subset, sums = shard.block_partition([8, 7, 6, 5, 4], 2)
    assert abs(sums[0] - sums[1]) == 2 and sum(sums) == 30  # what differencing gives; the optimum is 0
    assert [sum(s for s, j in zip([8, 7, 6, 5, 4], subset, strict=True) if j == k) for k in (0, 1)] == sums


def test_differencing_balances_and_places_everything():
    rng = random.Random(3)
    sizes = [rng.randint(1, 1000) for _ in range(700)]
    subset, sums = shard.block_partition(sizes, 16)
    assert max(sums) - min(sums) <= 5
    assert sums == [sum(s for s, j in zip(sizes, subset, strict=True) if j == k) for k in range(16)]
    assert shard.differencing([]) == [] and shard.differencing([(1, 2)]) == [[0, 1]]


def brute_differencing(sizes, k):
    """Sums of k-way differencing, by looking for the two largest spreads each time."""
    parts = [tuple(sorted([s] + [0] * (k - 1))) for s in sizes]
    while len(parts) > 1:
        at = sorted(range(len(parts)), key=lambda i: parts[i][0] - parts[i][-1])[:2]
        x, y = (parts[i] for i in at)
        parts = [p for i, p in enumerate(parts) if i not in at] + [tuple(sorted(a + b for a, b in zip(x, reversed(y), strict=True)))]
    return parts[0]


def test_differencing_against_brute_force():
    rng = random.Random(7)
    for _ in range(60):
        # Sizes that are all different, so that no tie of spreads can be taken another way.
        sizes, k = rng.sample(range(1, 10_000), rng.randint(1, 40)), rng.randint(2, 6)
        assert tuple(sorted(shard.block_partition(sizes, k)[1])) == brute_differencing(sizes, k)


def test_levels_of_differencing_balance(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 3000) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, size long")
    for most in (4096, 5):
        rows = shard.shard_by_bytes(df, F.col("id"), F.col("size"), shards=4, block=16, most=most).collect()
        sums = [sum(sizes[r.id] for r in rows if r.shard == j) for j in range(4)]
        assert sorted(r.id for r in rows) == list(range(2000)) and max(sums) - min(sums) <= 0.002 * sum(sizes)
        assert all(sorted(r.slot for r in rows if r.shard == j) == list(range(sum(r.shard == j for r in rows))) for j in range(4))


def test_shards_keep_groups_and_number_rows(spark):
    rows = queries.queries()["op1_shard_kk"](spark, SF).toPandas()
    docs = {r.doc_id: r.text for r in read_table(spark, SF, "documents").collect()}
    assert len(rows) == len(docs)
    assert rows.groupby(rows.doc_id.map(docs.get)).shard.nunique().max() == 1
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    for r in rows.itertuples():
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    total = rows.groupby("shard")["size"].sum()
    assert total.max() - total.min() < 0.02 * total.mean()


def test_shards_of_odd_rows(spark):
    df = documents(spark, ODD, shard="old", size=5)
    out = shard.shard_by_bytes(df.drop("size"), F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)) + 1, shards=4).collect()
    assert len(out) == len(ODD) and all(0 <= r.shard < 4 for r in out)
    assert len({r.shard for r in out if r.text == "x"}) == 1
    assert shard.shard_by_bytes(documents(spark, []), F.col("text"), F.lit(1), shards=4).count() == 0


# 2. Decontamination


def brute_spans(text, items, window=10):
    doc, hit, found = words(text), set(), set()
    for item, t in items.items():
        w = words(t)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1) if n else ():
            if tuple(doc[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(item)
    return len(doc), len(hit), found


def test_automaton_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        vocab = "abcd"[: rng.randint(2, 4)]
        items = {str(k): " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9))) for k in range(rng.randint(0, 4))}
        gsa = decontaminate.ItemAutomaton([(k, [w.encode() for w in words(t)]) for k, t in items.items()], window=4)
        text = " ".join(rng.choice(vocab + "z") for _ in range(rng.randint(0, 40)))
        n, spans, found = gsa.scan(text)
        want = brute_spans(text, items, 4)
        assert (n, sum(b - a + 1 for a, b in spans), found) == want, (items, text)


def test_parts_give_the_same_spans(spark):
    docs, bench = read_table(spark, SF_SMALL, "documents").select("doc_id", "text"), read_table(spark, SF_SMALL, "benchmark")
    key = lambda df: sorted((r.doc_id, r.n_words, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in df.collect())
    assert key(decontaminate.find_spans(docs, bench)) == key(decontaminate.find_spans(docs, bench, part_words=400))


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, "rare pair")], "item_id long, text string")
    clean = "Nothing of it is in here, " * 6
    docs = documents(spark, [clean + item.upper().replace(" ", "-") + "! The end. " + clean, item, clean, None, "", "A Rare, pair. " + clean], n_words=7)
    out = {r.doc_id: r for r in decontaminate.remove_contamination(docs, bench).collect()}
    assert sorted(out) == [0, 2, 3, 4, 5]
    assert out[0].text == clean + "! The end. " + clean and out[0].n_chars == len(out[0].text)
    assert out[2].text == clean and out[3].text is None and out[4].text == "" and out[5].text == "A . " + clean
    assert out[0].n_words == 7
    again = decontaminate.find_spans(decontaminate.remove_contamination(docs, bench), bench).collect()
    assert not any(r.spans for r in again)
    assert decontaminate.find_spans(documents(spark, ODD), bench.limit(0)).filter(F.size("spans") > 0).count() == 0


def test_items_of_null_id(spark, tmp_path):
    from oracle import same

    texts = [" ".join(f"{c}{i}" for i in range(12)) for c in "abcd"]
    docs = [texts[0], " ".join(texts[:2]), " ".join([texts[3], texts[1], texts[2]]), "none of them", None]
    documents(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(None, texts[0]), (5, texts[1]), (None, texts[2]), (10, texts[3])], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert same(decontaminate.op2_decontaminate(spark, str(tmp_path)), queries.OP2_SQL, str(tmp_path)) == 5
    for part_words in (1_000_000, 1):
        found = decontaminate.find_spans(documents(spark, docs), bench, part_words=part_words).orderBy("doc_id").collect()
        assert [r["items"] for r in found] == [[None], [None, "5"], [None, "10", "5"], [], []]


# 3. HTML


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><div id="top-menu"><a href="/">Home</a></div><nav>x</nav>'
    "<article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>three\n four</b><p>five &lt;b&gt; &copy;<div class='comments'><p>no</p></div><ul><li>a<li>b</ul>"
    "<table><tr><td>1<td>2</table></article><footer>f</footer><!-- open"
)


def test_main_text():
    assert htmltext.main_text(PAGE) == "Head & line\nOne two three four\nfive <b> ©\na\nb\n1\n2"
    assert htmltext.main_text(None) == "" == htmltext.main_text("")
    assert htmltext.main_text("plain &amp; simple") == "plain & simple"
    assert htmltext.main_text("<p>a<script>if (1 < 2) x</p>") == "a"
    assert htmltext.main_text("<div>" * 3000 + "deep") == "deep"
    assert htmltext.main_text('<p title="a > b">x</p><p a=">y') == "x\ny"


def test_templates_go_where_they_recur(spark):
    def page(i, host, box):
        return (i, f"https://{host}/{i}", f"<body><div><p>Own text {i} here.</p></div><div><p>{box}</p></div></body>")

    rows = [page(i, "a.example", "Seen on all pages") for i in range(6)] + [page(9, "b.example", "Seen on all pages"), (10, None, "<p>x</p>"), (11, "odd", None), (12, "http://a.example/12", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "host": F.lit("h")})
    out = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert out[3] == "Own text 3 here." and out[9] == "Own text 9 here.\nSeen on all pages" and (out[10], out[11], out[12]) == ("x", "", "")
    assert htmltext.extract(df.limit(0)).count() == 0


def test_articles_keep_recurring_prose(spark):
    rows = [(i, "https://a.example/x", f"<body><nav>menu</nav><article><p>Common line.</p><p>Own {i}.</p></article></body>") for i in range(8)]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"Common line.\nOwn {r.page_id}." for r in out)


def texts_of(spark, bodies):
    rows = [(i, f"https://a.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return [r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_copies_and_shared_prose_keep_their_text(spark):
    copy = "<nav>{}</nav><div><p>The same body.</p><p>In two parts.</p></div>"
    assert texts_of(spark, [copy.format(i) for i in range(8)]) == ["The same body.\nIn two parts."] * 8
    assert texts_of(spark, [f"<div><p>Shared by three.</p></div><p>Own {i}.</p>" for i in range(3)]) == [f"Shared by three.\nOwn {i}." for i in range(3)]
    # Eight different pages, of which one has nothing but what it shares; its menu still goes.
    box, menu = "<div><p>Seen on all.</p></div>", "<div><a href=/>Home</a></div>"
    assert texts_of(spark, [f"{menu}{box}<p>Own {i}.</p>" for i in range(7)] + [menu + box])[6:] == ["Own 6.", "Seen on all."]
    # Words in a line stay, and so does an article in a box that recurs.
    assert texts_of(spark, [f"<p>{i} is <em>not</em> so</p><div>nor <b>is</b> {i}</div>" for i in range(8)]) == [f"{i} is not so\nnor is {i}" for i in range(8)]
    assert texts_of(spark, [f"<p>{i}</p><div><article><p>Same.</p></article></div>" for i in range(8)]) == ["Same."] * 8


def test_articles_keep_their_links(spark):
    menu = "<ul><li><a href=/a>Older</a></li><li><a href=/b>Newer</a></li><li><a href=/c>All</a></li></ul>"
    page = (
        "<article><p>Own {}<sup><a href=#1>[1]</a></sup> by <em><a href=/r>Reuters</a></em>.</p><ol><li><a href=/p>Python</a></li><li>Own {} too</li></ol>"
        "<div><a href=/s>Source</a></div><div>See <a>one</a>, <a>two</a>, <a>three</a></div><div><p><a>Said A</a> <a>and B</a> <a>and C</a>.</p></div><table><tr><td>" + menu + "</td></tr></table>" + menu + "</article>"
    )
    assert texts_of(spark, [page.format(i, i) for i in range(8)]) == [f"Own {i}[1] by Reuters.\nPython\nOwn {i} too\nSource\nSee one, two, three\nSaid A and B and C.\nOlder\nNewer\nAll" for i in range(8)]


def test_templates_of_a_part_of_a_large_host(spark):
    # A notice on 6 of 1,300 pages of the host: more than the fixed number, less than 0.5 % of them.
    notice = "<div><p>Notice of one section.</p></div>"
    out = texts_of(spark, [(notice if i < 6 else "") + f"<p>Own {i}.</p>" for i in range(1300)])
    assert out == [f"Own {i}." for i in range(1300)]


BROKEN = {
    "unclosed tags": "<a " * 330_000, "unclosed quotes": "<a x='" * 170_000, "one end for all": "<a x='" * 170_000 + ">", "both quotes": "<a x='><b y=\">" * 70_000,
    "open divisions": "<div>" * 4_000 + "<p></p>" * 100_000, "stray ends": "<div>" * 150_000 + "</p>" * 50_000, "comments": "<!--" * 250_000, "angles": "<" * 1_000_000,
    "declarations": "<!" * 500_000, "raw": "<script>" * 120_000, "blanks": "<a =" + " " * 900_000 + ">x",
}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_broken_pages_take_linear_time(name):
    import time

    began = time.process_time()
    htmltext.main_text(BROKEN[name])
    assert time.process_time() - began < 2.0  # under one second each on an idle core


def test_broken_and_very_long_pages_keep_their_text():
    assert htmltext.main_text("a < b <c d") == "a < b <c d"
    assert htmltext.main_text("<p>one<p title='x>two</p>") == "one\ntwo"
    assert htmltext.main_text("x<!-- never closed <p>y") == "x"
    assert htmltext.main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"
    long = "".join(f"<p>Line {i} of it.</p>" for i in range(60_000))
    assert htmltext.main_text(f"<nav>m</nav><article>{long}</article>") == "\n".join(f"Line {i} of it." for i in range(60_000))


def random_tree(rng, depth=0):
    """A tree of blocks: (tag, children), texts as leaves."""
    kids = [random_tree(rng, depth + 1) if depth < 3 and rng.random() < 0.5 else ("p", [f"word {rng.randrange(6)}"]) for _ in range(rng.randint(1, 3))]
    return (rng.choice(["div", "section", "table"][:2]), kids)


def written(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(written, tree[1]))}</{tree[0]}>"


def test_counted_subtrees_against_brute_force(spark):
    rng = random.Random(12)
    trees = {(h, i): ("div", [random_tree(rng) for _ in range(2)] + [("p", [f"own {h} {i}"])]) for h in range(3) for i in range((4, 9, 30)[h])}

    def subtrees(t):
        return set() if isinstance(t, str) else {written(t)}.union(*map(subtrees, t[1]))

    seen: dict = {}
    for (h, i), t in trees.items():
        for x in subtrees(t):
            seen.setdefault((h, x), set()).add(i)

    def left(t, h):
        if isinstance(t, str):
            return [t]
        return [] if len(seen[h, written(t)]) >= htmltext.MIN_PAGES else [b for k in t[1] for b in left(k, h)]

    rows = [(100 * h + i, f"https://h{h}.example/{i}", written(t)) for (h, i), t in trees.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert out == {100 * h + i: "\n".join(left(t, h)) for (h, i), t in trees.items()}
    # Without the counted templates the result is another one; a host of fewer pages than a template needs has none.
    alone = {i: htmltext.main_text(html) for i, _, html in rows}
    changed = [i for i in out if out[i] != alone[i]]
    assert len(changed) > 25 and all(i >= 100 for i in changed)


def test_templates_change_no_given_page(spark):
    # What the README says of the given tables.
    for row in read_table(spark, SF_SMALL, "pages").collect():
        whole, may, used = htmltext.page_hashes(row.html)
        assert may and not used and htmltext.main_text(row.html, may) == htmltext.main_text(row.html) != ""


# 4. Nearest neighbours


def test_recall_and_scores(spark):
    rows = queries.queries()["op4_ann_lists"](spark, SF).toPandas()
    df = read_table(spark, SF, "embeddings").select("vec_id", "embedding").toPandas()
    x = np.array(df.embedding.tolist(), np.float32)
    want = ann.brute_force(df.vec_id.to_numpy(), x, df.vec_id[df.vec_id % 20 == 0].to_numpy())
    both = want.merge(rows, on=["query_id", "vec_id"], suffixes=("", "_found"))
    assert len(both) >= 0.9 * len(want) and (both.score == both.score_found).all()
    for _, part in rows.groupby("query_id"):
        part = part.sort_values("rank")
        assert list(part["rank"]) == list(range(1, len(part) + 1)) and part.score.is_monotonic_decreasing


def test_recall_with_border_copies(spark, monkeypatch):
    monkeypatch.setattr(ann, "BORDER", 1.2)
    monkeypatch.setattr(ann, "LIST_ROWS", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.search_lists(df, lambda i: i % 50 == 0).toPandas()
    want = ann.brute_force(np.arange(2000), x, np.arange(0, 2000, 50))
    assert (rows.groupby("query_id").size() == ann.K).all()
    assert len(want.merge(rows, left_on=["query_id", "vec_id"], right_on=["query_id", "id"])) >= 0.9 * len(want)


def test_vectors_that_take_no_part_and_ties(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [0.5, 0.5], None, [0.0, 0.0], [float("nan"), 1.0], [None, 1.0], [float("inf"), 1.0], [1.0], [0.0, 3.0]]
    rows = [(i, x) for i, x in enumerate(v)] + [(0, v[0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "node": F.lit(2), "v": F.lit("x")})
    out = sorted(tuple(r) for r in ann.search_lists(df, lambda i: i.isin(0, 3, 9)).collect())
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 9, 0.0), (9, 1, 2, 1.5), (9, 2, 0, 0.0), (9, 3, 1, 0.0)]
    assert ann.search_lists(df.filter("vec_id = 3"), lambda i: i == 3).count() == 0
    many = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    got = ann.search_lists(many, lambda i: i == 50).orderBy("rank").collect()
    assert [r.id for r in got] == list(range(20))


def test_doubles_lengths_and_repeated_ids(spark):
    tiny = 1e-12
    rows = [(0, [1.0, 1.0]), (1, [1.0 + tiny, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0 + 2 * tiny]), (4, [9.0, 9.0, 9.0]), (5, [1.0, 0.0, 0.0]), (6, [2.0, 0.0, 0.0]), (0, [0.0, 5.0]), (7, []), (4, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(tuple(r) for r in ann.search_lists(df, lambda i: i.isin(0, 4)).collect())
    # 0 has two vectors: the best score of each candidate counts. Scores keep what a float would lose.
    assert [r[:3] for r in out] == [(0, 1, 3), (0, 2, 1), (0, 3, 2), (4, 1, 6), (4, 2, 5)]
    assert [r[3] for r in out] == [5 * (1.0 + 2 * tiny), 1.0 + tiny, 1.0, 18.0, 9.0]


def clustered(rng, n, centres=None, d=16):
    """Vectors of equal length in clusters of about fifty."""
    c = rng.normal(size=(n // 50, d))
    x = c[rng.integers(0, len(c), n)] + 0.15 * rng.normal(size=(n, d))
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def test_lists_are_bounded_and_work_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 64)
    monkeypatch.setattr(ann, "BUCKET_ROWS", 512)
    monkeypatch.setattr(ann, "QUERY_ROWS", 64)
    monkeypatch.setattr(ann, "LEAST_SAMPLE", 1024)
    monkeypatch.setattr(ann, "SAMPLE_SHARE", 4)
    work, rng = [], np.random.default_rng(3)
    for n in (4_000, 20_000):
        x = clustered(rng, n)
        index = ann.ListIndex(x[:: 4], 1.0 + 1e-6, n)
        row, at = index.places(x)
        sizes = np.bincount(at, minlength=len(index.graph.c))
        buckets = ann.Buckets(dict(enumerate(sizes.tolist())), len(sizes), 512)
        held = np.bincount(buckets.of(at, row))
        assert held.max() <= 1.3 * 512 and sizes.max() <= 16 * np.median(sizes)
        read = [buckets.read(found) for found in index.looks(x[::20])]
        assert all(len(np.unique(np.stack(r, 1), axis=0)) == len(r[0]) for r in read)
        work.append(sum(sizes[found].sum() for found in index.looks(x[::20])))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        rows = ann.search_lists(df, lambda i: i % 200 == 0).toPandas()
        want = ann.brute_force(np.arange(n), x, np.arange(0, n, 200))
        assert (rows.groupby("query_id").size() == ann.K).all()
        assert len(want.merge(rows, left_on=["query_id", "vec_id"], right_on=["query_id", "id"])) >= 0.9 * len(want)
    assert work[1] < work[0] * 5**1.3


def test_long_lists_are_cut():
    buckets = ann.Buckets({0: 10, 1: 95, 2: 1000, 3: 5}, 5, 100)
    assert buckets.first.tolist() == [0, 1, 2, 12, 12] and buckets.parts.tolist() == [1, 1, 10, 1, 1]
    of = buckets.of(np.full(5000, 2), np.arange(5000))
    assert set(of.tolist()) == set(range(2, 12)) and np.bincount(of - 2).max() < 700
    by, lists = buckets.read(np.array([0, 2, 3]))
    assert by.tolist() == [0, *range(2, 12), 12] and lists.tolist() == [0, *[2] * 10, 3]


# 5. Quality


def simulated(rng, n, bad, wrong, right):
    """Vote rows of which a share `bad` are of bad documents."""
    truth = rng.random(n) < bad
    return (rng.random((n, len(quality.LABELLERS))) < np.where(truth, right, wrong)[:, None]).astype(int)


def counted(found):
    codes, n = np.unique(quality.pattern(found), return_counts=True)
    return dict(zip(codes.tolist(), n.tolist(), strict=True))


@pytest.mark.parametrize(("bad", "wrong", "right"), [(0.2, 0.01, 0.5), (0.3, 0.15, 0.8), (0.5, 0.25, 0.7), (0.1, 0.05, 0.95)])
def test_label_model_finds_accuracies(bad, wrong, right):
    model = quality.LabelModel(counted(simulated(np.random.default_rng(1), 20_000, bad, wrong, right)))
    assert abs(model.prior - (1 - bad)) < 0.02
    assert np.allclose(model.rates[0], wrong, atol=0.03) and np.allclose(model.rates[1], right, atol=0.05)
    want = (1 - bad) * (1 - wrong) + bad * right
    assert all(abs(x - want) < 0.03 for x in model.accuracies().values())


def test_label_model_without_votes():
    none = np.full((1, len(quality.LABELLERS)), quality.NONE)
    assert quality.LabelModel({}).posteriors(none).tolist() == [0.5]
    model = quality.LabelModel({int(quality.pattern(none)[0]): 7})
    assert model.posteriors(none).tolist() == [model.prior]


def test_label_model_against_brute_force():
    # Expectation-maximisation document by document, vote by vote.
    rng = np.random.default_rng(4)
    found = simulated(rng, 120, 0.3, 0.1, 0.7)
    found[rng.random(found.shape) < 0.2] = quality.NONE
    found[0] = quality.NONE
    post = [0.5 if all(v == quality.NONE for v in row) else 0.2 if quality.BAD in row else 0.9 for row in found]
    for _ in range(500):
        rows = [(row, g) for row, g in zip(found.tolist(), post, strict=True) if any(v != quality.NONE for v in row)]
        prior = (sum(g for _, g in rows) + 1) / (len(rows) + 2)
        rate = [[], []]
        for j in range(len(quality.LABELLERS)):
            for y, (a, b) in enumerate(quality.BEFORE):
                cast = [(row[j] == quality.BAD, g if y == 0 else 1 - g) for row, g in rows if row[j] != quality.NONE]
                rate[y].append((sum(w for is_bad, w in cast if is_bad) + a) / (sum(w for _, w in cast) + a + b))
        post = []
        for row in found.tolist():
            like = [prior, 1 - prior]
            for y in (0, 1):
                for j, v in enumerate(row):
                    like[y] *= 1.0 if v == quality.NONE else rate[y][j] if v == quality.BAD else 1 - rate[y][j]
            post.append(like[0] / sum(like))
    model = quality.LabelModel(counted(found))
    assert abs(model.prior - prior) < 1e-6 and np.allclose(model.rates, rate, atol=1e-6)
    assert np.allclose(model.posteriors(found), post, atol=1e-6)


def plain_statistics(text):
    """The statistics one by one, in plain Python."""
    import re
    from collections import Counter

    w, raw = text.split(), text.encode()
    n, used = len(w), Counter(w)
    solid = sum(b not in (9, 10, 11, 12, 13, 32) for b in raw)
    up, low = sum(65 <= b < 91 for b in raw), sum(97 <= b < 123 for b in raw)
    lines = [x for x in (x.strip() for x in text.split("\n")) if x]
    signs = [chr(b) for b in raw if 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,'-"]
    of = lambda f: sum(c for x, c in used.items() if f(x)) / max(1, n)
    return [
        len(signs) / max(1, solid), up / max(1, up + low), max(used.values(), default=0) / max(1, n), 1 - len(set(zip(w, w[1:], strict=False))) / (n - 1) if n > 1 else 0.0,
        1 - sum(len(set(w[i : i + 50])) for i in range(0, n, 50)) / n if n else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0,
        1 - sum(x[-1] in ".!?…\"”»:;。！？" for x in lines) / len(lines) if lines else 0.0, sum(map(len, w)) / max(1, n),
        of(lambda x: not any(c.isalnum() for c in x)), of(lambda x: bool(re.search(r"[#$%&*+<=>@^_`{|}~\\/]", x))), of(lambda x: bool(re.search(r"([^\w\s.-])\1", x))),
    ]


def test_statistics_against_plain_python(spark):
    import pyarrow as pa

    texts = [t or "" for t in ODD] + ["\n\n x \n", "A.\nB!\nc", "##x $$ a_b ab__ é» ..", "\u00a0tab\tend"] + [r.text for r in read_table(spark, SF_SMALL, "documents").select("text").collect()]
    found = quality.Described(pa.array(texts, pa.string()))
    assert found.words.tolist() == [len(t.split()) for t in texts]
    assert np.allclose(found.stats, [plain_statistics(t) for t in texts], atol=1e-12)
    # One by one, the features are the same ones; null counts as empty, and no text gives nothing.
    for i in (3, 5, 9, len(texts) - 1):
        one = quality.Described(pa.array([texts[i]]))
        mine = found.doc == i
        pairs = lambda x, y: sorted(zip(x.tolist(), y.tolist(), strict=True))
        assert pairs(found.index[mine], found.value[mine]) == pairs(one.index, one.value)
    assert quality.Described(pa.array([None], pa.string())).words.tolist() == [0] and len(quality.Described(pa.array([], pa.string())).stats) == 0


def test_shapes():
    import pyarrow as pa

    assert quality.shapes(pa.array(["Word", "USA", "a1b22", "$$$$!!", "日本", "don't", "x--", ""])).to_pylist() == ["Aa", "A", "a9a9", "$$!!", "x", "a'a", "a--", ""]


def test_quality_against_labels(spark):
    out = queries.queries()["op5_quality_weak"](spark, SF).join(read_table(spark, SF, "labels"), "doc_id").toPandas()
    assert out[out.quality == 1].keep.mean() > 0.98 and out[out.quality == 0].keep.mean() < 0.1


def test_sample_is_bounded_by_count(spark, monkeypatch):
    # A row repeated very often is drawn once, and never more than the sample is.
    docs = documents(spark, ["the same words again and again"] * 3000 + [f"text {i} of some words" for i in range(500)]).withColumn("doc_id", F.when(F.col("doc_id") < 3000, 1).otherwise(F.col("doc_id")))
    sizes = []
    monkeypatch.setattr(quality, "Scorer", lambda doc, index, value, labels: sizes.append(len(labels)))
    quality.fit(docs, sample=100)
    quality.fit(docs, sample=100_000)
    assert sizes[0] <= 100 and sizes[1] == 501
    quality.fit(documents(spark, ["one text of a few words"] * 5000).withColumn("doc_id", F.lit(1).cast("long")), sample=10)
    assert sizes[2] == 1


def test_quality_of_odd_rows(spark):
    docs = documents(spark, ODD, posterior="old")
    out = quality.score_documents(docs, *quality.fit(docs)).collect()
    assert len(out) == len(ODD) and all(0 <= r.quality_score <= 1 for r in out)
    assert quality.keep_quality(documents(spark, [])).count() == 0
    assert quality.keep_quality(docs).columns == docs.columns


# 6. WARC


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "long text " * 200
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://a/5", "short"), (6, "http://a/6", "short"), (7, "http://a/7", "ü" * 700)]
    rows += [(i, f"http://b/{i}", f"<html><body>page {i} " + "common words of the site " * (i % 50)) for i in range(100, 400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    done = warc.write_archives(df, tmp_path.as_uri(), archive_bytes=100_000)
    files = [r.uri for r in done.collect()]
    assert len(files) > 1
    out = {r.page_id: r for r in warc.read_archives(spark, done).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert (out[1].record_type, out[1].refers_to, out[2].record_type, out[2].refers_to) == ("revisit", 2, "response", None)
    assert out[5].record_type == out[6].record_type == "response"
    raw = [open(f.removeprefix("file://"), "rb").read(4) for f in files]
    assert raw[0] == (0x184D2A5D).to_bytes(4, "little")
    assert warc.read_archives(spark, warc.write_archives(df.limit(0), tmp_path.as_uri())).count() == 0


def test_archives_of_repeated_rows_and_long_payloads(spark, tmp_path):
    big, long = "<p>" + "long text " * 200, "".join(f"<p>{i} of it</p>" for i in range(300_000))
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (2, "http://a/2", big), (3, None, long), (4, None, long), (None, "u", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(9), "sha1": F.lit("x"), "first": F.lit(0)})
    out = warc.read_archives(spark, warc.write_archives(df, tmp_path.as_uri())).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in out) == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "revisit", 4), (4, "response", 0)]
    assert {(r.payload_bytes, r.payload_digest) for r in out} == {(len(x), hashlib.sha1(x.encode()).hexdigest()) for x in (big, long)}


def test_archives_know_the_store_schemes(tmp_path):
    assert warc.filesystem(tmp_path.as_uri())[1] == str(tmp_path)
    with pytest.raises(ValueError, match="viewfs"):
        warc.filesystem("viewfs://cluster/x")


# 7. Near-duplicates


def brute_classes(texts, similarity=0.8):
    sets = [neardup.shingles(h) if len(h := neardup.WordHashes().of(t)) else None for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and neardup.probability_jaccard(*sets[i], *sets[j]) >= similarity:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    a = np.sort(rng.integers(0, 2**63, 400).astype(np.uint64))
    x = rng.integers(1, 6, 400)
    b, y = a[80:], x[80:].copy()
    y[:100] += 2
    sig = neardup.signatures([(a, x), (b, y), (a[:1], x[:1])], slots=4000)
    want = neardup.probability_jaccard(a, x, b, y)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4000)
    assert (sig[2] == a[0]).all()
    p, q = x / x.sum(), np.zeros(400)
    q[80:] = y / y.sum()
    brute = sum(1 / sum(max(p[j] / p[i], q[j] / q[i]) for j in range(400)) for i in range(80, 400))
    assert abs(brute - want) < 1e-9


def test_classes_against_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(120)) for _ in range(12)]
    texts = [None, "", "...", "one two", "One, two!", "one"] + base
    for t in base[:6]:
        w = t.split()
        for k in range(1, 9):
            v = list(w)
            for _ in range(rng.randint(0, k)):
                v[rng.randrange(len(v))] = f"x{rng.random()}"
            texts.append(" ".join(v))
    texts += [base[0].upper()] * 3
    got = {r.doc_id: r.class_id for r in neardup.classes(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def edited(rng, n, most=9, words=100):
    """Texts that are one base text with 0 to `most` words replaced."""
    base, texts = [f"w{rng.randint(0, 5000)}" for _ in range(words)], []
    for i in range(n):
        v = list(base)
        for k in range(rng.randint(0, most)):
            v[rng.randrange(words)] = f"x{i}_{k}"
        texts.append(" ".join(v))
    return texts


@pytest.mark.parametrize("block", [8, 1024])
def test_blocks_of_any_size_give_the_same_classes(spark, monkeypatch, block):
    texts = edited(random.Random(4), 60)
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = {r.doc_id: r.class_id for r in neardup.classes(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_chain_of_edits_is_one_class(spark):
    # Each text is near the next one only: no centre reaches them all.
    words_ = [f"w{i}" for i in range(400)]
    texts = [" ".join([f"y{i}" for i in range(6 * k)] + words_[6 * k :]) for k in range(40)]
    got = {r.class_id for r in neardup.classes(documents(spark, texts)).collect()}
    assert got == {0} == set(brute_classes(texts))


def test_pairs_at_the_threshold_are_found():
    # Recall of bands and estimate together, at similarities of 0.8 to 0.82.
    rng, missed, n = np.random.default_rng(6), 0, 400
    least = neardup.least_estimate(0.8)
    for _ in range(n):
        a = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64))
        b = np.sort(np.concatenate([a[111:], rng.integers(0, 2**63, 111).astype(np.uint64)]))
        one = np.ones(1000, int)
        sig = neardup.signatures([(a, one), (b, one)])
        low = sig.astype(np.uint8)
        band = (neardup.band_keys(sig)[0] == neardup.band_keys(sig)[1]).any()
        missed += not (band and neardup._estimate((low[0] == low[1]).sum()) >= least)
    assert missed == 0


def test_forest_of_a_block():
    p, q, w = np.array([1, 1, 2, 4, 1]), np.array([2, 3, 3, 5, 2]), np.array([0.7, 0.9, 0.8, 0.71, 0.95])
    assert sorted(neardup._forest(p, q, w)) == [1, 3, 4]


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randint(0, 900)}" for _ in range(300_000))
    docs = documents(spark, [long, long + " end", long[: len(long) // 2], "a " * 200_000], node=1, sig="s", h1=2, component=3, key=4, band=5)
    assert [r.class_id for r in neardup.classes(docs).orderBy("doc_id").collect()] == [0, 0, 2, 3]
    assert neardup.keep_one(docs).columns == docs.columns


def test_whole_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").orderBy("doc_id").collect()]
    want = [docs[i][0] for i in brute_classes([t for _, t in docs])]
    got = {r.doc_id: r.class_id for r in queries.queries()["op7_neardup_probminhash"](spark, SF_SMALL).collect()}
    assert [got[i] for i, _ in docs] == want


def test_one_of_each_class_stays_whole(spark):
    docs = documents(spark, [*ODD, ODD[-1]], __id=3).withColumnRenamed("__id", "node")
    kept = neardup.keep_one(docs.union(docs)).collect()
    assert neardup.keep_one(docs).columns == docs.columns
    texts = [r.text for r in kept]
    assert texts.count("x") == 1 and texts.count(ODD[-1]) == 1 and texts.count(None) == 2
    assert neardup.keep_one(documents(spark, [])).count() == 0


# 8. SentencePiece


@pytest.fixture(scope="module")
def unigram():
    return sentencepiece.Unigram.from_model(sentencepiece.default_model())


def brute_ids(model, pieces, text):
    s = "▁" + text.replace(" ", "▁")
    best, back = [0.0] + [None] * len(s), [None] * (len(s) + 1)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 20), e):
            i = pieces.get(s[b:e])
            score = model.scores[i] if i is not None else model.unknown_score if e - b == 1 else None
            if score is not None and (best[e] is None or best[b] + score > best[e]):
                best[e], back[e] = best[b] + score, (b, i)
    out, e = [], len(s)
    while e:
        b, i = back[e]
        out.append([i] if i is not None else [model.byte_ids[x] for x in s[b:e].encode()])
        e = b
    return [i for x in reversed(out) for i in x]


def test_segmentation_is_the_best_one(unigram):
    import sentencepiece as lib

    sp = lib.SentencePieceProcessor(model_file=sentencepiece.default_model())
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    rng, parts = random.Random(2), ["a", "the", "don't", " ", "  ", "\n", " \n", "\t", "é", "日本", "22", ".", "!!", "🙂", "ق", "▁", "ing", "straße"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 10))) for _ in range(600)]
    for text, ids in zip(texts, unigram.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == brute_ids(unigram, pieces, text), text
        if "▁" not in text:
            assert unigram.decode(ids) == text


def test_long_texts_without_blanks(unigram, monkeypatch):
    import time

    import sentencepiece as lib

    sp = lib.SentencePieceProcessor(model_file=sentencepiece.default_model())
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    rng = random.Random(8)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    texts = ["".join(rng.choice(signs) for _ in range(1500)), "".join(rng.choice("日本語文字的是不了人我在有他这") for _ in range(1500)), "a" * 700, "ab cd\n" * 300 + "  " + "xyz" * 200]
    monkeypatch.setattr(sentencepiece, "WINDOW", 128)
    for text in texts:
        assert np.frombuffer(unigram.encode([text])[0], "<i4").tolist() == brute_ids(unigram, pieces, text)
    monkeypatch.undo()
    for text in (texts[0] * 200, texts[1] * 200):
        began = time.process_time()
        ids = unigram.encode([text])[0]
        assert unigram.decode(ids) == text and time.process_time() - began < 6.0


def test_trie_finds_all_words():
    words_ = {"a": 0, "ab": 1, "abc": 2, "b": 3, "bd": 4, "日": 5}
    trie = sentencepiece.DoubleArray(words_)
    text = "abcbdx日a"
    codes = trie.codes(np.array([ord(c) for c in text]))
    found = {(s, n, v) for n, start, value in trie.matches(codes, len(text) - np.arange(len(text))) for s, v in zip(start.tolist(), value.tolist(), strict=True)}
    assert found == {(i, len(w), v) for w, v in words_.items() for i in range(len(text)) if text.startswith(w, i)}


def test_documents_round_trip(spark):
    out = queries.queries()["op8_sentencepiece_unigram"](spark, SF_SMALL).collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in out)
    odd = sentencepiece.encode_documents(documents(spark, ODD, ids="old"), sentencepiece.default_model()).collect()
    assert all(r.round_trip for r in odd) and [r.n_pieces for r in odd][:2] == [0, 0]
    assert sentencepiece.encode_documents(documents(spark, []), sentencepiece.default_model()).count() == 0


# 9. Token files


def test_texts_get_the_ids_of_the_untouched_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), tokens_orc.TextEncoder(path)
    assert mine.cut
    rng = random.Random(1)
    parts = ["a", "don't", "'s", " ", " ", "  ", "\n", "\n\n", "\t", "é", "日本", "22", ".", "!!", "_", "\u2007", "\u200b", "\u3000", "<|endoftext|>", "²", "\u0301", "\x1c", "\x85", "\r\n", "🙂", " 's", " x"]
    texts = [None, "", "a <|endoftext|> b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 9] for t in texts]
    for cut in (True, False):
        mine.cut = cut
        ids, n = mine.encode(pa.array(texts, pa.string()), 9)
        for text, w, part in zip(texts, want, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert part.tolist() == w, repr(text)


def test_chunks_hold_every_row():
    import pyarrow as pa

    texts = pa.array(["abc", None, "x" * 20, "", "yy", "z" * 8])
    assert list(byte_chunks(texts, 8)) == [(0, 2), (2, 1), (3, 2), (5, 1)]
    assert list(byte_chunks(texts.slice(0, 0), 8)) == []
    batches = [pa.RecordBatch.from_arrays([texts, pa.array(range(6))], names=["t", "i"]), pa.RecordBatch.from_arrays([texts.slice(0, 0), pa.array([], pa.int64())], names=["t", "i"]), pa.RecordBatch.from_arrays([texts, pa.array(range(6, 12))], names=["t", "i"])]
    assert [b.column("i").to_pylist() for b in gathered(iter(batches), "t", 12)] == [[0, 1], [2], [3, 4, 5], [6, 7], [8], [9, 10, 11]]
    assert list(gathered(iter([]), "t", 12)) == []


def test_very_long_text():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    for text in ("some words, and more\n" * 100_000, "x" * 200_000, "ab  " * 50_000):
        ids, _ = tokens_orc.TextEncoder.at(path).encode(pa.array([text]), 0)
        assert ids[:-1].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    rows = {r.doc_id: r for r in queries.queries()["op9_tokens_orc"](spark, SF_SMALL).collect()}
    for d in read_table(spark, SF_SMALL, "documents").orderBy("doc_id").collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert (rows[d.doc_id].start, rows[d.doc_id].n_tokens, rows[d.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = f"{tmp_path.as_uri()}/odd"
    docs = documents(spark, ODD, file=1)
    tokens_orc.write_tokens(docs.union(docs.withColumn("doc_id", F.lit(None).cast("long"))), public_tokenizers.path("byte_bpe_50k.json"), path)
    out = tokens_orc.digests(tokens_orc.read_tokens(spark, path)).collect()
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert len(out) == 2 * len(ODD)


def test_no_rows_give_no_tokens(spark, tmp_path):
    import public_tokenizers

    path = f"{tmp_path.as_uri()}/none"
    tokens_orc.write_tokens(documents(spark, []), public_tokenizers.path("byte_bpe_50k.json"), path)
    assert tokens_orc.digests(tokens_orc.read_tokens(spark, path)).count() == 0


def test_repeated_ids_and_clashing_columns(spark, tmp_path):
    import public_tokenizers

    docs = documents(spark, ["b", "a", "a", None], __h=1, before=2, n=3, ids=4).withColumn("doc_id", F.lit(7).cast("long"))
    path = f"{tmp_path.as_uri()}/same"
    tokens_orc.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    out = tokens_orc.read_tokens(spark, path).orderBy("start").collect()
    assert [r.start for r in out] == [0, *np.cumsum([len(r.ids) for r in out])[:-1]] and sorted(len(r.ids) for r in out) == [1, 2, 2, 2]


def test_footers_hold_bloom_filters_and_stripes_are_skipped(spark, tmp_path):
    import public_tokenizers
    from py4j.java_gateway import get_field

    rng, word = random.Random(3), "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choice(word) for _ in range(9)) for _ in range(120)) for _ in range(3000)]
    # Even ids only, so that an odd id lies between the minimum and the maximum of a stripe; all so large that Java gets them as longs.
    base = 1 << 40
    docs = spark.createDataFrame([(base + 2 * i, t) for i, t in enumerate(texts * 4)], "doc_id long, text string").coalesce(1)
    path = f"{tmp_path.as_uri()}/t"
    rows = tokens_orc.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    rows.repartitionByRange(1, "doc_id").sortWithinPartitions("doc_id").write.options(**tokens_orc.ORC_OPTIONS | {"orc.stripe.size": "400000"}).orc(path)
    assert "EqualTo(doc_id,7)" in spark.read.orc(path).filter("doc_id = 7")._jdf.queryExecution().toString()
    assert spark.read.orc(path).filter(f"doc_id = {base + 8}").count() == 1 and spark.read.orc(path).filter(f"doc_id = {base + 7}").count() == 0
    jvm = spark._jvm
    conf, orc = spark._jsc.hadoopConfiguration(), jvm.org.apache.orc
    file = jvm.org.apache.hadoop.fs.Path(str(next(tmp_path.glob("t/*.orc"))))
    reader = orc.OrcFile.createReader(file, orc.OrcFile.readerOptions(conf))
    stripes = reader.getStripes()
    assert stripes.size() > 2 and str(reader.getCompressionKind()) == "ZSTD"
    names = reader.getSchema().getFieldNames()
    column = list(names).index("doc_id") + 1
    include = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
    flags = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
    include[0] = include[column] = flags[column] = True
    for s in range(stripes.size()):
        index = reader.rows().readRowIndex(s, include, flags)
        assert index.getRowGroupIndex()[column].getEntryCount() > 0 and index.getBloomFilterIndex()[column].getBloomFilterCount() > 0

    def read(value) -> int:
        """Rows that come up for doc_id = value, by the file's metadata alone."""
        sarg = jvm.org.apache.hadoop.hive.ql.io.sarg
        predicate = sarg.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", getattr(sarg.PredicateLeaf, "Type").LONG, base + value).end().build()
        columns = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 1)
        columns[0] = "doc_id"
        records, batch, n = reader.rows(reader.options().searchArgument(predicate, columns)), reader.getSchema().createRowBatch(), 0
        while records.nextBatch(batch):
            n += get_field(batch, "size")
        return n

    total = reader.getNumberOfRows()
    assert 0 < read(12_000) <= total / 2  # by the minimum and maximum of each stripe
    assert sum(read(i) == 0 for i in range(1, 2000, 20)) > 90  # by the Bloom filters: odd ids are in none


# 10. Language


def test_held_out_accuracy(spark):
    out = queries.queries()["op10_langid_profiles"](spark, SF).join(read_table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert all(out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id])
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.98 and out.score.between(0, 1).all()


def brute_grams(text):
    from collections import Counter

    flat = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    flat = " ".join(flat.split(" "))
    while "  " in flat:
        flat = flat.replace("  ", " ")
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(flat) - n + 1):
            g = flat[i : i + n]
            if g != " " and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out


def test_gram_counts_against_brute_force(monkeypatch):
    text = "Ab c, dé--f 日本 123 abab."
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    want = sorted((code(g), n) for g, n in brute_grams(text).items() if g.strip())
    for piece in (langid.PIECE, 1, 3, 7):
        monkeypatch.setattr(langid, "PIECE", piece)
        codes, counts = langid.gram_counts(text)
        assert [x for x in zip(codes.tolist(), counts.tolist(), strict=True)] == want, piece


def test_language_of_odd_rows(spark):
    docs = documents(spark, ODD, score="old").union(documents(spark, ["the cat and the dog"] * 9, score="old").withColumn("doc_id", F.col("doc_id") + 100))
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [out[i].lang_pred for i in (0, 1, 2, 6)] == ["und"] * 4 and out[0].score == 0
    assert langid.identify(documents(spark, [])).count() == 0
    kept = langid.reject_unidentified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2, 6})


def test_profiles_count_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, 4)) for _ in range(6_000)]
    want: dict[int, int] = {}
    for t in texts:
        for c, n in zip(*(x.tolist() for x in langid.gram_counts(t)), strict=True):
            want[c] = want.get(c, 0) + n
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for held in (langid.HELD, 100):
        monkeypatch.setattr(langid, "HELD", held)
        p = langid.fit_profiles(docs, "doc_id", "text", "lang")
        rank = {int(c): int(p.table[0, i]) for i, c in enumerate(p.codes)}
        assert sorted(rank, key=rank.get) == sorted(want, key=lambda c: (-want[c], c))[: langid.PROFILE]


UNLEARNED = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
]


def test_unlearned_languages_of_latin_letters_go(spark):
    docs = read_table(spark, SF, "documents")
    more = documents(spark, UNLEARNED).withColumns({"doc_id": F.col("doc_id") - 100, "lang": F.lit(None).cast("string")}).select(*docs.columns)
    kept = {r.doc_id for r in langid.reject_unidentified(docs.unionByName(more)).collect()}
    assert kept.isdisjoint(range(-100, 0))
    # Of the learned languages, nothing that has a letter goes.
    assert kept == {r.doc_id for r in langid.identify(docs).filter("lang_pred <> 'und'").collect()}


# The pipeline


@pytest.mark.parametrize("kind", ["empty", "nulls", "odd"])
def test_pipeline_of_odd_tables(spark, kind):
    import corpus_pipeline

    texts = {"empty": [], "nulls": [None] * 5, "odd": [*ODD, *ODD, "the cat and the dog went out " * 30, "a " * 100_000]}[kind]
    names = {"key": 1, "node": 2, "sig": "s", "spans": 3, "component": 4, "words": 5, "lang_pred": "x", "quality_score": 6.0, "shard": 7}
    docs = documents(spark, texts, **names)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        assert name == "tokens" or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() == 0 or kind == "odd"


def test_staged_tables_go_with_their_scratch(spark, tmp_path, monkeypatch):
    import uuid

    from brindle.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"{tmp_path.as_uri()}/{uuid.uuid4().hex}")
    with common.scratch(spark):
        with common.scratch(spark):
            common.staged(spark.range(3), "inner")
            kept = common.staged(spark.range(4), "outer", keep=True)
        assert kept.count() == 4 and [p.name.split("-")[-1] for p in tmp_path.iterdir()] == ["outer"]
    assert not list(tmp_path.iterdir())
    assert len(neardup.classes(documents(spark, ODD)).collect()) == len(ODD)
    assert sorted(p.name.split("-")[-1] for p in tmp_path.iterdir()) == ["classes", "named"]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = read_table(spark, SF_SMALL, "documents")
    first = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    rows = docs.collect()
    assert 0 < len(rows) < len(first) and all(r.round_trip for r in rows)
    assert len({neardup.digest_of(neardup.WordHashes().of(r.text)) for r in rows}) == len(rows)
    bench = {str(r.item_id): r.text for r in read_table(spark, SF_SMALL, "benchmark").collect()}
    assert not any(brute_spans(r.text, bench)[1] for r in rows)
    for r in rows:
        assert r.text == first[r.doc_id] or brute_spans(first[r.doc_id], bench)[1]
    assert corpus_pipeline.run(spark, SF_SMALL).count() == len(rows)


def test_pipeline_leaves_its_last_table_only(spark, monkeypatch, tmp_path):
    import uuid

    import corpus_pipeline
    from brindle.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"{tmp_path.as_uri()}/{uuid.uuid4().hex}")
    assert corpus_pipeline.run(spark, SF_SMALL).count() > 0
    left = [p.name.split("-")[-1] for p in tmp_path.iterdir()]
    assert "tokens" in left and not {name for name, _ in corpus_pipeline.STAGES[:-1]} & set(left), left
