"""Rules on literals, files, numpy cross-checks and properties."""

from __future__ import annotations

import json
import math
import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import dates as T, text as X
from brindle.operators import aggregate as A, dedup as D, filters as P, joins as J, lexicon as L, panel, stats as E, windows as W
from brindle.sources import files as S, paging as G
from brindle.streaming import streams as R
from conftest import SF, SF_SMALL


def texts(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")


def apply(spark, f, rows):
    return [r[0] for r in texts(spark, rows).orderBy("id").select(f(F.col("text")).alias("x")).collect()]


def test_unicode(spark):
    got = apply(spark, X.normalize_unicode(), ["itâ€™s", "ﬁne", "a b   c\n", "café", "日本", None, ""])
    assert got == ["it’s", "fine", "a b c", "café", "日本", None, ""]
    assert apply(spark, X.normalize_unicode(fold=True), ["café naïve"]) == ["cafe naive"]
    assert apply(spark, X.normalize_unicode(emoji=True), ["good 😀"]) == ["good :grinning_face:"]


def test_masks(spark):
    rows = ["see https://x.y/z?q=1 now", "WWW.site.org", "mail a.b+c@d-e.co.uk!", "call +1 555 123 4567", "hi @user_1 #TagName", "none"]
    assert apply(spark, X.mask_entities, rows) == ["see <URL> now", "<URL>", "mail <EMAIL>!", "call <PHONE>", "hi <USER> Tag Name", "none"]
    assert apply(spark, lambda c: X.mask_entities(c, numbers=True), ["v 2.5 and 12345678901"]) == ["v <NUM> and <PHONE>"]


def test_negation_windows(spark):
    one = lambda w: apply(spark, lambda c: X.negation_scope(c, w), ["not good at all", "a b", "so don't, you know it", "not"])
    assert one(1) == ["not_good at all", "a b", "so don't,_you know it", "not"]
    assert one(3) == ["not_good_at_all", "a b", "so don't,_you_know_it", "not"]


def test_emoticon_single_pass(spark):
    assert apply(spark, X.replace_emoticons, [":)D", ":'(", "a:Db", ":-)"]) == [":smile:D", ":cry:", "a:grin:b", ":smile:"]


def test_boilerplate_and_composite(spark):
    assert apply(spark, X.remove_boilerplate, ["Hi  there Sent from my iPhone", "[deleted]"]) == ["Hi there", ""]
    got = apply(spark, lambda c: X.clean_text(c, window=2), ["WOW!!!!! not a  #GoodDay :) https://a.b", "", None, "nan"])
    assert got == ["WOW!!! not_a_Good Day :smile: <URL>", "", "", "nan"]
    assert apply(spark, X.as_text, [None, "x"]) == ["nan", "x"]


def test_tokens(spark):
    got = apply(spark, X.word_tokens, ["I don't know, cannot say: well-known a/b (yes) it's 5 x2", ""])
    assert got == [["i", "do", "know", "can", "not", "say", "yes", "it"], []]
    assert apply(spark, X.sentences, ["A b. C d!  E?", None, "no end"]) == [["A b.", "C d!", "E?"], None, ["no end"]]


def test_dominant_emotion_rules(spark):
    lex = S.lexicon_of(spark, {"a": ["joy"], "b": ["trust"], "p": ["positive"]})
    df = texts(spark, ["x", "a b", "p p a", None])
    rows = {r.id: r for r in L.emotion_counts(df, lex, "text").collect()}
    assert [rows[i].nrc_dominant_emotion for i in range(4)] == ["anger", "joy", "positive", "anger"]
    assert rows[2].nrc_positive == 2 and rows[2].nrc_net_sentiment == 2 and len(rows) == 4


@pytest.mark.parametrize("most_words", [30_000, 0])
def test_emotions_of_repeated_and_null_ids(spark, most_words):
    lex = S.lexicon_of(spark, {"good": ["joy", "positive"], "bad": ["fear", "negative"]})
    rows = [(1, "good good"), (1, "bad"), (None, "good"), (None, None), (2, ""), (1, "bad")]
    out = L.emotion_counts(spark.createDataFrame(rows, "id long, text string"), lex, "text", most_words=most_words).collect()
    key = lambda r: (r.id is None, r.id, r.text or "", r.nrc_joy, r.nrc_fear, r.nrc_net_sentiment, r.nrc_dominant_emotion)
    want = [(False, 1, "good good", 2, 0, 2, "joy"), (False, 1, "bad", 0, 1, -1, "fear"), (False, 1, "bad", 0, 1, -1, "fear"), (False, 2, "", 0, 0, 0, "anger"), (True, None, "good", 1, 0, 1, "joy"), (True, None, "", 0, 0, 0, "anger")]
    assert sorted(map(str, map(key, out))) == sorted(map(str, want))


def test_class_scores_fall_back(spark):
    def scorer(batch):
        if any(t == "bad" for t in batch):
            raise RuntimeError("no")
        return [{"Positive": 0.5, "Negative": 0.5, "odd": 9.0} for _ in batch]

    rows = L.class_scores(texts(spark, ["x", "bad"]), "text", scorer).orderBy("id").collect()
    assert (rows[0].hf_dominant_sentiment, rows[1].hf_dominant_sentiment) == ("positive", "neutral")
    assert rows[1].hf_neutral_score == 1.0 and rows[0].hf_neutral_score == 0.0


def test_near_dup_chain_is_not_transitive(spark):
    w = [f"w{i}" for i in range(20)]
    a, b, c = w, w[1:] + ["x"], w[3:] + ["x", "y", "z"]
    rows = [" ".join(r) for r in (a, b, c)] + ["alone here", None, None]
    pairs = {(r.a, r.b) for r in D.near_dup_pairs(texts(spark, rows), "id", "text").collect()}
    assert (0, 1) in pairs and (0, 2) not in pairs
    kept = {r.id for r in D.near_dedup(texts(spark, rows), "id", "text").collect()}
    assert 0 in kept and 3 in kept


def test_prefix_filter_finds_all_pairs(spark):
    rng = random.Random(3)
    base = [[f"t{rng.randint(0, 60)}" for _ in range(12)] for _ in range(8)]
    rows = [" ".join(b if rng.random() < 0.5 else b[:-1] + [f"u{rng.randint(0, 5)}"]) for b in base for _ in range(5)]
    sets = {i: set(r.split()) for i, r in enumerate(rows)}
    first = {}
    for i, s in sets.items():
        first.setdefault(frozenset(s), i)
    want = {(i, j) for i in first.values() for j in first.values() if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.7}
    assert {(r.a, r.b) for r in D.near_dup_pairs(texts(spark, rows), "id", "text", 0.7).collect()} == want


def test_dedup_kinds(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, None, "u"), (3, None, "v")], "n int, id string, url string")
    assert {r.n for r in D.dedup_by_id_or_url(df, ["n"]).collect()} == {1, 3}
    assert {r.id for r in D.exact_dedup(texts(spark, [None, None, "A", "a", "A"]), "text", ["id"]).collect()} == {0, 2, 3}
    assert D.keep_last(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int"), "k", [F.desc("v")]).collect()[0].v == 2


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline, two'), (2, None)], "id int, text string")
    out = S.write_output(df, tmp_path.as_uri(), "csv", "posts")
    back = S.read_input(spark, out)
    assert out.endswith("posts_cleaned.csv") and [r.text for r in back.orderBy("id").collect()] == ['a "quoted"\nline, two', None]
    assert S.read_input(spark, S.write_output(df, tmp_path.as_uri(), "parquet", "p")).count() == 2
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert S.read_input(spark, str(tmp_path / "x.jsonl")).count() == 2
    with pytest.raises(ValueError):
        S.read_input(spark, "x.doc")
    (tmp_path / "bom.csv").write_bytes("﻿date,v\n1,é\n".encode())
    assert S.read_input(spark, str(tmp_path / "bom.csv")).columns == ["date", "v"]
    (tmp_path / "latin.csv").write_bytes("t\né\n".encode("latin-1"))
    assert S.read_input(spark, str(tmp_path / "latin.csv"), encoding="ISO-8859-1").first()[0] == "é"
    (tmp_path / "reddit_a.csv").write_text("text_type,text\n Title ,x\ncomment,y\n")
    (tmp_path / "reddit_a_cleaned.csv").write_text("text_type,text\ntitle,z\n")
    merged = S.merge_files(spark, str(tmp_path / "reddit*.csv"))
    assert {r.source_file for r in merged.collect()} == {"reddit_a.csv"}
    assert {k: v.count() for k, v in S.split_by_type(merged).items()} == {"merged": 2, "title": 1, "selftext": 0}
    assert S.canonical(merged).columns[:6] == list(S.CANONICAL)
    (tmp_path / "k.txt").write_text("# c\n\n a \nb\n")
    assert [r.line for r in S.read_lines(spark, str(tmp_path / "k.txt")).collect()] == ["a", "b"]
    (tmp_path / "lex.txt").write_text("good\tjoy\t1\ngood\tfear\t0\nbad\todd\t1\nshort\n")
    assert [tuple(r) for r in S.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()] == [("good", "joy")]
    (tmp_path / "b.json").write_text(json.dumps({"patterns": ["x"]}))
    assert S.read_boilerplate(str(tmp_path / "b.json")) == ["x"]
    S.write_report(df.agg(F.count("*").alias("n")), f"{tmp_path.as_uri()}/report")
    assert json.loads(spark.read.text(f"{tmp_path.as_uri()}/report").first()[0]) == {"n": 2}
    S.write_sheets({"one": df, "two": df}, f"{tmp_path.as_uri()}/book")
    assert spark.read.parquet(f"{tmp_path.as_uri()}/book/two.parquet").count() == 2


def test_transpose_and_flatten(spark):
    df = spark.createDataFrame([("rev", 1.0, 2.0), ("cost", 3.0, 4.0)], "item string, q1 double, q2 double")
    out = S.transpose(df, "item", ["q1", "q2"], ["rev", "cost"]).orderBy("date").collect()
    assert [tuple(r) for r in out] == [("q1", 1.0, 3.0), ("q2", 2.0, 4.0)]
    nested = spark.createDataFrame([("a", (1, None)), ("b", None)], "id string, public_metrics struct<likes:int,replies:int>")
    assert [tuple(r) for r in S.flatten_posts(nested).orderBy("id").collect()] == [("a", 1, 0), ("b", 0, 0)]


def test_cache(spark):
    df = spark.createDataFrame([("fr", "chat"), ("fr", "chien"), ("en", "cat")], "lang string, text_clean string")
    cache = spark.createDataFrame([("fr", "chat", "cat")], "lang string, t string, text_en string").select(X.cache_key(F.col("lang"), F.col("t")).alias("cache_key"), "text_en")
    hits, misses = S.cache_lookup(df, cache, X.cache_key(F.col("lang"), F.col("text_clean")))
    assert misses.count() == 2 and hits.filter("text_en IS NOT NULL").count() == 1
    new = misses.withColumn("text_en", F.lit("?")).union(cache.withColumn("text_en", F.lit("CAT")))
    assert S.cache_upsert(cache, new).filter("text_en = 'CAT'").count() == 1
    out = S.translate(df, cache, lambda lang, text: text.str.upper()).collect()
    assert sorted(r.text_en for r in out) == ["CHIEN", "cat", "cat"]


def fetch_posts(key, before, size):
    rows = [(f"{key}{i}", float(i), f"text {i}") for i in range(25, 0, -1)]
    return [r for r in rows if before is None or r[1] < before][:size]


def test_paged_source(spark):
    G.register(spark)
    df = spark.read.format("paged").options(fetch="test_operators:fetch_posts", keys="a,b", page=10, max_pages=2).load()
    assert df.groupBy("key").count().orderBy("key").collect()[0][1] == 20 and df.agg(F.min("time")).first()[0] == 6.0


def test_paging_queries(spark):
    df = spark.createDataFrame([("k", i, 2 * i, "2024-01-02T03") for i in range(9)], "key string, id int, likes int, at string")
    assert {r.id for r in G.keyset_pages(df, "id", ["key"], 2, 2).collect()} == {5, 6, 7, 8}
    assert G.keyset_pages(df, "id", (), 2, 1).count() == 2
    assert {r.date for r in G.liked_posts(df, "likes", "key", "at", 10).collect()} == {"2024-01-02"}
    two = spark.createDataFrame([("u1", "b", 1), ("u1", "a", 1), ("u2", "b", 2), ("u3", "b", 3)], "id string, kw string, t int")
    got = {(r.id, r.kw) for r in G.first_keyword_limit(two, "id", "kw", F.col("kw"), "t", 1).collect()}
    assert got == {("u1", "a"), ("u3", "b")}


def test_filters(spark):
    df = spark.createDataFrame([("1", "x", 5.0, None), ("a", "x", 6.0, 1.0)], "n string, c string, v double, w double").withColumn("Unnamed: 0", F.lit(1))
    assert "Unnamed: 0" not in P.drop_unnamed(df).columns
    assert [r.n for r in P.coerce_numbers(df, ["n", "c"]).collect()] == [1.0, None] and P.coerce_numbers(df, ["c"]).schema["c"].dataType.simpleString() == "string"
    assert P.drop_constant(df, ["v", "w"]).columns == ["n", "c", "v", "Unnamed: 0"]
    assert P.complete_cases(df, ["w"]).count() == 1
    with pytest.raises(ValueError):
        P.require_columns(df, ["zz"])
    with pytest.raises(ValueError):
        P.require_rows(df, 3)
    assert P.drop_bad_dates(texts(spark, ["2024-01-01", "no"]), "text").count() == 1
    assert P.drop_removed(texts(spark, ["", "[removed]", "x", None]), "text").count() == 1
    cases = {"NVIDIA faces new export controls from China.": True, "NVIDIA released new GPU today.": False, "New export controls announced by the BIS today.": False}
    got = apply(spark, lambda c: P.both_lists(c, ["export controls", "bis", "china"], ["nvidia", "gpu"]), list(cases))
    assert got == list(cases.values())


def test_dates(spark):
    df = spark.createDataFrame([(1756829872.0, "2023-02-01T01:02:03.5Z", datetime(2024, 1, 1))], "a double, b string, c timestamp")
    assert [df.select(T.utc_date(df, c)).first()[0] for c in "abc"] == [date(2025, 9, 2), date(2023, 2, 1), date(2024, 1, 1)]
    assert T.date_column(df.withColumnRenamed("c", "Created_At")) == "Created_At" and T.date_column(df) is None
    assert T.recent_windows(spark, "2024-01-08 00:05:00", 7).count() == 6
    assert T.any_of(df, ["z", "b"]) == "b"


def test_trading_days(spark):
    cal = spark.createDataFrame([(date(2024, 3, d),) for d in (7, 8, 11, 12)], "day date")
    at = ["2024-03-08 20:59:59", "2024-03-08 21:00:00", "2024-03-09 12:00:00", "2024-03-11 19:59:59", "2024-03-11 20:00:00", "2024-03-12 20:00:00"]
    df = spark.createDataFrame([(i, datetime.fromisoformat(a)) for i, a in enumerate(at)], "i int, ts timestamp")
    got = [r.trading_date for r in J.trading_days(df, "ts", cal).orderBy("i").collect()]
    assert got == [date(2024, 3, 8), date(2024, 3, 11), date(2024, 3, 11), date(2024, 3, 11), date(2024, 3, 12), None]


def test_asof_never_looks_ahead(spark):
    rng = random.Random(1)
    left = [(i, rng.randint(0, 50)) for i in range(60)]
    right = [(t, None if rng.random() < 0.3 else rng.random()) for t in rng.sample(range(50), 20)]
    l = spark.createDataFrame(left, "i int, t int").withColumn("k", F.lit("a"))
    r = spark.createDataFrame(right, "t int, v double").withColumn("k", F.lit("a"))
    got = {x.i: x.v for x in J.asof_backward(l, r, "t", ["k"], ["v"]).collect()}
    for i, t in left:
        before = [x for x in right if x[0] <= t]
        assert got[i] == (max(before)[1] if before else None)


def test_fill_after_exact_match_loses_weekends(spark):
    days = spark.createDataFrame([(1,), (2,), (4,)], "d int")
    q = spark.createDataFrame([(2, 5.0), (3, 7.0)], "d int, v double")
    assert [r.v for r in J.exact_then_ffill(days, q, "d", ["v"]).orderBy("d").collect()] == [None, 5.0, 5.0]
    assert [r.v for r in J.asof_backward(days, q, "d", [], ["v"]).orderBy("d").collect()] == [None, 5.0, 7.0]


def test_joins(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, None)], "d int, x double"), spark.createDataFrame([(2, None), (3, 3.0)], "d int, y double")
    assert {r.d for r in J.outer_align(a, b, "d").collect()} == {1, 3}
    assert {r.d for r in J.unseen(a, b, "d").collect()} == {1}


def test_series(spark):
    x = [1.0, 2.0, None, 4.0, 8.0]
    df = spark.createDataFrame(list(enumerate(x)), "t int, x double")
    got = df.select("t", W.trailing_sum("x", "t").alias("s"), W.forward_fill("x", "t").alias("f")).orderBy("t").collect()
    assert [r.s for r in got] == [None, 3.0, 3.0, 7.0, 14.0] and [r.f for r in got] == [1.0, 2.0, 2.0, 4.0, 8.0]
    assert [r.ret for r in W.padded_return(df, "x", "t").orderBy("t").collect()] == [None, 1.0, 0.0, 1.0, 1.0]


def test_panel(spark):
    prices = spark.createDataFrame([(date(2024, 1, d), 10.0, 5.0) for d in (1, 2, 3)], "date date, adj_close double, shares double")
    q = spark.createDataFrame([(date(2023, 10, 1), 1.0, 2.0, 1.0, 1.0, 4.0, 1.0, 0.0), (date(2024, 1, 2), 3.0, 2.0, 1.0, 1.0, 4.0, 1.0, 0.0)], "date date, total_revenue double, operating_income double, gross_profit double, net_income double, total_debt double, cash double, equity double")
    rows = panel.daily_panel(prices, q).orderBy("date").collect()
    assert rows[0].p_s_ttm_x is None and rows[2].p_s_ttm_x == 50 / 4 and rows[2].debt_equity_x is None and rows[2].ev_daily == 53


def model_rows(n=80, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n) + 5
    return x1, x2, 1 + 2 * x1 - 0.5 * x2 + rng.normal(size=n) * (1 + np.abs(x1))


def test_regression_against_numpy(spark):
    x1, x2, y = model_rows()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(x1, x2, y, strict=True))], "t int, x1 double, x2 double, y double").withColumn("dup", F.col("x1") * 3)
    fit = E.ols(df, "y", ["x1", "x2", "dup"])
    assert fit.names == ["(Intercept)", "x1", "x2"]
    m = np.stack([np.ones(len(y)), x1, x2], 1)
    b, inv = np.linalg.lstsq(m, y, rcond=None)[0], np.linalg.inv(m.T @ m)
    e = y - m @ b
    h = np.einsum("ij,jk,ik->i", m, inv, m)
    assert np.allclose(fit.beta, b) and np.allclose(fit.xtx_inv, inv) and math.isclose(fit.rss, e @ e)
    n, k = m.shape
    for kind, w in {"HC0": e**2, "HC1": e**2 * n / (n - k), "HC3": e**2 / (1 - h) ** 2, "HC4": e**2 / (1 - h) ** np.minimum(4, n * h / k)}.items():
        assert np.allclose(E.robust_covariance(df, fit, kind), inv @ (m.T * w) @ m @ inv), kind
    lag, u = 3, m * e[:, None]
    meat = u.T @ u
    for l in range(1, lag + 1):
        g = u[l:].T @ u[:-l]
        meat += (1 - l / (lag + 1)) * (g + g.T)
    assert np.allclose(E.newey_west(df, fit, "t", lag), inv @ meat @ inv * n / (n - k))
    r2 = lambda t, z: 1 - ((t - z @ np.linalg.lstsq(z, t, rcond=None)[0]) ** 2).sum() / ((t - t.mean()) ** 2).sum()
    assert math.isclose(E.breusch_pagan(df, fit)[0], n * r2(e**2, m), rel_tol=1e-6)
    lagged = np.concatenate([[0.0], e[:-1]])[:, None]
    assert math.isclose(E.breusch_godfrey(df, fit, "t", 1)[0], n * r2(e, np.hstack([m, lagged])), rel_tol=1e-5)
    assert math.isclose(E.durbin_watson(fit.residuals(df), "e", "t").first()[0], (np.diff(e) ** 2).sum() / (e @ e), rel_tol=1e-9)
    assert math.isclose(E.vif(df, ["x1", "x2"])["x1"], 1 / (1 - np.corrcoef(x1, x2)[0, 1] ** 2), rel_tol=1e-9)
    rows = E.influence(df, fit).orderBy("t").collect()
    s2 = e @ e / (n - k)
    assert np.allclose([r.cooks for r in rows], e**2 / s2 / k * h / (1 - h) ** 2)
    assert E.trimmed_fit(df, fit).n < n
    f, p = E.granger(df, "x1", "y", "t", 1)
    assert f >= 0 and 0 <= p <= 1


def test_tails():
    assert math.isclose(E.t_two_sided(2.0, 10), 0.07338803477074, rel_tol=1e-9)
    assert math.isclose(E.chi2_upper(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(E.chi2_upper(30, 10), 0.000856641210, rel_tol=1e-6)
    assert math.isclose(E.f_upper(4.0, 2, 20), 1.4**-10, rel_tol=1e-9)
    assert E.adjust_p([0.01, 0.04, 0.03], "BH") == pytest.approx([0.03, 0.04, 0.04])


def test_unit_root_and_errors(spark):
    rng = np.random.default_rng(3)
    noise, x = rng.normal(size=120), rng.normal(size=120)
    walk, e = np.cumsum(noise), np.zeros(120)
    for i in range(1, 120):
        e[i] = 0.6 * e[i - 1] + 0.3 * noise[i]
    df = spark.createDataFrame([(i, float(noise[i]), float(walk[i]), float(x[i]), float(1 + 2 * x[i] + e[i])) for i in range(120)], "t int, a double, w double, x double, y double")
    assert E.adf(df, "a", "t")[1] == 0.01 and E.adf(df, "w", "t")[1] > 0.05
    assert [c for c in E.difference_if_needed(df, ["a", "w"], "t").columns if c.startswith("d_")] == ["d_w"]
    power, shift, _ = E.box_cox_power(df.withColumn("z", F.exp("y")), "z", ["x"])
    assert abs(power) < 0.25 and shift == 0
    w, a, b = E.garch_params(noise)
    assert w > 0 and a >= 0 and b >= 0 and a + b < 1


def test_regression_with_ar_errors_by_maximum_likelihood(spark):
    rng, n = np.random.default_rng(11), 400
    u, x, e = rng.normal(size=n), rng.normal(size=n), np.zeros(n)
    for i in range(2, n):
        e[i] = 0.5 * e[i - 1] - 0.3 * e[i - 2] + u[i]
    y = 1 + 2 * x + e
    beta, phi, sigma2, likelihood = E.ar_regression(y, x[:, None], 2)
    assert np.allclose(beta, [1, 2], atol=0.15) and np.allclose(phi, [0.5, -0.3], atol=0.1) and abs(sigma2 - 1) < 0.15
    # The likelihood is that of the whole joint normal distribution.
    def brute(phi, beta, sigma2):
        lags = np.zeros(n)
        a = np.array([[1, -phi[0], -phi[1]], [-phi[0], 1 - phi[1], 0], [-phi[1], -phi[0], 1]])
        lags[:3] = np.linalg.solve(a, [1, 0, 0])
        for k in range(3, n):
            lags[k] = phi[0] * lags[k - 1] + phi[1] * lags[k - 2]
        v = sigma2 * lags[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
        r = y - beta[0] - beta[1] * x
        return -0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ np.linalg.solve(v, r))

    best = brute(phi, beta, sigma2)
    assert abs(best - likelihood) < 1e-6
    assert all(brute(phi + d, beta, sigma2) < best for d in ([0.02, 0], [-0.02, 0], [0, 0.02], [0, -0.02]))
    df = spark.createDataFrame([("a", i, float(y[i]), float(x[i])) for i in range(n)] + [("b", i, 1.0, None) for i in range(9)], "k string, t int, y double, x double")
    rows = E.arima_errors_ml(df, "y", ["x"], "t", 2, by="k").collect()
    assert [(r.k, r.term) for r in rows] == [("a", t) for t in ("(Intercept)", "x", "ar1", "ar2", "sigma2", "log_likelihood")]
    assert np.allclose([r.estimate for r in rows], [*beta, *phi, sigma2, likelihood])


def test_garch_with_heavy_tails(spark):
    rng, n, nu = np.random.default_rng(5), 3000, 5
    h, r = 1.0, []
    for z in rng.standard_t(nu, size=n) * math.sqrt((nu - 2) / nu):
        r.append(math.sqrt(h) * z)
        h = 0.1 + 0.1 * r[-1] ** 2 + 0.8 * h
    w, a, b, found = E.garch_params(np.array(r), student=True)
    assert abs(a - 0.1) < 0.06 and abs(b - 0.8) < 0.12 and 3.5 < found < 8 and 0.03 < w < 0.25
    best = E.garch_likelihood(np.array(r), a, b, found)
    assert best > E.garch_likelihood(np.array(r), a, b, None) and all(E.garch_likelihood(np.array(r), a + d, b - d, found) <= best + 1e-6 for d in (-0.01, 0.01))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(r[:200])] + [("b", 0, 1.0)], "k string, t int, r double")
    rows = {x.k: x for x in E.garch(df, "k", "t", "r").collect()}
    assert rows["a"].nu > 2 and rows["b"].nu is None


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 3.0)], "k string, v double")
    assert [tuple(r) for r in A.value_counts(df, "k").collect()] == [("a", 2), ("b", 1)]
    assert A.missing_shares(df, ["v"]).first()[0] == pytest.approx(1 / 3)
    assert sum(r.n for r in A.histogram(df, "v", 4).collect()) == 2
    days = A.daily_means(df.withColumn("d", F.when(F.col("k") == "a", F.lit("2024-01-01"))), F.to_date("d"), ["v"]).collect()
    assert [tuple(r) for r in days] == [(date(2024, 1, 1), 2.0)]


def test_streams(spark, tmp_path):
    out, check = f"{tmp_path.as_uri()}/out", f"{tmp_path.as_uri()}/check"
    (tmp_path / "in").mkdir()
    src = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src.filter("event_id < 5").coalesce(1).write.parquet(f"{tmp_path.as_uri()}/in/a.parquet")
    stream = lambda: spark.readStream.schema(src.schema).option("recursiveFileLookup", True).parquet(f"{tmp_path.as_uri()}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    R.run_once(R.first_seen(stream(), "user_id"), check, R.month_sink(out))
    first = spark.read.parquet(out).count()
    src.filter("event_id >= 5").coalesce(1).write.parquet(f"{tmp_path.as_uri()}/in/b.parquet")
    R.run_once(R.first_seen(stream(), "user_id"), check, R.month_sink(out))
    assert first < spark.read.parquet(out).count() == src.select("user_id").distinct().count()
    assert {r.month for r in R.missing_months(spark, out, "2023-12-01", "2024-02-01").collect()} == {"2023-12", "2024-02"}


def workbook(path, sheets):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>text</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData></worksheet>")


def test_spreadsheets(spark, tmp_path):
    from brindle.sources import sheets as H

    first = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>1.5</v></c></row><row/><row><c r="C4"><v>2</v></c><c r="D4"><v>9</v></c></row>'
    for name in ("a", "b"):
        workbook(f"{tmp_path}/{name}.xlsx", {"One": first, "Two": '<row><c t="s"><v>0</v></c></row><row><c><v>7</v></c></row>'})
    df = S.read_input(spark, f"{tmp_path}/a.xlsx")
    assert df.columns == ["text", "Unnamed: 1", "n"] and [tuple(r) for r in df.collect()] == [("two runs", None, "1.5"), (None, None, None), (None, None, "2")]
    both = H.read_sheet(spark, f"{tmp_path}/*.xlsx", "Two")
    assert both.columns == ["text"] and [r.text for r in both.collect()] == ["7", "7"]
    with pytest.raises(KeyError):
        H.read_sheet(spark, f"{tmp_path}/*.xlsx", "Three")


def test_word_files(spark, tmp_path):
    import zipfile

    from brindle.sources import sheets as H

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(f"{tmp_path}/a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>")
    assert [r.text for r in H.read_documents(spark, f"{tmp_path}/*.docx").collect()] == ["One line\n\nTwo"]


def test_pulls_are_tried_again():
    from brindle.sources import paging as G

    waits, logins, left = [], [], [G.Wait(7.0), PermissionError(), OSError()]

    def fetch(x):
        if left:
            raise left.pop(0)
        return x

    assert G.retrying(fetch, sleep=waits.append, login=lambda: logins.append(1))(3) == 3
    assert waits == [7.0, 4.0, 8.0] and logins == [1]
    left[:] = [OSError()] * 5
    with pytest.raises(OSError):
        G.retrying(fetch, sleep=waits.append)(3)
    assert len(waits) == 7
    left[:] = [KeyError()]
    with pytest.raises(KeyError):
        G.retrying(fetch, sleep=waits.append)(3)


def test_other_scripts_fold_to_latin_letters(spark):
    assert apply(spark, X.normalize_unicode(fold=True), ["Привет, Москва", "Ελλάδα", "Straße Łódź", "日本"]) == ["Privet, Moskva", "Ellada", "Strasse Lodz", "<U+65E5><U+672C>"]


@pytest.mark.parametrize("blocks", [1, 7, 256])
def test_values_are_carried_over_blocks(spark, blocks):
    rng = random.Random(blocks)
    rows = [(rng.choice(["a", "a", "a", None]), rng.randint(0, 50), i, rng.choice([None, None, float(i)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v double")
    got = {r.i: r.v for r in J.carried(df, "v", "t", ["i"], ["k"], block_rows=-(-len(rows) // blocks)).collect()}
    last: dict = {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        last[k] = v if v is not None else last.get(k)
        assert got[i] == last[k]
    assert J.carried(df.limit(0), "v", "t", ["i"], ["k"]).count() == 0
    alone = {r.i: r.v for r in J.carried(df, "v", "t", ["i"], block_rows=-(-len(rows) // blocks)).collect()}
    carry = None
    for _, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        carry = v if v is not None else carry
        assert alone[i] == carry


def test_language_model(spark):
    from brindle.operators import language as N

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = N.train(docs.filter(~held), "text", "lang")
    found = docs.filter(held).select("lang", N.language(model)(F.col("text")).alias("p"))
    assert found.agg(F.avg((F.col("lang") == F.col("p")).cast("double"))).first()[0] > 0.97
    assert model.predict([None, "", "123 !!", "the house and the garden of the city"]) == ["und", "und", "und", "en"]
    assert N.train(docs.limit(0), "text", "lang").predict(["abc"]) == ["und"]
    one = model.predict(["der Hund und die Katze"] * 3 + ["x" * (N.CHUNK + 5), "le chat et la maison dans la ville"])
    assert one[:3] == ["de"] * 3 and one[4] == "fr"


def test_values_are_carried_over_even_blocks(spark):
    """One time far from all others leaves the blocks even, and they carry as one window does."""
    rng = np.random.default_rng(8)
    rows = [(int(t), None if rng.random() < 0.7 else float(i), "a" if rng.random() < 0.6 else None) for i, t in enumerate(rng.integers(0, 10_000, 5_000))]
    df = spark.createDataFrame([*rows, (10**15, None, "a"), (None, 1.0, "a")], "t long, v double, k string").withColumn("id", F.monotonically_increasing_id())
    for by in ((), ("k",)):
        want = sorted(map(tuple, J.carried(df, "v", "t", ["id"], by).collect()), key=str)
        got = J.carried(df, "v", "t", ["id"], by, block_rows=250)
        assert sorted(map(tuple, got.collect()), key=str) == want
    blocks = df.repartitionByRange(21, "t", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.avg("count")).first()
    assert blocks[0] <= 3 * blocks[1]


def test_quartiles_of_large_groups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1001)] + [("b", 1.0), ("b", 2.0), ("c", None), (None, 4.0)], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in A.quartiles(df, "g", "v", exact_rows=100).collect()}
    assert got["b"] == (1.25, 1.5, 1.75, 2) and got[None] == (4.0, 4.0, 4.0, 1) and got["c"] == (None, None, None, 0)
    assert got["a"][3] is None and all(abs(x - y) <= 1 for x, y in zip(got["a"][:3], (250, 500, 750), strict=True))
    assert {r.g: r.n_exact for r in A.quartiles(df, "g", "v").collect()} == {"a": 1001, "b": 2, "c": 0, None: 1}


def test_models_on_the_split_of_random_split_from_one_reading(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    from brindle.operators import ml

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    df = spark.range(0, 1000, numPartitions=3).select(F.when(F.col("id") % 50 != 0, F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b"), (F.sin("id") + F.col("id") % 7).alias("y"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features", handleInvalid="skip").transform(df.na.drop(subset=["y", "a", "b"])).select("features", "y")
    train, test = rows.randomSplit([0.8, 0.2], seed=42)
    want = []
    for name, model in (("tree", DecisionTreeRegressor(labelCol="y", maxDepth=4, seed=42)), ("line", LinearRegression(labelCol="y", solver="normal"))):
        found = model.fit(train).transform(test)
        want.append((name, *[RegressionEvaluator(labelCol="y", metricName=m).evaluate(found) for m in ("rmse", "r2")], test.count()))
    got = ml.fit_and_score(df.withColumn("y", counted("y")), "y", ["a", "b"]).collect()
    for g, w in zip(got, want, strict=True):
        assert (g.model, g.n_test) == (w[0], w[3]) and (g.rmse, g.r2) == (pytest.approx(w[1], rel=1e-9), pytest.approx(w[2], rel=1e-9))
    # Once for the test on null and once for the rows.
    assert seen.value <= 2 * 1000
