"""Groups of near duplicates by signatures against all pairs by brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from brindle.operators import dedup as D


def test_groups_against_all_pairs(spark):
    rng, rows = random.Random(3), []
    for c in range(25):  # clusters of near and equal sets of different similarity
        base = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 8])):
            words = list(base)
            for _ in range(rng.randrange(len(base) // 9 + 1)):
                words[rng.randrange(len(words))] = f"u{rng.randrange(10**6)}"
            rng.shuffle(words)
            rows.append(" ".join(words))
    rows += [None, "", "  ", "one", "ONE one", "a b"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    df = spark.createDataFrame([*zip(ids, rows, strict=True), (None, rows[0])], "id int, body string").withColumns({x: F.lit(1) for x in ("w", "digest", "key", "first")})
    got = {r.id: r.representative for r in D.minhash_groups(df, "id", "body").collect()}
    assert set(got) == set(ids)
    sets = {i: frozenset((t or "").lower().split()) for i, t in zip(ids, rows, strict=True)}
    name = {i: i for i in ids}
    near = [(i, j) for i in ids for j in ids if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j]))]
    while True:
        before = dict(name)
        for i, j in near:
            name[i] = name[j] = min(name[i], name[j])
        if before == name:
            break
    met = [got[i] == got[j] for i, j in near]
    assert sum(met) >= 0.9 * len(met) and len(met) > 60
    assert all(name[got[i]] == name[i] and got[got[i]] == got[i] <= i for i in ids)  # nothing apart is put together
    assert D.minhash_groups(df.limit(0), "id", "body").count() == 0


def test_a_large_cluster_gives_few_pairs(spark, monkeypatch):
    seen = []
    verify = D._verified
    monkeypatch.setattr(D, "_verified", lambda pairs, groups, t: seen.append(pairs.count()) or verify(pairs, groups, t))
    base = [f"w{k}" for k in range(150)]
    df = spark.createDataFrame([(i, " ".join([*base, f"x{i}"])) for i in range(300)], "id int, body string")
    assert {r.representative for r in D.minhash_groups(df, "id", "body").collect()} == {0} and seen[0] < 16 * 300


def test_exact_pairs_against_all_pairs(spark):
    rng, rows = random.Random(8), ["", None, "one two", "two ONE"]
    for _ in range(30):  # few words, so that frequent ones stand in prefixes, too
        base = [f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.choice([8, 40, 90]))]
        rows += [" ".join(w if rng.random() > 0.05 else f"u{rng.randrange(50)}" for w in base) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, body string").withColumns({x: F.lit(1) for x in ("w", "t", "at", "size")})
    first = {}
    for i, t in enumerate(rows):
        first.setdefault(frozenset((t or "").lower().split()), i)
    for threshold in (0.6, 0.85):
        want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and a and b and len(a & b) >= threshold * len(a | b)}
        assert {(r.a, r.b) for r in D.near_dup_pairs(df, "id", "body", threshold).collect()} == want and len(want) > 10


def test_sets_are_compared_only_where_sketches_are_close(spark, monkeypatch):
    seen = []
    verify = D._verified
    monkeypatch.setattr(D, "_verified", lambda pairs, sets, t: seen.append(pairs.count()) or verify(pairs, sets, t))
    # Any two rows have a tenth of their words in common, the same for all and rarer than the others of each row.
    common = [f"s{k}" for k in range(60)]
    texts = [" ".join([*common, *rng.sample([f"f{k}" for k in range(1000)], 540)]) for rng in map(random.Random, range(60))]
    df = spark.createDataFrame(list(enumerate([*texts, texts[3] + " more"])), "id int, body string")
    assert D.near_dup_pairs(df, "id", "body").count() == 1 and seen == [1]


def test_sets_are_sent_with_blocks_and_not_with_pairs(spark, monkeypatch):
    """All pairs of a cluster are found, in blocks that are smaller than it, though hardly more than one a set is compared on its own."""
    seen = []
    verify = D._verified
    monkeypatch.setattr(D, "_verified", lambda pairs, sets, t: seen.append(pairs.count()) or verify(pairs, sets, t))
    monkeypatch.setattr(D, "BLOCK", 40)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join([*base, *(f"x{i}_{k}" for k in range(i % 3 * 9))]) for i in range(150)]
    df = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)], "id string, body string")
    sets = [frozenset(t.split()) for t in texts]
    first = {}
    for i, w in enumerate(sets):
        first.setdefault(w, i)
    want = {(f"d{i:03}", f"d{j:03}", len(a & b) / len(a | b)) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) >= 0.85 * len(a | b)}
    assert {(r.a, r.b, r.jaccard) for r in D.near_dup_pairs(df, "id", "body").collect()} == want
    assert len(want) > 1000 and sum(seen) < 300


def test_large_sets_are_met_in_their_parts(spark, monkeypatch):
    """Sets of several classes of size on both sides of the threshold, some with parts that are short or empty."""
    monkeypatch.setattr(D, "PART", 16)
    monkeypatch.setattr(D, "_stars", lambda buckets: buckets.select(buckets.id.alias("a"), buckets.id.alias("b")).limit(0))  # no cells: all pairs are met across
    rng, rows = random.Random(4), []
    for n in [7, 12, 15, 16, 17, 18, 30, 33, 37, 62, 66, 120, 250, 500] * 3:
        base = [f"t{rng.randrange(900)}" for _ in range(n)]
        for share in (0, 0.02, 0.07, 0.085, 0.16):
            rows.append(" ".join(w if rng.random() >= share else f"u{rng.randrange(10**6)}" for w in base))
        rows += [" ".join(base[: int(n * 0.85) + 1]), " ".join(base[: int(n * 0.86)] + ["more"])]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, body string")
    first = {}
    for i, t in enumerate(rows):
        first.setdefault(frozenset(t.split()), i)
    for threshold in (0.5, 0.85):
        want = {(i, j) for a, i in first.items() for b, j in first.items() if i < j and len(a & b) >= threshold * len(a | b)}
        assert {(r.a, r.b) for r in D.near_dup_pairs(df, "id", "body", threshold).collect()} == want and len(want) > 100


def test_links_that_no_band_shares_are_found(spark):
    """With two bands of 64 permutations hardly any near pair shares one; groups are those of all pairs all the same."""
    rng, rows = random.Random(6), []
    for _ in range(20):
        base = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(4):
            words = list(base)
            for _ in range(len(base) // 14):
                words[rng.randrange(len(words))] = f"u{rng.randrange(10**6)}"
            rows.append(" ".join(words))
    sets = [frozenset(t.split()) for t in rows]
    name = list(range(len(rows)))
    while True:
        before = list(name)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.85 * len(a | b):
                    name[i] = name[j] = min(name[i], name[j])
        if before == name:
            break
    df = spark.createDataFrame(list(enumerate(rows)), "id int, body string")
    assert {r.id: r.representative for r in D.minhash_groups(df, "id", "body", bands=2).collect()} == dict(enumerate(name)) and len(set(name)) < 60
