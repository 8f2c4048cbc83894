"""Languages by script, by a model that says how sure it is, and by a chain of both."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import language as N

ENGLISH = ["the ship went over the water and the men were glad of the wind", "there is nothing that they would have wanted more than this house", "when the rain had stopped we walked through the town again"]
GERMAN = ["das schiff fuhr über das wasser und die leute waren froh", "es gibt nichts das sie lieber gehabt hätten als dieses haus", "als der regen aufgehört hatte gingen wir wieder durch die stadt"]


def model_of(spark):
    rows = [(t, "en") for t in ENGLISH] + [(t, "de") for t in GERMAN] + [(None, "en"), ("x", None)]
    return N.train(spark.createDataFrame(rows, "body string, lang string"), "body", "lang")


def test_sureness_of_short_and_foreign_texts(spark):
    model = model_of(spark)
    lang, sure = model.scored(["the men went through the water", "die leute gingen durch das wasser", "qxz", "тихая погода стоит", "12 !", "", None])
    assert lang[:2] == ["en", "de"] and min(sure[:2]) > 0.99
    assert max(sure[2:4]) < 0.5 and lang[4:] == ["und"] * 3 and sure[4:] == [0.0] * 3
    assert N.LanguageModel([], model.table[:0]).scored(["the men"]) == (["und"], [0.0])
    long = "the men went through the water and " * 100_000
    assert model.scored([long, "x", long])[0][::2] == ["en", "en"]


def test_repeated_texts_count_once(spark):
    once = model_of(spark)
    rows = [(t, "en") for t in ENGLISH * 50] + [(t, "de") for t in GERMAN]
    again = N.train(spark.createDataFrame(rows, "body string, lang string"), "body", "lang")
    assert (once.table == again.table).all()


def test_all_labelled_texts_are_learned_from(spark):
    rows = spark.range(6_000).select(F.concat(F.lit("same words "), F.col("id").cast("string")).alias("body"), F.lit("en").alias("lang"))
    rows = rows.unionByName(rows.limit(100)).unionByName(spark.createDataFrame([("12 34", "no letters")], "body string, lang string"))
    model, alike = N.train(rows, "body", "lang"), N.train(rows.limit(1), "body", "lang")
    counts = np.zeros((2, N.SLOTS))
    for _, _, slot in N._triples(["same words "] * 6_000):
        counts[0] += np.bincount(slot, minlength=N.SLOTS)
    assert model.names == ["en", "no letters"] and alike.names == ["en"]
    assert (model.table == N.LanguageModel(model.names, counts).table).all()


def test_script_and_chain(spark):
    cases = [
        ("ησυχη θαλασσα", "el"), ("שקט בים", "he"), ("ทะเล", "th"), ("바다", "ko"), ("日本の海", "ja"), ("海", "und"), ("ზღვა", "ka"), ("ծով", "hy"),
        ("the men went through the water", "en"), ("αβ the men went through the water", "en"), ("qz", "und"), ("42", "und"), ("", "und"), (None, "und"),
    ]
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(cases)], "id int, body string, want string").withColumns({"lang": F.lit(1), "sure": F.lit(2)})
    model = model_of(spark)
    got = N.language_chain(df, "body", [N.script_language, lambda c: N.sure_language(model)(c)["lang"]])
    assert {r.id: r.lang_pred for r in got.collect()} == dict(enumerate(w for _, w in cases))
    assert got.columns == [*df.columns, "lang_pred"]
    assert N.language_chain(df.limit(0), "body", [N.script_language]).count() == 0


def test_a_chain_knows_what_few_of_many_texts_teach(spark):
    rows = [(f"{i} {ENGLISH[i % 3]}", "en") for i in range(4_000)] + [("zyx wvu zyx wvu", "en")]
    model = N.train(spark.createDataFrame([*rows, *((t, "de") for t in GERMAN)], "body string, lang string"), "body", "lang")
    plain = np.zeros(N.SLOTS)
    for _, _, slot in N._triples([t for t, _ in rows]):
        plain += np.bincount(slot, minlength=N.SLOTS)
    en = model.names.index("en")
    assert (model.table[en] == N.LanguageModel(["en"], plain[None]).table[0]).all()
    df = spark.createDataFrame([("zyx wvu zyx",)], "body string")
    assert N.language_chain(df, "body", [N.script_language, lambda c: N.sure_language(model)(c)["lang"]]).first().lang_pred == "en"


def test_answered_texts_do_not_go_to_python(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def late(t):
        if t is not None:
            seen.add(1)
        return "late"

    df = spark.createDataFrame([(i, "καλημέρα" if i % 4 else "good day") for i in range(40)], "id int, t string")
    got = N.language_chain(df, "t", [N.script_language, late]).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"el": 30, "late": 10} and seen.value == 10


def test_batches_and_chunks_are_small(spark):
    from brindle.plans.text_queries import table
    from conftest import SF_SMALL

    own = spark.newSession()
    table(own, SF_SMALL, "documents")
    assert int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000 and own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{16 << 20}b"
    sizes = [len(slot) for _, _, slot in N._triples(["a few words " * 1_000] * 200)]
    assert len(sizes) > 8 and max(sizes) < 300_000


def test_scripts_are_counted_without_arrays_of_matches(spark):
    import random
    import re
    import unicodedata

    rng = random.Random(5)
    signs = ["a", "é", "α", "Ω", ";", "א", "ְ", "ก", "่", "가", "ᄀ", "ა", "ա", "か", "ー", "日", "1", "😀", "𝒳", " ", "\n", "."]
    texts = ["".join(rng.choice(rng.sample(signs, 3)) for _ in range(rng.randint(0, 12))) for _ in range(3_000)] + [None]

    def plain(t):
        t = t or ""
        letters = sum(unicodedata.category(x)[0] == "L" for x in t)
        for lang, p in N.SCRIPT_LANGUAGES.items():
            count = lambda q: len(re.findall(re.sub(r"\\x\{(\w+)\}", r"\\u\1", q), t))  # noqa: B023, E731
            own = count(p) + (count(N.HAN) if lang == "ja" and count(p) else 0)
            if own * 2 > letters:
                return lang
        return "und"

    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", N.script_language(F.col("t")).alias("lang"))
    assert [r.lang for r in df.orderBy("id").collect()] == [plain(t) for t in texts]
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
