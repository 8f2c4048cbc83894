"""The class scorer: held-out accuracy, saving and loading, odd texts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.operators import ml
from brindle.operators.lexicon import HF_CLASSES
from brindle.plans.text_queries import labelled_classes
from conftest import SF


@pytest.fixture(scope="module")
def split(spark):
    rows = labelled_classes(spark, SF).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).cache()
    return rows.filter("NOT held"), rows.filter("held")


@pytest.fixture(scope="module")
def model(split):
    return ml.train_scorer(split[0], "text", "label")


def test_held_out_accuracy(split, model):
    found = ml.model_scores(split[1], "text", model).withColumn("right", F.col("hf_dominant_sentiment") == F.regexp_replace(F.lower("label"), " ", "_"))
    share, n = found.agg(F.avg(F.col("right").cast("int")), F.count("*")).first()
    base = split[1].groupBy("label").count().agg(F.max("count")).first()[0] / n
    assert n > 50 and share >= 0.8 and share > base


def test_saved_and_loaded(spark, split, model, tmp_path):
    ml.save_scorer(model, f"{tmp_path.as_uri()}/scorer")
    again = ml.load_scorer(f"{tmp_path.as_uri()}/scorer")
    rows = lambda m: sorted(ml.model_scores(split[1].select("doc_id", "text"), "text", m).drop("text").collect())
    assert rows(model) == rows(again)


def test_odd_texts(spark, model):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "!!! 123"), (3, "word " * 50_000), (4, "日本")], "id int, text string").withColumn("label", F.lit("kept"))
    out = ml.model_scores(df, "text", model).orderBy("id").collect()
    assert [r.label for r in out] == ["kept"] * 5 and all(abs(sum(r[f"hf_{c}_score"] for c in HF_CLASSES) - 1) < 0.001 and r.hf_neutral_score == 0.0 for r in out)
    assert len({tuple(r)[3:] for r in out[:2]}) == 1
    assert ml.model_scores(df.limit(0), "text", model).count() == 0
    with pytest.raises(ValueError, match="no such class"):
        ml.train_scorer(spark.createDataFrame([("a", "glad")], "text string, label string"), "text", "label")


def test_terms_and_labels_are_read_once(spark):
    """Every step of the fit reads the written terms: a text is computed for its terms and for the test on null, no more."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    rows = [(f"good day {i}", "Positive") if i % 2 else (f"bad night {i}", "Negative") for i in range(40)]
    ml.train_scorer(spark.createDataFrame(rows, "text string, label string").select(counted("text").alias("text"), "label"), "text", "label")
    assert 40 <= seen.value <= 80


def test_terms_of_odd_tokens(spark):
    cases = {"x😀abc 😀abc": ["abc", "#a😀a", "#😀a"], "Don't (go) cannot a-b é.": ["do", "go", "can", "not", "é", "#a'a", "#(a)", "#a-a"], "12,5 a1!": ["#0,0", "#a0!"], "": [""]}
    got = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, t string").select("id", ml._terms(F.col("t")).alias("terms")).orderBy("id").collect()
    assert [r.terms for r in got] == list(cases.values())
