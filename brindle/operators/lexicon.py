"""Lexicon emotion counts, dominant emotion, language tags and pluggable batch scorers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.text import label_name, once, word_tokens
from brindle.sources.files import EMOTIONS

#: A synthetic lexicon of words of the test documents; a real one comes from read_lexicon.
SYNTHETIC = {
    "the": ("trust", "positive"), "and": ("joy", "positive"), "of": ("fear", "negative"), "to": ("anticipation",), "in": ("surprise",), "is": ("trust",),
    "that": ("sadness", "negative"), "for": ("joy", "positive"), "with": ("trust", "positive"), "idiot": ("anger", "disgust", "negative"),
    "pathetic": ("disgust", "negative"), "de": ("trust", "positive"), "la": ("joy", "positive"), "der": ("anticipation",), "die": ("fear", "negative"), "un": ("surprise",),
}
#: Words of a lexicon that go into the row expression at most.
MOST_WORDS = 30_000
HF_CLASSES = ("very_negative", "negative", "neutral", "positive", "very_positive")


def emotion_counts(df: DataFrame, lexicon: DataFrame, text: str, prefix: str = "nrc_", most_words: int = MOST_WORDS) -> DataFrame:
    """df with a count for each emotion, net_sentiment and dominant_emotion; rows without a hit count 0.

    Each occurrence of a word counts, each row by itself. Up to `most_words` words the lexicon becomes sets
    in the row's expression, and nothing is shuffled; a larger one is joined to the words of each distinct
    text, and the counts to the rows by the text's digest.
    """
    words = lexicon.groupBy("word").agg(F.collect_set("emotion").alias("emotions"))
    known = words.limit(most_words + 1).collect()
    names = [prefix + e for e in EMOTIONS]
    if len(known) <= most_words:
        of = {e: [r.word for r in known if e in r.emotions] for e in EMOTIONS}
        count = lambda hits, e: F.size(F.filter(hits, lambda t: t.isin(of[e]))) if of[e] else F.lit(0)
        hits = F.filter(word_tokens(F.col(text)), lambda t: t.isin([r.word for r in known])) if known else F.array().cast("array<string>")
        counted = df.withColumn("__n", once(hits, lambda h: F.struct(*[count(h, e).alias(e) for e in EMOTIONS])))
        value = lambda e: F.when(F.col(text).isNull(), 0).otherwise(F.col("__n")[e])
    else:
        texts = df.filter(F.col(text).isNotNull()).select(F.md5(text).alias("__k"), text).dropDuplicates(["__k"])
        tokens = texts.select("__k", F.explode(word_tokens(F.col(text))).alias("word")).groupBy("__k", "word").agg(F.count("*").alias("n"))
        found = tokens.join(lexicon.distinct(), "word").groupBy("__k").agg(F.struct(*[F.sum(F.when(F.col("emotion") == e, F.col("n")).otherwise(0)).alias(e) for e in EMOTIONS]).alias("__n"))
        counted = df.withColumn("__k", F.md5(text)).join(found, "__k", "left").drop("__k")
        value = lambda e: F.coalesce(F.col("__n")[e], F.lit(0))
    out = counted.withColumns({prefix + e: value(e).cast("long") for e in EMOTIONS}).drop("__n")
    return out.withColumns({prefix + "net_sentiment": F.col(prefix + "positive") - F.col(prefix + "negative"), prefix + "dominant_emotion": dominant(names, EMOTIONS)})


def dominant(columns, names) -> Column:
    """The name of the largest column; the first of equal ones, so the first of all if all are zero."""
    values = F.array(*[F.col(c) for c in columns])
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(values, F.array_max(values)).cast("int"))


def class_scores(df: DataFrame, text: str, scorer: Callable[[list[str]], list[dict[str, float]]], batch: int = 32, prefix: str = "hf_") -> DataFrame:
    """df with a score for each class, rounded half-even to 4, and the dominant class.

    scorer gives, for a batch of texts, the scores by label in its own order. A failing batch is tried text
    by text, and a failing text is neutral. Unknown labels are ignored, missing classes are 0.0; of equal
    scores the scorer's first label wins.
    """

    def one(scores: dict[str, float]) -> dict:
        found = {}
        for label, value in scores.items():
            name = label.lower().replace(" ", "_")
            if name in HF_CLASSES:
                found[name] = float(value)
        order = [*found, *(c for c in HF_CLASSES if c not in found)]
        row = {f"{prefix}{c}_score": found.get(c, 0.0) for c in HF_CLASSES}
        return row | {f"{prefix}dominant_sentiment": max(order, key=lambda c: found.get(c, 0.0))}

    def run(texts: list[str]) -> list[dict[str, float]]:
        try:
            return scorer(texts)
        except Exception:  # noqa: BLE001  any backend's error
            out = []
            for t in texts:
                try:
                    out += scorer([t])
                except Exception:  # noqa: BLE001
                    out.append({"neutral": 1.0})
            return out

    schema = ", ".join([*(f"{prefix}{c}_score double" for c in HF_CLASSES), f"{prefix}dominant_sentiment string"])

    @F.pandas_udf(schema)
    def score(texts: pd.Series) -> pd.DataFrame:
        given = texts.fillna("").tolist()
        return pd.DataFrame([one(s) for at in range(0, len(given), batch) for s in run(given[at : at + batch])], columns=[x.split(" ")[0] for x in schema.split(", ")])

    out = df.withColumn("__s", score(text))
    names = [f"{prefix}{c}_score" for c in HF_CLASSES]
    return out.select(*df.columns, *[F.bround(F.col("__s")[n], 4).alias(n) for n in names], F.col("__s")[f"{prefix}dominant_sentiment"].alias(f"{prefix}dominant_sentiment"))


__all__ = ["EMOTIONS", "HF_CLASSES", "SYNTHETIC", "class_scores", "dominant", "emotion_counts", "label_name"]
