"""Models from MLlib: trees and lines on a seeded split, and a class scorer of texts that is trained, saved and loaded."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.text import label_name, once, word_tokens
from brindle.operators.lexicon import HF_CLASSES
from brindle.sources.shared import passing


def fit_and_score(df: DataFrame, y: str, x: Sequence[str], seed: int = 42, depth: int = 4) -> DataFrame:
    """model, rmse, r2, n_test of a tree and a line on a fifth of the rows.

    The split is that of randomSplit, which sorts each partition and draws: rows are sorted and written once with their
    numbers, and both models are held against the test rows in one pass.
    """
    rows = VectorAssembler(inputCols=list(x), outputCol="features", handleInvalid="skip").transform(df.na.drop(subset=[y, *x])).select("features", y)
    models = {"tree": DecisionTreeRegressor(labelCol=y, maxDepth=depth, seed=seed, predictionCol="__tree"), "line": LinearRegression(labelCol=y, solver="normal", predictionCol="__line")}
    with passing(df.sparkSession) as write:
        dealt = write(rows.sortWithinPartitions("features", y).withColumn("__test", F.rand(seed) >= 0.8))
        test, train = dealt.filter("__test").select("features", y), dealt.filter("NOT __test").select("features", y)
        for model in models.values():
            test = model.fit(train).transform(test)
        own = F.col(y).cast("double")
        miss = {name: F.sum(F.pow(own - F.col(f"__{name}"), F.lit(2.0))).alias(name) for name in models}
        found = test.agg(F.count(F.lit(1)).alias("n"), F.var_pop(own).alias("var"), *miss.values()).first()
    n = found["n"]
    if not n:
        raise ValueError("no rows to test on")

    def r2(error: float) -> float:
        # A column of one value leaves nothing to explain.
        return 1 - error / (found["var"] * n) if found["var"] else -math.inf if error else math.nan

    out = [(name, math.sqrt(found[name] / n), r2(found[name]), n) for name in models]
    return df.sparkSession.createDataFrame(out, "model string, rmse double, r2 double, n_test long")


def _terms(text: Column) -> Column:
    """Words, and the shapes of tokens that are none (letters as a, digits as 0), each once; one empty term of a text without any."""
    words = F.coalesce(word_tokens(text), F.array().cast("array<string>"))
    odd = F.coalesce(F.regexp_extract_all(text, F.lit(r"(?U)(?<!\S)(?!\p{L}++[.,;:!?]?+(?!\S))\S++"), 0), F.array().cast("array<string>"))
    shapes = F.transform(odd, lambda t: F.concat(F.lit("#"), F.regexp_replace(F.regexp_replace(F.substring(t, 1, 12), r"\p{L}+", "a"), r"\p{Nd}+", "0")))
    return once(F.array_distinct(F.concat(words, shapes)), lambda found: F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found))


def train_scorer(labelled: DataFrame, text: str, label: str, features: int = 1 << 13, penalty: float = 0.3, rounds: int = 15) -> PipelineModel:
    """Hashed terms, weighted by rarity, to multinomial logistic regression; labels are names of HF_CLASSES.

    Rows of null text or label are left out. What is collected is one weight for each feature and class. The terms are
    written to the shared folder once, as every step of the fit reads them again.
    """
    found = labelled.filter(F.col(text).isNotNull() & F.col(label).isNotNull()).select(_terms(F.col(text)).alias("__terms"), label_name(F.col(label)).alias("__label"))
    steps = [
        HashingTF(inputCol="__terms", outputCol="__counts", numFeatures=features), IDF(inputCol="__counts", outputCol="__features", minDocFreq=2),
        StringIndexer(inputCol="__label", outputCol="__class", stringOrderType="alphabetAsc", handleInvalid="keep"),
        LogisticRegression(featuresCol="__features", labelCol="__class", predictionCol="__guess", probabilityCol="__p", rawPredictionCol="__raw", family="multinomial", regParam=penalty, maxIter=rounds),
    ]
    with passing(labelled.sparkSession) as write:
        rows = write(found)
        unknown = rows.filter(~F.col("__label").isin(*HF_CLASSES)).select("__label").limit(1).collect()
        if unknown:
            raise ValueError(f"no such class: {unknown[0][0]}")
        return Pipeline(stages=steps).fit(rows)


def save_scorer(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_scorer(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_scores(df: DataFrame, text: str, model: PipelineModel, prefix: str = "hf_") -> DataFrame:
    """df with a score for each class, rounded half-even to 4, and the dominant class, as class_scores gives them.

    Classes that the model has not seen are 0.0; what it gives to labels it does not know is dealt to the others. Null and
    blank texts are scored as texts without words; of equal scores the first class wins.
    """
    known = list(next(s for s in model.stages if hasattr(s, "labelsArray")).labelsArray[0])
    # The array is a column of its own: it is used many times.
    scored = model.transform(df.withColumns({"__terms": _terms(F.col(text)), "__label": F.lit(known[0])})).withColumn("__a", vector_to_array("__p"))
    p = F.col("__a")
    total = sum((F.get(p, k) for k in range(1, len(known))), F.get(p, 0))
    raw = {c: F.get(p, known.index(c)) / total if c in known else F.lit(0.0) for c in HF_CLASSES}
    values = F.array(*raw.values())
    best = F.element_at(F.array(*[F.lit(c) for c in HF_CLASSES]), F.array_position(values, F.array_max(values)).cast("int"))
    return scored.select(*df.columns, *[F.bround(v, 4).alias(f"{prefix}{c}_score") for c, v in raw.items()], best.alias(f"{prefix}dominant_sentiment"))
