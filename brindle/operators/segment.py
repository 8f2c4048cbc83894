"""Sentence boundaries with a model of abbreviations that is learned from the texts themselves, after Kiss and Strunk (2006).

A token type is an abbreviation if it stands before a period far more often than chance has it (a log-likelihood ratio,
scaled by its length, its inner periods and how often it stands without one). All counts are sums over token types.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.text import collapse, once
from brindle.sources.shared import rounds

#: A score from which on a type is an abbreviation, and the share of periods that an abbreviation is taken to have.
LEAST_SCORE = 0.3
EXPECTED = 0.99
ENDS = r"[.!?…]+$"


def bare(t: Column) -> Column:
    """A token without signs around it, but for marks at its end."""
    return F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?…]+$", "")


def token_type(core: Column) -> Column:
    """Lower case, without marks at the end; numbers are one type."""
    return once(F.lower(F.regexp_replace(core, ENDS, "")), lambda plain: F.when(plain.rlike(r"^\p{Nd}[\p{Nd}.,]*$"), "##").otherwise(plain))


#: A mark at the end of a token within a text, with signs after it that `bare` takes off, and the blank before the next token.
BREAK = r"([.!?…][^\p{L}\p{N}.!?… ]*+) "


def pieces(c: Column) -> Column:
    """The text with white space collapsed, cut after every token that may end a sentence (a line break stands in no collapsed text)."""
    return F.split(F.regexp_replace(collapse(c), BREAK, "$1\n"), "\n")


def _first(piece: Column) -> Column:
    return F.substring_index(piece, " ", 1)


def _last(piece: Column) -> Column:
    return F.substring_index(piece, " ", -1)


def token_rows(df: DataFrame, id_: str, text: str) -> DataFrame:
    """word of every white-space token as it stands, and once more, with a blank before it, of every one that begins a text or follows one that ends with a mark."""

    def words(cut: Column) -> Column:
        # A token of signs only has no core, so it ends nothing.
        begins = F.filter(cut, lambda p, i: (i == 0) | _last(F.get(cut, i - 1)).rlike(r"[\p{L}\p{N}]"))
        return F.concat(F.flatten(F.transform(cut, lambda p: F.split(p, " "))), F.transform(begins, lambda p: F.concat(F.lit(" "), _first(p))))

    return df.select(F.explode(once(pieces(F.col(text)), words)).alias("word"))


def type_counts(tokens: DataFrame) -> DataFrame:
    """type, n_with and n_without (a period), n_lower, n_inside (upper-case first letters within a sentence).

    Tokens are summed as they stand first, so each different one is looked at once.
    """
    core, begins, n = F.col("core"), F.col("begins"), F.col("n")
    words = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # Exploded from an array of one, as a filter on the type would be computed anew below a plain projection.
    typed = F.explode(F.transform(F.array(bare(F.trim("word"))), lambda c: F.struct(c.alias("core"), token_type(c).alias("type"))))
    rows = words.select(typed.alias("x"), F.startswith("word", F.lit(" ")).alias("begins"), "n").select("x.*", "begins", "n")
    with_, lower, upper = core.rlike(r"[^.]\.$"), core.rlike(r"^\p{Ll}"), core.rlike(r"^\p{Lu}")
    total = lambda of, n: F.sum(F.when(of, n).otherwise(0))
    return rows.filter("type <> ''").groupBy("type").agg(
        total(~begins & with_, n).alias("n_with"), total(~begins & ~with_, n).alias("n_without"), total(~begins & lower, n).alias("n_lower"), total(upper, F.when(begins, -n).otherwise(n)).alias("n_inside"))


def learned_counts(df: DataFrame, id_: str, text: str) -> DataFrame:
    """type_counts of the texts whose id is not null, written to the shared folder, as they are read more than once."""
    with rounds(df.sparkSession) as write:
        return write(type_counts(token_rows(df.filter(F.col(id_).isNotNull()), id_, text)))


def scored(counts: DataFrame) -> DataFrame:
    """counts with score, how much a type that stands before periods looks like an abbreviation."""
    total = counts.agg((F.sum("n_with") / F.sum(F.col("n_with") + F.col("n_without"))).alias("p"))
    k, rest = F.col("n_with"), F.col("n_without")
    ratio = -2 * (k * F.log("p") + rest * F.log(1 - F.col("p")) - k * F.lit(math.log(EXPECTED)) - rest * F.lit(math.log(1 - EXPECTED)))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    score = ratio * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), -rest)
    # One row of sums beside every type.
    return counts.crossJoin(F.broadcast(total)).withColumn("score", F.when((k > 0) & F.col("type").rlike(r"\p{L}"), score).otherwise(0.0)).drop("p")


def abbreviations(counts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    return scored(counts).filter(F.col("score") >= least).select("type", "score")


def boundaries(df: DataFrame, id_: str, text: str, counts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """id, k (from 0) of every piece after which a sentence ends, but for the last ones of texts.

    ! and ? end one. A period does unless a lower-case word follows; after an abbreviation or an initial it does only if an
    upper-case word follows that is known in lower case and not in upper case within sentences; so do three dots.
    """
    pairs = lambda cut: F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), lambda p, k: F.struct(k.alias("k"), bare(_last(F.get(cut, k))).alias("core"), bare(_first(p)).alias("next")))
    rows = df.filter(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.explode(once(pieces(F.col(text)), pairs)).alias("x")).select("id", "x.*")
    marks = rows.filter(F.col("core").rlike(ENDS)).withColumn("type", token_type(F.col("core"))).withColumn("next_type", token_type(F.col("next")))
    model = scored(counts)
    named = marks.join(model.filter(F.col("score") >= least).select("type", F.lit(True).alias("short")), "type", "left")
    # Other types start nothing, so they need not be met.
    follows = model.filter((F.col("n_lower") > 0) & (F.col("n_inside") == 0)).select(F.col("type").alias("next_type"), F.lit(True).alias("starter"))
    named = named.join(follows, "next_type", "left")
    careful = F.coalesce("short", F.lit(False)) | F.col("core").rlike(r"^\p{L}\.$") | F.col("core").rlike(r"(?:\.\.|…)$")
    starts = F.col("next").rlike(r"^\p{Lu}") & F.coalesce("starter", F.lit(False))
    ends = F.when(F.col("core").rlike(r"[!?][.!?…]*$"), True).when(careful, starts).otherwise(~F.col("next").rlike(r"^\p{Ll}"))
    return named.filter(ends).select("id", "k")


def model_sentences(df: DataFrame, id_: str, text: str, least: float = LEAST_SCORE) -> DataFrame:
    """df with sentences, an array for each text: its tokens joined by one blank.

    id_ tells the rows apart (rows of a null id are left out of the model and are one sentence). Null and empty texts have
    none. The model is that of all texts of df; what a task holds is bounded by one text.
    """
    ends = boundaries(df, id_, text, learned_counts(df, id_, text), least).groupBy("id").agg(F.sort_array(F.collect_list("k")).alias("__ends"))

    def joined(x: Column) -> Column:
        cut = x["cut"]
        last = F.concat(F.coalesce(x["ends"], F.array().cast("array<int>")), F.array(F.size(cut) - 1))
        # One span for each sentence, from the piece after the one before to its own.
        spans = once(last, lambda e: F.zip_with(F.concat(F.array(F.lit(-1)), F.slice(e, 1, F.size(e) - 1)), e, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
        return F.transform(spans, lambda s: F.array_join(F.slice(cut, s["a"] + 2, s["b"] - s["a"]), " "))

    out = df.join(ends.withColumnRenamed("id", id_), id_, "left")
    found = once(F.struct(pieces(F.col(text)).alias("cut"), F.col("__ends").alias("ends")), lambda x: F.when(x["cut"].isNotNull(), joined(x)))
    return out.withColumn("sentences", F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda s: s != "")).drop("__ends")
