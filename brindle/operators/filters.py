"""Row filters, flags and schema checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brindle.functions.stem import stem
from brindle.functions.text import SCRIPTS, is_bot_post, tokens

#: What bots say of themselves.
BOT_MARKERS = ("i am a bot", "this action was performed automatically", "beep boop")
#: Names of companies by ticker.
COMPANIES = {
    "NVDA": ("nvidia", "nvda"), "AMD": ("amd", "advanced micro devices"), "Intel": ("intel", "intc"), "TSMC": ("tsmc", "taiwan semiconductor", "tsm"),
    "ASML": ("asml",), "Micron": ("micron",), "Qualcomm": ("qualcomm", "qcom"), "Broadcom": ("broadcom", "avgo"),
}


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def drop_bots(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~is_bot_post(F.col(text)))


def has_bot_marker(c: Column, markers: Sequence[str] = BOT_MARKERS) -> Column:
    low, hit = F.lower(c), F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    return F.coalesce(hit, F.lit(False))


def drop_removed(df: DataFrame, text: str = "text") -> DataFrame:
    """Without empty, [removed] and [deleted] texts."""
    return df.filter(F.col(text).isNotNull() & ~F.col(text).isin("", "[removed]", "[deleted]"))


def min_tokens(df: DataFrame, text: str, least: int = 2) -> DataFrame:
    return df.filter(F.coalesce(F.size(tokens(F.col(text))), F.lit(0)) >= least)


def not_blank(df: DataFrame, text: str) -> DataFrame:
    return df.filter(F.col(text).isNotNull() & (F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != ""))


def is_foreign(lang: Column) -> Column:
    return ~lang.isin("en", "und")


def changed(a: Column, b: Column) -> Column:
    """Whether two texts differ, null being the empty text."""
    return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))


def script_counts(df: DataFrame, text: str) -> DataFrame:
    """One row: in how many texts each script occurs."""
    return df.agg(*[F.count_if(F.col(text).rlike(p)).alias(n) for n, p in SCRIPTS.items()])


def first_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """Whether any term stands in the text as words, whatever the case."""
    import re

    return F.coalesce(c.rlike(r"(?iU)\b(?:" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")\b"), F.lit(False))


def both_lists(c: Column, general: Sequence[str], ontopic: Sequence[str]) -> Column:
    return contains_any(c, general) & contains_any(c, ontopic)


def companies(c: Column) -> Column:
    """Tickers named in a text, or Other."""
    found = F.filter(F.array(*[F.when(contains_any(c, names), t) for t, names in COMPANIES.items()]), lambda t: t.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("Other"))).otherwise(found)


def keyword_sentence(words: Column, keywords: Sequence[str], most: int = 100) -> Column:
    """Whether a sentence of at most `most` tokens has a keyword as token, or its plain plural.

    Stands in for a part-of-speech and lemma model: any word class counts, and only a final s is dropped.
    """
    singular = F.transform(words, lambda t: F.regexp_replace(t, r"(?<=\w{3})s$", ""))
    keys = F.array(*[F.lit(k.lower()) for k in keywords])
    return (F.size(words) <= most) & (F.arrays_overlap(words, keys) | F.arrays_overlap(singular, keys))


def stem_sentence(words: Column, keywords: Sequence[str], most: int = 100) -> Column:
    """Whether a sentence of at most `most` tokens has a word of the same stem as a keyword."""
    keys = F.transform(F.array(*[F.lit(k.lower()) for k in keywords]), stem)
    return (F.size(words) <= most) & F.arrays_overlap(F.transform(words, stem), keys)


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("Unnamed")])


def coerce_numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Strings to doubles, what is no number to null; a column without any number stays as it is."""
    got = df.agg(*[F.count(F.col(n).try_cast("double")).alias(n) for n in names]).first()
    return df.withColumns({n: F.col(n).try_cast("double") for n in names if got[n]})


def drop_constant(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Without those of names that hold at most one distinct finite value; one pass."""
    finite = lambda n: F.when(~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) < float("inf")), F.col(n))
    row = df.agg(*[F.struct(F.min(finite(n)), F.max(finite(n))).alias(n) for n in names]).first()
    return df.drop(*[n for n in names if row[n][0] == row[n][1]])


def complete_cases(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(names) if names else None)


def require_rows(df: DataFrame, least: int) -> DataFrame:
    n = df.limit(least).count()
    if n < least:
        raise ValueError(f"{n} rows, at least {least} are needed")
    return df


def drop_bad_dates(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.try_to_timestamp(column)).filter(F.col(column).isNotNull())


def map_values(c: Column, table: dict) -> Column:
    """Looked-up values; null for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c) if table else F.lit(None)


def override_label(label: Column, score: Column, over: float = 0.4, to: str = "neutral") -> Column:
    return F.when(score > over, to).otherwise(label)
