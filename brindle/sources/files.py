"""Reading and writing files by kind, merging, profiles of schemas, line lists, lexicons and the text cache."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CSV = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}
#: The emotions of the lexicon, in the order in which ties are settled.
EMOTIONS = ("anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust", "positive", "negative")
#: The columns that a merged table begins with.
CANONICAL = ("submission_id", "comment_id", "timestamp", "subreddit", "text_type", "text")


def suffix(path: str) -> str:
    return path.rstrip("/").rpartition(".")[2].lower()


def read_input(spark: SparkSession, path: str, schema=None, encoding: str = "UTF-8") -> DataFrame:
    """csv, jsonl, parquet or xlsx (the first sheet) by the path's suffix; anything else raises ValueError.

    CSV text may span lines and double its quotes; a byte order mark before the first name goes. Without
    a schema CSV columns are strings, so no extra pass infers types.
    """
    kind = suffix(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        df = reader.options(**CSV).option("encoding", encoding).csv(path)
        return df.toDF(*[re.sub("^(?:﻿|ï»¿)", "", c) for c in df.columns])
    if kind in ("jsonl", "json"):
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "xlsx":
        from brindle.sources.sheets import read_sheet

        return read_sheet(spark, path)
    raise ValueError(f"no reader for .{kind}: {path}")


def spread(scan: DataFrame) -> DataFrame:
    """A table as it was read, dealt to as many partitions as there are cores if it comes in fewer.

    A small file is one task's work otherwise; a large table comes in more partitions and stays as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def write_output(df: DataFrame, path: str, kind: str = "csv", stem: str | None = None, suffix_: str = "_cleaned") -> str:
    """Write as {stem}_cleaned.{kind} below path; returns the name."""
    out = f"{path.rstrip('/')}/{stem}{suffix_}.{kind}" if stem else path
    if kind == "csv":
        df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(out)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(out)
    else:
        raise ValueError(f"no writer for .{kind}")
    return out


def write_report(report: DataFrame, path: str) -> None:
    """A one-row table of counters as JSON."""
    report.select(F.to_json(F.struct(*report.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_sheets(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """A table directory for each sheet."""
    for name, df in tables.items():
        write_output(df, f"{path.rstrip('/')}/{name}.{kind}", kind)


def merge_files(spark: SparkSession, glob: str, skip: str = r"_cleaned|merged", schema=None) -> DataFrame:
    """All CSV files of a glob with source_file, but those whose name matches `skip`."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.options(**CSV).csv(glob).withColumn("source_file", F.col("_metadata.file_name"))
    return df.filter(~F.col("source_file").rlike(skip))


def canonical(df: DataFrame, names: Sequence[str] = CANONICAL) -> DataFrame:
    """Canonical columns first (empty where missing), the others after them."""
    return df.select(*[F.col(n) if n in df.columns else F.lit("").alias(n) for n in names], *[c for c in df.columns if c not in names])


def split_by_type(df: DataFrame, column: str = "text_type") -> dict[str, DataFrame]:
    """All rows, titles and selftexts, by the trimmed lower-case type; comments are in `merged` only."""
    kind = F.lower(F.trim(F.coalesce(F.col(column), F.lit("nan"))))
    df = df.withColumn(column, kind)
    return {"merged": df, "title": df.filter(F.col(column) == "title"), "selftext": df.filter(F.col(column) == "selftext")}


def read_lines(spark: SparkSession, path: str, comments: bool = True) -> DataFrame:
    """Trimmed lines of a list file without blank ones and, if comments are marked, those that begin with #."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")
    return lines.filter(~F.col("line").startswith("#")) if comments else lines


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """word, emotion of a tab-separated word / emotion / 0-1 file; short rows and other emotions are skipped."""
    rows = spark.read.csv(path, sep="\t", schema="word string, emotion string, assoc int", mode="PERMISSIVE")
    return rows.filter((F.col("assoc") == 1) & F.col("emotion").isin(*EMOTIONS)).select(F.lower("word").alias("word"), "emotion").distinct()


def lexicon_of(spark: SparkSession, words: dict[str, Sequence[str]]) -> DataFrame:
    return spark.createDataFrame([(w, e) for w, es in words.items() for e in es], "word string, emotion string")


def read_boilerplate(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return list(json.load(f)["patterns"])


def flatten_posts(df: DataFrame, struct: str = "public_metrics") -> DataFrame:
    """Counters out of a nested struct, 0 where absent."""
    names = [f.name for f in df.schema[struct].dataType.fields]
    return df.select(*[c for c in df.columns if c != struct], *[F.coalesce(F.col(f"{struct}.{n}"), F.lit(0)).cast("long").alias(n) for n in names])


def json_number(c: Column, path: str, default: float = 0.0) -> Column:
    return F.coalesce(F.get_json_object(c, path).try_cast("double"), F.lit(default))


def transpose(df: DataFrame, item: str, columns: Sequence[str], items: Sequence[str], date: str = "date") -> DataFrame:
    """Rows of items with date columns to rows of dates with item columns."""
    long = df.unpivot([item], list(columns), date, "value")
    return long.groupBy(date).pivot(item, list(items)).agg(F.first("value"))


def cache_lookup(df: DataFrame, cache: DataFrame, key: Column, value: str = "text_en") -> tuple[DataFrame, DataFrame]:
    """Rows with the cached value (null on a miss), and the distinct missing keys."""
    keyed = df.withColumn("cache_key", key)
    hits = keyed.join(cache.select("cache_key", value), "cache_key", "left")
    return hits, keyed.join(cache, "cache_key", "left_anti").select("cache_key").distinct()


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows in place of old ones of the same key."""
    return cache.join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new)


def translate(df: DataFrame, cache: DataFrame | None = None, backend: Callable | None = None, lang: str = "lang", text: str = "text_clean") -> DataFrame:
    """text_en: the text itself for en and und, else the cached translation, else what backend gives for it.

    backend takes a Series of languages and one of texts and gives a Series of texts, in an Arrow UDF;
    without one (kind `none`) the text stays.
    """
    from brindle.functions.text import cache_key

    foreign = ~F.coalesce(F.col(lang), F.lit("und")).isin("en", "und")
    hit = F.lit(None).cast("string")
    if cache is not None:
        df = df.withColumn("__k", cache_key(F.col(lang), F.col(text))).join(cache.select(F.col("cache_key").alias("__k"), F.col("text_en").alias("__hit")), "__k", "left").drop("__k")
        hit = F.col("__hit")
    made = F.pandas_udf(backend, "string")(F.col(lang), F.col(text)) if backend else F.col(text)
    return df.withColumn("text_en", F.when(~foreign, F.col(text)).otherwise(F.coalesce(hit, made))).drop("__hit")
