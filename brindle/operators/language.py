"""Language identification by a model of letter triples that is trained on labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brindle.functions.text import once
from brindle.sources.shared import passing

#: Numbers that a triple is hashed to.
SLOTS = 1 << 15
UNDETERMINED = "und"
#: Characters that are looked at together; each takes some 70 bytes on the way.
CHUNK = 1 << 18


@cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_)


def _triples(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text, slot) of chunks of texts: every triple of characters that holds a letter; whatever is no letter counts as a blank."""
    begin, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(f"  {(t or '').lower()}  ")
        size += len(held[-1])
        if size >= CHUNK or i + 1 == len(texts):
            c = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = _letters()[c]
            c = np.where(letter, c, 32).astype(np.uint32)
            text = np.repeat(np.arange(len(held)), [len(x) for x in held])
            ok = (letter[:-2] | letter[1:-1] | letter[2:]) & (text[:-2] == text[2:])
            slot = ((c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1]) * np.uint32(0x85EBCA6B) ^ c[2:]) * np.uint32(0xC2B2AE35) >> np.uint32(17)
            yield begin, text[:-2][ok], slot[ok].astype(np.int64)
            begin, held, size = i + 1, [], 0


class LanguageModel:
    """Log probabilities of the slots of each language."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        self.table = np.log((counts + 0.1) / (counts.sum(1, keepdims=True) + 0.1 * SLOTS)) if names else np.zeros((0, SLOTS))

    def scored(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, the first of equal ones, and how sure that is; `und` and 0 without a letter or a language.

        Sureness is the language's share of the likelihood of all languages and of none of them, which gives every slot
        the same chance. So a few letters that all languages have are not sure, nor is a text in a language that was not learned.
        """
        out, sure = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        for begin, text, slot in _triples(texts) if self.names else ():
            n = int(text[-1]) + 1 if len(text) else 0
            scores = np.stack([np.bincount(text, row[slot], n) for row in self.table])
            none = np.bincount(text, minlength=n) * -np.log(SLOTS)
            best = np.argmax(scores, axis=0)
            top = scores[best, np.arange(n)]
            share = 1 / (np.exp(np.minimum(scores - top, 0)).sum(axis=0) + np.exp(np.minimum(none - top, 700)))
            for i in np.unique(text):
                out[begin + i], sure[begin + i] = self.names[int(best[i])], float(share[i])
        return out, sure

    def predict(self, texts: list[str | None]) -> list[str]:
        """The likeliest language of each text, however unsure."""
        return self.scored(texts)[0]


def train(df: DataFrame, text: str, lang: str) -> LanguageModel:
    """The model of the non-null languages of df, from all labelled texts, each text of a language counted once. What the driver gets is SLOTS numbers a language."""
    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not names:
        return LanguageModel([], np.zeros((0, SLOTS)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for k in set(langs):
                mine = total.setdefault(k, np.zeros(SLOTS, np.int64))
                for _, _, slot in _triples([t for t, x in zip(texts, langs, strict=True) if x == k]):
                    mine += np.bincount(slot, minlength=SLOTS)
        for k, mine in total.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], names=["lang", "slot", "n"])

    counts = np.zeros((len(names), SLOTS))
    with passing(df.sparkSession) as write:
        # Only texts that occur more than once are shuffled to be told apart; the others are counted where they are read.
        named = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
        copied = write(named.groupBy("lang", "digest").agg(F.count("*").alias("n")).filter("n > 1").select("lang", "digest"))
        alone = named.join(copied, ["lang", "digest"], "left_anti").select("lang", "text")
        copies = named.join(copied, ["lang", "digest"], "left_semi").select("lang", "text").distinct()
        for k, slot, n in alone.unionByName(copies).mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n")).collect():
            counts[names.index(k), slot] = n
    return LanguageModel(names, counts)


def language(model: LanguageModel):
    """A function that gives the language of a text column, in an Arrow UDF."""

    @F.pandas_udf(T.StringType())
    def predict(s: pd.Series) -> pd.Series:
        return pd.Series(model.predict([x if isinstance(x, str) else None for x in s]), dtype="object")

    def of(c: Column) -> Column:
        return predict(c)

    return of


def sure_language(model: LanguageModel, least: float = 0.9):
    """A function that gives (lang, sure) of a text column; `und` if the model is less sure than `least`."""

    @F.pandas_udf("lang string, sure double")
    def predict(s: pd.Series) -> pd.DataFrame:
        lang, sure = model.scored([x if isinstance(x, str) else None for x in s])
        return pd.DataFrame({"lang": [a if p >= least else UNDETERMINED for a, p in zip(lang, sure, strict=True)], "sure": sure})

    def of(c: Column) -> Column:
        return predict(c)

    return of


#: Scripts that tell a language by themselves, the first of those in equal numbers; kana tell Japanese though Han signs stand between them.
SCRIPT_LANGUAGES = {
    "el": r"[\x{0370}-\x{03ff}]", "he": r"[\x{0590}-\x{05ff}]", "th": r"[\x{0e00}-\x{0e7f}]", "ko": r"[\x{1100}-\x{11ff}\x{ac00}-\x{d7a3}]",
    "ka": r"[\x{10a0}-\x{10ff}]", "hy": r"[\x{0530}-\x{058f}]", "ja": r"[\x{3040}-\x{30ff}]",
}
HAN = r"[\x{4e00}-\x{9fff}]"


def _count(c: Column, others: str) -> Column:
    """Code points of a text without runs of the others; no array of matches is made."""
    return F.length(F.regexp_replace(c, others, ""))


def _script_of(c: Column) -> Column:
    letters = _count(c, r"\P{L}+")

    def of(beyond: Column, letters: Column) -> Column:
        out = F.lit(UNDETERMINED)
        for lang, signs in reversed(SCRIPT_LANGUAGES.items()):
            own = _count(beyond, f"[^{signs[1:-1]}]+")
            if lang == "ja":
                own = F.when(own > 0, own + _count(beyond, f"[^{HAN[1:-1]}]+")).otherwise(0)
            out = F.when(own * 2 > letters, F.lit(lang)).otherwise(out)
        # Signs of no script here: most texts are done after two passes.
        return F.when(F.length(beyond) * 2 > letters, out).otherwise(F.lit(UNDETERMINED))

    return once(F.struct(F.regexp_replace(c, r"[\x00-\x7f]+", "").alias("beyond"), letters.alias("letters")), lambda x: of(x["beyond"], x["letters"]))


def script_language(c: Column) -> Column:
    """The language whose own script writes over half of the letters of a text, Han signs counted with kana if there are any; else `und`.

    The text is computed once, and so are its letters and its signs beyond ASCII, in which alone scripts are looked for.
    """
    return F.coalesce(once(c, _script_of), F.lit(UNDETERMINED))


def language_chain(df: DataFrame, text: str, detectors: Sequence[Callable[[Column], Column]], name: str = "lang_pred") -> DataFrame:
    """Adds the answer of the first detector that gives one; a detector is a function of the text column, and null or `und` is no answer.

    The script is the cheaper detector and goes first: `[script_language, lambda c: sure_language(model)(c)["lang"]]`.
    Missing texts and texts without a letter are `und`. A detector gets null in place of a text that has its answer, so
    texts go to Python only if the detectors before it leave them open.
    """
    answer = F.lit(None).cast("string")
    for d in detectors:
        rest = F.when(answer.isNull(), F.col(text))
        answer = F.coalesce(answer, F.nullif(d(rest), F.lit(UNDETERMINED)))
    return df.withColumn(name, F.coalesce(answer, F.lit(UNDETERMINED)))
