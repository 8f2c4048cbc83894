"""Word stems by suffix stripping, after Porter (1980), as columns.

A word is read as [C](VC)^m[V], with runs of consonants C and vowels V; y is a vowel after a consonant. Suffixes go, or
change, where what is left before them has the measure m that the step asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The published suffixes of steps 2, 3 and 4, with what takes their place in 2 and 3.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

# A y that is a consonant is written Y from the first step on.
CONSONANTS, VOWELS = "[^aeiouy]+", "[aeiouy]+"
SOME_VOWEL = "[aeiouy]"
M_1_UP = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"
M_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$"
M_2_UP = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
# Consonant, vowel, consonant at the end, the last one not w, x or Y.
SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$"
BEFORE = "^(.+?)"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _suffix(w: Column, suffixes, measure: str, to: dict[str, str] | None) -> Column:
    pattern = f"{BEFORE}({'|'.join(suffixes)})$"
    end = F.regexp_extract(w, pattern, 2)

    def strip(parts: Column) -> Column:
        new = F.concat(parts["left"], F.element_at(F.create_map(*[F.lit(x) for kv in to.items() for x in kv]), parts["end"])) if to else parts["left"]
        return F.when((parts["end"] != "") & parts["left"].rlike(measure), new).otherwise(parts["word"])

    return _with(F.struct(w.alias("word"), end.alias("end"), F.regexp_extract(w, pattern, 1).alias("left")), strip)


def _step_1b(w: Column) -> Column:
    left = F.regexp_extract(w, f"{BEFORE}(?:ed|ing)$", 1)

    def mend(x: Column) -> Column:
        double = (F.substring(x, -1, 1) == F.substring(x, -2, 1)) & (F.length(x) > 1) & ~F.substring(x, -1, 1).rlike("[aeiouylsz]")
        e = x.rlike("(?:at|bl|iz)$") | (x.rlike(SHORT) & x.rlike(M_1))
        return F.when(x.rlike("(?:at|bl|iz)$"), F.concat(x, F.lit("e"))).when(double, F.regexp_replace(x, ".$", "")).when(e, F.concat(x, F.lit("e"))).otherwise(x)

    eed = F.regexp_extract(w, f"{BEFORE}eed$", 1)
    return F.when(w.endswith("eed"), F.when((eed != "") & eed.rlike(M_1_UP), F.regexp_replace(w, "d$", "")).otherwise(w)).when((left != "") & left.rlike(SOME_VOWEL), _with(left, mend)).otherwise(w)


def _step_5(w: Column) -> Column:
    left = F.regexp_extract(w, f"{BEFORE}e$", 1)
    w = F.when((left != "") & (left.rlike(M_2_UP) | (left.rlike(M_1) & ~left.rlike(SHORT))), left).otherwise(w)
    return _with(w, lambda x: F.when(x.endswith("ll") & x.rlike(M_2_UP), F.regexp_replace(x, "l$", "")).otherwise(x))


def stem(word: Column) -> Column:
    """The stem of a lower-case English word; words of two letters or less, and what has other signs than a to z, stay."""

    def all_steps(w: Column) -> Column:
        # A y at the start, or after a vowel, is a consonant.
        x = F.regexp_replace(F.regexp_replace(w, "^y", "Y"), "([aeiou])y", "$1Y")
        x = F.regexp_replace(F.regexp_replace(x, f"{BEFORE}(ss|i)es$", "$1$2"), f"{BEFORE}([^s])s$", "$1$2")
        x = _with(x, _step_1b)
        x = _with(x, lambda x: F.when(F.regexp_extract(x, f"{BEFORE}[yY]$", 1).rlike(SOME_VOWEL), F.regexp_replace(x, "[yY]$", "i")).otherwise(x))
        x = _suffix(x, STEP_2, M_1_UP, STEP_2)
        x = _suffix(x, STEP_3, M_1_UP, STEP_3)
        x = _with(x, lambda x: F.when(x.rlike(f"{BEFORE}(?:{'|'.join(STEP_4)})$"), _suffix(x, STEP_4, M_2_UP, None)).otherwise(_suffix(F.regexp_replace(x, "([st])ion$", "$1#"), ["#"], M_2_UP, None)))
        x = F.regexp_replace(x, "#$", "ion")
        return F.lower(_with(x, _step_5))

    return _with(word, lambda w: F.when(w.rlike("^[a-z]{3,}$"), all_steps(w)).otherwise(w))
