"""Text functions as Spark columns. `(?U)` gives \\w, \\d, \\s and \\b their Unicode meaning."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, functions as F

# Patterns, word lists and tables that results depend on.
URL = r"(?iU)https?://\S+|www\.\S+"
EMAIL = r"(?U)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?U)(?:\+?\d{1,3}[\s\-]?)?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}"
MENTION = r"(?U)@\w+"
HASHTAG = r"(?U)#(\w+)"
NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
REPEATED = r"([!?.])\1{3,}"
NEGATIONS = ("not", "no", "never", "hardly", "barely", "scarcely", "n't", "nt", "neither", "nor", "nobody", "nothing", "nowhere", "cannot")
EMOTICONS = {
    ":)": ":smile:", ":-)": ":smile:", "=)": ":smile:",
    ":(": ":sad:", ":-(": ":sad:", "=(": ":sad:",
    ";)": ":wink:", ";-)": ":wink:",
    ":D": ":grin:", ":-D": ":grin:",
    ":'(": ":cry:", ":'-(": ":cry:",
    ":P": ":tongue:", ":-P": ":tongue:",
    "<3": ":heart:",
    ":/": ":unsure:", ":-/": ":unsure:",
    ":O": ":surprise:", ":-O": ":surprise:",
    "XD": ":laughing:", "xD": ":laughing:",
}
BOT_PHRASES = ("i am a bot", "i'm a bot", "this action was performed automatically", "beep boop")
BOILERPLATE = (
    "sent from my iphone", "sent from my android", "unsubscribe from this", "click here to unsubscribe",
    "this is an automated message", "do not reply to this email", r"\[deleted\]", r"\[removed\]",
)
STOPWORDS = (
    "a an the and or but if in on at by for with about to from of is are was were be been being have has had do does did this that these those it its "
    "i you he she we they me him her us them my your his our their as so than too very can will just"
).split()
POLICY_TERMS = (
    "export control", "ban", "sanction", "restriction", "BIS", "entity list", "license", "ECCN", "FDP", "Huawei", "SMIC", "China", "PRC", "Taiwan",
    "decoupling", "reshoring", "blacklist", "waiver", "exemption",
)
SCRIPTS = {
    "cjk": r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}]",
    "arabic": r"[\x{0600}-\x{06ff}]",
    "cyrillic": r"[\x{0400}-\x{04ff}]",
    "devanagari": r"[\x{0900}-\x{097f}]",
    "thai": r"[\x{0e00}-\x{0e7f}]",
    "hebrew": r"[\x{0590}-\x{05ff}]",
    "greek": r"[\x{0370}-\x{03ff}]",
}
SPACE = r"(?U)\s+"


def collapse(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def tokens(c: Column) -> Column:
    """White-space tokens; none of a blank text."""
    return F.filter(F.split(c, SPACE), lambda t: t != "")


def as_text(c: Column) -> Column:
    """Null as the word nan, as a string cast of a missing value gives it."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def once(c: Column, f) -> Column:
    """f of c, which is computed once however often f uses it: its column is a lambda's variable."""
    return F.transform(F.array(c), f)[0]


def only_if(pattern: str, f):
    """f for the texts that match the pattern, which is cheaper to look for than what f does."""
    return lambda c: once(c, lambda x: F.when(x.rlike(pattern), f(x)).otherwise(x))


def mask_urls(c: Column) -> Column:
    return only_if("(?i)http|www", lambda x: F.regexp_replace(x, URL, "<URL>"))(c)


def mask_emails(c: Column) -> Column:
    return only_if("@", lambda x: F.regexp_replace(x, EMAIL, "<EMAIL>"))(c)


def mask_phones(c: Column) -> Column:
    return only_if(r"(?U)\d{2}", lambda x: F.regexp_replace(x, PHONE, "<PHONE>"))(c)


def mask_mentions(c: Column) -> Column:
    return only_if("@", lambda x: F.regexp_replace(x, MENTION, "<USER>"))(c)


def mask_numbers(c: Column) -> Column:
    return F.regexp_replace(c, NUMBER, "<NUM>")


def split_hashtags(c: Column) -> Column:
    """Drop # and split the tag where a small letter meets a capital; text outside tags stays as it is."""
    tag = lambda p: F.regexp_replace(p, r"(?U)\G(\w*?[a-z])(?=[A-Z])", "$1 ")
    part = lambda p, i: F.when(i == 0, p).when(p.rlike(r"(?U)^\w"), tag(p)).otherwise(F.concat(F.lit("#"), p))
    return F.array_join(F.transform(F.split(c, "#", -1), part), "")


def mask_entities(c: Column, numbers: bool = False) -> Column:
    """URL, e-mail, phone, mention, hashtag, then numbers if asked for: in this order."""
    c = split_hashtags(mask_mentions(mask_phones(mask_emails(mask_urls(c)))))
    return mask_numbers(c) if numbers else c


def compress_punctuation(c: Column) -> Column:
    """Four or more of one of ! ? . in a row become three."""
    return F.regexp_replace(c, REPEATED, "$1$1$1")


def remove_boilerplate(c: Column, patterns: Sequence[str] = BOILERPLATE) -> Column:
    """Each pattern out, whatever its case; white space collapses only if there are patterns."""
    if not patterns:
        return c

    def out(x: Column) -> Column:
        for p in patterns:
            x = F.regexp_replace(x, f"(?iu){p}", "")
        return x

    return collapse(only_if("(?iu)" + "|".join(f"(?:{p})" for p in patterns), out)(c))


def is_bot_post(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(map(re.escape, BOT_PHRASES))), F.lit(False))


def replace_emoticons(c: Column) -> Column:
    """Single pass, longest key first: the text is cut at every key, and keys are looked up."""
    pattern = "|".join(re.escape(k) for k in sorted(EMOTICONS, key=len, reverse=True))
    table = F.create_map(*[F.lit(x) for kv in EMOTICONS.items() for x in kv])

    def replaced(x: Column) -> Column:
        found = F.regexp_extract_all(x, F.lit(f"({pattern})"))
        pieces = F.zip_with(F.split(x, pattern, -1), F.transform(found, lambda k: table[k]), lambda r, k: F.concat(r, F.coalesce(k, F.lit(""))))
        return F.array_join(pieces, "")

    # Every key is one of these signs and another one.
    return only_if(r"[:;=<xX][-'()DPO/3]", replaced)(c)


def negation_scope(c: Column, window: int = 3) -> Column:
    """A cue and the next `window` tokens joined by _; scopes don't overlap, the scan goes on after each.

    Scopes are put between two noncharacters of Unicode (U+FDD0, U+FDD1), which no text should hold.
    """
    words = "|".join(re.escape(w) for w in NEGATIONS)
    cue = rf"(?<![^ ])(?i:(?:{words}|[^ ]*n't)[.,;:!?]*)(?![^ ])(?: [^ ]+){{0,{window}}}"
    marked = F.regexp_replace(collapse(c), cue, "\ufdd0$0\ufdd1")
    return F.array_join(F.transform(F.split(marked, "[\ufdd0\ufdd1]", -1), lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(" "), F.lit("_"))).otherwise(p)), "")


def remove_stopwords(c: Column, words: Sequence[str] = tuple(STOPWORDS), keep: Sequence[str] = NEGATIONS) -> Column:
    drop = [w for w in words if w not in keep]
    return F.concat_ws(" ", F.filter(tokens(c), lambda t: ~F.lower(t).isin(*drop)))


def tweet_clean(c: Column) -> Column:
    """The older nine steps: lower, mentions, URLs, #, ASCII, punctuation, digits, white space, stop words."""
    c = F.lower(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, MENTION, "")
    c = F.regexp_replace(c, r"(?U)http\S+|www\S+", "")
    c = F.regexp_replace(c, "#", "")
    c = F.regexp_replace(c, r"[^\x00-\x7F]", "")
    c = F.regexp_replace(c, r"[!-/:-@\[-`{-~]", "")
    c = F.regexp_replace(c, r"\d+", "")
    return F.concat_ws(" ", F.filter(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda t: (t != "") & ~t.isin(*STOPWORDS)))


def plan_clean(c: Column) -> Column:
    """URLs and mentions out, # out, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)http\S+", ""), MENTION, ""), HASHTAG, "$1"))


def word_tokens(c: Column) -> Column:
    """Lower-case tokens of letters only: edge punctuation goes, n't splits off, mixed tokens drop.

    A stand-in for a trained word tokenizer; tokens with inner hyphens, slashes or dots are dropped whole.
    One pass finds the tokens: nothing is done token by token.
    """
    whole = only_if("cannot", lambda x: F.regexp_replace(x, r"(?U)\bcannot\b", "can not"))(F.lower(c))
    flat = only_if("'", lambda x: F.regexp_replace(x, r"n't(?![\p{L}])|'(?:s|re|ve|ll|d|m)(?![\p{L}])", " "))(whole)
    return F.regexp_extract_all(flat, F.lit(r"(?U)(?<!\S)[^\p{L}\p{N}\s]*+(\p{L}++)[^\p{L}\p{N}\s]*+(?!\S)"), 1)


def sentences(c: Column) -> Column:
    """Cut after . ! ? followed by white space; trimmed, without empty ones."""
    cut = F.split(F.regexp_replace(c, r"(?U)([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(cut, collapse), lambda s: s != "")


def truncate_flag(c: Column, most: int = 2000) -> tuple[Column, Column]:
    """The text cut to `most` code points, and whether it was longer."""
    return F.substring(c, 1, most), F.length(c) > most


def ellipsis(c: Column, most: int = 60) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def label_name(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def strip_kind(c: Column) -> Column:
    """All t3_ out of an id."""
    return F.replace(c, F.lit("t3_"), F.lit(""))


def cache_key(lang: Column, text: Column) -> Column:
    return F.sha2(F.concat(lang, F.lit("||"), text), 256)


def pack_terms(terms: Column, most: int = 190, glue: str = " OR ") -> Column:
    """Terms joined in order to queries of at most `most` characters; a longer term is one of its own."""
    start = F.array().cast("array<string>")

    def step(acc, t):
        last = F.element_at(acc, -1)
        longer = F.concat(last, F.lit(glue), t)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))
        return F.when(F.size(acc) == 0, F.array(t)).when(F.length(longer) <= most, grown).otherwise(F.concat(acc, F.array(t)))

    return F.aggregate(terms, start, step)


def has_policy_context(c: Column) -> Column:
    low = F.lower(c)
    hit = F.lit(False)
    for t in POLICY_TERMS:
        hit = hit | low.contains(t.lower())
    return F.coalesce(hit, F.lit(False))


_MISREAD = re.compile("[\u0080-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


# What UTF-8 of two, three and four bytes looks like in Windows-1252 or Latin-1, for the usual first bytes.
_REST = "[\u0080-\u00bf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_RUN = re.compile(f"[ÂÃ]{_REST}|â{_REST}{{2}}|ð{_REST}{{3}}")


def _as_read(text: str) -> str | None:
    for encoding in ("cp1252", "latin-1"):
        try:
            return text.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
    return None


def _mended(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read right: the whole text, or its parts that can be nothing else; anything else stays."""
    if text.isascii() or not _MISREAD.search(text):
        return text
    whole = _as_read(text)
    return whole if whole is not None else _RUN.sub(lambda m: _as_read(m[0]) or m[0], text)


def _short_name(c: str) -> str:
    """The Unicode name of a sign, without the words that only say what kind of sign it is."""
    name = unicodedata.name(c, "symbol").lower()
    if "fitzpatrick" in name:
        return TONES[ord(c) - 0x1F3FB] + "_skin_tone"
    return name.replace(" ", "_").replace("-", "_")


# Skin tones in the order of their code points.
TONES = ("light", "medium_light", "medium", "medium_dark", "dark")
_SIGN = r"[\u00a9\u00ae\u203c\u2049\u2122\u2139\u2190-\u21ff\u2300-\u27bf\u2900-\u297f\u2b00-\u2bff\u3030\u303d\u3297\u3299\U0001f000-\U0001faff]"
_ONE = f"{_SIGN}(?:[\U0001f3fb-\U0001f3ff]|\ufe0f)?"
# Longest first: flags of two letters, of subdivisions, keycaps, signs that are joined.
EMOJI = re.compile(f"[\U0001f1e6-\U0001f1ff]{{2}}|\U0001f3f4[\U000e0020-\U000e007e]+\U000e007f|[0-9#*]\ufe0f?\u20e3|{_ONE}(?:\u200d{_ONE})*|[\ufe0f\u200d]")


def _named(m: re.Match) -> str:
    """One name for a whole sequence."""
    s = m[0]
    if s in "\ufe0f\u200d":
        return ""
    if "\U0001f1e6" <= s[0] <= "\U0001f1ff" and len(s) == 2:
        return ":flag_" + "".join(chr(ord(c) - 0x1F1E6 + ord("a")) for c in s) + ":"
    if len(s) > 1 and "\U000e0020" <= s[1] <= "\U000e007e":
        return ":flag_" + "".join(chr(ord(c) - 0xE0000) for c in s[1:-1]) + ":"
    if s[-1] == "\u20e3":
        return f":keycap_{s[0]}:"
    signs = [c for c in s if c not in "\ufe0f\u200d"]
    # Arrows and letters in circles are signs too, but no pictures.
    if len(signs) == 1 and unicodedata.category(signs[0]) != "So" and "\ufe0f" not in s:
        return s
    return ":" + "_".join(map(_short_name, signs)) + ":"


def _names(text: str) -> str:
    """Emoji, whole sequences of them too, as :name:, with the Unicode names of their signs; other joiners and variation selectors go."""
    return text if text.isascii() else EMOJI.sub(_named, text)


# Letters of two scripts in Latin ones.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e io zh z i i k l m n o p r s t u f kh ts ch sh shch \" y ' e iu ia".split(), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
LATIN = CYRILLIC | GREEK | {c.upper(): t.capitalize() for c, t in (CYRILLIC | GREEK).items() if c.upper() != c} | {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "Þ": "Th"}
_LATIN = str.maketrans(LATIN)


#: Scripts whose letters are named by their sound; those of others are named by a word that begins with it.
SPOKEN = frozenset("HIRAGANA KATAKANA HANGUL DEVANAGARI BENGALI GUJARATI GURMUKHI TAMIL TELUGU KANNADA MALAYALAM ORIYA SINHALA ETHIOPIC CHEROKEE BOPOMOFO YI LAO KHMER MYANMAR TIBETAN".split())
_LETTER = re.compile(r"(?:SYLLABLE|LETTER|CHARACTER|VOWEL SIGN)(?: (?:SMALL|CAPITAL|VOWEL|INDEPENDENT|FINAL|INITIAL|MEDIAL))* ([A-Z]+)")
_SOUND = re.compile(r"[^aeiou]*")


def _latin(c: str) -> str:
    """A letter of a script without decomposition to Latin ones, by its Unicode name; one that has no name of its own, as a Han sign, by its code point."""
    if c.isascii():
        return c
    name = unicodedata.name(c, "")
    m = _LETTER.search(name)
    if m:
        sound = m[1].lower()
        return sound if name.split(" ")[0] in SPOKEN else _SOUND.match(sound)[0] or sound[0]
    if unicodedata.decimal(c, None) is not None:
        return str(unicodedata.decimal(c))
    return f"<U+{ord(c):04X}>" if unicodedata.category(c)[0] == "L" else ""


def _fold(text: str) -> str:
    """In ASCII: letters of other scripts in Latin ones, digits as such, signs and marks without either go."""
    # Syllables of one code point are named by their sound; their parts are not.
    text = "".join(_latin(c) if "\uac00" <= c <= "\ud7a3" or "\u3041" <= c <= "\u30ff" else c for c in unicodedata.normalize("NFC", text))
    text = unicodedata.normalize("NFKD", text.translate(_LATIN))
    return "".join(map(_latin, "".join(c for c in text if not unicodedata.combining(c)).translate(_LATIN)))


def normalize_unicode(emoji: bool = False, fold: bool = False):
    """Mend mojibake, NFKC, and if asked emoji names and ASCII folding, in one Arrow UDF; then collapse.

    NFKC, names and folding have no SQL function. Folding writes letters of other scripts in Latin ones: by table, by
    decomposition, by the sound in a letter's Unicode name, and Han signs by their code points, so no letter is lost.
    """

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            if x.isascii():
                return x
            x = unicodedata.normalize("NFKC", _mended(x))
            x = _names(x) if emoji else x
            return _fold(x) if fold else x

        return s.map(one, na_action="ignore")

    return lambda c: collapse(normal(c))


def clean_text(c: Column, numbers: bool = False, window: int | None = None, classic: bool = False, fold: bool = False) -> Column:
    """All steps in their order; null and blank texts become empty."""
    out = normalize_unicode(emoji=True)(c)
    out = replace_emoticons(compress_punctuation(mask_entities(remove_boilerplate(out), numbers)))
    if window is not None:
        out = negation_scope(out, window)
    if classic:
        out = remove_stopwords(out)
    if fold:
        out = normalize_unicode(fold=True)(out)
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "").otherwise(collapse(out))
