"""Stems and learned sentence boundaries."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brindle.functions.stem import stem
from brindle.operators import filters as P, segment as G

# The published examples of the steps.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat
troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer
airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil by by is is enjoy enjoi yes ye say sai""".split()


def test_published_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    rows = [*pairs, ("", ""), ("naïve", "naïve"), ("x-rays", "x-rays"), ("Cats", "Cats"), (None, None)]
    got = spark.createDataFrame(rows, "w string, want string").withColumn("got", stem(F.col("w"))).filter("NOT got <=> want").collect()
    assert got == []


def test_sentences_with_a_word_of_the_same_stem(spark):
    rows = [(0, ["they", "sanctioned", "it"]), (1, ["the", "sanctions"]), (2, ["terrific"]), (3, []), (4, ["sanction"] * 101)]
    df = spark.createDataFrame(rows, "id int, w array<string>")
    assert [r.id for r in df.filter(P.stem_sentence(F.col("w"), ["Sanction"])).orderBy("id").collect()] == [0, 1]


NAMES = "Smith Jones Brown Adams White".split()
PLAIN = "price market noon rain house street report paper morning river people water music garden window story letter number road bread".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    pick = lambda n: " ".join(rng.choice(PLAIN) for _ in range(n))
    out = []
    for _ in range(400):
        a, b = rng.choice(NAMES), rng.choice(NAMES)
        out.append(f"Then {rng.choice(['Dr', 'Mr', 'Mrs'])}. {a} saw the {pick(3)}. The {pick(4)} came to {rng.choice('JKL')}. {b} and the {pick(2)}.")
        out.append(f"We like the {pick(5)}. Shares of Acme Inc. rose then. We do not know the {pick(2)}.")
    return out


CASES = {
    "Then Dr. Smith saw the rain. The people left.": ["Then Dr. Smith saw the rain.", "The people left."],
    "Shares of Acme Inc. rose then. We like it!  Really?\nYes.": ["Shares of Acme Inc. rose then.", "We like it!", "Really?", "Yes."],
    "The number is 3.5 then. It came to J. Adams and K. White.": ["The number is 3.5 then.", "It came to J. Adams and K. White."],
    "We saw Acme Inc. Then the market came.": ["We saw Acme Inc.", "Then the market came."],
    "Wait... what is it? no idea.": ["Wait... what is it?", "no idea."],
    'He said "no." Then "yes!" and left.': ['He said "no."', 'Then "yes!"', "and left."],
    "one": ["one"], "": [], "  ": [],
}


def test_learned_sentences(spark, texts):
    rows = [*enumerate(CASES), (90, None), (None, "Null ids. Are one.")] + [(100 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, text string").withColumns({"i": F.lit(1), "type": F.lit(""), "core": F.lit("")})
    found = {r.id: r.sentences for r in G.model_sentences(df, "id", "text").filter("id < 100 OR id IS NULL").collect()}
    assert found == {**dict(enumerate(CASES.values())), 90: [], None: ["Null ids. Are one."]}
    counts = G.type_counts(G.token_rows(df, "id", "text"))
    assert {r.type for r in G.abbreviations(counts).collect()} >= {"dr", "mr", "mrs", "inc"}
    assert G.abbreviations(counts).filter(F.col("type").isin(*PLAIN, *map(str.lower, NAMES))).isEmpty()
    assert G.model_sentences(df.limit(0), "id", "text").count() == 0


# Signs and scripts


@pytest.mark.parametrize("text, want", [
    ("happy 😊", "happy :smiling_face_with_smiling_eyes:"), ("👨‍👩‍👧x", ":man_woman_girl:x"), ("👍🏽👍", ":thumbs_up_sign_medium_skin_tone::thumbs_up_sign:"),
    ("🇺🇸🇩🇪🇫", ":flag_us::flag_de::regional_indicator_symbol_letter_f:"), ("1️⃣#⃣", ":keycap_1::keycap_#:"), ("🏴󠁧󠁢󠁥󠁮󠁧󠁿", ":flag_gbeng:"), ("❤️", ":heavy_black_heart:"), ("🏳️‍🌈", ":waving_white_flag_rainbow:"), ("a→b", "a→b"), ("a‍b", "ab"), ("plain", "plain"),
])
def test_emoji_sequences(text, want):
    from brindle.functions.text import _names

    assert _names(text) == want


@pytest.mark.parametrize("text, want", [
    ("café", "cafe"), ("hello", "hello"), ("한국어", "hangugeo"), ("ひらがな カタカナ", "hiragana katakana"), ("שלום", "shlvm"), ("مرحبا", "mrhba"), ("Привет Ωμέγα ß", "Privet Omega ss"), ("日本", "<U+65E5><U+672C>"), ("٣٤", "34"), ("ＡＢ ﬁ", "AB fi"), ("हि", "hai"),
])
def test_other_scripts_in_latin_letters(text, want):
    from brindle.functions.text import _fold

    assert _fold(text) == want and _fold(text).isascii()


def test_no_letter_is_dropped():
    import unicodedata

    from brindle.functions.text import _fold

    letters = [chr(c) for a, b in ((0x400, 0x460), (0x5D0, 0x5EB), (0x621, 0x64B), (0x3041, 0x3097), (0x30A1, 0x30FB), (0xAC00, 0xAD00), (0x4E00, 0x4E80), (0x904, 0x93A), (0xE01, 0xE2F)) for c in range(a, b)]
    assert [c for c in letters if unicodedata.category(c)[0] == "L" and unicodedata.category(c) != "Lm" and not _fold(c)] == []


def test_mended_parts():
    from brindle.functions.text import _mended

    assert _mended("donâ€™t café") == "don’t café" and _mended("Ã©t") == "ét" and _mended("É« à Â") == "É« à Â"


def plain_counts(rows):
    """The counts token by token, as they are defined."""
    import re
    from collections import Counter

    alnum, out = lambda ch: ch.isalpha() or ch.isdigit(), {}

    def core(t):
        while t and not alnum(t[0]):
            t = t[1:]
        while t and not alnum(t[-1]) and t[-1] not in ".!?…":
            t = t[:-1]
        return t

    for id_, text in rows:
        cores = [core(t) for t in (text or "").split()] if id_ is not None else []
        for k, c in enumerate(cores):
            kind = re.sub("[.!?…]+$", "", c).lower()
            kind = "##" if re.fullmatch(r"\d[\d.,]*", kind) else kind
            if kind:
                n = out.setdefault(kind, Counter())
                n["n_with" if re.search(r"[^.]\.$", c) else "n_without"] += 1
                n["n_lower"] += c[0].islower()
                n["n_inside"] += c[0].isupper() and k > 0 and not re.search("[.!?…]$", cores[k - 1])
    return {k: tuple(n[x] for x in ("n_with", "n_without", "n_lower", "n_inside")) for k, n in out.items()}


def test_counts_of_odd_tokens(spark):
    """Against a plain count; different tokens are looked at once, not each time they occur."""
    rng = random.Random(3)
    signs = ["Dr.", "dr.", "The", "the", "...", "!", "(No.)", "no", "“Yes!”", "e.g.", "3.5", "3,5.", "a…", ".net", "-", "x!?", "Hm..", "–", "A.", '".', "U.S.", "end?)", "\n", " "]
    rows = [(i, rng.choice(["", " "]) + rng.choice([" ", "  ", "\t"]).join(rng.choice(signs) for _ in range(rng.randint(0, 12)))) for i in range(2_000)] + [(None, "Left out."), (9_000, None), (9_001, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = G.learned_counts(df, "id", "text").collect()
    assert {r.type: (r.n_with, r.n_without, r.n_lower, r.n_inside) for r in got} == plain_counts(rows)


def test_types_are_told_of_different_tokens_only(spark):
    df = spark.createDataFrame([(i, "The men were glad. They went home then.") for i in range(500)], "id int, text string")
    plan = G.type_counts(G.token_rows(df, "id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    # From the top: sums by type, the tokens' types, sums by token, the texts.
    assert plan.index("Aggregate [type") < plan.index("p{L}\\p{N}.!?…]+$") < plan.index("Aggregate [word") < plan.index("LogicalRDD")


def test_a_text_of_many_sentences(spark):
    text = " ".join(f"We saw the number {i} then!" for i in range(40_000))
    found = G.model_sentences(spark.createDataFrame([(0, text)], "id int, text string"), "id", "text").select(F.size("sentences"), F.element_at("sentences", -1)).first()
    assert tuple(found) == (40_000, "We saw the number 39999 then!")
