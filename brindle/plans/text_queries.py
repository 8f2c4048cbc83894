"""Queries over texts, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from brindle.functions import stem as ST, text as X
from brindle.operators import aggregate as A, dedup as D, filters as P, language as N, lexicon as L, ml as ML, segment as SG
from brindle.sources import files as S, paging as G
from brindle.sources.shared import small_batches

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add

#: Operators on rows that are typed in: tests run them, they are no queries.
EXAMPLES: dict = {}
EXAMPLES_SQL: dict[str, str] = {}


def example(sql: str | None = None):
    def add(f):
        EXAMPLES[f.__name__] = f
        if sql:
            EXAMPLES_SQL[f.__name__] = sql
        return f

    return add



def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    small_batches(spark)
    scan = spark.read.parquet(f"{sf}/{name}.parquet")
    return S.spread(scan) if name == "documents" else scan


# RE2 has no \w of Unicode, so the SQL spells the classes out.
W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
S_ = r"[\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]"
N_ = r"[^\s\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]"
URL_SQL = rf"(?i)https?://{N_}+|www\.{N_}+"
EMAIL_SQL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b"
PHONE_SQL = r"(?:\+?\d{1,3}[\s\-]?)?\(?\d{2,4}\)?[\s\-]?\d{3,4}[\s\-]?\d{3,4}"


def _re(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{to}', 'g')"


MASKED_SQL = _re(_re(_re(_re(_re("text", URL_SQL, "<URL>"), EMAIL_SQL, "<EMAIL>"), PHONE_SQL, "<PHONE>"), f"@{W}+", "<USER>"), rf"#({W}+)", r"\1")
PUNCT_SQL = _re(_re(_re(MASKED_SQL, "!{4,}", "!!!"), r"\?{4,}", "???"), r"\.{4,}", "...")


@query(f"SELECT doc_id, {PUNCT_SQL} AS masked FROM documents")
def clean_basic(spark, sf):
    """F3-F7, F9, F10 on all documents."""
    return table(spark, sf, "documents").select("doc_id", X.compress_punctuation(X.mask_entities(F.col("text"))).alias("masked"))


@query(f"SELECT page_id, {_re('url', URL_SQL, '<URL>')} AS masked, length(html) AS n FROM pages")
def mask_url_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.mask_urls(F.col("url")).alias("masked"), F.length("html").cast("long").alias("n"))


def literals(spark, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, text string")


def values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in enumerate(rows)) + ") AS t(id, text)"


TAGS = ["#LoveThis film", "#MakeAmericaGreatAgain", "USA today", "camelCase stays, #splitThis not", "no tag", "#a #B2C"]
PUNCT = ["a!", "b!!!", "c!!!!", "d!!!!! e?????", "f....", "?!?!", "x...y"]
BOTS = ["I am a bot, bleep", "i'M A BOT", "This action was performed automatically.", "BEEP BOOP", "I am about", "robot"]
NUMBERS = ["a 12 b 3.5 c", "x1 1x 7", "2024-01-02", "no", "1.2.3"]
FACES = [":) hi", "sad :'( and :(", ":)D", "xD XD :-P", "<3 you :/ or :-O", "none", "=( =) ;-) ;) :D :-D :-( :-/ :O :P :'-( :-)"]
NEGATED = ["this is not very good at all", "never say never again my friend", "I don't like it", "good not", "no, really no way out", "plain text here"]


@example("SELECT * FROM (VALUES (0, 'Love This film'), (1, 'Make America Great Again'), (2, 'USA today'), (3, 'camelCase stays, split This not'), (4, 'no tag'), (5, 'a B2C')) t(id, text)")
def hashtag_camelcase(spark, sf):
    return literals(spark, TAGS).select("id", X.split_hashtags(F.col("text")).alias("text"))


@example(f"SELECT id, {_re(_re(_re('text', '!{4,}', '!!!'), r'\?{4,}', '???'), r'\.{4,}', '...')} AS text FROM {values(PUNCT)}")
def punct_compress(spark, sf):
    return literals(spark, PUNCT).select("id", X.compress_punctuation(F.col("text")).alias("text"))


@example("SELECT * FROM (VALUES (0, 'a <NUM> b <NUM> c'), (1, 'x1 1x <NUM>'), (2, '<NUM>-<NUM>-<NUM>'), (3, 'no'), (4, '<NUM>.<NUM>')) t(id, text)")
def number_mask(spark, sf):
    return literals(spark, NUMBERS).select("id", X.mask_numbers(F.col("text")).alias("text"))


# RE2 has no look-ahead and no \b of Unicode: words are put between marks, numbers are words or two words with a dot.
NUMBERS_SQL = _re(_re(_re("text", f"({W}+)", "\x01\\1\x02"), "\x01\\p{Nd}+\x02(?:\\.\x01\\p{Nd}+\x02)?", "<NUM>"), "[\x01\x02]", "")


@query(f"SELECT doc_id, {NUMBERS_SQL} AS text FROM documents")
def number_mask_documents(spark, sf):
    """Numbers masked in all documents."""
    return table(spark, sf, "documents").select("doc_id", X.mask_numbers(F.col("text")).alias("text"))


@example(f"SELECT id, regexp_matches(lower(text), 'i am a bot|i''m a bot|this action was performed automatically|beep boop') AS bot FROM {values(BOTS)}")
def bot_flags(spark, sf):
    return literals(spark, BOTS).select("id", X.is_bot_post(F.col("text")).alias("bot"))


@example("""SELECT * FROM (VALUES (0, ':smile: hi'), (1, 'sad :cry: and :sad:'), (2, ':smile:D'), (3, ':laughing: :laughing: :tongue:'), (4, ':heart: you :unsure: or :surprise:'), (5, 'none'),
(6, ':sad: :smile: :wink: :wink: :grin: :grin: :sad: :unsure: :surprise: :tongue: :cry: :smile:')) t(id, text)""")
def emoticons(spark, sf):
    return literals(spark, FACES).select("id", X.replace_emoticons(F.col("text")).alias("text"))


@example("""SELECT * FROM (VALUES (0, 'this is not_very_good_at all'), (1, 'never_say_never_again my friend'), (2, 'I don''t_like_it'), (3, 'good not'), (4, 'no,_really_no_way out'), (5, 'plain text here')) t(id, text)""")
def negation_scope(spark, sf):
    return literals(spark, NEGATED).select("id", X.negation_scope(F.col("text")).alias("text"))


def negation_sql(text: str, window: int = 3) -> str:
    """Scopes between marks, then blanks within marks to _. Blanks are doubled first, so that each token has its own on both sides."""
    words = "|".join(w.replace("'", "''") for w in X.NEGATIONS)
    padded = f"' ' || replace(trim({_re(text, S_ + '+', ' ')}), ' ', '  ') || ' '"
    marked = _re(padded, rf" ((?i:(?:{words}|[^ ]*n''t)[.,;:!?]*)(?:  [^ ]+){{0,{window}}}) ", " \x01\\1\x02 ")
    inside = f"list_transform(regexp_split_to_array({marked}, '[\x01\x02]'), lambda p, i: CASE WHEN i % 2 = 0 THEN replace(p, '  ', '_') ELSE p END)"
    return f"trim(replace(array_to_string({inside}, ''), '  ', ' '))"


@query(f"SELECT doc_id, {negation_sql('text')} AS text FROM documents")
def negation_scope_documents(spark, sf):
    """F13 on all documents."""
    return table(spark, sf, "documents").select("doc_id", X.negation_scope(F.col("text")).alias("text"))


@query(f"""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part), t AS (SELECT p_partkey, string_agg(upper(w[1]) || w[2:], '' ORDER BY i) AS tag FROM w GROUP BY 1)
SELECT p_partkey, {_re('tag', '([a-z])([A-Z])', chr(92) + '1 ' + chr(92) + '2')} || ' of brandX' AS text FROM t""")
def hashtag_parts(spark, sf):
    """F7 on a tag made of every part's name."""
    tag = F.array_join(F.transform(F.split("p_name", " "), F.initcap), "")
    return table(spark, sf, "part").select("p_partkey", X.split_hashtags(F.concat(F.lit("#"), tag, F.lit(" of brandX"))).alias("text"))


CALLS_SQL = "replace(replace(replace(text, '.', repeat('.', CAST(turn % 6 AS INTEGER))), ',', repeat('!', CAST(turn % 5 AS INTEGER))), ' de ', repeat('?', CAST(turn % 7 AS INTEGER)))"


@query(f"SELECT conv_id, turn, {_re(_re(_re(CALLS_SQL, '!{4,}', '!!!'), r'\?{4,}', '???'), r'\.{4,}', '...')} AS text FROM conversations")
def punct_conversations(spark, sf):
    """F10 on all conversations, whose marks are repeated by the turn's number."""
    c = F.col("text")
    for mark, by, n in ((".", ".", 6), (",", "!", 5), (" de ", "?", 7)):
        c = F.replace(c, F.lit(mark), F.repeat(F.lit(by), (F.col("turn") % n).cast("int")))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.compress_punctuation(c).alias("text"))


@query("""WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT item_id, 'Beep BOOP ' || text FROM benchmark)
SELECT doc_id, coalesce(regexp_matches(lower(text), 'i am a bot|i''m a bot|this action was performed automatically|beep boop'), false) AS bot FROM t""")
def bot_documents(spark, sf):
    """P3 on all documents, and on the benchmark's items with a bot's words before them."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    more = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("Beep BOOP "), F.col("text")))
    return rows.union(more).select("doc_id", X.is_bot_post(F.col("text")).alias("bot"))


FACES_SQL = "replace(replace(replace(text, ', ', ' :) '), '. ', ' :-( xD'), 'on ', '<3:''(')"


def faces(c):
    """The text with emoticons in place of some of its signs."""
    for mark, face in ((", ", " :) "), (". ", " :-( xD"), ("on ", "<3:'(")):
        c = F.replace(c, F.lit(mark), F.lit(face))
    return c


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
TWEET_SQL = _re(_re(_re(_re(_re(_re("lower(coalesce(text, ''))", f"@{W}+", ""), rf"http{N_}+|www{N_}+", ""), "#", ""), r"[^\x00-\x7F]", ""), r"[!-/:-@\[-`{-~]", ""), r"\d+", "")
TWEET_SQL = f"array_to_string(list_filter(string_split(trim({_re(TWEET_SQL, chr(92) + 's+', ' ')}), ' '), lambda w: w <> '' AND NOT list_contains({STOP_SQL}, w)), ' ')"


@query(f"SELECT doc_id, {TWEET_SQL} AS clean FROM documents")
def tweet_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.tweet_clean(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, trim({_re(_re(_re(_re('text', f'http{N_}+', ''), f'@{W}+', ''), f'#({W}+)', chr(92) + '1'), f'{S_}+', ' ')}) AS clean FROM documents")
def plan_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.plan_clean(F.col("text")).alias("clean"))


TOKENS_SQL = f"len(list_filter(regexp_split_to_array(coalesce(text, ''), '{S_}+'), lambda w: w <> ''))"


@query(f"SELECT doc_id, source FROM documents WHERE {TOKENS_SQL} >= 2")
def min_token_filter(spark, sf):
    return P.min_tokens(table(spark, sf, "documents"), "text", 2).select("doc_id", "source")


@query("SELECT doc_id, substr(text, 1, 2000) AS text_clean, length(text) > 2000 AS truncated FROM documents")
def truncate_flag(spark, sf):
    cut, flag = X.truncate_flag(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", cut.alias("text_clean"), flag.alias("truncated"))


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, 'nan') ORDER BY doc_id) = 1")
def exact_dedup(spark, sf):
    return D.exact_dedup(table(spark, sf, "documents"), "text", ["doc_id"]).select("doc_id", "lang", "source")


@query(f"""WITH f AS (SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'i am a bot|beep boop') AS bot, row_number() OVER (PARTITION BY coalesce(text, 'nan') ORDER BY doc_id) > 1 AS dup,
{TOKENS_SQL} < 2 AS short FROM documents)
SELECT count(*) AS rows_in, count(*) FILTER (WHERE bot) AS removed_bots, count(*) FILTER (WHERE NOT bot AND dup) AS removed_duplicates,
count(*) FILTER (WHERE NOT bot AND NOT dup AND short) AS removed_short, count(*) FILTER (WHERE NOT bot AND NOT dup AND NOT short) AS rows_out FROM f""")
def removal_report(spark, sf):
    """A11. Copies are told by the digest of their text: a sum of ids by digest comes first, so no text is sorted or held."""
    text = F.md5(F.coalesce("text", F.lit("nan")).cast("binary"))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("digest"), X.is_bot_post(F.col("text")).alias("bot"), (F.coalesce(F.size(X.tokens(F.col("text"))), F.lit(0)) < 2).alias("short"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    df = docs.join(first, "digest").select((F.col("doc_id") > F.col("first")).alias("dup"), "bot", "short")
    return A.removal_report(df, [("bots", F.col("bot")), ("duplicates", F.col("dup")), ("short", F.col("short"))])


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS {n}" for n, p in X.SCRIPTS.items()) + " FROM documents")
def script_counts(spark, sf):
    return P.script_counts(table(spark, sf, "documents"), "text")


@query("SELECT lang, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM documents GROUP BY lang")
def lang_distribution(spark, sf):
    return A.shares(table(spark, sf, "documents"), "lang")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 15")
def top_sources(spark, sf):
    return A.value_counts(table(spark, sf, "documents"), "source", 15)


LEX_SQL = "(VALUES " + ", ".join(f"('{w}', '{e}')" for w, es in L.SYNTHETIC.items() for e in es) + ") AS lex(word, emotion)"
# Lower-case, contractions off, split at white space, edges stripped, letters only.
WORDS_SQL = _re(_re("lower(text)", rf"(^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])cannot($|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])", r"\1can not\2"), r"n''t([^\p{L}]|$)|''(?:s|re|ve|ll|d|m)([^\p{L}]|$)", r" \1\2")
TOK_SQL = rf"""tok AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array({WORDS_SQL}, '{S_}+')), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS word FROM documents)
WHERE regexp_full_match(word, '\p{{L}}+') GROUP BY ALL)"""
EMO = list(S.EMOTIONS)
SCORES_SQL = (
    f"WITH {TOK_SQL}, hit AS (SELECT doc_id, emotion, sum(n) AS n FROM tok JOIN {LEX_SQL} USING (word) GROUP BY ALL), sc AS (SELECT d.doc_id, d.source, "
    + ", ".join(f"CAST(coalesce(sum(h.n) FILTER (WHERE emotion = '{e}'), 0) AS BIGINT) AS nrc_{e}" for e in EMO)
    + " FROM documents d LEFT JOIN hit h USING (doc_id) GROUP BY ALL), dom AS (SELECT *, nrc_positive - nrc_negative AS nrc_net_sentiment, "
    + "[" + ", ".join(f"'{e}'" for e in EMO) + "][list_position([" + ", ".join(f"nrc_{e}" for e in EMO) + "], greatest(" + ", ".join(f"nrc_{e}" for e in EMO) + "))] AS nrc_dominant_emotion FROM sc) "
)


def _scored(spark, sf) -> DataFrame:
    return L.emotion_counts(table(spark, sf, "documents").select("doc_id", "source", "text"), S.lexicon_of(spark, L.SYNTHETIC), "text").drop("text")


@query(SCORES_SQL + "SELECT * FROM dom")
def lexicon_scores(spark, sf):
    return _scored(spark, sf)


@query(SCORES_SQL + "SELECT nrc_dominant_emotion, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM dom GROUP BY 1")
def dominant_emotion(spark, sf):
    return A.shares(_scored(spark, sf), "nrc_dominant_emotion")


@query(SCORES_SQL + "SELECT source, " + ", ".join(f"round_even(avg(nrc_{e}), 6) AS {e}_mean" for e in EMO) + ", count(*) AS n FROM dom GROUP BY source")
def source_emotion_mean(spark, sf):
    """The flagship: cleaned tokens, lexicon join, counts, means by source."""
    return _scored(spark, sf).groupBy("source").agg(*[F.bround(F.avg(f"nrc_{e}"), 6).alias(f"{e}_mean") for e in EMO], F.count("*").alias("n"))


@query(SCORES_SQL + "SELECT emotion, round_even(avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END), 9) AS share, round_even(avg(v), 9) AS mean_count FROM (SELECT "
       + "unnest([" + ", ".join(f"{{'emotion': 'nrc_{e}', 'v': nrc_{e}}}" for e in EMO) + "], recursive := true) FROM dom) GROUP BY emotion")
def emotion_prevalence(spark, sf):
    return A.prevalence(_scored(spark, sf), [f"nrc_{e}" for e in EMO]).select("emotion", F.bround("share", 9).alias("share"), F.bround("mean_count", 9).alias("mean_count"))


@query("""SELECT avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1.0 ELSE 0.0 END) AS agreement, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS both_positive,
count(*) FILTER (WHERE quality <> 1 AND toxic <> 0) AS both_negative, count(*) FILTER (WHERE (quality = 1) <> (toxic = 0)) AS disagree FROM labels""")
def label_agreement(spark, sf):
    return A.agreement(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 0)


@query("""SELECT conv_id, turn, lower(trim(role)) AS text_type, text, CASE WHEN lower(trim(role)) = 'user' THEN 'title' ELSE 'other' END AS kind FROM conversations""")
def type_split_merge(spark, sf):
    """Split by type and put together again by name."""
    parts = S.split_by_type(S.canonical(table(spark, sf, "conversations").withColumnRenamed("role", "text_type"), ("conv_id", "turn", "text_type", "text")))
    users = parts["merged"].filter("text_type = 'user'").withColumn("kind", F.lit("title"))
    return users.unionByName(parts["merged"].filter("text_type <> 'user'").withColumn("kind", F.lit("other")), allowMissingColumns=True)


SENT_SQL = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){S_}+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '{S_}+', ' ', 'g'))), lambda s: s <> '')"


@query(f"SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS pos, s AS sentence FROM (SELECT conv_id, turn, unnest({SENT_SQL}) AS s, generate_subscripts({SENT_SQL}, 1) AS pos FROM conversations)")
def sentence_explode(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


KEYS = ("the", "of", "nicht", "que")
ON_TOPIC = ("and", "in", "und", "de")


def _any_sql(words) -> str:
    return r"(?i)(^|[^\p{L}\p{M}\p{Nd}\p{Pc}])(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")($|[^\p{L}\p{M}\p{Nd}\p{Pc}])"


@query(f"SELECT doc_id, s AS sentence FROM (SELECT doc_id, unnest({SENT_SQL}) AS s FROM documents) WHERE regexp_matches(s, '{_any_sql(KEYS)}') AND regexp_matches(s, '{_any_sql(ON_TOPIC)}')")
def two_list_filter(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("sentence"))
    return df.filter(P.both_lists(F.col("sentence"), KEYS, ON_TOPIC))


def words_sql(text: str) -> str:
    """The word tokens of a text as a list."""
    return rf"list_filter(list_transform(regexp_split_to_array({WORDS_SQL.replace('lower(text)', f'lower({text})')}, '{S_}+'), lambda t: regexp_replace(t, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda t: regexp_full_match(t, '\p{{L}}+'))"


KEYS_SQL = "[" + ", ".join(f"'{k}'" for k in KEYS) + "]"


@query(SCORES_SQL + "SELECT dom.source, round_even(avg(nrc_net_sentiment), 6) AS mean_score, count(*) AS n, round_even(stddev_samp(nrc_net_sentiment), 6) AS std FROM dom JOIN documents d USING (doc_id) WHERE "
       + " OR ".join(f"contains(lower(d.text), '{t.lower()}')" for t in X.POLICY_TERMS) + " GROUP BY dom.source")
def policy_index(spark, sf):
    """Mean, count and deviation of the net sentiment of tier 1, by source."""
    docs = table(spark, sf, "documents").select("source", "text").filter(X.has_policy_context(F.col("text")))
    scored = L.emotion_counts(docs, S.lexicon_of(spark, L.SYNTHETIC), "text").withColumn("score", F.col("nrc_net_sentiment").cast("double"))
    out = A.summary(scored, "score", ["source"])
    return out.select("source", F.bround("mean", 6).alias("mean_score"), "n", F.bround("std", 6).alias("std"))


@query(f"""WITH s AS (SELECT doc_id, unnest({SENT_SQL}) AS sentence FROM documents), w AS (SELECT doc_id, sentence, {words_sql('sentence')} AS w FROM s)
SELECT doc_id, sentence FROM w WHERE len(w) <= 100 AND (list_has_any(w, {KEYS_SQL}) OR list_has_any(list_transform(w, lambda t: regexp_replace(t, '(\\w{{3}})s$', '\\1')), {KEYS_SQL}))""")
def keyword_sentences(spark, sf):
    """P20 on all documents' sentences."""
    df = table(spark, sf, "documents").select("doc_id", F.explode(X.sentences(F.col("text"))).alias("sentence"))
    return df.filter(P.keyword_sentence(X.word_tokens(F.col("sentence")), KEYS))


COMPANY = ["NVIDIA and AMD are competing in the AI chip market.", "Intel is building a new fab in Ohio.", "TSMC is at the center of geopolitical tension.", "New sanctions on China.", "ASML lithography machines are restricted."]


@example("SELECT * FROM (VALUES (0, 'NVDA,AMD'), (1, 'Intel'), (2, 'TSMC'), (3, 'Other'), (4, 'ASML')) t(id, companies)")
def company_detection(spark, sf):
    return literals(spark, COMPANY).select("id", F.concat_ws(",", P.companies(F.col("text"))).alias("companies"))


COMPANY_SQL = "[" + ", ".join(f"CASE WHEN regexp_matches(text, '{_any_sql(names)}') THEN '{t}' END" for t, names in P.COMPANIES.items()) + "]"


@query(f"""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 9 WHEN 0 THEN ' nvidia' WHEN 1 THEN ', AMD.' WHEN 2 THEN ' Advanced Micro Devices and Intel' WHEN 3 THEN ' tsmc/asml' WHEN 4 THEN ' intelligent' WHEN 5 THEN ' qcom' ELSE '' END AS text FROM part),
c AS (SELECT p_partkey, list_filter({COMPANY_SQL}, lambda x: x IS NOT NULL) AS c FROM t) SELECT p_partkey, CASE WHEN len(c) = 0 THEN 'Other' ELSE array_to_string(c, ',') END AS companies FROM c""")
def company_parts(spark, sf):
    """P19 on all parts' names, with companies after some."""
    names = [" nvidia", ", AMD.", " Advanced Micro Devices and Intel", " tsmc/asml", " intelligent", " qcom"]
    after = F.coalesce(F.element_at(F.array(*[F.lit(n) for n in names], *[F.lit("")] * 3), (F.col("p_partkey") % 9 + 1).cast("int")), F.lit(""))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(",", P.companies(F.concat("p_name", after))).alias("companies"))


@query("SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(lower(text), '{t.lower()}')" for t in X.POLICY_TERMS) + " THEN 1 ELSE 2 END AS tier FROM documents")
def policy_tier(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.when(X.has_policy_context(F.col("text")), 1).otherwise(2).alias("tier"))


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda t: t <> ''))) AS w FROM documents),
g AS (SELECT w, min(doc_id) AS id FROM w GROUP BY w), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM g a, g b
WHERE a.id < b.id AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w))) SELECT a, b, i / (na + nb - i) AS jaccard FROM p WHERE i / (na + nb - i) >= 0.85""".replace("\\\\s", S_))
def near_dup_pairs(spark, sf):
    return D.near_dup_pairs(table(spark, sf, "documents"), "doc_id", "text")


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda t: t <> ''))) AS w FROM documents),
g AS (SELECT w, min(doc_id) AS id FROM w GROUP BY w), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM g a, g b
WHERE a.id < b.id AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w))), n AS (SELECT a, b FROM p WHERE i / (na + nb - i) >= 0.85)
SELECT DISTINCT coalesce((SELECT min(a) FROM n WHERE n.b = g.id), g.id) AS doc_id FROM g""".replace("\\\\s", S_))
def near_dedup(spark, sf):
    return D.near_dedup(table(spark, sf, "documents"), "doc_id", "text").select("doc_id")


@query()
def lang_detect(spark, sf):
    """E24 on all documents, learned from the labels of four documents in five; its accuracy on the others is tested."""
    docs = table(spark, sf, "documents")
    model = N.train(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), "text", "lang")
    return docs.select("doc_id", "lang", N.language(model)(F.col("text")).alias("lang_pred"))


#: Letters of other scripts in place of a-z, for documents by number.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPT_LETTERS = [LATIN, "αβγδεζηθικλμνξοπρστυφχψωάέ", "אבגדהוזחטיכלמנסעפצקרשתםןףץ", "กขคงจฉชซญดตถทธนบปผฝพฟภมยรล", "가나다라마바사아자차카타파하거너더러머버서어저처커터", "かきくけこさしすせそたちつて日本語人大山川水火木金", LATIN]


def rewritten(c):
    """Lower-cased texts, in the letters of another script for five of seven documents."""
    at, out = F.col("doc_id") % len(SCRIPT_LETTERS), F.lit(None).cast("string")
    # Only the letters of a document's own number are looked up; Latin ones stay as they are.
    for k, x in enumerate(SCRIPT_LETTERS):
        out = F.when(at == k, F.lower(c) if x == LATIN else F.translate(F.lower(c), LATIN, x)).otherwise(out)
    return out


REWRITTEN_SQL = "[" + ", ".join(f"translate(lower(text), '{LATIN}', '{x}')" for x in SCRIPT_LETTERS) + f"][doc_id % {len(SCRIPT_LETTERS)} + 1]"
_signs = lambda p: f"len(regexp_extract_all(t, '{p}'))"
SCRIPT_SQL = "".join(
    f"WHEN {_signs(p) if k != 'ja' else f'(CASE WHEN {_signs(p)} > 0 THEN {_signs(p)} + {_signs(N.HAN)} ELSE 0 END)'} * 2 > {_signs(chr(92) + 'p{L}')} THEN '{k}' " for k, p in N.SCRIPT_LANGUAGES.items())


@query(f"SELECT doc_id, CASE {SCRIPT_SQL}ELSE 'und' END AS lang_pred FROM (SELECT doc_id, {REWRITTEN_SQL} AS t FROM documents)")
def script_languages(spark, sf):
    """Languages that their script tells, on all documents, most of them rewritten in other letters."""
    return table(spark, sf, "documents").select("doc_id", N.script_language(rewritten(F.col("text"))).alias("lang_pred"))


@query(f"""WITH d AS (SELECT doc_id, lang, CASE {SCRIPT_SQL}ELSE 'und' END AS script FROM (SELECT doc_id, lang, {REWRITTEN_SQL} AS t FROM documents))
SELECT CASE WHEN script <> 'und' THEN script ELSE lang END AS lang, script <> 'und' AS by_script, count(*) AS n, TRUE AS found FROM d GROUP BY ALL""")
def language_by_chain(spark, sf):
    """The script, then the model where it is sure, on the rewritten documents; found: at least 98 of 100 are named as they are, none otherwise by script."""
    docs = table(spark, sf, "documents")
    model = N.train(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), "text", "lang")
    rows = docs.select("doc_id", "lang", rewritten(F.col("text")).alias("t")).withColumn("script", N.script_language(F.col("t")))
    named = N.language_chain(rows, "t", [lambda c: F.col("script"), lambda c: N.sure_language(model)(c)["lang"]])
    by_script = F.col("script") != N.UNDETERMINED
    true = F.when(by_script, F.col("script")).otherwise(F.col("lang"))
    right = F.avg((F.col("lang_pred") == true).cast("double"))
    return named.groupBy(true.alias("lang"), by_script.alias("by_script")).agg(F.count("*").alias("n"), right.alias("right")).select("lang", "by_script", "n", (F.col("right") >= F.when(F.col("by_script"), 1.0).otherwise(0.98)).alias("found"))


def emoticons_sql(text: str) -> str:
    """Keys between marks in one pass, longest first, then each mark's key by its name."""
    keys = sorted(X.EMOTICONS, key=len, reverse=True)
    quoted = lambda k: k.replace("'", "''")
    pattern = "|".join("".join(f"\\{c}" if c in "()" else c for c in quoted(k)) for k in keys)
    out = _re(text, f"({pattern})", "\x03\\1\x04")
    for k in keys:
        out = f"replace({out}, '\x03{quoted(k)}\x04', '{X.EMOTICONS[k]}')"
    return out


@query(f"SELECT doc_id, {emoticons_sql(FACES_SQL)} AS text FROM documents")
def emoticon_documents(spark, sf):
    """F11 on all documents, with emoticons in place of some signs."""
    return table(spark, sf, "documents").select("doc_id", X.replace_emoticons(faces(F.col("text"))).alias("text"))


BOILERPLATE_SQL = "text"
for _p in X.BOILERPLATE:
    BOILERPLATE_SQL = _re(BOILERPLATE_SQL, f"(?i){_p}", "")
BOILERPLATE_SQL = f"trim({_re(BOILERPLATE_SQL, S_ + '+', ' ')})"
# The steps after NFKC, which SQL has not: the documents hold nothing that NFKC or the mending of encodings changes.
CLEAN_SQL = negation_sql(emoticons_sql(PUNCT_SQL.replace("(text,", f"({BOILERPLATE_SQL},", 1)))


@query(f"SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN '' ELSE {CLEAN_SQL} END AS text_clean FROM documents")
def unicode_clean(spark, sf):
    """F1, F2-F13, F16 on all documents, through one Arrow UDF for NFKC."""
    return table(spark, sf, "documents").select("doc_id", X.clean_text(F.col("text"), window=3).alias("text_clean"))


CLASSES = {"very_negative": "(n % 7) / 28", "negative": "(n % 5) / 20", "neutral": "0.25::DOUBLE", "positive": "(n % 3) / 12", "very_positive": "0.1::DOUBLE"}


@query("WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), s AS (SELECT doc_id, " + ", ".join(f"{x} AS {c}" for c, x in CLASSES.items()) + " FROM n) SELECT doc_id, "
       + ", ".join(f"round_even({c}, 4) AS hf_{c}_score" for c in CLASSES) + ", CASE greatest(" + ", ".join(CLASSES) + ") " + " ".join(f"WHEN {c} THEN '{c}'" for c in CLASSES) + " END AS hf_dominant_sentiment FROM s")
def class_scores(spark, sf):
    """E26 with a deterministic stand-in scorer."""
    def scorer(texts):
        return [{"Very Negative": (len(t) % 7) / 28, "Negative": (len(t) % 5) / 20, "Neutral": 0.25, "Positive": (len(t) % 3) / 12, "Very Positive": 0.1} for t in texts]

    return L.class_scores(table(spark, sf, "documents").select("doc_id", "text"), "text", scorer).drop("text")


@query("SELECT doc_id, sha256(coalesce(lang, '') || '||' || text) AS cache_key, lang NOT IN ('en', 'und') AS is_foreign, text AS text_en FROM documents")
def translate_none(spark, sf):
    """E25 without backend, F24, P12."""
    df = S.translate(table(spark, sf, "documents"), text="text")
    return df.select("doc_id", X.cache_key(F.coalesce("lang", F.lit("")), F.col("text")).alias("cache_key"), P.is_foreign(F.col("lang")).alias("is_foreign"), "text_en")


@query("""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY CAST(substr(source, 4) AS INTEGER), doc_id) = 1""")
def first_keyword_wins(spark, sf):
    """The first source in order keeps a text."""
    order = F.substring("source", 4, 10).cast("int")
    return D.keep_first(table(spark, sf, "documents"), [F.md5("text")], [order, "doc_id"]).select("doc_id", "source")


@query("""WITH f AS (SELECT event_type, event_id, ts, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) = 1)
SELECT event_type, event_id FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) <= 25""")
def keyword_limit(spark, sf):
    """New ids a keyword, newest first, with the limit that is the feature."""
    from pyspark.sql import Window

    newest = table(spark, sf, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), "event_id"))).filter("r = 1")
    return G.first_keyword_limit(newest, "event_id", "event_type", F.lit(0), "ts", 25).select("event_type", "event_id")


@query("SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in ("text", "lang", "source", "n_chars")) + " FROM documents")
def missing_shares(spark, sf):
    return A.missing_shares(table(spark, sf, "documents"), ["text", "lang", "source", "n_chars"])


@query("SELECT count(*) AS n, avg(CASE WHEN text IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate, round_even(avg(length(text)), 6) AS mean_length FROM documents")
def corpus_profile(spark, sf):
    return A.profile(table(spark, sf, "documents"), "text").withColumn("mean_length", F.bround("mean_length", 6))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || '...' ELSE text END AS short, coalesce(text, '') <> coalesce(substr(text, 1, 2000), '') AS changed FROM documents")
def ellipsis_and_audit(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.ellipsis(F.col("text")).alias("short"), P.changed(F.col("text"), F.substring("text", 1, 2000)).alias("changed"))


@query("""SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL AND text NOT IN ('', '[removed]', '[deleted]') AND trim(text) <> '' AND NOT regexp_matches(lower(text), 'i am a bot|this action was performed automatically|beep boop')""")
def forum_filters(spark, sf):
    """P4, P5, P8."""
    df = P.not_blank(P.drop_removed(table(spark, sf, "conversations")), "text")
    return df.filter(~P.has_bot_marker(F.col("text"))).select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY role ASC, turn DESC, conv_id LIMIT 20")
def head_sorted(spark, sf):
    """The first rows of a two-key sort."""
    return P.first_rows(table(spark, sf, "conversations").select("conv_id", "turn", "role"), [F.asc("role"), F.desc_nulls_last("turn"), "conv_id"], 20)


@query("SELECT doc_id, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS grade, CASE WHEN toxic > 0.4 THEN 'neutral' ELSE 'as is' END AS label FROM labels")
def value_map(spark, sf):
    """P28, P29."""
    return table(spark, sf, "labels").select("doc_id", P.map_values(F.col("quality"), {1: "good", 0: "bad"}).alias("grade"), P.override_label(F.lit("as is"), F.col("toxic")).alias("label"))


TERMS = ["tesla", "elon musk", "electric vehicle", "gigafactory", "battery day", "model three production numbers", "autopilot", "cybertruck delivery event"]


@example("""SELECT * FROM (VALUES (0, 'tesla OR elon musk OR electric vehicle'), (1, 'gigafactory OR battery day'), (2, 'model three production numbers'), (3, 'autopilot OR cybertruck delivery event')) t(pos, q)""")
def pack_terms(spark, sf):
    """F25 with a limit of 42 characters."""
    df = spark.range(1).select(F.array(*[F.lit(t) for t in TERMS]).alias("t"))
    return df.select(F.posexplode(X.pack_terms(F.col("t"), 42)).alias("pos", "q"))


def _stem_sql(source: str) -> str:
    """CTEs that add the stem of w to a table of words, as `stem`."""
    ends = lambda x, suffix: f"regexp_extract({x}, '{ST.BEFORE}(?:{suffix})$', 1)"
    like = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"

    def replaced(x: str, to: dict[str, str]) -> str:
        any_of = f"{ST.BEFORE}({'|'.join(to)})$"
        left, end = (f"regexp_extract({x}, '{any_of}', {k})" for k in (1, 2))
        return f"CASE WHEN {end} <> '' AND {like(left, ST.M_1_UP)} THEN {left} || CASE {end} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in to.items()) + f" END ELSE {x} END"

    ed, eed, four, ion = ends("x1", "ed|ing"), ends("x1", "eed"), "|".join(ST.STEP_4), "regexp_extract(x6, '^(.+?[st])ion$', 1)"
    steps = [
        r"regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiou])y', '\1Y', 'g')",
        rf"regexp_replace(regexp_replace(x0, '{ST.BEFORE}(ss|i)es$', '\1\2'), '{ST.BEFORE}([^s])s$', '\1\2')",
        f"CASE WHEN ends_with(x1, 'eed') THEN CASE WHEN {eed} <> '' AND {like(eed, ST.M_1_UP)} THEN x1[:-2] ELSE x1 END WHEN {ed} <> '' AND {like(ed, ST.SOME_VOWEL)} THEN {ed} || '+' ELSE x1 END",
        f"CASE WHEN NOT ends_with(x2, '+') THEN x2 WHEN {like('x2', '(?:at|bl|iz)[+]$')} THEN x2[:-2] || 'e' WHEN length(x2) > 2 AND x2[-2] = x2[-3] AND NOT {like('x2[-2]', '[aeiouylsz]')} THEN x2[:-3] WHEN {like('x2[:-2]', ST.SHORT)} AND {like('x2[:-2]', ST.M_1)} THEN x2[:-2] || 'e' ELSE x2[:-2] END",
        f"CASE WHEN {like(ends('x3', '[yY]'), ST.SOME_VOWEL)} THEN x3[:-2] || 'i' ELSE x3 END",
        replaced("x4", ST.STEP_2), replaced("x5", ST.STEP_3),
        f"CASE WHEN {ends('x6', four)} <> '' THEN CASE WHEN {like(ends('x6', four), ST.M_2_UP)} THEN {ends('x6', four)} ELSE x6 END WHEN {ion} <> '' AND {like(ion, ST.M_2_UP)} THEN {ion} ELSE x6 END",
        f"CASE WHEN {ends('x7', 'e')} <> '' AND ({like(ends('x7', 'e'), ST.M_2_UP)} OR ({like(ends('x7', 'e'), ST.M_1)} AND NOT {like(ends('x7', 'e'), ST.SHORT)})) THEN x7[:-2] ELSE x7 END",
        f"CASE WHEN ends_with(x8, 'll') AND {like('x8', ST.M_2_UP)} THEN x8[:-2] ELSE x8 END",
    ]
    chain = ", ".join(f"s{k} AS (SELECT *, {e} AS x{k} FROM {f's{k - 1}' if k else source})" for k, e in enumerate(steps))
    return chain + ", stems AS (SELECT *, CASE WHEN regexp_matches(w, '^[a-z]{3,}$') THEN lower(x9) ELSE w END AS stem FROM s9)"


@query(f"""WITH t AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}]+')) AS w FROM documents), u AS (SELECT w, count(*) AS n FROM t WHERE regexp_matches(w, '^[a-z]+$') GROUP BY w), {_stem_sql("u")}
SELECT stem, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_words FROM stems GROUP BY stem""".replace("\\\\", "\\"))
def stem_counts(spark, sf):
    """stems of all documents' words of plain letters; each different word is stemmed once."""
    words = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("w")).filter(F.col("w").rlike("^[a-z]+$"))
    different = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return different.groupBy(ST.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_words"))


BARE_SQL = r"regexp_replace({}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.!?…]+$', '', 'g')"
TYPE_SQL = r"CASE WHEN regexp_matches(regexp_replace({0}, '[.!?…]+$', ''), '^\p{{Nd}}[\p{{Nd}}.,]*$') THEN '##' ELSE lower(regexp_replace({0}, '[.!?…]+$', '')) END"
SEGMENT_SQL = rf"""k AS (SELECT doc_id, list_transform(string_split(trim(regexp_replace(text, '{S_}+', ' ', 'g')), ' '), lambda t: {BARE_SQL.format('t')}) AS c FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, i, c[i + 1] AS core, c[i + 2] AS next, CASE WHEN i > 0 THEN c[i] END AS before, {TYPE_SQL.format('c[i + 1]')} AS type FROM (SELECT *, unnest(range(len(c))) AS i FROM k)),
n AS (SELECT type, count(*) FILTER (regexp_matches(core, '[^.]\.$')) AS n_with, count(*) FILTER (NOT regexp_matches(core, '[^.]\.$')) AS n_without, count(*) FILTER (regexp_matches(core, '^\p{{Ll}}')) AS n_lower,
count(*) FILTER (regexp_matches(core, '^\p{{Lu}}') AND before IS NOT NULL AND NOT regexp_matches(before, '[.!?…]+$')) AS n_inside FROM t WHERE type <> '' GROUP BY type),
p AS (SELECT sum(n_with) / sum(n_with + n_without) AS p FROM n),
l AS (SELECT *, length(replace(type, '.', '')) AS letters FROM n, p),
m AS (SELECT *, CASE WHEN n_with > 0 AND regexp_matches(type, '\p{{L}}') THEN -2 * (n_with * ln(p) + n_without * ln(1 - p) - n_with * ln(0.99) - n_without * ln(0.01)) * exp(-letters) * (length(type) - letters + 1) * pow(letters, -n_without) ELSE 0.0 END AS score FROM l)"""


@query(f"WITH {SEGMENT_SQL} SELECT type, n_with, n_without, round_even(score, 6) + 0.0 AS score FROM m WHERE score >= 0.3")
def abbreviation_scores(spark, sf):
    """the token types that the documents show to be abbreviations."""
    counts = SG.learned_counts(table(spark, sf, "documents"), "doc_id", "text")
    return SG.scored(counts).filter(F.col("score") >= SG.LEAST_SCORE).select("type", "n_with", "n_without", (F.bround("score", 6) + F.lit(0.0)).alias("score"))


@query(rf"""WITH {SEGMENT_SQL}, e AS (SELECT doc_id, i, CASE WHEN regexp_matches(core, '[!?][.!?…]*$') THEN TRUE
WHEN coalesce(a.score >= 0.3, FALSE) OR regexp_matches(core, '^\p{{L}}\.$') OR regexp_matches(core, '(?:\.\.|…)$') THEN regexp_matches(next, '^\p{{Lu}}') AND coalesce(f.n_lower > 0 AND f.n_inside = 0, FALSE)
ELSE NOT regexp_matches(next, '^\p{{Ll}}') END AS ends FROM t LEFT JOIN m AS a USING (type) LEFT JOIN m AS f ON f.type = {TYPE_SQL.format('next')} WHERE regexp_matches(core, '[.!?…]+$') AND next IS NOT NULL),
w AS (SELECT doc_id, i, x, coalesce(sum(CAST(e.ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '{S_}+', ' ', 'g')), ' ')) AS x, generate_subscripts(string_split(trim(regexp_replace(text, '{S_}+', ' ', 'g')), ' '), 1) - 1 AS i FROM documents) LEFT JOIN e USING (doc_id, i)),
s AS (SELECT doc_id, k, string_agg(x, ' ' ORDER BY i) AS s FROM w GROUP BY doc_id, k)
SELECT doc_id, coalesce(count(s) FILTER (s <> ''), 0) AS n, md5(coalesce(string_agg(s, chr(10) ORDER BY k) FILTER (s <> ''), '')) AS digest FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id""")
def model_sentences(spark, sf):
    """sentences by the learned model, how many and a digest of them."""
    found = SG.model_sentences(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "\n")).alias("digest"))


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda t: t <> ''))) AS w FROM documents),
g AS (SELECT w, min(doc_id) AS id FROM w GROUP BY w), p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS i, len(a.w) AS na, len(b.w) AS nb FROM g a, g b
WHERE a.id <> b.id AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w))), n AS MATERIALIZED (SELECT a, b FROM p WHERE i / (na + nb - i) >= 0.85),
r AS (SELECT id, id AS to_id FROM g UNION SELECT r.id, n.b FROM r JOIN n ON n.a = r.to_id)
SELECT w.doc_id, (SELECT min(to_id) FROM r WHERE r.id = g.id) AS representative FROM w JOIN g USING (w)""".replace("\\s", S_))
def minhash_groups(spark, sf):
    """Near duplicates by signatures of 128 permutations, a representative for every document."""
    return D.minhash_groups(table(spark, sf, "documents"), "doc_id", "text")


def labelled_classes(spark, sf) -> DataFrame:
    """doc_id, text, label: toxic documents are very negative, others positive or negative by quality."""
    label = F.when(F.col("toxic") == 1, "Very Negative").when(F.col("quality") == 1, "Positive").otherwise("Negative")
    return table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels").withColumn("label", label).select("doc_id", "label"), "doc_id")


@query("SELECT doc_id, TRUE AS sums_to_one, TRUE AS within_bounds, TRUE AS dominant_is_largest, 0.0::DOUBLE AS unseen FROM documents")
def trained_class_scores(spark, sf):
    """A scorer trained on the labelled documents, over all of them; what holds of its scores."""
    scores = ML.model_scores(table(spark, sf, "documents").select("doc_id", "text"), "text", ML.train_scorer(labelled_classes(spark, sf), "text", "label"))
    each = {c: F.col(f"hf_{c}_score") for c in L.HF_CLASSES}
    largest = F.greatest(*each.values())
    own = sum((F.when(F.col("hf_dominant_sentiment") == c, v).otherwise(0.0) for c, v in each.items()), F.lit(0.0))
    return scores.select(
        "doc_id", (F.abs(sum(each.values(), F.lit(0.0)) - 1) < 0.001).alias("sums_to_one"), F.forall(F.array(*each.values()), lambda v: v.between(0, 1)).alias("within_bounds"),
        (own == largest).alias("dominant_is_largest"), (each["neutral"] + each["very_positive"]).alias("unseen"))


#: Signs that the documents lack, put before their texts, and what the Unicode step makes of them.
PLANTED = [
    ("donâ€™t stop ", "don’t stop "), ("ﬁne ＡＢ ", "fine AB "), ("👨‍👩‍👧 here ", ":man_woman_girl: here "), ("🇺🇸 👍🏽 1️⃣ ", ":flag_us: :thumbs_up_sign_medium_skin_tone: :keycap_1: "),
    ("@some_one said #lovethis!!!!! ", "@some_one said #lovethis!!!!! "), ("see https://a.example/x?y=1 or www.b.example now....... ", "see https://a.example/x?y=1 or www.b.example now....... "),
    ("Sent from my iPhone. Click here to unsubscribe now [removed] ", "Sent from my iPhone. Click here to unsubscribe now [removed] "), ("not good :) ", "not good :) "),
]


def planted(rows: list[tuple[str, str]]):
    return F.concat(F.element_at(F.array(*[F.lit(a) for a, _ in rows]), (F.col("doc_id") % len(rows) + 1).cast("int")), F.col("text"))


def planted_sql(rows: list[tuple[str, str]]) -> str:
    return "[" + ", ".join("'" + b.replace("'", "''") + "'" for _, b in rows) + f"][doc_id % {len(rows)} + 1] || text"


@query(f"WITH documents AS (SELECT doc_id, {planted_sql(PLANTED)} AS text FROM main.documents) SELECT doc_id, {CLEAN_SQL} AS text_clean FROM documents")
def planted_clean(spark, sf):
    """all documents, with signs before their texts that each of these steps changes."""
    return table(spark, sf, "documents").select("doc_id", X.clean_text(planted(PLANTED), window=3).alias("text_clean"))


FOLDED = [("Привет Ωμέγα ", "Privet Omega "), ("한국어 ", "hangugeo "), ("ひらがな カタカナ ", "hiragana katakana "), ("שלום ", "shlvm "), ("مرحبا ٣٤ ", "mrhba 34 "), ("日本 ", "<U+65E5><U+672C> "), ("ＡＢ ﬁ café ", "AB fi cafe ")]


@query(f"SELECT doc_id, trim(regexp_replace(replace(replace(strip_accents({planted_sql(FOLDED)}), 'ß', 'ss'), 'œ', 'oe'), '{S_}+', ' ', 'g')) AS folded FROM documents")
def folded_documents(spark, sf):
    """all documents in ASCII, with words of other scripts before their texts; in these texts accents go and ß is ss."""
    return table(spark, sf, "documents").select("doc_id", X.normalize_unicode(fold=True)(planted(FOLDED)).alias("folded"))
