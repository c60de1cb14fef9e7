"""Queries of text, token and pattern functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgauge import lexicon
from talkgauge.catalog.registry import SQL_CALLS, SQL_SCRIPTS, calls, query, quote, scripts, sql_list, sql_strip, table
from talkgauge.functions import patterns as p
from talkgauge.functions import text as t
from talkgauge.functions import tokens as k
from talkgauge.operators import grouping as g
from talkgauge.operators.tfidf import ngram_frequencies

_WIDE_FORMS, _NARROW_FORMS = "".join(map(chr, [*range(0xFF01, 0xFF5F), 0x3000])), "".join(map(chr, [*range(0x21, 0x7F), 0x20]))


def sql_width(x: str) -> str:
    return f"translate({x}, {quote(_WIDE_FORMS)}, {quote(_NARROW_FORMS)})"


def sql_fold_en(x: str) -> str:
    return sql_strip(f"regexp_replace(regexp_replace({sql_width(x)}, '[,，]+', ',', 'g'), '[.。]+', '.', 'g')")


def sql_contractions(x: str) -> str:
    out = x
    for short, long in lexicon.CONTRACTIONS.items():
        out = f"regexp_replace({out}, {quote(f'(?i)\\b{short}\\b')}, {quote(long)}, 'g')"
    return f"CASE WHEN contains({x}, '''') THEN {out} ELSE {x} END"


def sql_tokens(x: str) -> str:
    raw = f"regexp_extract_all(lower({sql_contractions(sql_width(x))}), {quote(lexicon.NUMBER_TOKEN)})"
    return f"list_filter({raw}, lambda w: NOT regexp_full_match(w, '\\p{{L}}') AND NOT list_contains({sql_list(lexicon.STOPWORDS_EN_TOKENS)}, w))"


_ENTRIES = lexicon.reverse_synonyms(lexicon.SYNONYMS_EN)
SQL_SYNONYMS = "MAP {" + ", ".join(f"{quote(word)}: {sql_list(words)}" for word, words in sorted(_ENTRIES.items())) + "}"


def sql_expand(tokens: str) -> str:
    """As a sorted list of distinct tokens."""
    more = f"flatten(list_transform({tokens}, lambda w: coalesce({SQL_SYNONYMS}[w], [])))"
    return f"list_filter(list_sort(list_distinct(list_concat({tokens}, {more}))), lambda w: NOT list_contains({sql_list(lexicon.STOPWORDS_EN)}, w))"


@query(f"SELECT doc_id, regexp_replace(text, {quote('[^一-鿿,.。，%()（）]+')}, '', 'g') AS clean FROM documents")
def q_clean_comparison(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.clean_comparison(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, regexp_replace(text, {quote('[^一-鿿A-Za-z,.。，%()（）]+')}, '', 'g') AS clean FROM documents")
def q_clean_display(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.clean_display(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {sql_fold_en('text')} AS clean FROM documents")
def q_clean_eng(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.clean(F.col("text"), "ENG").alias("clean"))


@query(f"SELECT doc_id, nfc_normalize({sql_width('text')}) AS normal FROM (SELECT doc_id, {quote(_WIDE_FORMS)} || text AS text FROM documents)")
def q_nfkc(spark, sf_dir):
    """Whole texts; the SQL composes and folds widths, which is all that NFKC does to these tables and the wide forms put in front."""
    return table(spark, sf_dir, "documents").select("doc_id", t.nfkc(F.concat(F.lit(_WIDE_FORMS), F.col("text"))).alias("normal"))


@query(f"SELECT call_id, row_idx, {sql_contractions('text')} AS expanded FROM {SQL_CALLS}")
def q_contractions(spark, sf_dir):
    return calls(spark, sf_dir).select("call_id", "row_idx", t.expand_contractions(F.col("text")).alias("expanded"))


@query(f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def q_tokenize_en(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", k.english_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT call_id, row_idx, list_filter({sql_tokens('text')}, lambda w: length(w) > 1 AND NOT list_contains({sql_list(lexicon.STOPWORDS_EN)}, w)) AS tokens FROM {SQL_CALLS}")
def q_business_tokens(spark, sf_dir):
    return calls(spark, sf_dir).select("call_id", "row_idx", k.business_tokens(k.english_tokens(F.col("text")), "ENG").alias("tokens"))


@query(f"SELECT call_id, row_idx, {sql_expand(sql_tokens('text'))} AS tokens FROM {SQL_CALLS}")
def q_expand_synonyms_en(spark, sf_dir):
    return calls(spark, sf_dir).select("call_id", "row_idx", F.sort_array(k.expand_en(F.col("text"))).alias("tokens"))


_PHRASE = "SELECT call_id, row_idx, 'No ' || {} || ' without ' || {} || ' ' || text AS text FROM " + SQL_CALLS
_KEYS = sorted(lexicon.KEYWORDS_EN)
_PICK = f"{sql_list(_KEYS)}[CAST((row_idx % {len(_KEYS)}) + 1 AS INTEGER)]"


@query(
    f"WITH said AS ({_PHRASE.format(_PICK, _PICK)}), split AS (SELECT call_id, row_idx, {sql_tokens('text')} AS w FROM said) "
    f"SELECT call_id, row_idx, list_sort(list_distinct(list_transform(list_filter(range(1, len(w)), lambda i: list_contains({sql_list(lexicon.NEGATIONS)}, w[i]) "
    f"AND list_contains({sql_list(lexicon.KEYWORDS_EN)}, w[i + 1])), lambda i: w[i] || '_' || w[i + 1]))) AS bigrams FROM split"
)
def q_negation_bigrams(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("row_idx") % len(_KEYS) + 1).cast("int"))
    said = F.concat(F.lit("No "), word, F.lit(" without "), word, F.lit(" "), F.col("text"))
    return calls(spark, sf_dir).select("call_id", "row_idx", F.sort_array(k.negation_bigrams(k.english_tokens(said))).alias("bigrams"))


def _sql_pieces(x: str, pattern: str, least: int) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {quote(pattern)}), lambda s: {sql_strip('s')}), lambda s: length(s) > {least})"


SQL_SENTENCES = (
    f"CASE WHEN len({_sql_pieces('text', '[。！？.!?]+', 2)}) > 0 THEN {_sql_pieces('text', '[。！？.!?]+', 2)} "
    f"WHEN length(text) > 100 AND len({_sql_pieces('text', '，', 10)}) > 0 THEN {_sql_pieces('text', '，', 10)} ELSE [{sql_strip('text')}] END"
)
#: Conversations as sentences, numbered densely within a call.
SQL_UTTERANCES = (
    f"(SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY row_idx, pos) - 1 AS row_idx, speaker, piece AS text FROM "
    f"(SELECT call_id, row_idx, speaker, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM (SELECT call_id, row_idx, speaker, {SQL_SENTENCES} AS pieces FROM {SQL_CALLS})) WHERE length(piece) > 0)"
)


@query(f"SELECT call_id, row_idx, speaker, text FROM {SQL_UTTERANCES}")
def q_sentences(spark, sf_dir):
    return g.utterances(calls(spark, sf_dir)).select("call_id", "row_idx", "speaker", "text")


def _sql_any(patterns: list[str], x: str) -> str:
    return f"regexp_matches({x}, {quote('|'.join(f'(?:{p})' for p in patterns))})"


#: Documents with a date or an amount in front of some of them, which the tables lack.
_SAMPLES = ["2025年10月9日 ", "十月九日 ", "2024-02-29 ", "港币50万 ", "$1,200 ", "12345 ", "2024 ", ""]
_DATED = f"(SELECT doc_id, {sql_list([])}::VARCHAR[] AS none, CASE doc_id % {len(_SAMPLES)} " + " ".join(f"WHEN {i} THEN {quote(x)}" for i, x in enumerate(_SAMPLES)) + " END || text AS text FROM documents)"


def _dated(spark, sf_dir):
    front = F.lit("")
    for i, x in enumerate(_SAMPLES):
        front = F.when(F.col("doc_id") % len(_SAMPLES) == i, x).otherwise(front)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(front, F.col("text")).alias("text"))


@query(f"SELECT doc_id, {_sql_any(lexicon.DATES['MAN'], 'text')} AS date_man, {_sql_any(lexicon.DATES['CAN'], 'text')} AS date_can FROM {_DATED}")
def q_date_patterns(spark, sf_dir):
    return _dated(spark, sf_dir).select("doc_id", p.has_date(F.col("text"), "MAN").alias("date_man"), p.has_date(F.col("text"), "CAN").alias("date_can"))


_LARGE = "len(list_filter(regexp_extract_all(text, '\\p{Nd}{4,}'), lambda n: length(n) <> 4 AND NOT coalesce(TRY_CAST(n AS HUGEINT) BETWEEN 1900 AND 2100, false))) > 0"
SQL_NUMBER_MAN = _sql_any(lexicon.NUMBERS["MAN"], "text")


@query(f"SELECT doc_id, {SQL_NUMBER_MAN} AS number_man, {_sql_any(lexicon.NUMBERS['CAN'], 'text')} OR {_LARGE} AS number_can FROM {_DATED}")
def q_numeric_patterns(spark, sf_dir):
    return _dated(spark, sf_dir).select("doc_id", p.has_number(F.col("text"), "MAN").alias("number_man"), p.has_number(F.col("text"), "CAN").alias("number_can"))


_BOOST_CASES = " ".join(
    f"WHEN {quote(name)} THEN (CASE WHEN d THEN CAST({date} AS DOUBLE) ELSE 0.0 END) + (CASE WHEN n THEN CAST({number} AS DOUBLE) ELSE 0.0 END)" for name, (date, number) in lexicon.BOOSTS_MAN.items()
)
_NAMES = [*sorted(lexicon.BOOSTS_MAN), "Floating rate price", "Greeting"]


@query(
    f"WITH marked AS (SELECT doc_id, {sql_list(_NAMES)}[CAST(doc_id % {len(_NAMES)} + 1 AS INTEGER)] AS point, {_sql_any(lexicon.DATES['MAN'], 'text')} AS d, {SQL_NUMBER_MAN} AS n FROM {_DATED}), "
    f"added AS (SELECT doc_id, point, CASE point {_BOOST_CASES} ELSE CASE WHEN n AND regexp_matches(lower(point), 'price|floating rate') THEN 0.15::DOUBLE ELSE 0.0 END END AS a FROM marked) "
    "SELECT doc_id, point, least(1.0, 0.85::DOUBLE + a)::DOUBLE AS boosted FROM added"
)
def q_boost(spark, sf_dir):
    point = F.element_at(F.array(*map(F.lit, sorted(_NAMES))), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    rows = _dated(spark, sf_dir).withColumn("point", point)
    added = p.boost(F.col("point"), p.has_date(F.col("text"), "MAN"), p.has_number(F.col("text"), "MAN"), p.dynamic_boost(F.col("point"), F.lit("")), lexicon.BOOSTS_MAN)
    return rows.select("doc_id", "point", p.boosted(F.lit(0.85), added).alias("boosted"))


@query(
    "WITH t AS (SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%M:%S') AS short FROM events) "
    "SELECT event_id, CAST(hour AS DOUBLE) * 3600 + minute * 60 + second AS seconds, CAST(minute * 60 + second AS DOUBLE) AS short_seconds FROM "
    "(SELECT event_id, CAST(clock[1:2] AS INTEGER) AS hour, CAST(clock[4:5] AS INTEGER) AS minute, CAST(clock[7:8] AS INTEGER) AS second FROM t)"
)
def q_time_parse(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", t.seconds_of(F.date_format("ts", "HH:mm:ss")).alias("seconds"), t.seconds_of(F.date_format("ts", "mm:ss")).alias("short_seconds"))


@query(
    "SELECT event_id, CASE WHEN s <= 0 THEN '00:00' ELSE (CASE WHEN s // 60 < 10 THEN '0' ELSE '' END) || (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS mmss "
    "FROM (SELECT event_id, CAST(floor(coalesce(value, 0)) AS BIGINT) AS s FROM events)"
)
def q_mmss(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.mmss(F.col("value")).alias("mmss"))


@query(
    f"WITH grams AS (SELECT call_id, unnest(flatten([list_transform(range(1, length(x) - n + 2), lambda i: substr(x, i, n)) for n in [2, 3, 4]])) AS gram FROM (SELECT call_id, {sql_fold_en('text')} AS x FROM {SQL_CALLS})) "
    "SELECT call_id, gram, count(*) AS n FROM grams GROUP BY ALL"
)
def q_ngram_freq(spark, sf_dir):
    return ngram_frequencies(calls(spark, sf_dir), t.clean(F.col("text"), "ENG"))


@query(f"SELECT script_row, CASE WHEN length(standard_script) > 100 THEN substr(standard_script, 1, 100) || '...' ELSE standard_script END AS clipped FROM {SQL_SCRIPTS}")
def q_clip(spark, sf_dir):
    return scripts(spark, sf_dir).select("script_row", t.clip(F.col("standard_script"), 100).alias("clipped"))
