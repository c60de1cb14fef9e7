"""Queries of the Cantonese and Mandarin paths. The tables hold no Chinese, so texts are made of the lexicon's words, chosen by a row's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgauge import config, lexicon
from talkgauge.catalog.registry import SQL_CALLS, calls, query, quote, sql_list, sql_strip, table
from talkgauge.catalog.scripting import sql_variations
from talkgauge.catalog.texts import sql_width
from talkgauge.config import Settings
from talkgauge.functions import text as t
from talkgauge.functions import tokens as k
from talkgauge.operators import matching as m
from talkgauge.operators import scripts as s

WORDS = [*sorted(lexicon.KEYWORDS_ZH)[:20], *sorted(lexicon.STOPWORDS_CAN)[:12], *sorted(lexicon.STOPWORDS_MAN)[:12], *sorted(lexicon.SYNONYMS_ZH), "不過", "這樣", "了", "來", "abc", "Wxyz", "OK"]
MARKS = ["", ",", "", "，，", ".", "", "。.", "", "!? ", "；"]
PICKS = 14


def _pick(items: list[str], number):
    return F.element_at(F.array(*map(F.lit, items)), (number % len(items) + 1).cast("int"))


def zh_text(a, b):
    """A text of PICKS words and marks between them, from two whole numbers."""
    return F.concat(*[x for i in range(PICKS) for x in (_pick(WORDS, a * (i + 1) + b * 7 + i * i), _pick(MARKS, a + b * 3 + i * 5))])


def sql_zh_text(a: str, b: str) -> str:
    pick = lambda items, number: f"[{', '.join(map(quote, items))}][CAST(({number}) % {len(items)} + 1 AS INTEGER)]"
    return "(" + " || ".join(x for i in range(PICKS) for x in (pick(WORDS, f"{a} * {i + 1} + {b} * 7 + {i * i}"), pick(MARKS, f"{a} + {b} * 3 + {i * 5}"))) + ")"


SQL_ZH_CALLS = f"(SELECT call_id, row_idx, speaker, {sql_zh_text('length(text)', 'row_idx')} AS text FROM {SQL_CALLS})"


def _zh_calls(spark, sf_dir):
    return calls(spark, sf_dir).withColumn("text", zh_text(F.length("text").cast("long"), F.col("row_idx")))


# -- cleaning ----------------------------------------------------------------------------------


def _sql_comparison(x: str) -> str:
    return f"regexp_replace({x}, {quote('[^一-鿿,.。，%()（）]+')}, '', 'g')"


def sql_clean_man(x: str) -> str:
    return sql_strip(f"regexp_replace(regexp_replace({_sql_comparison(x)}, '[,，]+', '，', 'g'), '[.。]+', '。', 'g')")


def sql_asr(x: str) -> str:
    """First single characters, all at once, then the longer ones as these left them."""
    singles: dict[str, str] = {}
    for word, errors in lexicon.ASR_ERRORS.items():
        for error in errors:
            if len(error) == 1 and error != word:
                singles.setdefault(error, word)
    out = f"translate({x}, {quote(''.join(singles))}, {quote(''.join(singles.values()))})"
    for word, errors in lexicon.ASR_ERRORS.items():
        for error in (e for e in errors if len(e) > 1):
            out = f"replace({out}, {quote(''.join(singles.get(c, c) for c in error))}, {quote(word)})"
    return out


def sql_clean_can(x: str) -> str:
    return sql_asr(_sql_comparison(x))


_CLEAN = {"MAN": sql_clean_man, "CAN": sql_clean_can}


@query(f"SELECT call_id, row_idx, {sql_clean_man('text')} AS clean FROM {SQL_ZH_CALLS}")
def q_clean_man(spark, sf_dir):
    return _zh_calls(spark, sf_dir).select("call_id", "row_idx", t.clean(F.col("text"), "MAN").alias("clean"))


@query(f"SELECT call_id, row_idx, {sql_clean_can('text')} AS clean FROM {SQL_ZH_CALLS}")
def q_clean_can(spark, sf_dir):
    return _zh_calls(spark, sf_dir).select("call_id", "row_idx", t.clean(F.col("text"), "CAN").alias("clean"))


@query(f"SELECT call_id, row_idx, {sql_asr('text')} AS normal FROM {SQL_ZH_CALLS}")
def q_normalize_asr(spark, sf_dir):
    return _zh_calls(spark, sf_dir).select("call_id", "row_idx", t.normalize_asr(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, regexp_replace({sql_width('text')}, {quote(r'[^\p{L}\p{N}_\s,.%()$]')}, '', 'g') AS clean FROM documents")
def q_clean_offline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.clean_offline_en(F.col("text")).alias("clean"))


# -- tokens ------------------------------------------------------------------------------------


def sql_segments(x: str) -> str:
    """Longest words first, then runs of Latin letters and digits, then single characters."""
    longest = sorted((w for w in k._lexicon_words() if len(w) > 1), key=lambda w: (-len(w), w))
    return f"regexp_extract_all({x}, {quote('(?s)' + '|'.join(longest) + '|[A-Za-z0-9]+|.')})"


def sql_business_zh(raw: str, language: str) -> str:
    return f"list_filter({raw}, lambda w: length(w) > 1 AND NOT list_contains({sql_list(lexicon.stopwords(language))}, w))"


_ZH_SYNONYMS = "MAP {" + ", ".join(f"{quote(word)}: {sql_list(words)}" for word, words in sorted(lexicon.reverse_synonyms(lexicon.SYNONYMS_ZH).items())) + "}"


def sql_expand_zh(raw: str) -> str:
    return f"list_sort(list_distinct(list_concat({raw}, flatten(list_transform({raw}, lambda w: coalesce({_ZH_SYNONYMS}[w], []))))))"


@query(f"SELECT call_id, row_idx, {sql_segments('text')} AS tokens FROM {SQL_ZH_CALLS}")
def q_segment_zh(spark, sf_dir):
    """Longest match, which stands in for the optional segmenters, over the raw text, Latin runs included."""
    split = k.LongestMatch(k._lexicon_words())
    return _zh_calls(spark, sf_dir).select("call_id", "row_idx", k.segment_with(F.col("text"), split).alias("tokens"))


@query(f"SELECT call_id, row_idx, {sql_expand_zh('raw')} AS tokens FROM (SELECT *, {sql_segments(sql_clean_can('text'))} AS raw FROM {SQL_ZH_CALLS})")
def q_expand_synonyms_zh(spark, sf_dir):
    raw = k.segment(t.clean(F.col("text"), "CAN"), "CAN")
    return _zh_calls(spark, sf_dir).select("call_id", "row_idx", F.sort_array(k.expanded_tokens(raw, "CAN")).alias("tokens"))


@query(f"SELECT call_id, row_idx, {sql_business_zh('raw', 'CAN')} AS can, {sql_business_zh('raw', 'MAN')} AS man FROM (SELECT *, {sql_segments('text')} AS raw FROM {SQL_ZH_CALLS})")
def q_business_tokens_zh(spark, sf_dir):
    rows = _zh_calls(spark, sf_dir).withColumn("raw", k.segment_with(F.col("text"), k.LongestMatch(k._lexicon_words())))
    return rows.select("call_id", "row_idx", k.business_tokens(F.col("raw"), "CAN").alias("can"), k.business_tokens(F.col("raw"), "MAN").alias("man"))


@query(
    f"WITH w AS (SELECT call_id, row_idx, list_filter(list_distinct({sql_business_zh(sql_segments(sql_clean_can('text')), 'CAN')}), lambda w: list_contains({sql_list(lexicon.KEYWORDS_ZH)}, w)) AS important FROM {SQL_ZH_CALLS}) "
    "SELECT call_id, row_idx, list_sort(important) AS important FROM w"
)
def q_report_keywords_zh(spark, sf_dir):
    """The important keywords of a text, as reports list them."""
    words = k.business_tokens(k.segment(t.clean(F.col("text"), "CAN"), "CAN"), "CAN")
    return _zh_calls(spark, sf_dir).select("call_id", "row_idx", F.sort_array(F.array_intersect(words, k.words_array(lexicon.KEYWORDS_ZH))).alias("important"))


# -- pairs and choice --------------------------------------------------------------------------

_SHEETS = 4
_SETTINGS = {language: Settings(language, threshold=0.05, use_rouge=False, early_exit=0.12) for language in ("CAN", "MAN")}
SQL_ZH_SCRIPTS = f"(SELECT item_id AS script_row, 'P' || (item_id % 8) AS point, 'S' || (item_id // 8 % {_SHEETS}) AS sheet, {sql_zh_text('item_id * 5', 'length(text)')} AS standard_script FROM benchmark)"


def _zh_groups(spark, sf_dir):
    sheet = F.concat(F.lit("S"), (F.col("call_id").cast("long") % _SHEETS).cast("string"))
    return _zh_calls(spark, sf_dir).select("call_id", F.col("row_idx").alias("group_id"), "speaker", "text", sheet.alias("sheet"))


def _zh_scripts(spark, sf_dir):
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        item.alias("script_row"), F.concat(F.lit("P"), (item % 8).cast("string")).alias("point"), F.concat(F.lit("S"), (F.floor(item / 8) % _SHEETS).cast("string")).alias("sheet"),
        zh_text(item * 5, F.length("text").cast("long")).alias("standard_script"),
    )


def _zh_pairs(spark, sf_dir, language):
    return m.pairwise(_zh_groups(spark, sf_dir), s.points(_zh_scripts(spark, sf_dir), language), _SETTINGS[language])


def _sql_scored(language: str) -> str:
    w, clean = config.weights(language), _CLEAN[language]
    features = lambda x, side: f"{sql_expand_zh('raw')} AS {side}_tokens, {sql_business_zh('raw', language)} AS {side}_words FROM (SELECT *, {sql_segments(clean(x))} AS raw FROM "
    groups = f"(SELECT call_id, group_id, sheet, speaker, text, {features('text', 'g')} (SELECT call_id, row_idx AS group_id, speaker, text, 'S' || (CAST(call_id AS BIGINT) % {_SHEETS}) AS sheet FROM {SQL_ZH_CALLS})))"
    variations = sql_variations(SQL_ZH_SCRIPTS, clean(sql_strip("standard_script")))
    texts = (
        f"(SELECT sheet, point, n, pos, script, {features('script', 's')} (SELECT sheet, point, len(variations) AS n, generate_subscripts(list_concat([holistic], variations), 1) - 2 AS pos, unnest(list_concat([holistic], variations)) AS script "
        f"FROM (SELECT sheet, point, string_agg(standard_script, ' ' ORDER BY script_row) AS holistic, flatten(list(variations ORDER BY script_row)) AS variations FROM {variations} GROUP BY sheet, point))))"
    )
    common = "len(list_intersect(s_tokens, g_tokens))"
    whole = "greatest(len(s_tokens), len(g_tokens))" if language == "CAN" else f"(len(s_tokens) + len(g_tokens) - {common})"
    keys = f"list_intersect(s_words, {sql_list(lexicon.KEYWORDS_ZH)})"
    return (
        f"(SELECT *, overlap * {w['expanded_overlap']}::DOUBLE + kw * {w['keyword_coverage']}::DOUBLE AS score FROM (SELECT call_id, group_id, g.sheet, speaker, point, n, pos, script, "
        f"coalesce({common} / nullif({whole}, 0), 0.0::DOUBLE) AS overlap, coalesce(len(list_intersect({keys}, g_words)) / nullif(len({keys}), 0), 0.0::DOUBLE) AS kw FROM {groups} g JOIN {texts} s USING (sheet)))"
    )


def _sql_pairs(language: str) -> str:
    """CAN takes the better of both matches; MAN the holistic one if it reaches the threshold, else the better."""
    cut = _SETTINGS[language].cut
    early = "false" if language == "CAN" else f"h >= {cut}"
    shown = "g" if language == "CAN" else f"CASE WHEN h >= {cut} THEN 0.0::DOUBLE ELSE g END"
    return (
        f"(WITH scored AS MATERIALIZED (SELECT * FROM {_sql_scored(language)}), best AS (SELECT call_id, group_id, point, first(sheet) AS sheet, first(speaker) AS speaker, CAST(first(n) AS BIGINT) AS n, max(CASE WHEN pos < 0 THEN score END) AS h, "
        "coalesce(max(CASE WHEN pos >= 0 THEN score END), 0.0::DOUBLE) AS g, first({'s': script, 'o': overlap, 'k': kw} ORDER BY pos) AS hs, "
        "first({'s': script, 'o': overlap, 'k': kw} ORDER BY CASE WHEN pos < 0 THEN 1 ELSE 0 END, score DESC, pos) AS gs FROM scored GROUP BY call_id, group_id, point), "
        f"judged AS (SELECT *, {early} OR h > g AS wins FROM best) "
        f"SELECT call_id, group_id, sheet, speaker, point, n AS all_variations_count, CASE WHEN wins THEN h ELSE g END AS weighted_score, CASE WHEN wins THEN 'Holistic' ELSE 'Granular' END AS match_type, "
        f"CASE WHEN wins THEN hs.s WHEN g > 0 THEN gs.s ELSE '' END AS best_variation, h AS holistic_score, {shown} AS granular_score, "
        "CASE WHEN wins THEN hs.o WHEN g > 0 THEN gs.o ELSE 0.0::DOUBLE END AS expanded_overlap, CASE WHEN wins THEN hs.k WHEN g > 0 THEN gs.k ELSE 0.0::DOUBLE END AS keyword_coverage FROM judged)"
    )


_PAIR_COLUMNS = ["call_id", "group_id", "sheet", "speaker", "point", "all_variations_count", "weighted_score", "match_type", "best_variation", "holistic_score", "granular_score", "expanded_overlap", "keyword_coverage"]


@query(f"SELECT script_row, variations FROM {sql_variations(SQL_ZH_SCRIPTS, sql_clean_can(sql_strip('standard_script')))}")
def q_script_variations_can(spark, sf_dir):
    return _zh_scripts(spark, sf_dir).select("script_row", s.variations(F.col("standard_script"), "CAN").alias("variations"))


@query(f"SELECT script_row, variations FROM {sql_variations(SQL_ZH_SCRIPTS, sql_clean_man(sql_strip('standard_script')))}")
def q_script_variations_man(spark, sf_dir):
    return _zh_scripts(spark, sf_dir).select("script_row", s.variations(F.col("standard_script"), "MAN").alias("variations"))


@query(f"SELECT {', '.join(_PAIR_COLUMNS)} FROM {_sql_pairs('CAN')}")
def q_pairwise_can(spark, sf_dir):
    return _zh_pairs(spark, sf_dir, "CAN").select(*_PAIR_COLUMNS)


@query(f"SELECT {', '.join(_PAIR_COLUMNS)} FROM {_sql_pairs('MAN')}")
def q_pairwise_man(spark, sf_dir):
    return _zh_pairs(spark, sf_dir, "MAN").select(*_PAIR_COLUMNS)


_EARLY = _SETTINGS["CAN"].early_exit


@query(
    f"SELECT call_id, sheet, point, CASE WHEN weighted_score >= {_SETTINGS['CAN'].cut} THEN 'Covered' ELSE 'Not Covered' END AS covered, CASE WHEN weighted_score <= 0 THEN -1 ELSE group_id END AS group_id, "
    f"CASE WHEN weighted_score <= 0 THEN '' ELSE speaker END AS speaker, match_type, best_variation, round(weighted_score, 6) AS weighted_score FROM {_sql_pairs('CAN')} "
    f"QUALIFY row_number() OVER (PARTITION BY call_id, point ORDER BY CASE WHEN weighted_score >= {_EARLY} THEN 0 ELSE 1 END, CASE WHEN weighted_score >= {_EARLY} THEN group_id END, weighted_score DESC, group_id) = 1"
)
def q_coverage_can(spark, sf_dir):
    """The first group that reaches the early exit, else the best; none is group -1."""
    rows = m.coverage(_zh_pairs(spark, sf_dir, "CAN"), _SETTINGS["CAN"])
    return rows.select("call_id", "sheet", "point", "covered", "group_id", "speaker", "match_type", "best_variation", F.round("weighted_score", 6).alias("weighted_score"))


@query(
    f"SELECT call_id, sheet, point, CASE WHEN weighted_score >= {_SETTINGS['MAN'].cut} THEN 'Covered' ELSE 'Not Covered' END AS covered, group_id, speaker, match_type, round(weighted_score, 6) AS weighted_score FROM {_sql_pairs('MAN')} "
    "QUALIFY row_number() OVER (PARTITION BY call_id, point ORDER BY weighted_score DESC, group_id) = 1"
)
def q_coverage_man(spark, sf_dir):
    rows = m.coverage(_zh_pairs(spark, sf_dir, "MAN"), _SETTINGS["MAN"])
    return rows.select("call_id", "sheet", "point", "covered", "group_id", "speaker", "match_type", F.round("weighted_score", 6).alias("weighted_score"))
