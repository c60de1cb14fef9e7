"""Queries of script parsing, term importance and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgauge import lexicon
from talkgauge.catalog.registry import SQL_SCRIPTS, query, quote, scripts, sql_list, sql_strip, table
from talkgauge.catalog.texts import sql_fold_en, sql_tokens
from talkgauge.functions import tokens as k
from talkgauge.operators import routing as r
from talkgauge.operators import scripts as s
from talkgauge.operators import terms as tm
from talkgauge.sources import files


def _pieces(x: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {quote(pattern)}), lambda s: {sql_strip('s')}), lambda s: length(s) > 0)"


def _merge(x: str) -> str:
    """The carry waits as the first item of the accumulator."""
    step = "CASE WHEN length(CASE WHEN acc[1] = '' THEN x[1] ELSE acc[1] || ' ' || x[1] END) <= 5 THEN list_concat([CASE WHEN acc[1] = '' THEN x[1] ELSE acc[1] || ' ' || x[1] END], acc[2:]) ELSE list_concat([''], acc[2:], [CASE WHEN acc[1] = '' THEN x[1] ELSE acc[1] || ' ' || x[1] END]) END"
    state = f"list_reduce(list_transform({x}, lambda e: [e]), lambda acc, x: {step}, [''])"
    return f"list_transform([{state}], lambda z: CASE WHEN z[1] = '' THEN z[2:] WHEN len(z) > 1 THEN list_concat(z[2:-2], [z[-1] || ' ' || z[1]]) ELSE [z[1]] END)[1]"


def sql_variations(source: str, whole: str) -> str:
    """The source's rows with ``variations``, from its column standard_script cleaned as ``whole`` says."""
    return (
        f"(SELECT * EXCLUDE (whole, merged, cut, found), CASE WHEN length(whole) = 0 THEN [] WHEN len(found) > 0 THEN found ELSE [whole] END AS variations FROM "
        f"(SELECT *, list_filter(cut, lambda v, i: list_position(cut, v) = i) AS found FROM (SELECT *, flatten(list_transform(merged, lambda m: CASE WHEN length(m) > 50 THEN {_merge(_pieces('m', ','))} ELSE [m] END)) AS cut "
        f"FROM (SELECT *, {_merge(_pieces('whole', s.SPLIT))} AS merged FROM (SELECT *, {whole} AS whole FROM {source})))))"
    )


SQL_VARIATIONS = sql_variations(SQL_SCRIPTS, sql_fold_en(sql_strip("standard_script")))


@query(f"SELECT script_row, variations FROM {SQL_VARIATIONS}")
def q_script_variations(spark, sf_dir):
    return scripts(spark, sf_dir).select("script_row", s.variations(F.col("standard_script"), "ENG").alias("variations"))


@query(f"SELECT script_row, {_merge(_pieces('standard_script', ' '))} AS merged FROM {SQL_SCRIPTS}")
def q_fragment_merge(spark, sf_dir):
    words = F.filter(F.transform(F.split("standard_script", " "), s.t.strip), lambda w: F.length(w) > 0)
    return scripts(spark, sf_dir).select("script_row", s.merge_fragments(words).alias("merged"))


@query(f"SELECT point, string_agg(standard_script, ' ' ORDER BY script_row) AS holistic, min(script_row) AS point_order, sum(len(variations))::BIGINT AS n_variations FROM {SQL_VARIATIONS} GROUP BY point")
def q_holistic_text(spark, sf_dir):
    return s.points(scripts(spark, sf_dir), "ENG").select("point", "holistic", "point_order", F.size("variations").cast("long").alias("n_variations"))


@query(
    "SELECT text AS standard_script, string_agg(point, ' + ' ORDER BY point) AS point, min(doc_id) AS script_row, count(*) AS n_rows "
    "FROM (SELECT doc_id, text, 'D' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS point FROM documents) GROUP BY text"
)
def q_dedup_scripts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("script_row"), F.col("text").alias("standard_script"), F.concat(F.lit("D"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("point"))
    return s.deduplicate(docs)


_OFFLINE = sql_strip("standard_script")


def _sql_offline() -> str:
    out = f"[{_OFFLINE}]"
    for mark in ("|", "\n", "；", "。"):
        cut = f"list_filter(list_transform(regexp_split_to_array(standard_script, {quote(f'[{mark}]')}), lambda s: {sql_strip('s')}), lambda s: length(s) > 3)"
        out = f"CASE WHEN contains(standard_script, {quote(mark)}) THEN CASE WHEN len({cut}) > 0 THEN {cut} ELSE [{_OFFLINE}] END ELSE {out} END"
    return out


@query(f"SELECT script_row, {_sql_offline()} AS variations FROM {SQL_SCRIPTS}")
def q_offline_variations(spark, sf_dir):
    return scripts(spark, sf_dir).select("script_row", s.offline_variations(F.col("standard_script")).alias("variations"))


@query(
    "SELECT s_suppkey, sheet, CASE WHEN sheet = 'NewProduct_CAN' THEN CASE WHEN note = '' THEN s_name WHEN s_name = '' THEN note ELSE s_name || ' | ' || note END ELSE s_name END AS point FROM "
    "(SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'NewProduct_CAN' ELSE 'Old_CAN' END AS sheet, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE n_name END AS note FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
)
def q_composite_key(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    rows = rows.select(
        "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "NewProduct_CAN").otherwise("Old_CAN").alias("sheet"), F.col("s_name").alias("point"), F.when(F.col("s_suppkey") % 3 != 0, F.col("n_name")).alias("note")
    )
    return s.composite_points(rows, {"NewProduct_CAN"}).select("s_suppkey", "sheet", "point")


# -- term importance ---------------------------------------------------------------------------

_LANGS = "(SELECT 'ENG' AS language, 'Demo' || (item_id % 2) AS product, 'P' || (item_id % 8) AS point, text FROM benchmark)"
_TOKENS = f"(SELECT DISTINCT language, product, point, unnest(list_filter({sql_tokens('text')}, lambda w: length(w) > 1 AND NOT list_contains({sql_list(lexicon.STOPWORDS_EN)}, w))) AS token FROM {_LANGS})"
SQL_TERMS = (
    f"(WITH tokens AS {_TOKENS}, dfs AS (SELECT language, product, token, count(DISTINCT point) AS df FROM tokens GROUP BY ALL), "
    "totals AS (SELECT language, product, count(DISTINCT point) AS n_points FROM tokens GROUP BY ALL), "
    f"scored AS (SELECT language, product, point, token, ln(n_points / df) * CASE WHEN list_contains({sql_list(lexicon.KEYWORDS_EN)}, token) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight "
    "FROM tokens JOIN dfs USING (language, product, token) JOIN totals USING (language, product)), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY language, product, point ORDER BY weight DESC, token) AS place, "
    "greatest(2, least(16, ceil(count(*) OVER (PARTITION BY language, product, point) * 0.15))) AS n FROM scored) "
    "SELECT language, product, point, token AS term, weight FROM ranked WHERE place <= n)"
)


def _terms(spark, sf_dir):
    item = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select(
        F.lit("ENG").alias("language"), F.concat(F.lit("Demo"), (item % 2).cast("string")).alias("product"), F.concat(F.lit("P"), (item % 8).cast("string")).alias("point"),
        F.explode(k.business_tokens(k.english_tokens(F.col("text")), "ENG")).alias("token"),
    )
    return tm.term_importance(rows, lexicon.KEYWORDS_EN, lexicon.STOPWORDS_EN)


@query(f"SELECT language, product, point, term, weight FROM {SQL_TERMS}")
def q_term_importance(spark, sf_dir):
    return _terms(spark, sf_dir)


@query(f"SELECT language, product, term, max(weight) AS weight FROM {SQL_TERMS} GROUP BY ALL")
def q_product_weights(spark, sf_dir):
    return tm.product_weights(_terms(spark, sf_dir))


_WANTED = [("ENG", "Demo0", "P0"), ("ENG", "Demo0", "new"), ("ENG", "Other", "P1")]
_MANUAL = ", ".join(f"({quote(term)}, {weight}::DOUBLE)" for term, weight in sorted(lexicon.TERM_WEIGHTS.items()))


@query(
    f"WITH terms AS {SQL_TERMS}, wanted(language, product, point) AS (VALUES {', '.join('(' + ', '.join(map(quote, row)) + ')' for row in _WANTED)}), manual(term, weight) AS (VALUES {_MANUAL}), "
    "own AS (SELECT language, product, point, term, weight, 'point' AS level FROM wanted JOIN terms USING (language, product, point)), "
    "rest AS (SELECT * FROM wanted WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.language = wanted.language AND t.product = wanted.product AND t.point = wanted.point)), "
    "product AS (SELECT rest.language, rest.product, rest.point, term, max(weight) AS weight, 'product' AS level FROM rest JOIN terms t ON t.language = rest.language AND t.product = rest.product GROUP BY ALL), "
    "fallback AS (SELECT rest.language, rest.product, rest.point, term, weight, 'manual' AS level FROM rest, manual WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.language = rest.language AND t.product = rest.product)) "
    "SELECT * FROM own UNION ALL SELECT * FROM product UNION ALL SELECT * FROM fallback"
)
def q_weight_fallback(spark, sf_dir):
    return tm.resolve_weights(spark.createDataFrame(_WANTED, "language string, product string, point string"), _terms(spark, sf_dir))


# -- routing -----------------------------------------------------------------------------------

_SQL_FILES = (
    "(SELECT conv_id || CASE conv_id % 6 WHEN 0 THEN '_x_C.csv' WHEN 1 THEN '_x_m.wav.csv' WHEN 2 THEN '_SQCCB_E.csv' WHEN 3 THEN '_Sales Leader_E.xlsx' WHEN 4 THEN '_C.csv' ELSE '_x_Z.csv' END AS filename FROM (SELECT DISTINCT conv_id FROM conversations))"
)
_SQL_MAPPING = (
    "(SELECT CAST(conv_id AS VARCHAR) AS sample_no, CASE (conv_id + k) % 4 WHEN 0 THEN 'Bond' WHEN 1 THEN ' SQCCB2 ' WHEN 2 THEN 'SalesLeader Plus' ELSE NULL END AS product_name, "
    "CASE k WHEN 0 THEN NULL WHEN 1 THEN 'sqc cb' ELSE 'Sales' END AS call_type, conv_id * 3 + k AS map_row FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 <> 0), (SELECT unnest([0, 1, 2]) AS k))"
)


def _files(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    kinds = ["_x_C.csv", "_x_m.wav.csv", "_SQCCB_E.csv", "_Sales Leader_E.xlsx", "_C.csv", "_x_Z.csv"]
    return ids.select(F.concat(F.col("conv_id").cast("string"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("conv_id") % 6 + 1).cast("int"))).alias("filename"))


def _mapping(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct().filter("conv_id % 5 <> 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    product = F.element_at(F.array(F.lit("Bond"), F.lit(" SQCCB2 "), F.lit("SalesLeader Plus"), F.lit(None)), ((F.col("conv_id") + F.col("k")) % 4 + 1).cast("int"))
    kind = F.when(F.col("k") == 1, "sqc cb").when(F.col("k") == 2, "Sales")
    return ids.select(F.col("conv_id").cast("string").alias("sample_no"), product.alias("product_name"), kind.alias("call_type"), (F.col("conv_id") * 3 + F.col("k")).alias("map_row"))


_SQL_TASKS = (
    f"(SELECT filename, p[1] AS sample_no, CASE upper(p[-1]) WHEN 'C' THEN 'CAN' WHEN 'M' THEN 'MAN' WHEN 'E' THEN 'ENG' END AS language, CASE WHEN contains(lower(filename), 'sqccb') THEN 'SQCCB' "
    f"WHEN regexp_matches(lower(filename), 'salesleader|sales leader|saleleader') THEN 'Sales Leader Confirmation' ELSE 'Sales Call' END AS call_type FROM "
    f"(SELECT filename, string_split(replace(replace(replace(filename, '.xlsx', '.csv'), '.csv', ''), '.wav', ''), '_') AS p FROM {_SQL_FILES}) WHERE len(p) >= 3 AND upper(p[-1]) IN ('C', 'M', 'E'))"
)
_SQL_PICKED = (
    "(SELECT t.*, m.product_name FROM " + _SQL_TASKS + " t JOIN " + _SQL_MAPPING + " m USING (sample_no) QUALIFY row_number() OVER (PARTITION BY filename ORDER BY "
    "CASE WHEN (CASE m.call_type WHEN 'sqc cb' THEN 'sqccb' WHEN 'Sales' THEN 'sales call' ELSE '' END) = lower(t.call_type) THEN 1 ELSE 0 END DESC, map_row) = 1)"
)


@query(f"SELECT filename, sample_no, language, call_type, product_name FROM {_SQL_PICKED}")
def q_mapping_pick(spark, sf_dir):
    return r.pick_mapping(r.parse_names(_files(spark, sf_dir)), _mapping(spark, sf_dir)).select("filename", "sample_no", "language", "call_type", "product_name")


@query(
    "WITH named AS (SELECT filename, sample_no, language, call_type, CASE call_type WHEN 'SQCCB' THEN CASE WHEN starts_with(lower(trim(product_name)), 'sqccb') THEN trim(product_name) ELSE 'SQCCB' END "
    "WHEN 'Sales Leader Confirmation' THEN CASE WHEN regexp_matches(lower(trim(product_name)), '^(salesleader|saleleader|sales leader)') THEN trim(product_name) ELSE 'SalesLeader' END ELSE trim(product_name) END AS product_name "
    f"FROM {_SQL_PICKED}) SELECT filename, sample_no, language, product_name, call_type, product_name || '_' || language AS script_sheet FROM named WHERE product_name IS NOT NULL"
)
def q_route_files(spark, sf_dir):
    return r.route(_files(spark, sf_dir), _mapping(spark, sf_dir))


@query(
    f"SELECT filename, CASE upper(right(base, 2)) WHEN '_C' THEN 'CAN' WHEN '_M' THEN 'MAN' WHEN '_E' THEN 'ENG' ELSE 'MAN' END AS by_suffix_or_sheet, CASE upper(right(base, 2)) WHEN '_C' THEN 'CAN' WHEN '_M' THEN 'MAN' WHEN '_E' THEN 'ENG' END AS by_suffix "
    f"FROM (SELECT filename, regexp_replace(filename, '(\\.wav)?\\.(csv|xlsx?)$', '') AS base FROM {_SQL_FILES})"
)
def q_language_of_file(spark, sf_dir):
    return _files(spark, sf_dir).select("filename", r.language_of_file(F.col("filename"), F.lit("Bond_MAN")).alias("by_suffix_or_sheet"), r.language_of_file(F.col("filename")).alias("by_suffix"))


_SHEETS = ["Bond_CAN", "New_Product_MAN", "Plain", "_ENG", "Fund_ENG2", "Bond_can"]


@query(
    f"SELECT p_partkey, sheet, nullif(regexp_extract(sheet, '^(.*)_(CAN|MAN|ENG)$', 1), '') AS product, nullif(regexp_extract(sheet, '^(.*)_(CAN|MAN|ENG)$', 2), '') AS language FROM "
    f"(SELECT p_partkey, [{', '.join(map(quote, _SHEETS))}][CAST(p_partkey % {len(_SHEETS)} + 1 AS INTEGER)] AS sheet FROM part)"
)
def q_sheet_parts(spark, sf_dir):
    """Product and language of sheets by their names."""
    sheet = F.element_at(F.array(*map(F.lit, _SHEETS)), (F.col("p_partkey") % len(_SHEETS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", sheet.alias("sheet"), s.sheet_product(sheet).alias("product"), s.sheet_language(sheet).alias("language"))


@query(
    f"SELECT filename, CASE WHEN ends_with(filename, '.wav.csv') THEN left(filename, length(filename) - 8) || '.xlsx' WHEN ends_with(filename, '.csv') THEN left(filename, length(filename) - 4) || '.xlsx' ELSE left(filename, length(filename) - 5) || '_result.xlsx' END AS report FROM {_SQL_FILES}"
)
def q_report_names(spark, sf_dir):
    return files.report_names(_files(spark, sf_dir)).select("filename", "report")
