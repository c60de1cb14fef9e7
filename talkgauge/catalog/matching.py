"""Queries of similarity metrics, pairwise scores, coverage and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge import lexicon
from talkgauge.catalog.grouping import SQL_GROUPS, groups
from talkgauge.catalog.registry import SQL_CALLS, calls, query, quote, scripts, sql_list, table
from talkgauge.catalog.scripting import SQL_TERMS, SQL_VARIATIONS, _terms
from talkgauge.catalog.texts import sql_expand, sql_fold_en, sql_tokens
from talkgauge.config import Settings
from talkgauge.functions import similarity as sim
from talkgauge.functions import text as t
from talkgauge.functions import tokens as k
from talkgauge.operators import matching as m
from talkgauge.operators import reports, rollup
from talkgauge.operators import scripts as scripting
from talkgauge.operators import tfidf as tf
from talkgauge.operators.embedding import HashingEmbedder

#: Metrics of tokens only; random prose shares few words with the scripts, so the threshold is low.
SETTINGS = Settings("ENG", threshold=0.04, use_rouge=False)
SHEETS = 4

_WORDS = "list_filter({}, lambda w: length(w) > 1 AND NOT list_contains(" + sql_list(lexicon.STOPWORDS_EN) + ", w))"
SQL_SHEET_GROUPS = (
    f"(SELECT call_id, group_id, speaker, text, 'S' || (CAST(call_id AS BIGINT) % {SHEETS}) AS sheet, {sql_expand('raw')} AS g_tokens, {_WORDS.format('raw')} AS g_words FROM (SELECT *, {sql_tokens(sql_fold_en('text'))} AS raw FROM {SQL_GROUPS}))"
)
_SHEET_VARIATIONS = f"(SELECT *, 'S' || (script_row // 8 % {SHEETS}) AS sheet FROM {SQL_VARIATIONS})"
SQL_TEXTS = (
    "(SELECT sheet, point, point_order, n, pos, script, " + sql_expand("raw") + " AS s_tokens, " + _WORDS.format("raw") + " AS s_words FROM (SELECT *, " + sql_tokens(sql_fold_en("script")) + " AS raw FROM "
    "(SELECT sheet, point, point_order, len(variations) AS n, generate_subscripts(list_concat([holistic], variations), 1) - 2 AS pos, unnest(list_concat([holistic], variations)) AS script FROM "
    f"(SELECT sheet, point, min(script_row) AS point_order, string_agg(standard_script, ' ' ORDER BY script_row) AS holistic, flatten(list(variations ORDER BY script_row)) AS variations FROM {_SHEET_VARIATIONS} GROUP BY sheet, point))))"
)
_OVERLAP = "coalesce(len(list_intersect(s_tokens, g_tokens)) / nullif(len(list_distinct(list_concat(s_tokens, g_tokens))), 0), 0.0::DOUBLE)"
_K = f"list_intersect(s_words, {sql_list(lexicon.KEYWORDS_EN)})"
_COVER = f"coalesce(len(list_intersect({_K}, g_words)) / nullif(len({_K}), 0), 0.0::DOUBLE)"
SQL_SCORED = f"(SELECT *, overlap * 0.13::DOUBLE + kw * 0.10::DOUBLE AS score FROM (SELECT call_id, group_id, g.sheet, speaker, text, g_words, point, point_order, n, pos, script, s_words, {_OVERLAP} AS overlap, {_COVER} AS kw FROM {SQL_SHEET_GROUPS} g JOIN {SQL_TEXTS} s USING (sheet)))"
SQL_PAIRS = (
    f"(WITH scored AS MATERIALIZED (SELECT * FROM {SQL_SCORED}), best AS (SELECT call_id, group_id, point, first(sheet) AS sheet, first(speaker) AS speaker, first(text) AS text, first(point_order) AS point_order, CAST(first(n) AS BIGINT) AS n, "
    "max(CASE WHEN pos < 0 THEN score END) AS h, coalesce(max(CASE WHEN pos >= 0 THEN score END), 0.0::DOUBLE) AS g, first({'s': script, 'o': overlap, 'k': kw} ORDER BY pos) AS hs, "
    "first({'s': script, 'o': overlap, 'k': kw} ORDER BY CASE WHEN pos < 0 THEN 1 ELSE 0 END, score DESC, pos) AS gs FROM scored GROUP BY call_id, group_id, point) "
    f"SELECT *, h >= {SETTINGS.cut} OR h > g AS wins FROM best)"
)
SQL_PAIRWISE = (
    "(SELECT call_id, group_id, sheet, speaker, text, point, point_order, n AS all_variations_count, CASE WHEN wins THEN h ELSE g END AS weighted_score, CASE WHEN wins THEN 'Holistic' ELSE 'Granular' END AS match_type, "
    f"CASE WHEN wins THEN hs.s WHEN g > 0 THEN gs.s ELSE '' END AS best_variation, h AS holistic_score, CASE WHEN h >= {SETTINGS.cut} THEN 0.0::DOUBLE ELSE g END AS granular_score, "
    f"CASE WHEN wins THEN hs.o WHEN g > 0 THEN gs.o ELSE 0.0::DOUBLE END AS expanded_overlap, CASE WHEN wins THEN hs.k WHEN g > 0 THEN gs.k ELSE 0.0::DOUBLE END AS keyword_coverage FROM {SQL_PAIRS})"
)
_PAIR_COLUMNS = ["call_id", "group_id", "sheet", "speaker", "point", "point_order", "all_variations_count", "weighted_score", "match_type", "best_variation", "holistic_score", "granular_score", "expanded_overlap", "keyword_coverage"]


def _sheet_groups(spark, sf_dir):
    return groups(spark, sf_dir).withColumn("sheet", F.concat(F.lit("S"), (F.col("call_id").cast("long") % SHEETS).cast("string")))


def _points(spark, sf_dir):
    sheet = F.concat(F.lit("S"), (F.floor(F.col("script_row") / 8) % SHEETS).cast("string"))
    return scripting.points(scripts(spark, sf_dir).withColumn("sheet", sheet), "ENG")


def _pairs(spark, sf_dir, settings=SETTINGS, embedder=None):
    return m.pairwise(_sheet_groups(spark, sf_dir), _points(spark, sf_dir), settings, embedder)


# -- metrics -----------------------------------------------------------------------------------


@query()
def q_rouge_l(spark, sf_dir):
    """Each group with every script text of its sheet, by the production form: of each point the holistic text (pos -1) and all variations."""
    return m.rouge_l_pairs(_sheet_groups(spark, sf_dir), _points(spark, sf_dir), "ENG")


_LCS_CTE = (
    "WITH RECURSIVE pairs AS (SELECT p_partkey, p_name AS a, p_type AS b FROM part), "
    "dp(p_partkey, i, prev) AS (SELECT p_partkey, 0, list_transform(range(0, length(b) + 1), lambda j: 0) FROM pairs UNION ALL "
    "SELECT d.p_partkey, d.i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda acc, j: list_concat(acc, [CASE WHEN substr(a, d.i + 1, 1) = substr(b, j[1], 1) THEN d.prev[j[1]] + 1 ELSE greatest(d.prev[j[1] + 1], acc[-1]) END]), [0]) "
    "FROM dp d JOIN pairs USING (p_partkey) WHERE d.i < length(a)) "
    "SELECT p_partkey, CASE WHEN length(a) = 0 OR length(b) = 0 OR prev[-1] = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * prev[-1] / (length(a) + length(b)) END AS rouge_l FROM dp JOIN pairs USING (p_partkey) WHERE i = length(a)"
)


@query(_LCS_CTE)
def q_rouge_l_short(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return part.select("p_partkey", sim.rouge_l_short(F.col("a"), F.col("b")).alias("rouge_l"))


@query(_LCS_CTE)
def q_rouge_l_bits(spark, sf_dir):
    """The same rows by the bit-parallel form."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return part.select("p_partkey", sim.rouge_l(F.col("a"), F.col("b")).alias("rouge_l"))


#: Vectors whose nearest is sought have ids divisible by this; so many of them go out with one pass over the table.
_EVERY, _BLOCK = 50, 2_000


@query(
    f"WITH scored AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS c FROM embeddings q JOIN embeddings v ON q.vec_id % {_EVERY} = 0 AND v.vec_id <> q.vec_id) "
    "SELECT query_id, vec_id AS nearest, c AS cosine FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) = 1"
)
def q_embedding_cosine(spark, sf_dir):
    """For each vector of the query set (ids divisible by 50) the most similar of all other vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", sim.unit(F.col("embedding")).alias("v"))
    asked = rows.filter(F.col("vec_id") % _EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    low, high = asked.agg(F.min("query_id"), F.max("query_id")).first()
    step, found = _EVERY * _BLOCK, []
    for start in range(low or 0, (high or 0) + 1, step):
        block = asked.filter(F.col("query_id").between(start, start + step - 1))
        scored = rows.crossJoin(F.broadcast(block)).filter("vec_id <> query_id").select("query_id", "vec_id", F.round(sim.cosine_of_units(F.col("v"), F.col("q")), 9).alias("c"))  # a block of fixed size
        found.append(scored.groupBy("query_id").agg(F.max_by("vec_id", F.struct("c", -F.col("vec_id"))).alias("nearest"), F.max("c").alias("cosine")))
    return reduce(DataFrame.unionAll, found)


def _sql_pairs(metric: str) -> str:
    return f"SELECT call_id, group_id, point, CAST(pos AS INTEGER) AS pos, {metric} FROM {SQL_SHEET_GROUPS} g JOIN {SQL_TEXTS} s USING (sheet) WHERE pos >= 0"


def _metric(spark, sf_dir, name, column):
    rows = m.features(_sheet_groups(spark, sf_dir), "text", "g", SETTINGS)
    texts = m.features(_points(spark, sf_dir).select("sheet", "point", F.posexplode("variations").alias("pos", "script")), "script", "s", SETTINGS)
    return m.join_sheet(rows, texts).select("call_id", "group_id", "point", "pos", column.alias(name))


@query(_sql_pairs(f"round({_OVERLAP}, 9) AS jaccard"))
def q_jaccard(spark, sf_dir):
    return _metric(spark, sf_dir, "jaccard", F.round(sim.jaccard(F.col("s_tokens"), F.col("g_tokens")), 9))


@query(_sql_pairs("round(coalesce(len(list_intersect(s_tokens, g_tokens)) / nullif(greatest(len(s_tokens), len(g_tokens)), 0), 0.0::DOUBLE), 9) AS overlap"))
def q_overlap_max(spark, sf_dir):
    return _metric(spark, sf_dir, "overlap", F.round(sim.overlap_max(F.col("s_tokens"), F.col("g_tokens")), 9))


@query(
    "WITH said AS (SELECT call_id, row_idx, " + sql_list(sorted(lexicon.KEYWORDS_EN)) + "[CAST(row_idx % 8 + 1 AS INTEGER)] AS one, " + sql_list(sorted(lexicon.KEYWORDS_EN)) + "[CAST(CAST(call_id AS BIGINT) % 8 + 1 AS INTEGER)] AS two, text FROM " + SQL_CALLS + "), "
    f"split AS (SELECT call_id, row_idx, {_WORDS.format(sql_tokens(chr(39) + chr(39) + ' || one || ' + chr(39) + ' ' + chr(39) + ' || two || ' + chr(39) + ' refund' + chr(39)))} AS s_words, {_WORDS.format(sql_tokens('one || ' + chr(39) + ' ' + chr(39) + ' || text'))} AS g_words FROM said) "
    f"SELECT call_id, row_idx, {_COVER} AS keyword_coverage FROM split"
)
def q_keyword_coverage(spark, sf_dir):
    keys = F.array(*map(F.lit, sorted(lexicon.KEYWORDS_EN)))
    one, two = F.element_at(keys, (F.col("row_idx") % 8 + 1).cast("int")), F.element_at(keys, (F.col("call_id").cast("long") % 8 + 1).cast("int"))
    words = lambda x: k.business_tokens(k.english_tokens(x), "ENG")
    script, call = words(F.concat(one, F.lit(" "), two, F.lit(" refund"))), words(F.concat(one, F.lit(" "), F.col("text")))
    return calls(spark, sf_dir).select("call_id", "row_idx", sim.keyword_coverage(script, call, lexicon.KEYWORDS_EN).alias("keyword_coverage"))


@query(_sql_pairs("array_to_string(list_sort(list_distinct(list_intersect(s_words, g_words))), ', ') AS shared"))
def q_overlap_keywords(spark, sf_dir):
    words = F.array_join(sim.overlap_keywords(F.col("s_words"), F.col("g_words"), lexicon.KEYWORDS_ZH), ", ")
    return _metric(spark, sf_dir, "shared", words)


# -- TF-IDF ------------------------------------------------------------------------------------

_GRAMS = "flatten([list_transform(range(1, length(x) - n + 2), lambda i: substr(x, i, n)) for n in [2, 3, 4]])"
_STOP = sorted(w for w in lexicon.STOPWORDS_EN if 2 <= len(w) <= 4)


@query(
    f"WITH terms AS {SQL_TERMS}, docs AS (SELECT item_id, 'P' || (item_id % 8) AS point, array_to_string({_WORDS.format(sql_tokens('text'))}, ' ') AS x FROM benchmark), "
    f"grams AS (SELECT item_id, point, gram, count(*) AS tf FROM (SELECT item_id, point, unnest({_GRAMS}) AS gram FROM docs WHERE x <> '') GROUP BY ALL), "
    "idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM docs WHERE x <> '')) / (1 + count(*))) + 1 AS idf FROM grams GROUP BY gram), "
    "vec AS (SELECT item_id, point, gram, (1 + ln(tf)) * idf AS x FROM grams JOIN idf USING (gram)), "
    f"core AS (SELECT point, term AS gram, max(weight) AS w FROM terms WHERE length(term) BETWEEN 2 AND 4 AND NOT list_contains({sql_list(_STOP)}, term) GROUP BY ALL), "
    f"w AS (SELECT * FROM core UNION ALL SELECT point, unnest({sql_list(_STOP)}) AS gram, 0.0::DOUBLE FROM (SELECT DISTINCT point FROM terms)), "
    "pairs AS (SELECT l.item_id AS left_id, r.item_id AS right_id, r.point, sum(l.x * r.x * coalesce(w.w, 1) * coalesce(w.w, 1)) AS dot FROM vec l JOIN vec r USING (gram) "
    "LEFT JOIN w ON w.point = r.point AND w.gram = l.gram GROUP BY ALL), "
    "norms AS (SELECT v.item_id, p.point, sum(v.x * v.x * coalesce(w.w, 1) * coalesce(w.w, 1)) AS n2 FROM vec v CROSS JOIN (SELECT DISTINCT point FROM vec) p LEFT JOIN w ON w.point = p.point AND w.gram = v.gram GROUP BY ALL) "
    "SELECT left_id, right_id, pairs.point, round(dot / sqrt(a.n2 * b.n2), 9) AS cosine FROM pairs JOIN norms a ON a.item_id = left_id AND a.point = pairs.point JOIN norms b ON b.item_id = right_id AND b.point = pairs.point WHERE dot <> 0"
)
def q_tfidf_cosine(spark, sf_dir):
    """All items against all, fitted on all items, with each right item's point's weights."""
    tokens = k.business_tokens(k.english_tokens(F.col("text")), "ENG")
    docs = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("call_id"), F.col("item_id"), F.concat(F.lit("P"), (F.col("item_id") % 8).cast("string")).alias("point"), tokens.alias("tokens"))
    idf = tf.inverse_frequencies(docs.select("call_id", F.col("item_id").alias("doc"), "tokens"))
    left = tf.vectors(docs.select("call_id", F.col("item_id").alias("left_id"), "tokens"), ["call_id", "left_id"], idf)
    right = tf.vectors(docs.select("call_id", F.col("item_id").alias("right_id"), "point", "tokens"), ["call_id", "right_id", "point"], idf)
    terms = _terms(spark, sf_dir).groupBy("point", "term").agg(F.max("weight").alias("weight"))
    return tf.weighted_cosine(left, right, tf.gram_weights(terms, lexicon.STOPWORDS_EN)).select("left_id", "right_id", "point", F.round("cosine", 9).alias("cosine"))


# -- pairs, coverage, reports ------------------------------------------------------------------


@query(f"SELECT {', '.join(_PAIR_COLUMNS)} FROM {SQL_PAIRWISE}")
def q_pairwise(spark, sf_dir):
    return _pairs(spark, sf_dir).select(*_PAIR_COLUMNS)


@query(f"SELECT call_id, group_id, point, arg_max(script, {{'s': score, 'p': -pos}}) AS variation, max(score) AS score FROM {SQL_SCORED} WHERE pos >= 0 AND score > 0 GROUP BY ALL")
def q_best_variation(spark, sf_dir):
    never = Settings("ENG", threshold=9.0, use_rouge=False)  # no holistic match stops early, so the variation is looked for everywhere
    pairs = _pairs(spark, sf_dir, never)
    rows = m.features(_sheet_groups(spark, sf_dir), "text", "g", never)
    texts = m.features(_points(spark, sf_dir).select("sheet", "point", F.posexplode("variations").alias("pos", "script")), "script", "s", never)
    side = lambda x: F.struct(*(F.col(f"{x}_{name}").alias(name) for name in ("tokens", "words", "keys")))
    scored = m.join_sheet(rows, texts).select("call_id", "group_id", "point", "pos", "script", m.metrics(never, side("s"), side("g"))["score"].alias("score")).filter("score > 0")
    best = scored.groupBy("call_id", "group_id", "point").agg(F.max_by("script", F.struct("score", -F.col("pos"))).alias("variation"), F.max("score").alias("score"))
    return best.join(pairs.select("call_id", "group_id", "point"), ["call_id", "group_id", "point"], "left_semi")


_COVERAGE = f"(SELECT *, CASE WHEN weighted_score >= {SETTINGS.cut} THEN 'Covered' ELSE 'Not Covered' END AS covered FROM {SQL_PAIRWISE} QUALIFY row_number() OVER (PARTITION BY call_id, point ORDER BY weighted_score DESC, group_id) = 1)"


@query(f"SELECT call_id, point, covered, group_id, speaker, match_type, round(weighted_score, 6) AS weighted_score, all_variations_count FROM {_COVERAGE}")
def q_coverage_first_max(spark, sf_dir):
    return m.coverage(_pairs(spark, sf_dir), SETTINGS).select("call_id", "point", "covered", "group_id", "speaker", "match_type", F.round("weighted_score", 6).alias("weighted_score"), "all_variations_count")


_EARLY = 0.03


@query(
    f"SELECT call_id, point, CASE WHEN weighted_score <= 0 THEN -1 ELSE group_id END AS group_id, round(weighted_score, 6) AS weighted_score FROM {SQL_PAIRWISE} "
    f"QUALIFY row_number() OVER (PARTITION BY call_id, point ORDER BY CASE WHEN weighted_score >= {_EARLY} THEN 0 ELSE 1 END, CASE WHEN weighted_score >= {_EARLY} THEN group_id END, weighted_score DESC, group_id) = 1"
)
def q_coverage_first_over(spark, sf_dir):
    best = m.best_groups(_pairs(spark, sf_dir), Settings("CAN", early_exit=_EARLY))
    return best.select("call_id", "point", "group_id", F.round("weighted_score", 6).alias("weighted_score"))


@query(
    f"SELECT call_id, count(*) AS total_points, count(*) FILTER (covered = 'Covered') AS covered_points, count(*) FILTER (covered <> 'Covered') AS uncovered_points, "
    f"round(100.0::DOUBLE * count(*) FILTER (covered = 'Covered') / count(*), 6) AS coverage_rate FROM {_COVERAGE} GROUP BY call_id"
)
def q_coverage_kpis(spark, sf_dir):
    kpis = reports.coverage_kpis(m.coverage(_pairs(spark, sf_dir), SETTINGS))
    return kpis.withColumn("coverage_rate", F.round("coverage_rate", 6))


@query()
def q_coverage_full(spark, sf_dir):
    """All points by all metrics, the default embedder included; SQL has neither the vectors nor the sequence metric."""
    settings = Settings("ENG")
    return m.coverage(_pairs(spark, sf_dir, settings, HashingEmbedder()), settings)


@query(
    f"SELECT call_id, point AS Required_Discussion_Point, CASE WHEN covered = 'Covered' THEN '✅ Covered' ELSE '❌ Not Covered' END AS Covered, group_id AS Group_ID, speaker AS Speaker, all_variations_count AS All_Variations_Count, match_type FROM {_COVERAGE}"
)
def q_detailed_coverage(spark, sf_dir):
    rows = reports.detailed_coverage(m.coverage(_pairs(spark, sf_dir), SETTINGS))
    return rows.select("call_id", "Required_Discussion_Point", "Covered", "Group_ID", "Speaker", "All_Variations_Count", "match_type")


# -- speakers and views ------------------------------------------------------------------------



def _timed(spark, sf_dir):
    clock = lambda s: F.concat_ws(":", F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lpad((F.floor(s / 60) % 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))
    start = F.col("row_idx") * 40 + 60
    rows = calls(spark, sf_dir).withColumn("start_time", clock(start)).withColumn("end_time", clock(start + F.length("text") % 60 - 5))
    return rows.withColumn("is_system", F.col("speaker") == "system")


_STATS = (
    f"(SELECT call_id, speaker, CAST(sum(greatest(0, length(text) % 60 - 5)) AS DOUBLE) AS speaking_seconds, CAST(sum(length(replace(text, ' ', ''))) AS BIGINT) AS word_count, min(row_idx) AS first_row FROM {SQL_CALLS} WHERE speaker <> 'system' GROUP BY call_id, speaker)"
)
_ROLES = f"(SELECT *, CASE row_number() OVER (PARTITION BY call_id ORDER BY word_count DESC, first_row) WHEN 1 THEN 'Sales' WHEN 2 THEN 'Customer' ELSE 'Other' END AS role FROM {_STATS})"


@query(
    f"SELECT call_id, speaker, role, speaking_seconds, word_count, round(CASE WHEN speaking_seconds > 0 THEN word_count / speaking_seconds ELSE 0.0::DOUBLE END, 6) AS words_per_second FROM {_ROLES} "
    f"UNION ALL SELECT DISTINCT call_id, speaker, 'System', NULL, NULL, NULL FROM {SQL_CALLS} WHERE speaker = 'system'"
)
def q_speaker_stats(spark, sf_dir):
    stats = reports.speaker_stats(_timed(spark, sf_dir))
    return stats.select("call_id", "speaker", "role", "speaking_seconds", "word_count", F.round("words_per_second", 6).alias("words_per_second"))


@query(f"SELECT call_id, coalesce(max(word_count) FILTER (role = 'Sales'), 0) AS sales_word_count, coalesce(max(word_count) FILTER (role = 'Customer'), 0) AS customer_word_count FROM {_ROLES} GROUP BY call_id")
def q_speaker_roles(spark, sf_dir):
    return reports.role_counts(reports.speaker_stats(_timed(spark, sf_dir).filter("not is_system")))


_TOP = (
    f"(SELECT call_id, speaker, word, count(*) AS n_words, min({{'r': row_idx, 'p': pos}}) AS first FROM (SELECT call_id, speaker, row_idx, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM "
    f"(SELECT call_id, speaker, row_idx, {_WORDS.format(sql_tokens('text'))} AS w FROM {SQL_CALLS})) GROUP BY ALL)"
)


@query(f"SELECT call_id, speaker, word, n_words, CAST(row_number() OVER (PARTITION BY call_id, speaker ORDER BY n_words DESC, first) AS INTEGER) AS place FROM {_TOP} QUALIFY place <= 10")
def q_top_words(spark, sf_dir):
    rows = calls(spark, sf_dir).select("call_id", "speaker", "row_idx", k.business_tokens(k.english_tokens(F.col("text")), "ENG").alias("tokens"))
    return reports.top_words(rows, ["call_id", "speaker"])


_VIEW_POINTS = [f"P{i}" for i in range(8)]
_VIEW = ", ".join(
    f"coalesce(max(CASE WHEN point = '{p}' THEN CASE WHEN weighted_score >= {SETTINGS.cut} THEN 'YES' ELSE 'NO' END END), 'NO') AS \"{p}_Hit\", round(coalesce(max(CASE WHEN point = '{p}' THEN weighted_score END), 0.0::DOUBLE), 6) AS \"{p}_Score\"" for p in _VIEW_POINTS
)


def _view(spark, sf_dir):
    view = reports.call_view(_pairs(spark, sf_dir), _VIEW_POINTS, SETTINGS.cut)
    for p in _VIEW_POINTS:
        view = view.withColumn(f"{p}_Score", F.round(f"{p}_Score", 6)).drop(f"{p}_Keywords")
    return view


_VIEW_SQL = f"SELECT call_id, CAST(group_id AS VARCHAR) AS group_id, speaker, text AS call_text, 'NO' AS system_audio_recording, {_VIEW} FROM {SQL_PAIRWISE} GROUP BY call_id, group_id, speaker, text"


@query(_VIEW_SQL)
def q_call_view_pivot(spark, sf_dir):
    return _view(spark, sf_dir)


@query(
    f"SELECT * FROM ({_VIEW_SQL}) UNION ALL BY NAME SELECT call_id, 'SYS_' || row_idx AS group_id, speaker, text AS call_text, 'YES' AS system_audio_recording, {', '.join(f"'NO' AS \"{p}_Hit\"" for p in _VIEW_POINTS)} FROM {SQL_CALLS} WHERE speaker = 'system'"
)
def q_view_with_system(spark, sf_dir):
    return reports.view_with_system(_view(spark, sf_dir), _timed(spark, sf_dir))


# -- roll-up -----------------------------------------------------------------------------------

_BOUNDS = "(SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)"


@query(
    f"SELECT o_orderkey, CASE WHEN o_totalprice < q1 - 1.5::DOUBLE * (q3 - q1) THEN 'Unusually Short' WHEN o_totalprice > q3 + 1.5::DOUBLE * (q3 - q1) THEN 'Unusually Long' ELSE '' END AS flag FROM orders, {_BOUNDS}"
)
def q_iqr_outliers(spark, sf_dir):
    return rollup.flag_outliers(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), {"o_totalprice": "flag"}).select("o_orderkey", "flag")


_SECONDS = f"(SELECT call_id, arg_max(row_idx * 40 + 60 + length(text) % 60 - 5, row_idx) AS total_seconds FROM {SQL_CALLS} GROUP BY call_id)"


def _sql_flag(c: str, flag: str) -> str:
    q = lambda x: f"quantile_cont({c}, {x}) OVER ()"
    iqr = f"1.5::DOUBLE * ({q(0.75)} - {q(0.25)})"
    return f"CASE WHEN {c} < {q(0.25)} - {iqr} THEN 'Unusually Short' WHEN {c} > {q(0.75)} + {iqr} THEN 'Unusually Long' ELSE '' END AS {flag}"


@query(
    f"WITH kpis AS (SELECT call_id, count(*) AS total_points, count(*) FILTER (covered = 'Covered') AS covered_points FROM {_COVERAGE} GROUP BY call_id), "
    f"roles AS (SELECT call_id, coalesce(max(word_count) FILTER (role = 'Sales'), 0) AS sales_word_count, coalesce(max(word_count) FILTER (role = 'Customer'), 0) AS customer_word_count FROM {_ROLES} GROUP BY call_id), "
    f"joined AS (SELECT kpis.call_id, total_points, covered_points, CAST(total_seconds AS DOUBLE) AS total_seconds, coalesce(sales_word_count, 0) AS sales_word_count, coalesce(customer_word_count, 0) AS customer_word_count FROM kpis JOIN {_SECONDS} USING (call_id) LEFT JOIN roles USING (call_id)) "
    f"SELECT call_id, call_id AS sample_no, 'Demo' AS product_name, 'ENG' AS language, 'Sales Call' AS call_type, round(100.0::DOUBLE * covered_points / total_points, 6) AS coverage_rate, total_points, covered_points, total_seconds, "
    f"lpad(CAST(CAST(total_seconds AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(total_seconds AS BIGINT) % 60 AS VARCHAR), 2, '0') AS total_mmss, {_sql_flag('total_seconds', 'duration_outlier')}, sales_word_count, {_sql_flag('sales_word_count', 'sales_wc_outlier')}, "
    f"customer_word_count, {_sql_flag('customer_word_count', 'customer_wc_outlier')} FROM joined"
)
def q_call_summary(spark, sf_dir):
    rows = _timed(spark, sf_dir)
    kpis = reports.coverage_kpis(m.coverage(_pairs(spark, sf_dir), SETTINGS), rows)
    tasks = rows.select("call_id").distinct().select("call_id", F.col("call_id").alias("sample_no"), F.lit("Demo").alias("product_name"), F.lit("ENG").alias("language"), F.lit("Sales Call").alias("call_type"))
    return rollup.call_summary(tasks, kpis, reports.role_counts(reports.speaker_stats(rows))).withColumn("coverage_rate", F.round("coverage_rate", 6))


@query(
    f"WITH log AS (SELECT call_id, CASE WHEN count(*) FILTER (covered = 'Covered') > 0 THEN 'SUCCESS' ELSE 'ERROR' END AS status FROM {_COVERAGE} GROUP BY call_id) "
    "SELECT count(*) AS total_tasks, count(*) FILTER (status = 'SUCCESS') AS successful, count(*) FILTER (status <> 'SUCCESS') AS failed, round(count(*) FILTER (status = 'SUCCESS') * 100.0::DOUBLE / count(*), 6) AS success_rate FROM log"
)
def q_batch_statistics(spark, sf_dir):
    kpis = reports.coverage_kpis(m.coverage(_pairs(spark, sf_dir), SETTINGS))
    log = kpis.select("call_id", F.when(F.col("covered_points") > 0, "SUCCESS").otherwise("ERROR").alias("status"))
    return rollup.batch_statistics(log).withColumn("success_rate", F.round("success_rate", 6))


@query(
    f"WITH kpis AS (SELECT DISTINCT call_id FROM {_COVERAGE}), roles AS (SELECT call_id, coalesce(max(word_count) FILTER (role = 'Sales'), 0) AS s, coalesce(max(word_count) FILTER (role = 'Customer'), 0) AS c FROM {_ROLES} GROUP BY call_id), "
    f"joined AS (SELECT call_id, CAST(total_seconds AS DOUBLE) AS t, coalesce(s, 0) AS s, coalesce(c, 0) AS c FROM kpis JOIN {_SECONDS} USING (call_id) LEFT JOIN roles USING (call_id)), "
    f"flagged AS (SELECT {_sql_flag('t', 'ft')}, {_sql_flag('s', 'fs')}, {_sql_flag('c', 'fc')} FROM joined) "
    "SELECT count(*) FILTER (ft <> '') AS duration_outliers, count(*) FILTER (fs <> '') AS sales_wc_outliers, count(*) FILTER (fc <> '') AS customer_wc_outliers FROM flagged"
)
def q_outlier_counts(spark, sf_dir):
    return rollup.outlier_counts(q_call_summary(spark, sf_dir))
