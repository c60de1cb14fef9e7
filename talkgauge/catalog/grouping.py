"""Queries of runs, system recordings and dialogue groups over sentences of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkgauge.catalog.registry import calls, query
from talkgauge.catalog.texts import SQL_UTTERANCES
from talkgauge.operators import grouping as g

MAIN = ("user", "assistant")

_ISLANDS = f"(SELECT *, row_idx - row_number() OVER (PARTITION BY call_id, speaker ORDER BY row_idx) AS island, length(text) AS chars FROM {SQL_UTTERANCES} WHERE speaker IS NOT NULL)"


def _utterances(spark, sf_dir):
    return g.utterances(calls(spark, sf_dir))


@query(f"SELECT call_id, speaker, min(row_idx) AS run_start, max(row_idx) AS run_end, count(*) AS n_rows, avg(chars) AS mean_chars FROM {_ISLANDS} GROUP BY call_id, speaker, island")
def q_speaker_runs(spark, sf_dir):
    return g.speaker_runs(_utterances(spark, sf_dir))


@query(
    f"WITH runs AS (SELECT call_id, speaker, count(*) AS n, avg(chars) AS mean FROM {_ISLANDS} GROUP BY call_id, speaker, island), "
    "long AS (SELECT DISTINCT call_id, speaker FROM runs WHERE n >= 1 AND mean >= 20 AND lower(speaker) NOT IN ('user', 'assistant')) "
    f"SELECT u.call_id, u.row_idx, u.speaker, long.speaker IS NOT NULL AS is_system FROM {SQL_UTTERANCES} u LEFT JOIN long USING (call_id, speaker)"
)
def q_system_audio(spark, sf_dir):
    return g.flag_system_audio(_utterances(spark, sf_dir), MAIN, min_rows=1, min_run=1, min_mean_chars=20).select("call_id", "row_idx", "speaker", "is_system")


_FIT = "length({a}.text) + length({b}.text) + 1 <= 150"
_JOIN = "{{'text': {a}.text || ' ' || {b}.text, 'idx': list_concat({a}.idx, {b}.idx)}}"


def _forward(x: str, heed: bool) -> str:
    stop = " AND NOT list_contains(['。','！','？','；','，','.','!','?',';'], right(acc[-1].text, 1))" if heed else ""
    both = _JOIN.format(a="acc[-1]", b="x[1]")
    return f"list_reduce(list_transform({x}, lambda e: [e]), lambda acc, x: CASE WHEN {_FIT.format(a='acc[-1]', b='x[1]')}{stop} THEN list_concat(acc[:-2], [{both}]) ELSE list_concat(acc, x) END)"


def _backward(x: str) -> str:
    both = _JOIN.format(a="x[1]", b="acc[1]")
    return f"list_reduce(list_reverse(list_transform({x}, lambda e: [e])), lambda acc, x: CASE WHEN length(acc[1].text) < 20 AND {_FIT.format(a='x[1]', b='acc[1]')} THEN list_concat([{both}], acc[2:]) ELSE list_concat(x, acc) END)"


SQL_GROUPS = (
    "(WITH marked AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY call_id ORDER BY row_idx) THEN 0 ELSE 1 END AS new FROM " + SQL_UTTERANCES + "), "
    "numbered AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY row_idx) AS run FROM marked), "
    "runs AS (SELECT call_id, run, first(speaker) AS speaker, list({'text': text, 'idx': [row_idx]} ORDER BY row_idx) AS rows FROM numbered GROUP BY call_id, run), "
    f"a AS (SELECT call_id, speaker, {_forward('rows', True)} AS rows FROM runs), b AS (SELECT call_id, speaker, {_backward('rows')} AS rows FROM a), "
    f"c AS (SELECT call_id, speaker, {_forward('rows', False)} AS rows FROM b), "
    "each AS (SELECT call_id, speaker, unnest(rows) AS g FROM c) "
    "SELECT call_id, row_number() OVER (PARTITION BY call_id ORDER BY list_min(g.idx)) AS group_id, speaker, g.text AS text, list_min(g.idx) AS start_idx, list_max(g.idx) AS end_idx, g.idx AS orig_indices FROM each)"
)


def groups(spark, sf_dir):
    return g.dialogue_groups(_utterances(spark, sf_dir))


@query(f"SELECT call_id, group_id, speaker, text, start_idx, end_idx, orig_indices FROM {SQL_GROUPS}")
def q_grouping_3pass(spark, sf_dir):
    return groups(spark, sf_dir).drop("start_time", "end_time")


@query(f"SELECT call_id, unnest(orig_indices) AS row_idx, group_id FROM {SQL_GROUPS}")
def q_row_to_group(spark, sf_dir):
    return g.row_groups(groups(spark, sf_dir))


@query(
    f"WITH mapped AS (SELECT call_id, unnest(orig_indices) AS row_idx, group_id FROM {SQL_GROUPS}) "
    f"SELECT u.call_id, u.row_idx AS original_row, group_id, speaker, text AS original_text FROM {SQL_UTTERANCES} u LEFT JOIN mapped USING (call_id, row_idx)"
)
def q_sentence_level(spark, sf_dir):
    rows = _utterances(spark, sf_dir)
    return g.sentence_level(rows, g.dialogue_groups(rows)).drop("start_time", "end_time")


@query(
    "WITH long AS (SELECT DISTINCT call_id, speaker FROM (SELECT call_id, speaker, avg(chars) AS mean FROM " + _ISLANDS + " GROUP BY call_id, speaker, island) WHERE mean >= 20 AND lower(speaker) NOT IN ('user', 'assistant')) "
    f"SELECT call_id, count(*) AS n_rows FROM {SQL_UTTERANCES} u LEFT JOIN long USING (call_id, speaker) WHERE long.speaker IS NULL GROUP BY call_id"
)
def q_human_rows(spark, sf_dir):
    flagged = g.flag_system_audio(_utterances(spark, sf_dir), MAIN, min_rows=1, min_run=1, min_mean_chars=20)
    return g.analysed_rows(flagged, F.lit("Sales Call")).groupBy("call_id").agg(F.count("*").alias("n_rows"))
