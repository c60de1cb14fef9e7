"""Runs of a speaker's rows, system recordings, and dialogue groups.

A call's rows are ordered by ``row_idx``. Calls are the unit of partitioning: one shuffle by call and
speaker for the runs, one by call for the groups; within a call everything is a window or a fold.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgauge.functions import text as t

#: Rows of a run that are folded in the JVM, which copies the array at each step; longer runs are folded in Python, in one pass.
LONG_RUN = 500
_GROUPS = "array<struct<text:string,start_time:string,end_time:string,orig_indices:array<bigint>>>"


def speaker_runs(calls: DataFrame) -> DataFrame:
    """Gaps and islands: ``call_id, speaker, run_start, run_end, n_rows, mean_chars`` for each run of consecutive rows."""
    place = F.row_number().over(Window.partitionBy("call_id", "speaker").orderBy("row_idx"))
    chars = F.length(t.strip(t.text_or_empty(F.col("text"))))
    rows = calls.filter("speaker is not null").select("call_id", "speaker", "row_idx", chars.alias("chars"), (F.col("row_idx") - place).alias("island"))
    return rows.groupBy("call_id", "speaker", "island").agg(
        F.min("row_idx").alias("run_start"), F.max("row_idx").alias("run_end"), F.count("*").alias("n_rows"), F.avg("chars").alias("mean_chars")
    ).drop("island")


def flag_system_audio(calls: DataFrame, main_speakers: Iterable[str], min_rows: int = 10, min_run: int = 10, min_mean_chars: float = 20) -> DataFrame:
    """The calls with ``is_system``: all rows of a speaker other than the main ones that has enough
    rows and a long enough run of them with a long enough mean text. A null speaker never is."""
    main = [s.lower() for s in main_speakers]
    speaker = Window.partitionBy("call_id", "speaker")
    place = F.row_number().over(speaker.orderBy("row_idx"))
    rows = calls.withColumn("_island", F.col("row_idx") - place).withColumn("_chars", F.length(t.strip(t.text_or_empty(F.col("text")))))
    run = Window.partitionBy("call_id", "speaker", "_island")
    long = (F.count("*").over(run) >= min_run) & (F.avg("_chars").over(run) >= min_mean_chars)
    rows = rows.withColumn("_long", long).withColumn("_rows", F.count("*").over(speaker)).withColumn("_any", F.max("_long").over(speaker))
    other = F.col("speaker").isNotNull() & ~F.lower("speaker").isin(main)
    return rows.withColumn("is_system", other & (F.col("_rows") >= min_rows) & F.col("_any")).drop("_island", "_chars", "_long", "_rows", "_any")


def speaker_changes(calls: DataFrame) -> DataFrame:
    """The rows with ``run``, which counts a call's changes of speaker; a null speaker is a change each time."""
    order = Window.partitionBy("call_id").orderBy("row_idx")
    before = F.lag("speaker").over(order)
    same = F.coalesce(F.col("speaker") == before, F.lit(False))
    return calls.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(order)).drop("_new")


def _merged(a: Column, b: Column, start: Column, end: Column) -> Column:
    return F.struct(
        F.concat(a["text"], F.lit(" "), b["text"]).alias("text"), start.alias("start_time"), end.alias("end_time"),
        F.concat(a["orig_indices"], b["orig_indices"]).alias("orig_indices"),
    )


def _fits(a: Column, b: Column, most: int) -> Column:
    return F.length(a["text"]) + F.length(b["text"]) + 1 <= most


def _forward(groups: Column, most: int, heed_punctuation: bool) -> Column:
    """Appends each group to the one before it where both fit together."""

    def step(done, x):
        last = F.element_at(done, -1)
        joins = _fits(last, x, most)
        if heed_punctuation:
            joins = joins & ~t.ends_with_punctuation(last["text"])
        both = _merged(last, x, last["start_time"], F.coalesce(x["end_time"], last["end_time"]))
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.slice(groups, F.lit(2), F.size(groups)), F.slice(groups, 1, 1), step)


def _backward(groups: Column, most: int, short: int) -> Column:
    """Puts each group before the next one where that is short and both fit together."""
    turned = F.reverse(groups)

    def step(done, x):
        first = F.get(done, F.lit(0))
        joins = _fits(x, first, most) & (F.length(first["text"]) < short)
        both = _merged(x, first, F.coalesce(x["start_time"], first["start_time"]), first["end_time"])
        return F.when(joins, F.concat(F.array(both), F.slice(done, F.lit(2), F.size(done)))).otherwise(F.concat(F.array(x), done))

    return F.aggregate(F.slice(turned, F.lit(2), F.size(turned)), F.slice(turned, 1, 1), step)


def fold_rows(rows: list[dict], most: int, short: int) -> list[dict]:
    """The three passes over a run's rows, as _forward and _backward make them."""

    def merged(a: dict, b: dict) -> dict:
        return {"text": f"{a['text']} {b['text']}", "start_time": a["start_time"], "end_time": b["end_time"], "orig_indices": [*a["orig_indices"], *b["orig_indices"]]}

    def fits(a: dict, b: dict) -> bool:
        return len(a["text"]) + len(b["text"]) + 1 <= most

    def forward(groups: list[dict], heed: bool) -> list[dict]:
        out = groups[:1]
        for x in groups[1:]:
            last = out[-1]
            if fits(last, x) and not (heed and last["text"].endswith(t.PUNCTUATION)):
                both = merged(last, x)
                out[-1] = both if x["end_time"] is not None else both | {"end_time": last["end_time"]}
            else:
                out.append(x)
        return out

    turned = forward(rows, True)[::-1]
    out = turned[:1]  # its last item is the first group so far
    for x in turned[1:]:
        after = out[-1]
        if fits(x, after) and len(after["text"]) < short:
            both = merged(x, after)
            out[-1] = both if x["start_time"] is not None else both | {"start_time": after["start_time"]}
        else:
            out.append(x)
    return forward(out[::-1], False)


def _folded(pieces: Column, most: int, short: int) -> Column:
    @F.arrow_udf(_GROUPS)
    def fold(runs: pa.Array) -> pa.Array:
        return pa.array([None if run is None else fold_rows(run, most, short) for run in runs.to_pylist()], runs.type)

    whole = _forward(_backward(_forward(pieces, most, True), most, short), most, False)
    long = F.size(pieces) > LONG_RUN
    return F.when(long, fold(F.when(long, pieces).cast(_GROUPS))).otherwise(F.when(~long, whole).cast(_GROUPS))


def dialogue_groups(calls: DataFrame, max_chars: int = 150, short_chars: int = 20, legacy_nan: bool = False) -> DataFrame:
    """Groups of a speaker's neighbouring rows: ``call_id, group_id, speaker, text, start_idx, end_idx,
    start_time, end_time, orig_indices``.

    Rows without text are left out first. Merges need the same speaker on both sides, so a run of one speaker is folded on its own: forward up to
    punctuation, backward for short pieces, and forward once more. A null speaker's rows are never merged.
    """
    rows = calls.withColumn("text", t.strip(t.text_or_empty(F.col("text"), legacy_nan))).filter(F.length("text") > 0)
    item = F.struct("row_idx", "text", "start_time", "end_time", F.array("row_idx").alias("orig_indices"))
    runs = speaker_changes(rows).groupBy("call_id", "run").agg(F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(item)).alias("rows"))
    pieces = F.transform("rows", lambda r: F.struct(r["text"].alias("text"), r["start_time"].alias("start_time"), r["end_time"].alias("end_time"), r["orig_indices"].alias("orig_indices")))
    groups = runs.select("call_id", "speaker", pieces.alias("pieces")).select("call_id", "speaker", F.explode(_folded(F.col("pieces"), max_chars, short_chars)).alias("g"))
    groups = groups.select("call_id", "speaker", "g.*", F.array_min("g.orig_indices").alias("start_idx"), F.array_max("g.orig_indices").alias("end_idx"))
    number = F.row_number().over(Window.partitionBy("call_id").orderBy("start_idx")).cast("long")
    return groups.select("call_id", number.alias("group_id"), "speaker", "text", "start_idx", "end_idx", "start_time", "end_time", "orig_indices")


def row_groups(groups: DataFrame) -> DataFrame:
    """``call_id, row_idx, group_id``."""
    return groups.select("call_id", F.explode("orig_indices").alias("row_idx"), "group_id")


def sentence_level(calls: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with text, and the group that it is in, if any."""
    rows = calls.withColumn("original_text", t.strip(F.col("text"))).filter(F.length("original_text") > 0)
    return rows.join(row_groups(groups), ["call_id", "row_idx"], "left").select("call_id", F.col("row_idx").alias("original_row"), "group_id", "speaker", "start_time", "end_time", "original_text")


def analysed_rows(flagged: DataFrame, call_type: Column | None = None, include_system: bool = False) -> DataFrame:
    """The rows that groups are made of: without system recordings, which only sales calls have."""
    if include_system:
        return flagged
    system = F.col("is_system") if call_type is None else F.col("is_system") & (call_type == "Sales Call")
    return flagged.filter(~system)


def utterances(calls: DataFrame) -> DataFrame:
    """A row for each sentence, numbered densely within its call."""
    pieces = calls.select("call_id", "row_idx", "speaker", F.posexplode(t.sentences(t.text_or_empty(F.col("text")))).alias("pos", "text")).filter(F.length("text") > 0)
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("row_idx", "pos")) - 1
    return pieces.select("call_id", place.cast("long").alias("row_idx"), "speaker", "text", F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("end_time"))
