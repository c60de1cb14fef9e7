"""Required points and the variations of their scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgauge.functions import text as t

SPLIT = r"[.;\n]|版本[AB][:：]|Version [AB][:：]|情[况況][一二三四五六七八九十][:：]"
SHORT, LONG = 5, 50


def merge_fragments(pieces: Column) -> Column:
    """Pieces of at most five characters go in front of the next one; a last one goes behind the one before it."""
    start = F.struct(F.lit("").alias("carry"), F.array().cast("array<string>").alias("out"))

    def step(state, x):
        now = F.when(state["carry"] == "", x).otherwise(F.concat(state["carry"], F.lit(" "), x))
        short = F.length(now) <= SHORT
        return F.struct(F.when(short, now).otherwise("").alias("carry"), F.when(short, state["out"]).otherwise(F.concat(state["out"], F.array(now))).alias("out"))

    def finish(state):
        out, carry = state["out"], state["carry"]
        behind = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat(F.element_at(out, -1), F.lit(" "), carry)))
        return F.when(carry == "", out).when(F.size(out) > 0, behind).otherwise(F.array(carry))

    return F.aggregate(pieces, start, step, finish)


def _pieces(x: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(x, pattern), t.strip), lambda s: F.length(s) > 0)


def variations(script: Column, language: str, split_before_clean: bool = False) -> Column:
    """A script's variations, without repeats.

    The text is cleaned first, which in Chinese removes most of what it is then split on; with split_before_clean
    it is split first. Pieces of over fifty characters are split at commas too.
    """
    empty = F.array().cast("array<string>")
    whole = t.clean(t.strip(t.text_or_empty(script)), language)
    if split_before_clean:
        raw = F.filter(F.transform(_pieces(t.text_or_empty(script), SPLIT), lambda s: t.clean(s, language)), lambda s: F.length(s) > 0)
    else:
        raw = _pieces(whole, SPLIT)
    merged = merge_fragments(raw)
    cut = F.flatten(F.transform(merged, lambda s: F.when(F.length(s) > LONG, merge_fragments(_pieces(s, ","))).otherwise(F.array(s))))
    found = F.array_distinct(cut)
    return F.when(F.length(whole) == 0, empty).when(F.size(found) > 0, found).otherwise(F.array(whole))


def offline_variations(script: Column) -> Column:
    """For vectors: split at the first of four separators that occurs; pieces of over three characters, else the text."""
    whole = t.strip(script)
    out = F.array(whole)
    for mark in ("|", "\n", "；", "。"):
        pieces = F.filter(F.transform(F.split(script, f"[{mark}]"), t.strip), lambda s: F.length(s) > 3)
        out = F.when(F.contains(script, F.lit(mark)), F.when(F.size(pieces) > 0, pieces).otherwise(F.array(whole))).otherwise(out)
    return out


def composite_points(scripts: DataFrame, sheets: frozenset[str] | set[str], separator: str = " | ") -> DataFrame:
    """On listed sheets a point is named with its note; a point or note alone stands for itself."""
    blank = lambda c: F.coalesce(t.strip(F.col(c)), F.lit(""))
    point, note = blank("point"), blank("note")
    both = F.when(note == "", point).when(point == "", note).otherwise(F.concat(point, F.lit(separator), note))
    listed = F.trim("sheet").isin(sorted(s.strip() for s in sheets)) if sheets else F.lit(False)
    return scripts.withColumn("point", F.when(listed, F.nullif(both, F.lit(""))).otherwise(F.col("point")))


def sheet_language(sheet: Column) -> Column:
    return F.nullif(F.regexp_extract(sheet, "^(.*)_(CAN|MAN|ENG)$", 2), F.lit(""))


def sheet_product(sheet: Column) -> Column:
    """All before the language's underscore, further underscores included."""
    return F.nullif(F.regexp_extract(sheet, "^(.*)_(CAN|MAN|ENG)$", 1), F.lit(""))


def points(scripts: DataFrame, language: str, split_before_clean: bool = False) -> DataFrame:
    """``sheet, point, point_order, scripts, variations, holistic``: a point's rows in the sheet's order.

    Rows without a point or a script are left out. Variations of different rows may repeat; the holistic text is all scripts.
    """
    rows = scripts.dropna(subset=["point", "standard_script"])
    item = F.struct("script_row", "standard_script", variations(F.col("standard_script"), language, split_before_clean).alias("variations"))
    grouped = rows.groupBy("sheet", "point").agg(F.min("script_row").alias("point_order"), F.array_sort(F.collect_list(item)).alias("rows"))
    texts = F.transform("rows", lambda r: r["standard_script"])
    return grouped.select(
        "sheet", "point", "point_order", texts.alias("scripts"), F.flatten(F.transform("rows", lambda r: r["variations"])).alias("variations"),
        F.array_join(texts, " ").alias("holistic"),
    )


def deduplicate(scripts: DataFrame) -> DataFrame:
    """One row for each distinct script; its points are joined in order of name."""
    rows = scripts.dropna(subset=["point", "standard_script"])
    return rows.groupBy("standard_script").agg(F.array_join(F.sort_array(F.collect_list("point")), " + ").alias("point"), F.min("script_row").alias("script_row"), F.count("*").alias("n_rows"))
