"""Reports as rows of workbook cells: ``report, sheet_no, sheet, place, cells``, which sinks write in order of ``place``.

A cell is a text or a number. Reports are laid out for all calls at once; a workbook is made where its rows meet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Headings of the reports.
TITLES = ("A. Overall Performance KPIs", "B. Key Insights - Speaker View", "C. Detailed Coverage List")
SPEAKER_HEADER = ("Role", "Speaker", "Speaking Duration (seconds)", "Word Count", "Words per Second", "Top 10 Keywords")
SUMMARY_HEADER = (
    "Sample No", "Product Name", "Language", "Call Type", "Coverage Rate (%)", "Total Points", "Covered Points", "Total Duration (s)", "Total Duration (MM:SS)",
    "Duration Outlier", "Sales Word Count", "Sales WC Outlier", "Customer Word Count", "Customer WC Outlier",
)
SUMMARY_REPORT = "Summarized_Analysis_Report.xlsx"

CELL = "struct<s:string,n:double>"


def text(x: Column | str) -> Column:
    x = F.lit(x) if isinstance(x, str) else x.cast("string")
    return F.struct(x.alias("s"), F.lit(None).cast("double").alias("n"))


def cell(df: DataFrame, name: str) -> Column:
    """A column's values as cells: numbers stay numbers, lists are their items with commas between."""
    kind, x = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return F.struct(F.lit(None).cast("string").alias("s"), x.cast("double").alias("n"))
    return text(F.array_join(x, ", ") if isinstance(kind, T.ArrayType) else x)


def _rows(df: DataFrame, number: int, sheet: str, part: int, order: list[Column], cells: list[Column]) -> DataFrame:
    place = F.struct(F.lit(part).alias("part"), F.array(*(x.cast("double") for x in order)).alias("at"))
    return df.select("report", F.lit(number).alias("sheet_no"), F.lit(sheet).alias("sheet"), place.alias("place"), F.array(*cells).cast(f"array<{CELL}>").alias("cells"))


def _lines(reports: DataFrame, number: int, sheet: str, part: int, lines: list[tuple[str, ...]]) -> DataFrame:
    """The same lines in every report."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.array(*map(text, line)).cast(f"array<{CELL}>").alias("cells")) for i, line in enumerate(lines)])).alias("line")
    return reports.select("report", each).select("report", F.lit(number).alias("sheet_no"), F.lit(sheet).alias("sheet"), F.struct(F.lit(part).alias("part"), F.array(F.col("line.i").cast("double")).alias("at")).alias("place"), F.col("line.cells").alias("cells"))


def table(df: DataFrame, report: str, sheet: str, header: dict[str, str] | list[str], order: list[str], number: int = 0) -> DataFrame:
    """One sheet of one workbook from a small table's rows."""
    header = dict.fromkeys(header) if not isinstance(header, dict) else header
    named = df.withColumn("report", F.lit(report))
    one = df.sparkSession.createDataFrame([(report,)], "report string")
    top = _lines(one, number, sheet, 0, [tuple(name or c for c, name in header.items())])
    ranked = named.withColumn("_at", F.struct(*order))
    rows = ranked.select("report", F.lit(number).alias("sheet_no"), F.lit(sheet).alias("sheet"), F.array(*(cell(named, c) for c in header)).cast(f"array<{CELL}>").alias("cells"), "_at")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("report").orderBy("_at"))  # one workbook's rows, which one task writes anyway
    return top.unionByName(rows.select("report", "sheet_no", "sheet", F.struct(F.lit(1).alias("part"), F.array(place.cast("double")).alias("at")).alias("place"), "cells"))


def call_reports(names: DataFrame, kpis: DataFrame, speakers: DataFrame, detailed: DataFrame, views: list[DataFrame], sentences: DataFrame) -> DataFrame:
    """A workbook for each call: Executive Summary (indicators, speakers, the coverage list), Coverage Analysis (groups by points) and Original Call Text.

    ``names``: call_id, report; a call without indicators has no report. ``views`` has one table for each script sheet, whose points are its columns.
    """
    names = names.join(kpis.select("call_id"), "call_id", "left_semi").select("call_id", "report")
    of = lambda df: df.join(names, "call_id")
    summary, reports = "Executive Summary", names.select("report")
    metrics = of(kpis).select("report", F.posexplode(F.array(
        F.array(text("Total Call Duration"), text(F.col("total_duration"))), F.array(text("Compliance Coverage Rate (%)"), text(F.format_string("%.1f%%", F.col("coverage_rate")))),
        F.array(text("Total Points Checked"), text(F.col("total_points"))), F.array(text("Covered Points"), text(F.col("covered_points"))), F.array(text("Uncovered Risk Points"), text(F.col("uncovered_points"))),
    )).alias("at", "cells"))
    out = [
        _lines(reports, 0, summary, 0, [(TITLES[0],), ()]),
        metrics.select("report", F.lit(0).alias("sheet_no"), F.lit(summary).alias("sheet"), F.struct(F.lit(1).alias("part"), F.array(F.col("at").cast("double")).alias("at")).alias("place"), F.col("cells").cast(f"array<{CELL}>").alias("cells")),
        _lines(reports, 0, summary, 2, [(), (), (TITLES[1],), (), SPEAKER_HEADER]),
    ]
    rank = F.when(F.col("role") == "Sales", 0).when(F.col("role") == "Customer", 1).when(F.col("role") == "Other", 2).otherwise(3)
    figures = [F.when(F.col("role") == "System", text("N/A")).otherwise(cell(speakers, c)) for c in ("speaking_seconds", "word_count", "words_per_second", "top_words")]
    out.append(_rows(of(speakers), 0, summary, 3, [rank, -F.coalesce("word_count", F.lit(0)), F.xxhash64("speaker")], [text(F.col("role")), text(F.col("speaker")), *figures]))
    shown = [c for c in detailed.columns if c not in ("call_id", "sheet", "point_order")]
    out.append(_lines(reports, 0, summary, 4, [(), (), (TITLES[2],), (), tuple(shown)]))
    out.append(_rows(of(detailed), 0, summary, 5, [F.col("point_order")], [cell(detailed, c) for c in shown]))
    for view in views:
        columns = [c for c in view.columns if c != "call_id"]
        own = of(view)
        out.append(_lines(own.select("report").distinct(), 1, "Coverage Analysis", 0, [tuple(columns)]))
        system = F.col("system_audio_recording") == "YES"
        out.append(_rows(own, 1, "Coverage Analysis", 1, [system.cast("int"), F.regexp_extract("group_id", r"(\d+)$", 1)], [cell(view, c) for c in columns]))
    listed = [c for c in sentences.columns if c != "call_id"]
    out.append(_lines(reports, 2, "Original Call Text", 0, [tuple(listed)]))
    out.append(_rows(of(sentences), 2, "Original Call Text", 1, [F.col("original_row")], [cell(sentences, c) for c in listed]))
    return reduce(DataFrame.unionByName, out)


def summary_report(summary: DataFrame) -> DataFrame:
    """The roll-up of a batch as one workbook."""
    columns = ["sample_no", "product_name", "language", "call_type", "coverage_rate", "total_points", "covered_points", "total_seconds", "total_mmss", "duration_outlier", "sales_word_count", "sales_wc_outlier", "customer_word_count", "customer_wc_outlier"]
    return table(summary, SUMMARY_REPORT, "Summary Report", dict(zip(columns, SUMMARY_HEADER)), ["language", "call_id"])
