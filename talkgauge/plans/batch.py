"""A batch: route files, check each language's calls in one plan, write results, roll up."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import lexicon
from talkgauge.config import LANGUAGES, Settings
from talkgauge.functions import text as t
from talkgauge.functions import tokens as k
from talkgauge.operators import layout, routing, rollup, terms
from talkgauge.operators.embedding import Embedder, HashingEmbedder, normalize_keys, script_embeddings
from talkgauge.operators.scripts import deduplicate, sheet_language, sheet_product
from talkgauge.plans.coverage import Coverage
from talkgauge.sources import files
from talkgauge.sources.workbooks import write_workbooks


def run_batch(
    spark: SparkSession, calls: DataFrame, names: DataFrame, mapping: DataFrame, scripts: DataFrame, output: str, settings: Settings = Settings(), embedder: Embedder | None = None, term_table: DataFrame | None = None,
    embeddings: DataFrame | None = None, workbooks: bool = False,
) -> DataFrame:
    """Checks all calls and writes groups, coverage, sentences, speakers and summary under ``output``, and workbooks if asked; returns the log of tasks.

    ``calls.call_id`` is the file's name; ``embeddings`` (clean_text, embedding) are stored vectors of MAN and ENG. The log has a row for each file, with its language's
    name, a status and, for an error, its reason: a file that can't be routed isn't checked, and a call without groups or whose sheet has no points has no coverage.
    """
    tasks = routing.route(names, mapping).withColumn("call_id", F.col("filename"))
    summaries = None
    for language in LANGUAGES:
        own = tasks.filter(F.col("language") == language)
        if own.isEmpty():
            continue
        weights = term_table if language == "CAN" else None
        if weights is not None:
            weights = weights.filter(F.col("language") == "CAN").groupBy("point", "term").agg(F.max("weight").alias("weight"))
        rows = calls.join(own.select("call_id"), "call_id", "left_semi")
        sheets = scripts.filter(sheet_language(F.col("sheet")) == language)
        vectors = None if language == "CAN" or embeddings is None else normalize_keys(embeddings, language)
        coverage = Coverage(rows, own, sheets, replace(settings, language=language), None if language == "CAN" else embedder or HashingEmbedder(), weights, vectors)
        for name in ("groups", "coverage", "sentences", "speakers", "summary"):
            files.write_report(getattr(coverage, name), f"{output}/{language}/{name}", by_call=False)
        if workbooks:
            write_workbooks(coverage.reports(files.report_names(own.select("call_id", "filename"))), f"{output}/{language}/reports")
        coverage.pairs.unpersist()
        summary = spark.read.parquet(f"{output}/{language}/summary")
        summaries = summary if summaries is None else summaries.unionByName(summary)
    done = tasks.limit(0).select("call_id") if summaries is None else summaries.select("call_id")
    log = _log(names, mapping, tasks, done)
    if summaries is not None:
        flags = {"total_seconds": "duration_outlier", "sales_word_count": "sales_wc_outlier", "customer_word_count": "customer_wc_outlier"}
        flagged = rollup.flag_outliers(summaries.drop(*flags.values()), flags)
        files.write_report(flagged, f"{output}/summary", by_call=False)
        files.write_report(rollup.outlier_counts(flagged), f"{output}/outliers", by_call=False)
        if workbooks:
            write_workbooks(layout.summary_report(spark.read.parquet(f"{output}/summary")), f"{output}/reports")
    return log


def _log(names: DataFrame, mapping: DataFrame, tasks: DataFrame, done: DataFrame) -> DataFrame:
    """All files with status and reason."""
    parsed = routing.parse_names(names).select("filename", F.lit(1).alias("_parsed"))
    picked = routing.pick_mapping(routing.parse_names(names), mapping).select("filename", F.lit(1).alias("_mapped"))
    ready = tasks.select("filename", F.lit(1).alias("_routed"), *[c for c in tasks.columns if c != "filename"])
    rows = names.select("filename").join(parsed, "filename", "left").join(picked, "filename", "left").join(ready, "filename", "left").join(done.withColumn("_done", F.lit(1)), "call_id", "left")
    reason = (
        F.when(F.col("_done").isNotNull(), None).when(F.col("_parsed").isNull(), "the name has no sample, type and supported language").when(F.col("_mapped").isNull(), "the sample isn't mapped")
        .when(F.col("_routed").isNull(), "the sample has no product").otherwise("no groups, or no points on the sheet")
    )
    shown = F.element_at(F.create_map(*[F.lit(x) for pair in routing.LANGUAGE_NAMES.items() for x in pair]), F.col("language"))
    kept = ["filename", *[c for c in tasks.columns if c not in ("filename", "call_id")]]
    return rows.select(*kept, F.coalesce("call_id", "filename").alias("call_id"), shown.alias("language_name"), F.when(F.col("_done").isNotNull(), "SUCCESS").otherwise("ERROR").alias("status"), reason.alias("reason"))


def summarize_only(spark: SparkSession, output: str) -> DataFrame:
    """The roll-up anew from the summaries that earlier batches wrote."""
    flags = {"total_seconds": "duration_outlier", "sales_word_count": "sales_wc_outlier", "customer_word_count": "customer_wc_outlier"}
    summaries = spark.read.option("recursiveFileLookup", True).parquet(*[f"{output}/{language}/summary" for language in LANGUAGES if _exists(spark, f"{output}/{language}/summary")])
    return rollup.flag_outliers(summaries.drop(*flags.values()), flags)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def build_term_importance(scripts: DataFrame) -> DataFrame:
    """``language, product, point, term, weight`` of all script sheets. Equal scripts are counted once; each of their points gets their tokens."""
    out = None
    for language in LANGUAGES:
        sheets = scripts.filter(sheet_language(F.col("sheet")) == language).withColumn("product", sheet_product(F.col("sheet")))
        clean = t.clean_offline_en(F.col("standard_script")) if language == "ENG" else t.clean(F.col("standard_script"), language)
        tokens = sheets.dropna(subset=["point", "standard_script"]).select(F.lit(language).alias("language"), "product", "point", F.explode(k.business_tokens(k.segment(clean, language), language)).alias("token"))
        found = terms.term_importance(tokens, lexicon.KEYWORDS_ZH, lexicon.stopwords(language))
        out = found if out is None else out.unionByName(found)
    return out


def distinct_scripts(scripts: DataFrame) -> DataFrame:
    """The script table as its deduplicated workbook has it."""
    return deduplicate(scripts)


def write_distinct_scripts(scripts: DataFrame, folder: str, name: str = "scripts_deduplicated.xlsx") -> None:
    """That workbook: one sheet with each distinct script and its points."""
    header = {"point": "Required_Discussion_Point", "standard_script": "Standard_Script"}
    write_workbooks(layout.table(distinct_scripts(scripts), name, "Scripts", header, ["script_row", "standard_script"]), folder)


def build_script_vectors(scripts: DataFrame, language: str, path: str, embedder: Embedder | None = None) -> None:
    """Encodes a language's scripts, each distinct clean text once, and stores the vectors as a table that run_batch takes."""
    own = scripts.filter(sheet_language(F.col("sheet")) == language)
    files.write_report(script_embeddings(own, language, embedder or HashingEmbedder()), path, by_call=False)
