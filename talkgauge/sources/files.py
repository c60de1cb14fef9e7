"""Transcripts, scripts, mappings and term weights from files, and results to files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge import schemas
from talkgauge.functions.text import output_name
from talkgauge.sources.xlsx import workbook_rows


def list_transcripts(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """``filename`` of a folder's transcripts, in order of name; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename")).orderBy("filename")


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """CSV transcripts as calls, a file each; ``call_id`` is the file's name.

    With multiLine a file is one partition and is read from its start, so the generated id grows in
    the file's order; the row's index is its rank in the file.
    """
    names = list(schemas.TRANSCRIPT_FILE)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("pathGlobFilter", "*.csv").csv(folder, enforceSchema=False)
    schemas.require(raw, *names[:2])
    columns = [F.col(f"`{h}`").cast("string").alias(c) if h in raw.columns else F.lit(None).cast("string").alias(c) for h, c in schemas.TRANSCRIPT_FILE.items()]
    rows = raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("call_id"), F.monotonically_increasing_id().alias("_id"), *columns)
    return index_rows(rows.withColumn("call_id", F.url_decode("call_id")))


def index_rows(rows: DataFrame) -> DataFrame:
    """``row_idx`` from 0 in each call, in order of ``_id``."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("call_id").orderBy("_id")) - 1
    return rows.withColumn("row_idx", place.cast("long")).select("call_id", "row_idx", "speaker", "text", "start_time", "end_time")


def transcript_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts in the first sheets of workbooks."""
    rows = workbook_rows(spark, folder, schemas.TRANSCRIPT_FILE)
    return rows.select(F.col("file").alias("call_id"), F.col("row").alias("row_idx"), "speaker", "text", "start_time", "end_time")


def script_workbook(spark: SparkSession, path: str, sheet: str = "*") -> DataFrame:
    """Script sheets whose names end in a language; one named sheet if asked for."""
    rows = workbook_rows(spark, path, schemas.SCRIPT_FILE, sheet)
    return rows.filter(F.regexp_like("sheet", F.lit("_(CAN|MAN|ENG)$"))).select("sheet", F.col("row").alias("script_row"), "point", "standard_script", "note")


def script_csv(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    schemas.require(raw, "Required_Discussion_Point", "Standard_Script")
    columns = [F.col(f"`{h}`").alias(c) if h in raw.columns else F.lit(None).cast("string").alias(c) for h, c in schemas.SCRIPT_FILE.items()]
    return raw.select(F.lit(sheet).alias("sheet"), F.monotonically_increasing_id().alias("script_row"), *columns)


def mapping_workbook(spark: SparkSession, path: str) -> DataFrame:
    """``sample_no, product_name, call_type, map_row``."""
    rows = workbook_rows(spark, path, {"Sample No": "sample_no", "Product Name": "product_name", "Call Type": "call_type"})
    return rows.select(F.regexp_replace("sample_no", r"\.0$", "").alias("sample_no"), "product_name", "call_type", F.col("row").alias("map_row"))


def term_weights(spark: SparkSession, path: str) -> DataFrame:
    """Term importance from gzipped CSV; a missing file is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schemas.TERMS).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.TERMS)


def write_term_weights(terms: DataFrame, path: str) -> None:
    terms.select("language", "product", "point", "term", "weight").write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def write_report(df: DataFrame, path: str, by_call: bool = True) -> None:
    """A result as a table, in a folder for each call if asked for; Spark's commit leaves whole results or none."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("call_id") if by_call else writer).parquet(path)


def report_names(files: DataFrame) -> DataFrame:
    return files.withColumn("report", output_name(F.col("filename")))


def write_log(path: str, statistics: dict, tasks: list[dict], spark: SparkSession) -> None:
    """The batch log as one JSON document, in any store that Spark writes."""
    text = json.dumps({"batch_summary": statistics, "task_logs": tasks}, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
