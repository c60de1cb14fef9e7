"""Queries of sources, sinks and stored vectors: each writes rows of the tables to the shared folder, reads them back and returns them."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from talkgauge import schemas
from talkgauge.catalog.registry import SQL_CALLS, SQL_SCRIPTS, calls, query, scripts, table
from talkgauge.catalog.scripting import _SQL_MAPPING, SQL_TERMS, _mapping, _sql_offline, _terms
from talkgauge.catalog.texts import sql_fold_en
from talkgauge.operators import embedding as e
from talkgauge.sources import files
from talkgauge.sources.xlsx import register


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local session without one gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="talkgauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/talkgauge/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _sheet(df, path: str, name: str):
    """The rows as one workbook with one sheet of that name."""
    register(df.sparkSession)
    df.coalesce(1).write.format("xlsx").option("sheet", name).mode("append").save(path)


@query(f"SELECT speaker, text, count(*) AS n, count(*) AS n_places FROM {SQL_CALLS} GROUP BY speaker, text")
def q_transcript_files(spark, sf_dir):
    """Conversations written as CSV transcripts and read as calls; each file's rows have places of their own."""
    path, names = folder(spark, "transcripts"), {v: k for k, v in schemas.TRANSCRIPT_FILE.items()}
    rows = calls(spark, sf_dir).repartition(4, "call_id").sortWithinPartitions("call_id", "row_idx")
    rows.select(*(F.col(c).alias(names[c]) for c in ("speaker", "text", "start_time", "end_time"))).write.option("header", True).option("escape", '"').csv(path)
    read = files.transcripts(spark, path)
    return read.groupBy("speaker", "text").agg(F.count("*").alias("n"), F.countDistinct("call_id", "row_idx").alias("n_places"))


@query(f"SELECT speaker, text, count(*) AS n FROM {SQL_CALLS} GROUP BY speaker, text")
def q_transcript_workbooks(spark, sf_dir):
    """The same through workbooks, one for each of four parts."""
    path, names = folder(spark, "workbooks"), {v: k for k, v in schemas.TRANSCRIPT_FILE.items()}
    register(spark)
    rows = calls(spark, sf_dir).repartition(4, "call_id").select(*(F.col(c).alias(names[c]) for c in ("speaker", "text", "start_time", "end_time")))
    rows.write.format("xlsx").mode("append").save(path)
    return files.transcript_workbooks(spark, path).groupBy("speaker", "text").agg(F.count("*").alias("n"))


@query(f"SELECT 'Demo_ENG' AS sheet, point, standard_script FROM {SQL_SCRIPTS}")
def q_script_workbook(spark, sf_dir):
    """Scripts written as a workbook, beside one whose sheet has no language and is left out."""
    path = folder(spark, "scripts")
    rows = scripts(spark, sf_dir).select(F.col("point").alias("Required_Discussion_Point"), F.col("standard_script").alias("Standard_Script"), F.col("note").alias("Points to Note"))
    _sheet(rows, path, "Demo_ENG")
    _sheet(rows.limit(3), path + "-other", "Notes")
    read = files.script_workbook(spark, path).unionByName(files.script_workbook(spark, path + "-other"))
    return read.select("sheet", "point", "standard_script")


@query(f"SELECT 'Demo_ENG' AS sheet, point, standard_script FROM {SQL_SCRIPTS}")
def q_script_csv(spark, sf_dir):
    path = folder(spark, "scripts-csv")
    rows = scripts(spark, sf_dir).select(F.col("point").alias("Required_Discussion_Point"), F.col("standard_script").alias("Standard_Script"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.script_csv(spark, path, "Demo_ENG").select("sheet", "point", "standard_script")


@query(f"SELECT sample_no, product_name, call_type FROM {_SQL_MAPPING}")
def q_mapping_workbook(spark, sf_dir):
    path = folder(spark, "mapping")
    _sheet(_mapping(spark, sf_dir).select(F.col("sample_no").alias("Sample No"), F.col("product_name").alias("Product Name"), F.col("call_type").alias("Call Type")), path, "Mapping")
    return files.mapping_workbook(spark, path).select("sample_no", "product_name", "call_type")


@query(f"SELECT language, product, point, term, weight FROM {SQL_TERMS}")
def q_term_file(spark, sf_dir):
    """Term weights through gzipped CSV."""
    path = folder(spark, "terms")
    files.write_term_weights(_terms(spark, sf_dir), path)
    return files.term_weights(spark, path)


@query(f"SELECT call_id, row_idx, speaker, text FROM {SQL_CALLS}")
def q_report_tables(spark, sf_dir):
    """A result as a table with a folder for each call."""
    path = folder(spark, "report")
    files.write_report(calls(spark, sf_dir).select("call_id", "row_idx", "speaker", "text"), path)
    return spark.read.schema("row_idx long, speaker string, text string, call_id string").parquet(path).select("call_id", "row_idx", "speaker", "text")


@query("SELECT count(*) AS n_files FROM (SELECT unnest([1, 2, 3]))")
def q_listing(spark, sf_dir):
    """The names of a folder's transcripts, of which others aren't listed."""
    path = folder(spark, "listing")
    rows = calls(spark, sf_dir).select("speaker", "text")
    rows.repartition(3).write.option("header", True).csv(path)
    rows.limit(1).write.mode("append").json(path)
    return files.list_transcripts(spark, path).agg(F.count("*").alias("n_files"))


# -- vectors -----------------------------------------------------------------------------------


def lengths(texts: list[str]) -> np.ndarray:
    """An embedder that SQL knows too: the text's length, once and negated."""
    return np.array([[len(x), -len(x)] for x in texts], np.float32).reshape(len(texts), 2)


_PLACE = "'T' || (doc_id % 700)"


@query(f"SELECT doc_id, coalesce(embedding, [length({_PLACE})::FLOAT, -length({_PLACE})::FLOAT]) AS vector FROM documents LEFT JOIN embeddings ON vec_id = doc_id % 700")
def q_vector_lookup(spark, sf_dir):
    """Stored vectors by clean text; texts without one are encoded."""
    stored = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("T"), F.col("vec_id").cast("string")).alias("clean_text"), "embedding")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("T"), (F.col("doc_id") % 700).cast("string")).alias("clean"))
    return e.with_vectors(docs, "clean", stored, lengths).select("doc_id", "vector")


@query("SELECT 'T' || (vec_id % 90) AS clean_text, arg_min(embedding, key) AS embedding FROM (SELECT *, CASE vec_id % 3 WHEN 0 THEN 'T' WHEN 1 THEN ' T' ELSE '　Ｔ' END || (vec_id % 90) || repeat(' ', CAST(vec_id // 90 AS INTEGER)) AS key FROM embeddings) GROUP BY 1")
def q_normalize_keys(spark, sf_dir):
    """Stored texts that clean to the same one: the first in order of the original is taken."""
    front = F.element_at(F.array(F.lit("T"), F.lit(" T"), F.lit("　Ｔ")), (F.col("vec_id") % 3 + 1).cast("int"))
    key = F.concat(front, (F.col("vec_id") % 90).cast("string"), F.repeat(F.lit(" "), F.floor(F.col("vec_id") / 90).cast("int")))
    return e.normalize_keys(table(spark, sf_dir, "embeddings").select(key.alias("clean_text"), "embedding"), "ENG")


_EACH = f"(SELECT unnest(list_concat([standard_script], {_sql_offline()})) AS x FROM {SQL_SCRIPTS})"


@query(f"SELECT clean_text, [length(clean_text)::FLOAT, -length(clean_text)::FLOAT] AS embedding FROM (SELECT DISTINCT {sql_fold_en('x')} AS clean_text FROM {_EACH}) WHERE length(clean_text) > 0")
def q_script_vectors(spark, sf_dir):
    """Each distinct clean text of scripts and their offline variations, encoded once."""
    return e.script_embeddings(scripts(spark, sf_dir), "ENG", lengths)


@query(f"SELECT sheet, point, standard_script FROM (SELECT 'A_ENG' AS sheet, point, standard_script FROM {SQL_SCRIPTS} WHERE script_row % 2 = 0 UNION ALL SELECT 'B_MAN', point, standard_script FROM {SQL_SCRIPTS} WHERE script_row % 2 = 1)")
def q_all_sheets(spark, sf_dir):
    """All sheets of all workbooks of a folder, one table."""
    path = folder(spark, "sheets")
    rows = scripts(spark, sf_dir).select("script_row", F.col("point").alias("Required_Discussion_Point"), F.col("standard_script").alias("Standard_Script"))
    _sheet(rows.filter("script_row % 2 = 0").drop("script_row"), path + "/a", "A_ENG")
    _sheet(rows.filter("script_row % 2 = 1").drop("script_row"), path + "/b", "B_MAN")
    read = [files.script_workbook(spark, f"{path}/{part}") for part in "ab"]
    return read[0].unionByName(read[1]).select("sheet", "point", "standard_script")
