"""Registered queries, each with the SQL that gives the same rows in DuckDB, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the driver tables as calls and scripts ----------------------------------------------------


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls."""
    text = F.lit(None).cast("string")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("call_id"), F.col("turn").alias("row_idx"), F.col("role").alias("speaker"), "text", text.alias("start_time"), text.alias("end_time")
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as one sheet of eight points."""
    item = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        F.lit("Demo_ENG").alias("sheet"), item.alias("script_row"), F.concat(F.lit("P"), (item % 8).cast("string")).alias("point"), F.col("text").alias("standard_script"), F.lit(None).cast("string").alias("note")
    )


# -- pieces of SQL -----------------------------------------------------------------------------


def quote(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(quote(w) for w in sorted(words)) + "]"


SQL_CALLS = "(SELECT CAST(conv_id AS VARCHAR) AS call_id, turn AS row_idx, role AS speaker, text FROM conversations)"
SQL_SCRIPTS = "(SELECT item_id AS script_row, 'P' || (item_id % 8) AS point, text AS standard_script FROM benchmark)"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
