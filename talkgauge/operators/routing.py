"""Routing: from a file's name and the mapping of samples to the script sheet it is checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgauge.functions.text import strip

# Spellings of call types, and suffixes of languages.
CALL_TYPES = {
    "sqccb": ("sqccb", "sqc cb"),
    "sales leader confirmation": ("sales leader confirmation", "salesleader confirmation", "salesleader", "saleleader", "sales leader"),
    "sales call": ("sales call", "salescall", "sales"),
}
SUFFIXES = {"C": "CAN", "M": "MAN", "E": "ENG"}
LANGUAGE_NAMES = {"CAN": "Cantonese", "MAN": "Mandarin", "ENG": "English"}


def normalize_call_type(x: Column) -> Column:
    """One of three labels, else the text in lower case; null is empty."""
    text = F.lower(strip(F.coalesce(x, F.lit(""))))
    out = text
    for label, spellings in CALL_TYPES.items():
        out = F.when(text.isin(*spellings), label).otherwise(out)
    return out


def call_type(filename: Column) -> Column:
    name = F.lower(filename)
    leader = F.contains(name, F.lit("salesleader")) | F.contains(name, F.lit("sales leader")) | F.contains(name, F.lit("saleleader"))
    return F.when(F.contains(name, F.lit("sqccb")), "SQCCB").when(leader, "Sales Leader Confirmation").otherwise("Sales Call")


def parse_names(files: DataFrame) -> DataFrame:
    """``filename, sample_no, language, call_type``; names with fewer than three parts or another language are left out."""
    name = F.when(F.col("filename").endswith(".xlsx"), F.replace("filename", F.lit(".xlsx"), F.lit(".csv"))).otherwise(F.col("filename"))
    base = F.replace(F.replace(name, F.lit(".csv"), F.lit("")), F.lit(".wav"), F.lit(""))
    parts = F.split(base, "_")
    languages = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    out = files.select("filename", F.get(parts, F.lit(0)).alias("sample_no"), F.try_element_at(languages, F.upper(F.element_at(parts, -1))).alias("language"), call_type(name).alias("call_type"), F.size(parts).alias("_n"))
    return out.filter((F.col("_n") >= 3) & F.col("language").isNotNull()).drop("_n")


def pick_mapping(tasks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each task with its sample's product: from the row of the same call type, else from the sample's first row.

    ``mapping``: sample_no, product_name, call_type, map_row. Tasks of unknown samples are left out.
    """
    rows = mapping.select(F.col("sample_no").cast("string").alias("sample_no"), "product_name", normalize_call_type(F.col("call_type")).alias("_type"), "map_row")
    joined = tasks.join(rows, "sample_no").withColumn("_same", (F.col("_type") == normalize_call_type(F.col("call_type"))).cast("int"))
    place = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("_same"), "map_row"))
    return joined.withColumn("_place", place).filter("_place = 1").drop("_place", "_same", "_type", "map_row")


def route(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """``filename, sample_no, language, product_name, call_type, script_sheet``.

    Calls of the two special types keep a mapped product only if it begins like the type; a sales call needs one.
    """
    picked = pick_mapping(parse_names(files), mapping)
    product = F.nullif(strip(F.coalesce(F.col("product_name"), F.lit(""))), F.lit(""))
    lower = F.lower(product)
    leader = lower.startswith("salesleader") | lower.startswith("saleleader") | lower.startswith("sales leader")
    name = (
        F.when(F.col("call_type") == "SQCCB", F.when(lower.startswith("sqccb"), product).otherwise("SQCCB"))
        .when(F.col("call_type") == "Sales Leader Confirmation", F.when(leader, product).otherwise("SalesLeader"))
        .otherwise(product)
    )
    out = picked.withColumn("product_name", name).filter("product_name is not null")
    return out.select("filename", "sample_no", "language", "product_name", "call_type", F.concat_ws("_", "product_name", "language").alias("script_sheet"))


def language_of_file(filename: Column, sheet: Column | None = None) -> Column:
    """By the name's suffix in either case, else by the sheet's."""
    base = F.regexp_replace(filename, r"(\.wav)?\.(csv|xlsx?)$", "")
    languages = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    own = F.try_element_at(languages, F.upper(F.regexp_extract(base, "_([CMEcme])$", 1)))
    return own if sheet is None else F.coalesce(own, F.nullif(F.regexp_extract(sheet, "_(CAN|MAN|ENG)$", 1), F.lit("")))
