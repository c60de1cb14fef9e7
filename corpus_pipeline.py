"""A training-corpus pipeline over ``documents``: five stages, each one operator of talkgauge.llm.

Every stage but the last returns the columns of ``documents``, so its result can be written and read
again as the next one's input. ``run`` does that in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.llm.common import materialize
from talkgauge.llm.decontaminate import drop_contaminated
from talkgauge.llm.language_id import fit_fold, known_language
from talkgauge.llm.packing import pack
from talkgauge.llm.pii import pseudonymize
from talkgauge.llm.queries import PII_KEY, TOKENIZER
from talkgauge.llm.similar import similar_documents

#: A row of the documents table, also where ids are null or repeated.
ROW = "talkgauge_row"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no learned language: those whose n-grams are unlikely in all of them, as noise is.

    Learns from the labelled documents outside the test fold. A null or blank text, or one without a word, goes; repeated rows are judged
    each; without labels nothing is learned and nothing stays. An empty table stays empty.
    """
    return known_language(docs, fit_fold(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id, and one row of it: copies, fingerprints
    within two bits, and texts whose sets of five-word shingles have a similarity of 0.8 or more.

    Null and blank texts are copies of each other. A null id comes before all others; rows that share an id are told apart by a number that is
    written with them once. An empty table stays empty.
    """
    rows = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    groups = similar_documents(rows.withColumn(ROW, F.struct("doc_id", ROW)), min_similarity=0.8, shingle=5, doc_id=ROW)
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col(f"doc_id.{ROW}").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item. Null and empty texts overlap none and stay, repeated rows are judged each, and
    an empty table or benchmark drops nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal numbers, dates and addresses in the texts; n_chars follows the text.

    Null and empty texts stay as they are, with their n_chars; repeated rows are handled each, equally; an empty table stays empty.
    """
    changed = F.aggregate(F.map_values("pii_counts"), F.lit(0), lambda total, n: total + n) > 0
    replaced = pseudonymize(docs, PII_KEY)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        replaced = replaced.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return replaced.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids in sequences of 2,048: a row for each piece, with its place and its ``ids``.

    A null text is empty and has one token, as an empty one; repeated rows are documents of their own; an empty table gives no pieces.
    """
    return pack(docs, TOKENIZER, keep_ids=True)


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL has neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
