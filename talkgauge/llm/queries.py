"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgauge.llm.decontaminate import overlaps
from talkgauge.llm.language_id import language_id
from talkgauge.llm.licenses import scan
from talkgauge.llm.packing import pack
from talkgauge.llm.pii import KINDS, pseudonymize
from talkgauge.llm.simhash import near_duplicates
from talkgauge.llm.token_counts import token_counts
from talkgauge.llm.url_filter import filter_urls
from talkgauge.llm.va_file import top_k
from talkgauge.llm.warc import archive_round_trip

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: The registered query's key, for its results to be the same in each run; a deployment has its own, kept secret.
PII_KEY = b"key of the registered query"
#: Host, path and action of the registered query's rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)
    return docs.select("doc_id", "text", *(F.coalesce(F.col("pii_counts")[kind], F.lit(0)).alias(f"n_{kind}") for kind in KINDS))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = archive_round_trip(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_diff=2)


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
