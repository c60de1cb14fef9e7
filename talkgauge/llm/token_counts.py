"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Each text is encoded once. From then on only the histogram is used: one row per length that
occurs, so it is bounded by the longest text and not by the number of documents. Sums over all
greater lengths give, for every context limit, how many documents and tokens fit, how many are cut,
and what stays after truncation.

A null text counts as the empty text and has no tokens, an empty table has an empty histogram, and
repeated rows count each. Columns other than the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgauge.llm.common import each_text, materialize
from talkgauge.llm.tokens import encoder

#: Lengths in one block of the two-level suffix sum: one sum runs inside blocks, one over block totals.
BLOCK = 256


def token_lengths(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """One row ``n_tokens`` for each text; a stated column keeps the batch's order of rows."""

    def lengths(batches):
        ids = encoder(tokenizer)
        for batch in batches:
            counts = [len(data) // 4 for data in ids.id_bytes(each_text(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``n_tokens, documents``: exact counts, combined in each task before they are shuffled."""
    return token_lengths(docs, tokenizer, text).groupBy("n_tokens").agg(F.count("*").alias("documents"))


def context_curve(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs, as a context limit: what fits, what is over it, what truncation keeps.

    ``documents_over`` and ``tokens_over`` are the suffix sums. The histogram must be a table, since it
    is read three times. Only the totals of blocks pass through a single task.
    """
    rows = histogram.select(
        "n_tokens", "documents", (F.col("n_tokens") * F.col("documents")).alias("tokens"),
        F.floor(F.col("n_tokens") / block).alias("block"),
    )
    totals = rows.groupBy("block").agg(F.sum("documents").alias("block_documents"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select(
        "block",
        F.coalesce(F.sum("block_documents").over(after), F.lit(0)).alias("documents_above"),
        F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_above"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda name: F.coalesce(F.sum(name).over(inside), F.lit(0)) + F.col(f"{name}_above")
    sums = rows.join(above, "block").select("n_tokens", "documents", over("documents").alias("documents_over"), over("tokens").alias("tokens_over"))
    whole = histogram.agg(F.sum("documents").alias("all_documents"), F.sum(F.col("n_tokens") * F.col("documents")).alias("all_tokens"))
    within = F.col("all_tokens") - F.col("tokens_over")
    kept = within + F.col("n_tokens") * F.col("documents_over")
    return sums.crossJoin(F.broadcast(whole)).select(  # one row of totals
        F.col("n_tokens").alias("context_limit"), "documents",
        (F.col("all_documents") - F.col("documents_over")).alias("documents_within"), "documents_over",
        within.alias("tokens_within"), "tokens_over",
        kept.alias("truncated_tokens"), (F.col("all_tokens") - kept).alias("dropped_tokens"),
        ((F.col("all_documents") - F.col("documents_over")) / F.col("all_documents")).alias("share_within"),
    )


def quantiles(curve: DataFrame, shares: Iterable[float]) -> dict[float, int | None]:
    """The smallest length that at least each share of the documents doesn't exceed; None without documents."""
    shares = list(shares)
    total = curve.agg(F.max("documents_within")).first()[0]
    if total is None:
        return dict.fromkeys(shares)
    least = [max(1, math.ceil(share * total)) for share in shares]
    row = curve.agg(*(F.min(F.when(F.col("documents_within") >= n, F.col("context_limit"))).alias(f"q{i}") for i, n in enumerate(least))).first()
    return dict(zip(shares, row))


def at_limits(curve: DataFrame, limits: Iterable[int]) -> dict[int, dict[str, int]]:
    """Documents and tokens that fit any context limits, and tokens after truncation to them."""
    limits = list(limits)
    fits = lambda limit: F.max_by(F.struct("documents_within", "tokens_within"), F.when(F.col("context_limit") <= limit, F.col("context_limit")))
    row = curve.agg(F.max("documents_within").alias("all"), *(fits(limit).alias(f"l{i}") for i, limit in enumerate(limits))).first()
    out = {}
    for limit, found in zip(limits, row[1:]):
        documents, tokens = (found[0], found[1]) if found else (0, 0)
        out[limit] = {"documents_within": documents, "tokens_within": tokens, "truncated_tokens": tokens + limit * ((row[0] or 0) - documents)}
    return out


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """The context curve of a table of documents, from one pass over its texts."""
    return context_curve(materialize(length_histogram(docs, tokenizer, text), "lengths"))
