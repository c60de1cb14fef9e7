"""Roll-up over calls: one row each, with outliers flagged against all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgauge.functions import text as t

SHORT, LONG = "Unusually Short", "Unusually Long"


def iqr_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column the bounds Q1 - 1.5 IQR and Q3 + 1.5 IQR, with exact linear quantiles."""
    quartiles = df.agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in columns))
    low = lambda c: F.get(F.col(c), F.lit(0)) - 1.5 * (F.get(F.col(c), F.lit(1)) - F.get(F.col(c), F.lit(0)))
    high = lambda c: F.get(F.col(c), F.lit(1)) + 1.5 * (F.get(F.col(c), F.lit(1)) - F.get(F.col(c), F.lit(0)))
    return quartiles.select(*(x for c in columns for x in (low(c).alias(f"_low_{c}"), high(c).alias(f"_high_{c}"))))


def flag_outliers(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a flag column for each stated column; values inside the bounds and nulls have an empty flag."""
    bounds = iqr_bounds(df, list(columns))
    out = df.crossJoin(F.broadcast(bounds))  # one row of bounds
    for c, flag in columns.items():
        out = out.withColumn(flag, F.when(F.col(c) < F.col(f"_low_{c}"), SHORT).when(F.col(c) > F.col(f"_high_{c}"), LONG).otherwise(""))
    return out.drop(*bounds.columns)


def call_summary(tasks: DataFrame, kpis: DataFrame, roles: DataFrame) -> DataFrame:
    """One row for each call: its routing, coverage, duration and word counts, with outlier flags."""
    out = tasks.join(kpis, "call_id").join(roles, "call_id", "left").withColumn("total_seconds", t.seconds_of(F.col("total_duration")))
    for c in ("sales_word_count", "customer_word_count"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    out = flag_outliers(out, {"total_seconds": "duration_outlier", "sales_word_count": "sales_wc_outlier", "customer_word_count": "customer_wc_outlier"})
    return out.select(
        "call_id", "sample_no", "product_name", "language", "call_type", "coverage_rate", "total_points", "covered_points", "total_seconds",
        t.mmss(F.col("total_seconds")).alias("total_mmss"), "duration_outlier", "sales_word_count", "sales_wc_outlier", "customer_word_count", "customer_wc_outlier",
    )


def outlier_counts(summary: DataFrame) -> DataFrame:
    flags = ["duration_outlier", "sales_wc_outlier", "customer_wc_outlier"]
    return summary.agg(*(F.count_if(F.col(c) != "").alias(c.replace("outlier", "outliers")) for c in flags))


def batch_statistics(log: DataFrame) -> DataFrame:
    """Totals of a batch: tasks, successes, failures, and the share of successes in per cent. ``log`` has ``status``."""
    done = F.col("status") == "SUCCESS"
    return log.agg(F.count("*").alias("total_tasks"), F.count_if(done).alias("successful"), F.count_if(~done).alias("failed"), F.coalesce(F.try_divide(F.count_if(done) * 100.0, F.count("*")), F.lit(0.0)).alias("success_rate"))
