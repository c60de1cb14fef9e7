"""Term importance: which tokens set a point apart from the others."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkgauge import lexicon
from talkgauge.functions.text import strip

RATIO, LEAST, MOST = 0.15, 2, 16


def document_frequencies(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, token, df``: over how many points a token occurs; ``tokens`` has keys, point and token."""
    return tokens.groupBy(*keys, "token").agg(F.count_distinct("point").alias("df"))


def term_importance(tokens: DataFrame, keywords: Iterable[str], stopwords: Iterable[str] = (), keys: tuple[str, ...] = ("language", "product")) -> DataFrame:
    """``keys, point, term, weight``: for each point its most distinctive terms.

    A score is ln(points / df), doubled for important keywords. A point keeps 15 % of its distinct tokens, rounded up, at least 2
    and at most 16; equal scores go by the alphabet. Stopwords and blanks that were among them are left out then.
    """
    keys = list(keys)
    pairs = tokens.select(*keys, "point", "token").distinct()
    total = pairs.groupBy(*keys).agg(F.count_distinct("point").alias("n_points"))
    scored = pairs.join(document_frequencies(pairs, keys), [*keys, "token"]).join(total, keys)
    doubled = F.when(F.col("token").isin(sorted(keywords)), 2.0).otherwise(1.0)
    scored = scored.withColumn("weight", F.log(F.col("n_points") / F.col("df")) * doubled)
    point = Window.partitionBy(*keys, "point")
    n = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil(F.count("*").over(point) * F.lit(RATIO))))
    ranked = scored.withColumn("place", F.row_number().over(point.orderBy(F.desc("weight"), "token"))).withColumn("n", n)
    kept = ranked.filter((F.col("place") <= F.col("n")) & ~F.col("token").isin(sorted(stopwords)) & (F.length(strip(F.col("token"))) > 0))
    return kept.select(*keys, "point", F.col("token").alias("term"), "weight")


def product_weights(terms: DataFrame) -> DataFrame:
    """``language, product, term, weight``: a term's greatest weight over the product's points."""
    return terms.groupBy("language", "product", "term").agg(F.max("weight").alias("weight"))


def resolve_weights(wanted: DataFrame, terms: DataFrame) -> DataFrame:
    """``language, product, point, term, weight, level``: a point's own terms, else its product's, else the manual table."""
    points = wanted.select("language", "product", "point").distinct()
    own = points.join(terms, ["language", "product", "point"]).withColumn("level", F.lit("point"))
    rest = points.join(terms.select("language", "product", "point").distinct(), ["language", "product", "point"], "left_anti")
    product = rest.join(product_weights(terms), ["language", "product"]).withColumn("level", F.lit("product"))
    left = rest.join(terms.select("language", "product").distinct(), ["language", "product"], "left_anti")
    manual = F.explode(F.create_map(*[x for term, weight in sorted(lexicon.TERM_WEIGHTS.items()) for x in (F.lit(term), F.lit(weight))]))
    manual = left.select("language", "product", "point", manual.alias("term", "weight")).withColumn("level", F.lit("manual"))
    return own.unionByName(product).unionByName(manual)
