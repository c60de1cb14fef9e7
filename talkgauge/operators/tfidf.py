"""Character n-gram TF-IDF cosine, fitted per call and weighted by business terms.

Vectors are rows (n-gram, value), so a call's vocabulary is never one object. With tf' = 1 + ln tf and
idf = ln((1 + n) / (1 + df)) + 1; row norms are left out, since weights multiply afterwards and the cosine divides by norms again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgauge.functions.arrays import chars, let

ORDERS = (2, 3, 4)
MAX_FEATURES = 50_000


def char_ngrams(doc: Column, orders: Iterable[int] = ORDERS) -> Column:
    """All n-grams of a text, spaces included, order by order."""
    def of(letters: Column, n: int) -> Column:
        gram = lambda c, i: F.concat(c, *(F.get(letters, i + j) for j in range(1, n)))
        return F.transform(F.slice(letters, F.lit(1), F.greatest(F.size(letters) - (n - 1), F.lit(0))), gram)

    return let(chars(doc), lambda letters: F.flatten(F.array(*(of(letters, n) for n in orders))))


def ngram_frequencies(calls: DataFrame, text: Column) -> DataFrame:
    """``call_id, gram, n``: how often each n-gram occurs in a call's texts."""
    return calls.select("call_id", F.explode(char_ngrams(text)).alias("gram")).groupBy("call_id", "gram").agg(F.count("*").alias("n"))


def term_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` has tokens; a text is its tokens with spaces between. Texts without tokens have no rows."""
    rows = docs.filter(F.size("tokens") > 0).select(*keys, F.explode(char_ngrams(F.array_join("tokens", " "))).alias("gram"))
    return rows.groupBy(*keys, "gram").agg(F.count("*").alias("tf"))


def inverse_frequencies(corpus: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """``call_id, gram, idf`` over a corpus ``call_id, doc, tokens``; of more n-grams than max_features the most frequent."""
    counts = term_counts(corpus, ["call_id", "doc"])
    totals = corpus.filter(F.size("tokens") > 0).groupBy("call_id").agg(F.count("*").alias("n_docs"))
    grams = counts.groupBy("call_id", "gram").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy(F.desc("total"), "gram"))
    grams = grams.withColumn("place", place).filter(F.col("place") <= max_features)
    return grams.join(totals, "call_id").select("call_id", "gram", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def vectors(docs: DataFrame, keys: list[str], idf: DataFrame) -> DataFrame:
    """``keys, gram, x``; keys include call_id. n-grams outside the vocabulary are left out."""
    return term_counts(docs, keys).join(idf, ["call_id", "gram"]).select(*keys, "gram", ((1 + F.log("tf")) * F.col("idf")).alias("x"))


def gram_weights(terms: DataFrame, stopwords: Iterable[str]) -> DataFrame:
    """``point, gram, w``: a stopword of two to four characters weighs nothing on any point, a core term its weight; all else weighs 1.

    ``terms`` has ``point, term, weight``.
    """
    stop = sorted(w for w in stopwords if 2 <= len(w) <= 4)
    core = terms.filter(F.length("term").between(2, 4) & ~F.col("term").isin(stop)).select("point", F.col("term").alias("gram"), F.col("weight").alias("w"))
    zero = terms.select("point").distinct().select("point", F.explode(F.array(*map(F.lit, stop))).alias("gram"), F.lit(0.0).alias("w")) if stop else core.limit(0)
    return core.union(zero)


def weighted_cosine(left: DataFrame, right: DataFrame, weights: DataFrame) -> DataFrame:
    """``call_id, left_id, right_id, point, cosine`` for pairs of a call that share an n-gram of weight.

    ``left``: call_id, left_id, gram, x; ``right``: call_id, right_id, point, gram, x. Pairs that are absent have cosine 0.
    """
    w = F.coalesce(F.col("w"), F.lit(1.0))
    r = right.join(weights, ["point", "gram"], "left").select("call_id", "right_id", "point", "gram", (F.col("x") * w).alias("y"), w.alias("w")).filter("y <> 0")
    r_norm = r.groupBy("call_id", "right_id", "point").agg(F.sum(F.col("y") * F.col("y")).alias("r2"))
    dots = left.join(r, ["call_id", "gram"]).groupBy("call_id", "left_id", "right_id", "point").agg(F.sum(F.col("x") * F.col("w") * F.col("y")).alias("dot"))
    points = right.select("call_id", "point").distinct()
    base = left.groupBy("call_id", "left_id").agg(F.sum(F.col("x") * F.col("x")).alias("base"))
    change = left.join(weights, "gram").groupBy("call_id", "left_id", "point").agg(F.sum(F.col("x") * F.col("x") * (F.col("w") * F.col("w") - 1)).alias("change"))
    l_norm = base.join(points, "call_id").join(change, ["call_id", "left_id", "point"], "left").select("call_id", "left_id", "point", (F.col("base") + F.coalesce("change", F.lit(0.0))).alias("l2"))
    found = dots.join(r_norm, ["call_id", "right_id", "point"]).join(l_norm, ["call_id", "left_id", "point"])
    return found.filter("l2 > 0").select("call_id", "left_id", "right_id", "point", (F.col("dot") / F.sqrt(F.col("l2") * F.col("r2"))).alias("cosine"))
