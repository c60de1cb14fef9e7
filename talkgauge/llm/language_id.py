"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams per language in the tasks, adds them up in a shuffle, and brings one
matrix of ``languages x buckets`` to the driver, whose size the parameters fix. Log-probabilities
go to the executors as a broadcast. Scoring takes whole texts: the n-grams of a group of texts are hashed
as one array, their rows of the matrix are gathered, and sums between the texts' ends are the
log-likelihoods; no dense document vector is ever made.

The classifier is fitted on about ``per_language`` labelled rows of each language, chosen by a hash of the
text and of the row's id and not by their order, so copies of a text are chosen apart and the sample keeps its bound whatever repeats. The labels' names are learned from those rows.

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing was
learned. Rows with a null label are never learned from. Equal scores go to the first label in
alphabetical order. Repeated rows are scored each; an empty table gives no rows. Columns are passed on as they are, but for those
named ``lang_pred``, ``score`` and, in language_id(), ``held_out``, which the results replace. Whole texts are scored, however long.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import each_text

UNDETERMINED = "und"
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled rows of each language that the fit uses, about; a bound on the sample, not on what is scored.
PER_LANGUAGE = 4_000
#: Labels that are learned at most; a table with more distinct ones isn't a table of languages.
MAX_LANGUAGES = 512
#: Characters scored together.
GROUP_CHARS = 500_000
#: n-grams whose log-probabilities count in full; more of them are scaled down to so many for the score, since n-grams of a text depend on each other.
EVIDENCE = 200
#: Least likelihood of a text in a learned language, as likelihoods() has it; the least of a test table's document is 3.3, of Finnish up to 2.6, of random letters up to 1.4.
LEAST = 2.7
_PRIME = np.uint32(0x9E3779B1)
_WORD, _DIGIT = re.compile(r"[^\W\d_]+"), re.compile(r"\d")


@cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def ngrams(codes: np.ndarray, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that ends at each code point from the order-th on."""
    shift = np.uint32(33 - buckets.bit_length())
    out, rolled = [], np.zeros(len(codes), dtype=np.uint32)
    for order in range(1, max(orders) + 1):
        previous = np.concatenate([np.zeros(1, np.uint32), rolled[:-1]]) if order > 1 else rolled
        rolled = (previous * np.uint32(31) + codes + np.uint32(order)) * _PRIME
        rolled ^= rolled >> np.uint32(15)
        if order in orders:
            out.append((rolled[order - 1 :] * _PRIME) >> shift)
    return out


@dataclass(frozen=True)
class Model:
    """``log_prob`` has a row for each of the sorted labels and a column for each bucket."""

    labels: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...] = ORDERS


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", doc_id: str | None = None, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Model:
    """Learns from a bounded sample of the labelled rows: about per_language rows of each label, by a hash of text and doc_id, if there is one."""
    key = F.xxhash64(F.col(text), *([F.col(doc_id)] if doc_id else []))
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), key.alias("key")).dropna()
    counts = {row[0]: row[1] for row in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    labels = tuple(sorted(counts))
    if not labels:
        return Model((), np.zeros((0, buckets)), np.zeros(0), orders)
    scale = 1 << 20
    share = F.create_map(*[x for label in labels for x in (F.lit(label), F.lit(min(scale, per_language * scale // counts[label] + 1)))])
    sample = rows.filter(F.pmod("key", F.lit(scale)) < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, x in zip(batch.column(0).to_pylist(), each_text(batch.column(1))):
                held = total.setdefault(label, np.zeros(buckets, np.int64))
                for grams in ngrams(code_points(x), buckets, orders):
                    held += np.bincount(grams, minlength=buckets)
        for label, held in total.items():
            found = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.string()), pa.array(found), pa.array(held[found])], names=["lang", "bucket", "n"])

    summed = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {label: i for i, label in enumerate(labels)}
    matrix = np.zeros((buckets, len(labels)), np.float64)
    columns = np.array([place[label] for label in summed.column("lang").to_pylist()], dtype=np.int64)
    matrix[summed.column("bucket").to_numpy(), columns] = summed.column("n").to_numpy()
    log_prob = np.log(matrix + 0.5) - np.log(matrix.sum(axis=0) + 0.5 * buckets)
    return Model(labels, np.ascontiguousarray(log_prob.T), np.full(len(labels), -np.log(len(labels))), orders)


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and score of each whole text; the score is the label's share of the posterior."""
    predicted, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    codes = [code_points(x) if x else np.zeros(0, np.uint32) for x in texts]
    letters = _letters()
    rows = [i for i, x in enumerate(codes) if len(x) and len(model.labels) and letters[x].any()]
    if not rows:
        return predicted, scores
    sizes = np.array([len(codes[i]) for i in rows])
    ends = np.cumsum(sizes)
    joined = np.concatenate([codes[i] for i in rows])
    sums, seen = np.tile(model.log_prior, (len(rows), 1)), np.zeros(len(rows))
    for order, grams in zip(sorted(model.orders), ngrams(joined, model.log_prob.shape[1], model.orders)):
        # An n-gram is counted by its first character, up to where it would reach into the next text.
        first, last = np.minimum(ends - sizes, len(grams)), np.maximum(ends - order + 1, ends - sizes)
        own = np.stack([first, np.minimum(last, len(grams))], axis=1)
        steps = np.zeros(len(grams) + 1)
        for column, table in enumerate(model.log_prob):
            np.take(table, grams, out=steps[:-1], mode="clip")
            total = np.add.reduceat(steps, own.ravel())[::2]
            sums[:, column] += np.where(own[:, 1] > own[:, 0], total, 0.0)
        seen += own[:, 1] - own[:, 0]
    best = sums.argmax(axis=1)
    gaps = (sums - sums.max(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / np.maximum(seen, 1))[:, None]
    share = 1 / np.exp(gaps).sum(axis=1)
    for i, label, score in zip(rows, best.tolist(), share.tolist()):
        predicted[i], scores[i] = model.labels[label], score
    return predicted, scores


def _words(text: str | None) -> str:
    """The text's words without numbers, keys and the like: what holds a digit isn't a word of any language."""
    return " ".join(_WORD.findall(" ".join(x for x in (text or "").split() if not _DIGIT.search(x))))


def likelihoods(model: Model, texts: Iterable[str | None]) -> list[float | None]:
    """Of each text's words, the mean log-probability of an n-gram in the likeliest language, over that of a bucket by chance; null without words."""
    out: list[float | None] = []
    for text in texts:
        grams = ngrams(code_points(x), model.log_prob.shape[1], model.orders) if (x := _words(text)) and model.labels else []
        joined = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        out.append(float(max(table[joined].mean() for table in model.log_prob) + np.log(model.log_prob.shape[1])) if len(joined) else None)
    return out


def known_language(docs: DataFrame, model: Model, least: float = LEAST, text: str = "text") -> DataFrame:
    """The documents in a learned language: with words, and n-grams that are as likely as least in one of the languages."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def judge(texts: pa.Array) -> pa.Array:
        return pa.array(likelihoods(shared.value, each_text(texts)), pa.float64())

    return docs.filter(judge(F.col(text)) >= least)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of the documents, with ``lang_pred`` and ``score`` in place of any columns so named."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def classify(texts: pa.Array) -> pa.Array:
        labels, scores, group, chars = [], [], [], 0

        def done():
            found = score_texts(shared.value, group)
            labels.extend(found[0])
            scores.extend(found[1])

        for x in each_text(texts):
            if group and chars + len(x or "") > GROUP_CHARS:
                done()
                group, chars = [], 0
            group.append(x)
            chars += len(x or "")
        done()
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    taken = {"lang_pred", "score"}
    kept = [F.col(f"`{name}`") for name in docs.columns if name.lower() not in taken]
    found = classify(F.col(text))
    return docs.select(*kept, found.alias("lang_pred")).select(*kept, F.col("lang_pred.score").alias("score"), F.col("lang_pred.lang_pred").alias("lang_pred"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is in the test fold: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_fold(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on the labelled documents outside the test fold."""
    return fit(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1), doc_id="doc_id", per_language=per_language)


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fits on the labelled documents outside the test fold and predicts every document's language.

    A row with a null id is in no fold: it isn't learned from and counts as not held out.
    """
    return predict(docs.withColumn("held_out", held_out()), fit_fold(docs, per_language))
