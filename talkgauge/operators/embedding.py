"""Text vectors: the model is a plug-in, with a dependency-free default.

An embedder takes a list of texts and returns an array with a row for each. The default
hashes character n-grams; its cosines are lexical and don't equal those of a sentence model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.functions import text as t
from talkgauge.operators.scripts import offline_variations

Embedder = Callable[[list[str]], np.ndarray]


class HashingEmbedder:
    """Signed counts of hashed character n-grams, of length one."""

    def __init__(self, size: int = 128, orders: tuple[int, ...] = (2, 3, 4)):
        self.size, self.orders = size, orders

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size), np.float32)
        for row, x in zip(out, texts):
            for n in self.orders:
                for i in range(len(x) - n + 1):
                    h = int.from_bytes(hashlib.blake2b(x[i : i + n].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                    row[h % self.size] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


class SentenceModel:
    """A sentence-transformers model from a path, loaded once in each worker."""

    def __init__(self, path: str):
        self.path, self._model = path, None

    def __getstate__(self):
        return {"path": self.path, "_model": None}

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self._model is None:
            from sentence_transformers import SentenceTransformer

            self._model = SentenceTransformer(self.path)
        return np.asarray(self._model.encode(texts), np.float32)


def embed(x: Column, embedder: Embedder) -> Column:
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pa.Array) -> pa.Array:
        vectors = embedder([s or "" for s in texts.to_pylist()])
        return pa.array([v.tolist() for v in vectors], pa.list_(pa.float32()))

    return encode(x)


def script_embeddings(scripts: DataFrame, language: str, embedder: Embedder) -> DataFrame:
    """``clean_text, embedding``: each distinct clean text of scripts and their offline variations, encoded once."""
    texts = scripts.filter("standard_script is not null").select(F.explode(F.concat(F.array("standard_script"), offline_variations(F.col("standard_script")))).alias("x"))
    clean = texts.select(t.clean(F.col("x"), language).alias("clean_text")).filter(F.length("clean_text") > 0).distinct()
    return clean.withColumn("embedding", embed(F.col("clean_text"), embedder))


def normalize_keys(embeddings: DataFrame, language: str) -> DataFrame:
    """Vectors by clean text; of keys that clean to the same text the first in order of the original wins."""
    return embeddings.groupBy(t.clean(F.col("clean_text"), language).alias("clean_text")).agg(F.min_by("embedding", embeddings["clean_text"]).alias("embedding"))


def with_vectors(df: DataFrame, clean: str, embeddings: DataFrame, embedder: Embedder, vector: str = "vector") -> DataFrame:
    """Looks vectors up by clean text; texts that have none are encoded, each distinct one once."""
    wanted = df.select(F.col(clean).alias("clean_text")).distinct()
    known = wanted.join(embeddings, "clean_text", "left")
    missing = known.filter("embedding is null").select("clean_text").withColumn("embedding", embed(F.col("clean_text"), embedder))
    found = known.filter("embedding is not null").unionByName(missing).select(F.col("clean_text").alias("_key"), F.col("embedding").alias(vector))
    return df.join(found, df[clean] == found["_key"], "left").drop("_key")
