"""Exact top-k search by integer inner product, over a vector-approximation file.

The file holds each vector twice: as one byte for each component, the quantised cell that it lies in,
and exactly. A search reads the cells of all vectors and gets from them, for each query, bounds
of the score. The k-th greatest lower bound over all tasks is a score that the result reaches for
certain, so vectors whose upper bound is below it are out. The rest are read exactly, in
the order of their bounds (greatest upper bound first, as the least distance), until the k-th score
found is above all bounds that are left.

Queries go out in blocks of a fixed number, so what a task holds doesn't grow with their number; a task takes them in
portions, so that one pass over the file serves many. A block costs two passes, of which the first reads cells alone, and its results are a part of
one table. Each task returns k rows for a query at most. The second pass reads the column of exact vectors as well: where a hundredth of all vectors are queries, nearly each
vector is a candidate of one of them, and a row's cells and its vector lie side by side, so only what bounds leave is taken out of a batch and computed with.

A table without vectors gives no rows, and other columns are ignored, whatever their names. A vector of any length is quantised whole.

Components are floor(scale * x) with x as double. A vector that is null or that holds a null or
non-finite component takes no part, nor does a row without an id. Vectors are compared with vectors of
their own length. Rows are told apart by their id: rows that share the query's id are not its candidates, and a query
id that occurs in several rows is searched once, with the first of its vectors in order of their components.
Ties go to the smaller id; equal rows of one id each count. Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgauge.llm.common import materialize, shared_path

SCALE = 1024
#: Cells of a component between its least and greatest value; a cell's number takes a byte.
CELLS = 64
#: Queries of one block, 16 MB of 64 components each, and those of a block bounded together.
BLOCK_QUERIES, PORTION = 32_000, 2_000
#: Vectors of the file bounded together, for each block of queries.
ROWS = 2_000


def integer_vectors(table: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: the components that take part, as longs."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return table.filter(v.isNotNull() & F.col(vec_id).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, the least and the greatest value of each component."""
    each = vectors.select(F.size("v").alias("dims"), F.posexplode("v").alias("pos", "x"))
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.zeros(0), np.zeros(0))}
    for dims, pos, low, high in each.groupBy("dims", "pos").agg(F.min("x"), F.max("x")).collect():
        lows, highs = found.setdefault(dims, (np.zeros(dims), np.zeros(dims)))
        lows[pos], highs[pos] = low, high
    return found


def build(vectors: DataFrame, cells: int = CELLS):
    """The file as a table ``vec_id, cells, v``, and the edges of cells for each length of vectors."""
    edges = {}
    for dims, (low, high) in ranges(vectors).items():
        step = np.maximum(1, -(-(high - low + 1) // cells))
        edges[dims] = (low, step)

    def quantise(batches):
        for batch in batches:
            codes = []
            for v in batch.column(1):
                x = np.array(v.as_py(), dtype=np.float64)
                low, step = edges[len(x)]
                codes.append(((x - low) // step).clip(0, cells - 1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary()), batch.column(1)], names=["vec_id", "cells", "v"])

    return materialize(vectors.mapInArrow(quantise, "vec_id long, cells binary, v array<long>"), "va-file"), edges


def _chunks(batches, rows: int = ROWS):
    """(dims, ids, cells, places, batch) of vectors of one length."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            ids = batch.column(0).to_numpy()
            codes = batch.column(1).to_pylist()
            sizes = np.array([len(c) for c in codes])
            for dims in np.unique(sizes):
                places = np.flatnonzero(sizes == dims)
                cells = np.frombuffer(b"".join(codes[i] for i in places), dtype=np.uint8).reshape(len(places), int(dims))
                yield int(dims), ids[places], cells, places, batch


def _bounds(edges, dims: int, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, one row for each vector and one column for each query."""
    low, step = edges[dims]
    middle = low + cells * step + (step - 1) / 2
    width = np.broadcast_to((step - 1) / 2, middle.shape)
    q = queries.astype(np.float64)
    centre, spread = middle @ q.T, width @ np.abs(q).T
    spread = spread + 1e-9 * (np.abs(centre) + spread) + 1e-6  # what rounding may cost
    return centre - spread, centre + spread


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    limit = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if limit < 2.0**62:
        return vectors @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors], dtype=np.int64)


def _portions(own: np.ndarray, vectors: np.ndarray, size: int = PORTION):
    """(slice, ids, vectors) of a block's queries of one length."""
    for start in range(0, len(own), size):
        part = slice(start, start + size)
        yield part, own[part], vectors[part]


def _by_length(block: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out: dict[int, list] = {}
    for vec_id, v in block:
        out.setdefault(len(v), []).append((vec_id, v))
    return {dims: (np.array([x[0] for x in rows]), np.array([x[1] for x in rows], dtype=np.int64).reshape(len(rows), dims)) for dims, rows in out.items()}


def _certain(file: DataFrame, edges, queries, k: int) -> DataFrame:
    """``query_id, least``: a score that a query's k-th result reaches for certain; none with fewer than k candidates."""

    def lower(batches):
        kept = {dims: np.full((k, len(ids)), -np.inf) for dims, (ids, _) in queries.value.items()}
        for dims, ids, cells, _, _ in _chunks(batches):
            for part, own, vectors in _portions(*queries.value[dims]) if dims in kept else ():
                bound, _ = _bounds(edges, dims, cells, vectors)
                bound[ids[:, None] == own[None, :]] = -np.inf
                both = np.concatenate([kept[dims][:, part], bound])
                kept[dims][:, part] = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
        for dims, best in kept.items():
            ids = np.repeat(queries.value[dims][0], k)
            values = best.T.ravel()
            real = np.isfinite(values)
            yield pa.RecordBatch.from_arrays([pa.array(ids[real]), pa.array(values[real])], names=["query_id", "bound"])

    ranked = F.sort_array(F.collect_list("bound"), asc=False)
    return file.select("vec_id", "cells").mapInArrow(lower, "query_id long, bound double").groupBy("query_id").agg(F.get(ranked, F.lit(k - 1)).alias("least"))


def _read(file: DataFrame, edges, queries, least, k: int) -> DataFrame:
    """Each task's k best of the vectors that the bounds leave, by exact scores."""

    def best(batches):
        found: dict[int, list[tuple[int, int]]] = {}
        for dims, ids, cells, places, batch in _chunks(batches):
            exact = batch.column(2)
            for _, own, vectors in _portions(*queries.value[dims]) if dims in queries.value else ():
                _, upper = _bounds(edges, dims, cells, vectors)
                upper[ids[:, None] == own[None, :]] = -np.inf
                floor = np.array([least.value.get(int(q), -np.inf) for q in own])
                for column in np.flatnonzero((upper >= floor).any(axis=0) & (upper.max(axis=0) > -np.inf)):
                    bound = upper[:, column]
                    order = np.flatnonzero((bound >= floor[column]) & (bound > -np.inf))
                    order = order[np.argsort(-bound[order], kind="stable")]
                    held = found.setdefault(int(own[column]), [])
                    for start in range(0, len(order), 4 * k):
                        some = order[start : start + 4 * k]
                        if len(held) >= k and bound[some[0]] < held[k - 1][0]:
                            break
                        x = np.array(exact.take(pa.array(places[some])).to_pylist(), dtype=np.int64).reshape(len(some), dims)
                        held += zip(_exact(x, vectors[column]).tolist(), ids[some].tolist())
                        held.sort(key=lambda pair: (-pair[0], pair[1]))
                        del held[k:]
        rows = [(query, vec, score) for query, held in found.items() for score, vec in held]
        for start in range(0, len(rows), 10_000):
            part = list(zip(*rows[start : start + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], names=["query_id", "vec_id", "score"])

    return file.mapInArrow(best, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best candidates, all if there are fewer.

    ``is_query`` tells the queries among the table's rows by their ``vec_id``.
    """
    spark = table.sparkSession
    file, edges = build(integer_vectors(table, vec_id, embedding, scale))
    asked = materialize(file.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    path = shared_path(spark, "found")

    def search(block):
        queries = spark.sparkContext.broadcast(_by_length(block))
        least = {row[0]: row[1] for row in _certain(file, edges, queries, k).filter("least is not null").collect()}  # a number for each query of the block
        found = _read(file, edges, queries, spark.sparkContext.broadcast(least), k)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        ranked = found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        ranked.write.mode("append").parquet(path)
        queries.unpersist()

    block: list[tuple[int, list[int]]] = []
    for row in asked.toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == block_queries:
            search(block)
            block = []
    if block:
        search(block)
    kind = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(kind).parquet(path) if not asked.isEmpty() else spark.createDataFrame([], kind)
