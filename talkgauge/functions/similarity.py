"""Similarity of two texts, from their characters, tokens and vectors."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge import config
from talkgauge.functions.arrays import chars, let
from talkgauge.functions.tokens import words_array

#: Bits of texts that go through another text together.
LANE = 1 << 16
_END = 0xFFFFFFFF


def lcs_short(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of characters, by a fold over rows of the table; for short texts."""
    def fold(letters: Column) -> Column:
        def row(previous, c):
            def step(new, j):
                kept = F.greatest(F.element_at(previous, j + 1), F.element_at(new, -1))
                return F.concat(new, F.array(F.when(F.element_at(letters, j) == c, F.element_at(previous, j) + 1).otherwise(kept)))

            return F.aggregate(F.sequence(F.lit(1), F.size(letters)), F.array(F.lit(0)), step)

        return F.aggregate(chars(a), F.array_repeat(F.lit(0), F.size(letters) + 1), row)

    found = F.element_at(let(chars(b), fold), -1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(found)


def lcs_length(a: str, b: str) -> int:
    """The same by bit-parallel rows (Hyyrö 2004): one machine operation for each word of the shorter text's bits."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if held := masks.get(c):
            u = row & held
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def lcs_blocks(texts: list[str], others: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """lcs_length of each text with each other text: the number of a block's first text, and a row for each of its texts.

    Bits of a block's texts stand side by side in one integer, each text's followed by a bit for its carry, so that a step takes all of them. Other texts that begin alike share the steps of their beginning.
    """
    order = sorted(range(len(others)), key=others.__getitem__)
    shared = [0, *(len(os.path.commonprefix([others[i], others[j]])) for i, j in zip(order, order[1:])), 0]
    wanted = {ord(c) for x in others for c in x}
    stop = 0
    while (start := stop) < len(texts):
        bits = 0
        while stop < len(texts) and (stop == start or bits + len(texts[stop]) < LANE):
            bits += len(texts[stop]) + 1
            stop += 1
        sizes = np.array([len(x) for x in texts[start:stop]])
        ends = np.cumsum(sizes + 1) - 1
        codes = np.frombuffer("".join(x + "\0" for x in texts[start:stop]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[ends] = _END
        number = lambda flags: int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
        full = number(codes != _END)
        masks = {chr(c): number(codes == c) for c in np.unique(codes).tolist() if c in wanted}

        def after(row: int, x: str, masks=masks, full=full) -> int:
            for c in x:
                if held := masks.get(c):
                    u = row & held
                    row = row + u & full | row ^ u
            return row

        out, kept = np.empty((stop - start, len(others)), np.int64), [(0, full)]
        for k, i in enumerate(order):
            while kept[-1][0] > shared[k]:
                kept.pop()
            (at, row), fork = kept[-1], shared[k + 1]
            if fork > at:
                row, at = after(row, others[i][at:fork]), fork
                kept.append((at, row))
            ones = np.frombuffer(after(row, others[i][at:]).to_bytes(len(codes) // 8 + 1, "little"), np.uint8)
            out[:, i] = sizes - np.add.reduceat(np.unpackbits(ones, count=len(codes), bitorder="little"), ends - sizes, dtype=np.int64)
        yield start, out


@F.arrow_udf(T.LongType())
def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    """lcs_length over Arrow batches; null if either text is."""
    return pa.array([None if x is None or y is None else lcs_length(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())


def f_measure(common: Column, a: Column, b: Column) -> Column:
    """F of precision and recall of a common subsequence: twice its length over both lengths; 0 if a text is empty."""
    return F.when((F.length(a) == 0) | (F.length(b) == 0) | (common == 0), 0.0).otherwise(F.lit(2.0) * common / (F.length(a) + F.length(b)))


def rouge_l(a: Column, b: Column) -> Column:
    """ROUGE-L over characters."""
    return f_measure(lcs(a, b), a, b)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def rouge_l_each(texts: pa.Array, other: pa.Array) -> pa.Array:
    """ROUGE-L of each text of an array with one other text; an empty array costs nothing."""

    def f(a: str, b: str) -> float:
        common = lcs_length(a, b) if a and b else 0
        return 2.0 * common / (len(a) + len(b)) if common else 0.0

    return pa.array([None if x is None or y is None else [f(a, y) for a in x] for x, y in zip(texts.to_pylist(), other.to_pylist())], pa.list_(pa.float64()))


def rouge_l_all(others: dict[str, list[str]]) -> Callable[[Column, Column], Column]:
    """A function of a key and a text: ROUGE-L of the text with each of the key's texts, in their order. Pairs don't go through Arrow, and equal texts of a batch are compared once."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def scores(keys: pa.Array, texts: pa.Array) -> pa.Array:
        keys, missing = keys.to_pylist(), texts.is_null().to_numpy(zero_copy_only=False)
        sizes = [0 if gone else len(others.get(key, ())) for key, gone in zip(keys, missing)]
        offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
        values, places = np.zeros(offsets[-1]), defaultdict(lambda: defaultdict(list))
        for at, (key, x) in enumerate(zip(keys, texts.to_pylist())):
            if sizes[at]:
                places[key][x].append(at)
        for key, own in places.items():
            distinct, lengths = list(own), np.array([len(x) for x in others[key]])
            for first, common in lcs_blocks(distinct, others[key]):
                for row, x in zip(common, distinct[first:]):
                    f = np.divide(2.0 * row, lengths + len(x), out=np.zeros(len(row)), where=row > 0)
                    for at in own[x]:
                        values[offsets[at] : offsets[at + 1]] = f
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(missing))

    return scores


def rouge_l_short(a: Column, b: Column) -> Column:
    return f_measure(lcs_short(a, b), a, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing, has no length, or lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(F.coalesce(dot(a, b) / norms, F.lit(0.0)))


def unit(a: Column) -> Column:
    """The vector with a length of one; a zero vector stays so, and a missing one missing."""
    scaled = lambda v: let(F.sqrt(dot(v, v)), lambda norm: F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm)))
    return let(a, scaled)


def cosine_of_units(a: Column, b: Column) -> Column:
    """The cosine of vectors of length one; 0 where a vector is missing or lengths differ."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def cosine_all(others: dict[str, list[list[float] | None]], embedder: Callable[[list[str]], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A function of a key and a text: cosine_of_units of the text's unit vector with each of the key's vectors, in their order; sums go over components in the order that the columns' functions have."""
    sizes = {key: len(own) for key, own in others.items()}
    blocks: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for key, own in others.items():
        places = defaultdict(list)
        for at, v in enumerate(own):
            places[None if v is None else len(v)].append(at)
        blocks[key] = [(np.array(at), np.array([own[i] for i in at], np.float64).T.copy()) for size, at in places.items() if size]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def cosines(keys: pa.Array, texts: pa.Array) -> pa.Array:
        keys, texts = keys.to_pylist(), [x or "" for x in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([sizes.get(key, 0) for key in keys], dtype=np.int64)]).astype(np.int32)
        values, places = np.zeros(offsets[-1]), defaultdict(list)
        for at, key in enumerate(keys):
            if sizes.get(key):
                places[key].append(at)
        for key, rows in places.items():
            step = max(1, (1 << 18) // sizes[key])
            for own in (rows[i : i + step] for i in range(0, len(rows), step)):
                mine = np.asarray(embedder([texts[i] for i in own]), np.float32).astype(np.float64)
                squares = np.zeros(len(own))
                for k in range(mine.shape[1]):
                    squares += mine[:, k] * mine[:, k]
                norms = np.sqrt(squares)[:, None]
                mine /= np.where(norms == 0, 1, norms)
                for columns, other in blocks[key]:
                    if len(other) == mine.shape[1]:
                        total = np.zeros((len(own), len(columns)))
                        for k in range(len(other)):
                            total += mine[:, k, None] * other[k]
                        for at, row in zip(own, total):
                            values[offsets[at] + columns] = row
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return cosines


def jaccard(a: Column, b: Column) -> Column:
    """Common over all tokens; 0 if there are none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap_max(a: Column, b: Column) -> Column:
    """Common tokens over the larger set's; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))), F.lit(0.0))


def keyword_coverage(script: Column, call: Column, keywords: Iterable[str]) -> Column:
    """Of the script's important keywords, the share that the call has; 0 if the script has none."""
    wanted = F.array_intersect(script, words_array(keywords))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, call)), F.size(wanted)), F.lit(0.0))


def overlap_keywords(script: Column, call: Column, keywords: Iterable[str]) -> Column:
    """Shared tokens, important ones first, alphabetical within both."""
    common, important = F.array_intersect(script, call), words_array(keywords)
    return F.concat(F.array_sort(F.array_intersect(common, important)), F.array_sort(F.array_except(common, important)))


def weighted(language: str, semantic: Column, overlap: Column, rouge: Column, keywords: Column) -> Column:
    w = config.weights(language)
    return semantic * w["semantic"] + overlap * w["expanded_overlap"] + rouge * w["rouge_l"] + keywords * w["keyword_coverage"]
