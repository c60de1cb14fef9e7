"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a fixed mask over a run of words: it hashes the words at its ones and ignores those at
its zeros, so a substituted word under a zero doesn't break it. The seeds of all benchmark items
are joined with those at every word of every training text. A hit fixes how an item lies along a text; from there
the two are compared word by word, and of the runs with at least the stated share of matching words the one with most of
them is an overlap if it has enough.

Items go out in blocks of a bounded number of words, each with one pass over the texts; texts are read
where they lie and nothing is shuffled, so a passage that a third of all documents hold costs each task its own documents only.

Words are runs of letters and digits in lower case. Whole texts are searched. A null or empty text has no overlap, and a null item or one
without words has none either. An item that is shorter than the seeds is found by all its words in a row, one of a single word too; since a
few words in a row are no sign of a leak, such items are reported but documents are dropped for items of MIN_ITEM words or more only.
Repeated documents and items are compared each; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import each_text, materialize, shared_path

#: Masks over eleven words of which seven count; and four words in a row, which any run of 13 matches at 80 % has somewhere.
SEEDS = ("11101100101", "10110101101", "11010011011", "1111")
#: An overlap has as many matching words at least (or all of a shorter item), and such a share of matches.
MIN_WORDS = 13
MIN_SHARE = 0.8
#: Words of an item for which documents are dropped.
MIN_ITEM = 5
#: Words of the items of one block, about; a block takes some 50 MB in a worker.
BLOCK_WORDS = 500_000
#: Characters of texts that are hashed together.
GROUP_CHARS = 500_000
#: Hits that are made distinct together.
HITS = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_FILTER_BITS = 22
_ROW = "talkgauge_decontamination_row"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _keys(ids: np.ndarray, offsets: tuple[int, ...], number: int) -> np.ndarray:
    """The hash of the words under a mask, for a mask that begins at each word."""
    n = len(ids) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, np.uint64(number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    for offset in offsets:
        key = (key ^ ids[offset : offset + n]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key


@dataclass
class Overlap:
    item: object
    matched: int
    length: int
    text_start: int
    item_start: int


class Items:
    """Benchmark items with their seeds; finds overlaps in texts."""

    def __init__(self, items: list[tuple[object, str]], seeds: tuple[str, ...] = SEEDS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, min_item: int = 1):
        split = [(item, words) for item, text in items if len(words := words_of(text)) >= max(1, min_item)]
        self.names = [item for item, _ in split]
        self.vocabulary: dict[str, int] = {}
        for _, words in split:
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.items = [np.array([self.vocabulary[w] for w in words], dtype=np.uint64) for _, words in split]
        self.min_words, self.min_share = min_words, min_share
        masks = [tuple(i for i, c in enumerate(seed) if c == "1") for seed in seeds]
        self.span = max((mask[-1] + 1 for mask in masks), default=0)
        short = {len(x) for x in self.items if len(x) < self.span}
        self.masks, self.seeds = [*masks, *(tuple(range(n)) for n in sorted(short))], len(masks)
        keys, places = [], []
        for i, ids in enumerate(self.items):
            for number, mask in enumerate(self.masks):
                if number < len(masks) if len(ids) >= self.span else len(mask) == len(ids):
                    found = _keys(ids, mask, number)
                    keys.append(found)
                    places.append(np.stack([np.full(len(found), i), np.arange(len(found))], axis=1))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.places = self.keys[order], (np.concatenate(places)[order] if keys else np.zeros((0, 2), np.int64))
        self.filter = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def _alignments(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (text, item, shift) of all hits: an item that begins at a text's word shift. Repetitive
        texts hit a place many times over, so hits are made distinct in portions of a fixed size."""
        longest = max(map(len, self.items))
        reach = len(ids) + longest + 1
        distinct = np.zeros(0, np.int64)
        for number, mask in enumerate(self.masks):
            keys = _keys(ids, mask, number)
            some = np.flatnonzero(self.filter[keys >> np.uint64(64 - _FILTER_BITS)])
            first = np.searchsorted(self.keys, keys[some], "left")
            n = np.searchsorted(self.keys, keys[some], "right") - first
            some, first, n = some[n > 0], first[n > 0], n[n > 0]
            portion = np.cumsum(n) // HITS
            for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(portion)) + 1):
                at, size = some[part], n[part]
                found = np.repeat(first[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
                at = np.repeat(at, size)
                text = np.searchsorted(starts, at, "right") - 1
                item, place = self.places[found].T
                pair = text * len(self.items) + item
                codes = pair * reach + (at - starts[text] - place + longest)
                if number >= self.seeds:  # a whole item in a row: its first place in a text is enough
                    codes = codes[np.unique(pair, return_index=True)[1]]
                    codes = codes[~np.isin(codes // reach, distinct // reach)]
                distinct = np.union1d(distinct, codes)
        pair, shift = np.divmod(distinct, reach)
        return np.stack([pair // len(self.items), pair % len(self.items), shift - longest], axis=1)

    def _best(self, text: np.ndarray, item: int, shift: int) -> Overlap | None:
        ids = self.items[item]
        a, b = max(0, -shift), min(len(ids), len(text) - shift)
        same = text[a + shift : b + shift] == ids[a:b]
        matches = np.concatenate([[0], np.cumsum(same)])
        worth = matches - self.min_share * np.arange(len(matches)) + 1e-9 * np.arange(len(matches))
        # For each start the farthest end up to which the share holds: most matches that any such run from there has.
        highest = np.maximum.accumulate(worth[::-1])[::-1]
        ends = np.searchsorted(-highest, -worth, "right") - 1
        start = int((matches[ends] - matches).argmax())
        run = np.flatnonzero(same[start : ends[start]])
        if not len(run):
            return None
        start, end, matched = start + int(run[0]), start + int(run[-1]) + 1, len(run)
        if matched < min(self.min_words, len(ids)):
            return None
        return Overlap(self.names[item], matched, end - start, a + shift + start, a + start)

    def overlaps(self, texts: list[str | None]) -> list[list[Overlap]]:
        """For each text, its best overlap with each item that it overlaps."""
        out: list[list[Overlap]] = [[] for _ in texts]
        if not self.items:
            return out
        known, gap, parts, starts, n = self.vocabulary.get, np.zeros(self.span, np.uint64), [], [], 0
        for text in texts:
            words = words_of(text)
            part = np.array([known(w, 0) for w in words], dtype=np.uint64)
            starts.append(n)
            parts += [part, gap]  # no seed can span two texts, since both its ends count
            n += len(part) + self.span
        joined = np.concatenate(parts)
        best: dict[tuple[int, int], Overlap] = {}
        for t, i, shift in self._alignments(joined, np.array(starts)).tolist():
            overlap = self._best(parts[2 * t], i, shift)
            if overlap and (overlap.matched > best[t, i].matched if (t, i) in best else True):
                best[t, i] = overlap
        for (t, _), overlap in best.items():
            out[t].append(overlap)
        return out

    def groups(self, texts: Iterable[str | None]):
        """overlaps() over groups of texts of bounded size, in order."""
        group, chars = [], 0
        for text in texts:
            if group and chars + len(text or "") > GROUP_CHARS:
                yield from self.overlaps(group)
                group, chars = [], 0
            group.append(text)
            chars += len(text or "")
        yield from self.overlaps(group)


def _blocks(benchmark: DataFrame, item_id: str, text: str, words: int, min_item: int = 1):
    """The benchmark's items in broadcasts of a bounded number of words."""
    context, block, size = benchmark.sparkSession.sparkContext, [], 0
    for row in benchmark.select(item_id, text).filter(F.col(text).isNotNull()).toLocalIterator():
        n = len(words_of(row[1]))
        if block and size + n > words:
            yield context.broadcast(Items(block, min_item=min_item))
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield context.broadcast(Items(block, min_item=min_item))


def _each_block(blocks, one, empty: DataFrame, name: str) -> DataFrame:
    """one(block) of a single block as it is, of several as parts of one table, so that the plan doesn't grow with the benchmark."""
    spark, path = empty.sparkSession, None
    for block, more in _ahead(blocks):
        if path is None and not more:
            return one(block)
        path = path or shared_path(spark, name)
        one(block).write.mode("append").parquet(path)
        block.unpersist()
    return spark.read.schema(empty.schema).parquet(path) if path else empty


def _ahead(blocks):
    """Each block, and whether another one follows."""
    blocks = iter(blocks)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)
        yield block, after is not None
        block = after


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, min_item: int = 1) -> DataFrame:
    """One row for each document and item that overlap, with the best overlap: ``doc_id, item_id,
    matched_words, overlap_words, doc_start, item_start`` (positions count words from 0)."""
    spark = docs.sparkSession
    names = ["doc_id", "item_id", "matched_words", "overlap_words", "doc_start", "item_start"]
    kinds = [docs.schema[doc_id].dataType, benchmark.schema[item_id].dataType, *[T.LongType()] * 4]
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds)])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def one(items):
        def find(batches):
            for batch in batches:
                out = [(doc, o.item, o.matched, o.length, o.text_start, o.item_start) for doc, each in zip(batch.column(0).to_pylist(), items.value.groups(each_text(batch.column(1)))) for o in each]
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row)) for row in out])

        return rows.mapInArrow(find, schema)

    return _each_block(_blocks(benchmark, item_id, item_text, block_words, min_item), one, spark.createDataFrame([], schema), "overlaps")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, min_item: int = MIN_ITEM) -> DataFrame:
    """The documents, all columns as they are, without those that overlap an item of min_item words or more."""
    spark = docs.sparkSession
    blocks = _ahead(_blocks(benchmark, item_id, item_text, block_words, min_item))
    block, more = next(blocks, (None, False))
    if not more:
        return docs.filter(_clean(block)(F.col(text))) if block else docs
    # Several blocks: rows are numbered once, and what each block finds is part of one table.
    path, rows = shared_path(spark, "contaminated"), materialize(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows")
    for block in chain([block], (block for block, _ in blocks)):
        rows.filter(~_clean(block)(F.col(text))).select(_ROW).write.mode("append").parquet(path)
        block.unpersist()
    return rows.join(spark.read.schema(rows.select(_ROW).schema).parquet(path).distinct(), _ROW, "left_anti").select(docs.columns)


def _clean(block):
    @F.arrow_udf(T.BooleanType())
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not each for each in block.value.groups(each_text(texts))], pa.bool_())

    return clean
