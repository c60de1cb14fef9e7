"""SimHash near-duplicates, found with a Gray-order hierarchical index.

A fingerprint has a bit set where more than half of a text's shingle hashes have it set. Copies
share a fingerprint, so only distinct fingerprints are searched, each with the smallest id that has it.

Sorted by Gray rank, neighbours differ in few bits, so a run of them agrees on many: that is its
masked pattern. The hierarchy has two parts. Its upper nodes stand over runs of equal size, cut at quantiles of the
rank; there is a bounded number of them, so their patterns go out to all tasks. Its lower nodes stand over the fingerprints of one run and
are built in the task that has the run. In both a node covers FANOUT nodes below it and holds the bits
on which all of them agree, less those that a node above it already holds, so each shared bit is compared once for the whole group.

A search goes down from the top, adds up differences on the bits of each node that it meets, and leaves out the whole
group once the sum is over ``max_diff``. A fingerprint is sent to those runs only that its way down the upper nodes reaches, of which it
takes its own and later ones, since earlier ones send theirs to it. This is exact: nothing is dropped, and no setting changes
what is found. A run with many visitors is copied, and its visitors are dealt among the copies. They are streamed past the
run's index, so a task holds one run and one batch.

What is found is written as a forest (a visitor with one fingerprint of the run, and that with its root in the run),
never as all pairs. Components come from alternating large-star and small-star steps over tables in the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import each_text, materialize, remove
from talkgauge.llm.components import components

BITS = 64
SEED = 42
#: Nodes under one node of the hierarchy.
FANOUT = 4
#: Runs at least, so that tasks have enough to share; fingerprints of one run at most (8 MB), about, which sets the number of runs of large tables; and runs
#: at most, whose patterns (24 bytes each) go to all tasks. A fingerprint visits some dozen of 64 runs and some fifty of 16,384.
MIN_RUNS, RUN_ROWS, MAX_RUNS = 64, 1 << 20, 16_384
#: Visitors that go past one copy of a run: so many, or so many times the run's own rows if that is more.
VISITORS, VISITORS_PER_ROW = 65_536, 16
#: Pairs of query and node that are open at a time.
FRONTIER = 1_000_000
#: Hashes whose bits are counted together.
COUNTED = 8_192


# -- fingerprints ------------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """The fingerprint of one whole text as a signed 64-bit integer; 0 without words or for null.

    A-Z are lower-cased; words are runs without ASCII white space; a text of fewer words than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(part), seed) for part in zip(*(words[i:] for i in range(shingle)))]
    return _majority(np.array(hashes, dtype="<u8"))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), COUNTED):
        octets = hashes[start : start + COUNTED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row's whole text, as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("fp", T.LongType())])

    def compute(batches):
        for batch in batches:
            prints = [fingerprint(x, shingle, seed) for x in each_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(compute, schema)


# -- the hierarchy -----------------------------------------------------------------------------


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the order of Gray codes: the integer whose Gray code it is."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _signed_rank(prints: np.ndarray) -> np.ndarray:
    """The Gray rank, its order kept, as a signed number."""
    return (gray_rank(prints) ^ np.uint64(1 << 63)).view(np.int64)


def rank_column(fp: str):
    """_signed_rank as a column."""
    rank = F.col(fp)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Nodes over rows in Gray order. A row is a fingerprint, or the pattern of a run with a mask of the bits that its fingerprints share.

    ``levels[0]`` are the rows and the last level is the top node; a level has each node's pattern and the bits that are its own.
    """

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None, fanout: int = FANOUT):
        masks = np.full(len(patterns), ~np.uint64(0)) if masks is None else masks
        self.fanout, levels = fanout, [(patterns & masks, masks)]
        while len(levels[-1][0]) > 1:
            pattern, mask = levels[-1]
            starts = np.arange(0, len(pattern), fanout)
            every, some = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~(every ^ some)
            levels.append((every & shared, shared))
        # A node keeps only the bits that the node above it doesn't share.
        above = [np.repeat(mask, fanout)[: len(levels[i][0])] for i, (_, mask) in enumerate(levels[1:])] + [np.zeros(1, np.uint64)]
        self.levels = [(pattern, mask & ~upper) for (pattern, mask), upper in zip(levels, above)]
        #: Nodes that searches met, and those of them that they left out with all below, by level.
        self.met, self.pruned = [0] * len(levels), [0] * len(levels)

    def search(self, queries: np.ndarray, max_diff: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, row) of all that differ in at most max_diff bits (of the row's mask), in portions."""
        if not len(self.levels[0][0]) or not len(queries):
            return
        step = max(1, FRONTIER // self.fanout)
        open_ = [(len(self.levels) - 1, np.zeros(min(step, len(queries) - i), np.int64), np.arange(i, min(i + step, len(queries))), np.uint8(0)) for i in range(0, len(queries), step)]
        while open_:
            depth, node, query, diff = open_.pop()
            pattern, own = self.levels[depth]
            diff = diff + np.bitwise_count((queries[query] ^ pattern[node]) & own[node])
            keep = np.flatnonzero(diff <= max_diff)
            self.met[depth] += len(node)
            self.pruned[depth] += len(node) - len(keep)
            if not depth:
                if len(keep):
                    yield query[keep], node[keep]
                continue
            below = len(self.levels[depth - 1][0])
            for start in range(0, len(keep), step):
                part = keep[start : start + step]
                child = (node[part][:, None] * self.fanout + np.arange(self.fanout)).ravel()
                inside = child < below
                open_.append((depth - 1, child[inside], np.repeat(query[part], self.fanout)[inside], np.repeat(diff[part], self.fanout)[inside]))


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the pairs in a forest whose rows point at their roots."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


class Run:
    """One run's fingerprints, past which visitors go."""

    def __init__(self, prints: np.ndarray, max_diff: int, fanout: int = FANOUT):
        self.max_diff, rank = max_diff, gray_rank(prints)
        order = np.argsort(rank)
        self.prints, self.rank = prints[order], rank[order]
        self.index, self.parent = GrayIndex(self.prints, fanout=fanout), np.arange(len(prints))

    def visit(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of visitors with later fingerprints of the run, at least one for each visitor and portion; more of them are kept in the run's own forest."""
        rank = gray_rank(prints)
        for query, row in self.index.search(prints, self.max_diff):
            later = self.rank[row] > rank[query]
            query, row = query[later], row[later]
            order = np.argsort(query, kind="stable")
            query, row = query[order], row[order]
            first = np.append(True, query[1:] != query[:-1])[: len(query)]
            again = np.flatnonzero(~first)
            _unite(self.parent, row[again - 1], row[again])
            yield prints[query[first]], self.prints[row[first]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        linked = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return self.prints[linked], self.prints[self.parent[linked]]


# -- the search over all tasks -----------------------------------------------------------------


def runs(prints: DataFrame, run_rows: int = RUN_ROWS) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The ranks at which runs begin, and of each run its pattern, mask and number of fingerprints; a bounded number of rows on the driver."""
    rows = prints.count()
    n = min(MAX_RUNS, max(1, min(MIN_RUNS, rows // MIN_RUNS), math.ceil(rows / run_rows)))
    starts = np.zeros(0, np.int64)
    if n > 1:
        cuts = prints.agg(F.percentile_approx(rank_column("fp"), [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("cuts")).first()[0]
        starts = np.unique(np.array(cuts, dtype=np.int64))

    def dealt(batches):
        for batch in batches:
            own = np.searchsorted(starts, _signed_rank(batch.column(0).to_numpy().view(np.uint64)), "right")
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(0)], names=["run", "fp"])

    found = prints.mapInArrow(dealt, "run long, fp long").groupBy("run").agg(F.bit_and("fp").alias("every"), F.bit_or("fp").alias("some"), F.count("*").alias("n")).collect()
    every, some, size = (np.zeros(len(starts) + 1, dtype=np.int64) for _ in range(3))
    for row in found:
        every[row.run], some[row.run], size[row.run] = row.every, row.some, row.n
    mask = ~(every ^ some).view(np.uint64)
    return starts, {"pattern": every.view(np.uint64) & mask, "mask": mask, "n": size}


def copies(nodes: dict[str, np.ndarray], max_diff: int, visitors: int = VISITORS, per_row: int = VISITORS_PER_ROW) -> np.ndarray:
    """How many copies of each run its visitors need: those of earlier runs that differ in at most max_diff of the bits that both runs share, and its own."""
    pattern, mask, n = nodes["pattern"], nodes["mask"], nodes["n"]
    most = np.zeros(len(n), np.int64)
    for run in range(len(n)):
        near = np.bitwise_count((pattern[: run + 1] ^ pattern[run]) & mask[: run + 1] & mask[run]) <= max_diff
        most[run] = n[: run + 1][near].sum()
    return np.maximum(1, -(-most // np.maximum(visitors, per_row * n)))


def links(prints: DataFrame, max_diff: int, run_rows: int = RUN_ROWS, visitors: int = VISITORS) -> DataFrame:
    """``a, b``: a forest of links between the distinct fingerprints ``fp``, which must be a table; it has the components of all links."""
    starts, nodes = runs(prints, run_rows)
    n_copies = copies(nodes, max_diff, visitors)
    first = np.cumsum(n_copies) - n_copies  # a run's copies are numbered from here

    def route(batches):
        index = GrayIndex(nodes["pattern"], nodes["mask"])
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            own = np.searchsorted(starts, _signed_rank(x), "right")
            # Members go to all copies of their run, visitors to one of each run's.
            row = np.repeat(np.arange(len(x)), n_copies[own])
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n_copies[own]) - n_copies[own], n_copies[own])
            yield _routed(first[own[row]] + nth, False, x[row])
            deal = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for query, run in index.search(x, max_diff):
                on = run >= own[query]
                query, run = query[on], run[on]
                yield _routed(first[run] + (deal[query] % n_copies[run].astype(np.uint64)).astype(np.int64), True, x[query])

    def find(batches):
        held: list[np.ndarray] = []
        run, at = None, None
        for batch in batches:
            copy, visits = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            x = batch.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((copy[1:] != copy[:-1]) | (visits[1:] != visits[:-1])) + 1
            for part in np.split(np.arange(len(x)), cuts):
                if not len(part):
                    continue
                if copy[part[0]] != at:
                    if run is not None:
                        yield _pairs(*run.forest())
                    held, run, at = [], None, copy[part[0]]
                if not visits[part[0]]:
                    held.append(x[part])
                    continue
                run = run or Run(np.concatenate(held or [x[:0]]), max_diff)
                for a, b in run.visit(x[part]):
                    yield _pairs(a, b)
        if run is not None:
            yield _pairs(*run.forest())

    routed = prints.select("fp").mapInArrow(route, "copy long, visits boolean, fp long")
    dealt = routed.repartition(int(min(10_000, max(2 * n_copies.sum(), 1))), "copy").sortWithinPartitions("copy", "visits")
    return dealt.mapInArrow(find, "a long, b long")


def _routed(copy: np.ndarray, visits: bool, prints: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(copy), pa.array(np.full(len(copy), visits)), pa.array(prints.view(np.int64))], names=["copy", "visits", "fp"])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = 3, max_diff: int = 2, doc_id: str = "doc_id", text: str = "text", run_rows: int = RUN_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row.

    ``fingerprint`` has 16 hexadecimal digits. ``component_id`` is the smallest id that links reach, the row's
    own id included. A null or blank text has fingerprint zero, which links like any other; a
    null id is never a component's id unless all its ids are null. Repeated rows stay rows; an empty table gives none. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), max_diff, run_rows))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = materialize(joined.select("fp", "root").join(named, "root").select("fp", "component_id"), "components")
    remove(docs.sparkSession, distinct, roots)
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
