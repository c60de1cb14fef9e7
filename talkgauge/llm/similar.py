"""Near-duplicates of two kinds at once: fingerprints within a few bits, and texts whose sets of word shingles are alike.

A few words changed in fifty leave two texts many bits apart, so links by fingerprint are completed by links of all pairs with a
Jaccard similarity of shingle sets of ``min_similarity`` or more (five words and 0.8, if not stated otherwise), judged on the exact sets.

Candidates: put in any common order, two sets of that similarity share one at least of the first shingles of each (a fifth of a set and
one), so these are a set's keys and no such pair is missed. Where the keys stand that a pair shares, and the sizes, rule out most others. The order
puts shingles that a bounded sample has often last; it decides the cost and not the result.

Places: of sets of n shingles that share o at least, the l-th shared shingle stands at place n - o + l of either at the latest, since only n - o before it can be a
set's own. So a pair is made of those keys only that are among its first (EARLY) by that bound, and judged if it has so many. Texts that are alike in
large part but not enough share many keys, but hardly one so early. A key that is early in none of its sets makes no pair and is left out. Where two sets have the
same (EARLY) keys right before a key, they share enough before it, so it makes no pair of them either.

Copies: sets that links have joined already aren't compared. Some sets of each key with more are compared with all its others first (ROUNDS), so that a
group of near copies is one component before all its pairs would be made. Then keys whose sets are one component are done.

Frequent keys: of the first l - 1 shingles more, similar sets share l, so the sets of a key that would make more pairs than rows meet in pairs of that
key and another one instead, then in threes, and so on up to DEPTH. The sets of a key are compared in blocks of BLOCK sets against blocks, so a task holds a
bounded number of them, and nothing is dropped.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import TEXTS, each_text, materialize, remove
from talkgauge.llm.components import components
from talkgauge.llm.simhash import RUN_ROWS, SEED, fingerprint, links

#: Texts whose shingles are counted for the order of keys, the least count of a common shingle, and common shingles at most.
SAMPLED, COMMON, COMMONS = 20_000, 3, 200_000
#: Sets of a key that a task compares with as many; a key with more is dealt into blocks.
BLOCK = 4_096
#: Pairs in different components for each set of a key, beyond which the key is refined if that makes fewer rows, by up to so many shingles in all.
CROSS, DEPTH = 2_048, 4
#: First shared keys of a pair that decide if it is judged; fewer, if sets of its sizes may share fewer.
EARLY = 2
#: Sets of a key that are compared with all its others, round by round, before all that are in different components by then.
ROUNDS = (4, 64)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; words as in fingerprint, none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    ids = np.array([xxhash.xxh64_intdigest(x, SEED) for x in words], dtype=np.uint64)
    size = min(shingle, len(ids))
    hashes = np.full(max(0, len(ids) - size + 1) if size else 0, np.uint64(SEED))
    for i in range(size):
        hashes = (hashes ^ ids[i : i + len(hashes)]) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
    return np.unique(hashes)


def prefix_length(n: int, least: float) -> int:
    """So many first shingles of a set of n that sets of a similarity of least share one."""
    return n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0


def first_shingles(hashes: np.ndarray, n: int, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A set's first n shingles in order of hash; common ones (sorted, with their places) come last."""
    at = np.searchsorted(common, hashes)
    found = common[np.minimum(at, len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
    rank = np.zeros(len(hashes), np.int64)
    rank[found] = place[at[found]]
    return hashes[np.lexsort((hashes, rank))[:n]]


def _common_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a bounded sample have, sorted, and the place of each in the order of counts."""
    scale = 1 << 30
    share = min(scale, SAMPLED * scale // max(1, texts.count()) + 1)

    def sets(batches):
        for batch in batches:
            for text in each_text(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle).view(np.int64))], names=["h"])

    counts = texts.filter(F.pmod(F.xxhash64("text"), F.lit(scale)) < share).select("text").mapInArrow(sets, "h long").groupBy("h").agg(F.count("*").alias("n"))
    rows = counts.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(COMMONS).toArrow()
    hashes = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


# -- candidates --------------------------------------------------------------------------------


def _bounds(n_a, n_b, least: float, ceil, greatest):
    """What sets of n_a and n_b shingles share at least, if they have the similarity, and how many keys of that.

    What two sets share lies in both prefixes, or behind the one that ends first, where at most ceil(least * n) - 1 are left; so they share the rest of the
    overlap as keys.
    """
    both = ceil(least / (1 + least) * (n_a + n_b) - 1e-9)
    return both, both - ceil(least * greatest(n_a, n_b) - 1e-9) + 1


def _ahead(at, n, least: float, ceil):
    """If a key can be among the first of a pair, by one set's place and size: the shorter set, which has fewer of its own, must have it so early."""
    return at + ceil(least / (1 + least) * (n + n) - 1e-9) < EARLY


def _in_keys(rows: DataFrame, least: float, first: int | None = None) -> DataFrame:
    """``a, b, take, late``: pairs of a key's sets, where components differ, sizes allow the similarity and the key can be among the first ``take`` that they share;
    late: how many places behind the bound of the first one.

    ``rows``: key, sid, n, at, before, root, side, shared; of keys that a bounded number of sets have. ``at``: the key's place in the set (from 0) less n; ``before``: a
    hash of the EARLY keys before it, or 0. Sets of a side 0 or 1 are
    compared across only. With ``first`` only so many sets of a key are compared with its others: those of whose keys the greatest share is other sets' too, as the text
    is that copies were made of; else all sets in which the key is early, since any pair has one of them.
    """
    names = ["a", "b", "take", "late"]

    def pairs(table: pa.Table):
        key, sid, n, place, before, root, side, shared = (table.column(i).to_numpy() for i in range(8))
        early = _ahead(place, n, least, np.ceil)
        order = np.lexsort((sid, ~early if first is None else -shared, key))
        key, sid, n, place, before, root, side, early = (x[order] for x in (key, sid, n, place, before, root, side, early))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        turns = np.repeat(np.add.reduceat(early.astype(np.int64), starts), sizes) if first is None else np.full(len(key), first)
        number = np.arange(len(key)) - np.repeat(starts, sizes)
        last = np.minimum(number, turns)
        at, turn = np.flatnonzero(last > 0), 0
        while len(at):
            other = at - number[at] + turn
            both, take = _bounds(n[at], n[other], least, np.ceil, np.maximum)
            late, take = np.maximum(place[at], place[other]) + both, np.minimum(take, EARLY)
            keep = (root[at] != root[other]) & (np.minimum(n[at], n[other]) >= least * np.maximum(n[at], n[other]) - 1e-9) & ((side[at] < 0) | (side[at] != side[other])) & (late < take)
            keep &= (before[at] == 0) | (before[at] != before[other])
            if keep.any():
                one, two = sid[other[keep]], sid[at[keep]]
                columns = [pa.array(x) for x in (np.minimum(one, two), np.maximum(one, two), take[keep].astype(np.int32), late[keep].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            turn += 1
            at = at[last[at] > turn]

    def search(batches):
        held: list[pa.RecordBatch] = []  # a key may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column(0).to_numpy()
            before = np.flatnonzero(key != key[-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            if held and (cut or key[0] != held[-1].column(0)[-1].as_py()):
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return rows.select("key", "sid", "n", "at", "before", "root", "side", "shared").repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long, take int, late int")


def _counted(pairs: DataFrame) -> DataFrame:
    """``a, b``: the pairs that share keys enough, the first of them within its bound. A pair that shares a frequent key early is found by that."""
    shared = pairs.groupBy("a", "b", "take").agg(F.count("*").alias("shared"), F.min("late").alias("late"))
    return shared.filter((F.col("shared") >= F.col("take")) & (F.col("late") <= 0)).select("a", "b")


def _screened(pairs: DataFrame, distinct: DataFrame, least: float) -> DataFrame:
    """``a, b``: the same for pairs ``a, b`` of frequent keys, from the keys themselves."""
    own = distinct.select("sid", "n", F.slice("keys", F.lit(1), F.col("p")).alias("keys"))
    rows = pairs.join(own.toDF("a", "n_a", "keys_a"), "a").join(own.toDF("b", "n_b", "keys_b"), "b")
    needed = _bounds(F.col("n_a"), F.col("n_b"), least, F.ceil, F.greatest)[1]
    return rows.filter(F.size(F.array_intersect("keys_a", "keys_b")) >= needed).select("a", "b")


def _with_first(rows: DataFrame, n: int, least: float) -> DataFrame:
    """``a, b, take, late``: as _in_keys with ``first``, for keys of any number of sets.

    ``rows``: key, sid, n, at, root, shared. Of each n-th part of a key's sets that is taken of whose keys the greatest share is other sets' too: where copies were
    changed each in its own way, that is the text that they were made of. They are found by an aggregate, so no task has all rows of a key.
    """
    first = rows.groupBy("key", F.pmod(F.xxhash64("sid"), F.lit(n)).alias("_part")).agg(F.max(F.struct("shared", "sid", "n", "at", "root")).alias("f")).select("key", "f")
    near = (F.col("root") != F.col("f.root")) & (F.least("n", "f.n") >= least * F.greatest("n", "f.n") - 1e-9)
    both, take = _bounds(F.col("n"), F.col("f.n"), least, F.ceil, F.greatest)
    late, take = (F.greatest("at", "f.at") + both).cast("int"), F.least(take, F.lit(EARLY)).cast("int")
    # Two sets may be each other's first in a key, which counts once too often; the sets are judged all the same.
    return rows.join(first, "key").filter(near & (late < take)).select(F.least("sid", "f.sid").alias("a"), F.greatest("sid", "f.sid").alias("b"), take.alias("take"), late.alias("late"))


def _crossing(rows: DataFrame) -> DataFrame:
    """``key, sets, shingles, cross``: keys whose sets are in several components, the shingles of all of them, and how many pairs of them are open."""
    each = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"))
    found = each.groupBy("key").agg(F.sum("c").alias("sets"), F.sum("shingles").alias("shingles"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count("*").alias("roots"))
    return found.filter("roots > 1").select("key", "sets", "shingles", ((F.col("sets") * F.col("sets") - F.col("squares")) / 2).alias("cross"))


def _refined(rows: DataFrame, distinct: DataFrame, level: int) -> DataFrame:
    """The rows ``key, sid, n, at, before, used`` of frequent keys, each with one shingle more of a prefix that is as much longer.

    ``at`` is the last one's place less n and less one for each other: the first shared keys of a pair are all within the first one's bound so.
    """
    more = F.posexplode(F.slice("keys", F.lit(1), F.col("p") + (level - 1))).alias("place", "k")
    each = rows.join(distinct.select("sid", "p", "keys"), "sid").select("key", "sid", "n", "at", "used", more).filter(~F.array_contains("used", F.col("k")))
    at = F.greatest(F.col("at") - 1, F.col("place") - F.col("n") - (level - 1))
    return each.select(F.xxhash64("key", "k").alias("key"), "sid", "n", at.alias("at"), F.lit(0).cast("long").alias("before"), F.array_append("used", F.col("k")).alias("used"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """The rows ``key, sid, n, at, before, sets`` dealt into blocks, each block with itself and with every other one of its key; most keys are one block."""
    count = F.ceil(F.col("sets") / size).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("sid"), count).cast("int")).select("*", F.explode(F.sequence(F.lit(0), count - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return rows.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "sid", "n", "at", "before", side.alias("side"), F.lit(0).alias("shared"))


def _verified(pairs: DataFrame, texts: DataFrame, distinct: DataFrame, least: float, shingle: int) -> DataFrame:
    """``a, b``: the pairs whose sets have a Jaccard similarity of least; only the sets of pairs are made and shuffled."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(distinct.select("sid", "least"), "sid").select(F.col("least").alias("_id")).distinct()

    def sets(batches):
        for batch in batches:
            for start in range(0, len(batch), TEXTS):
                found = [shingle_set(x, shingle) for x in batch.column(0).slice(start, TEXTS).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["sid", "hashes"])

    def judge(batches):
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, two))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= least * (len(one) + len(two) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # Ids may be null or repeated: what is made too much has no pair.
    own = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]), "left_semi").select("text").mapInArrow(sets, "sid long, hashes binary")
    made = materialize(own.dropDuplicates(["sid"]), "sets")
    joined = pairs.join(made.toDF("a", "one"), "a").join(made.toDF("b", "two"), "b").select("a", "b", "one", "two")
    out = materialize(joined.mapInArrow(judge, "a long, b long"), "alike")
    remove(pairs.sparkSession, made)
    return out


def _name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


# -- the operator ------------------------------------------------------------------------------


def similar_documents(
    docs: DataFrame, min_similarity: float = 0.8, shingle: int = 5, max_diff: int = 2, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, cross: int = CROSS, depth: int = DEPTH, rounds: tuple[int, ...] = ROUNDS, run_rows: int = RUN_ROWS
) -> DataFrame:
    """``doc_id, component_id``: as near_duplicates, with links between all texts whose sets of ``shingle`` words have that Jaccard similarity.

    Fingerprints are those of three-word shingles. Nulls, blanks and repeated rows are treated as in near_duplicates. ``block``, ``cross``, ``depth``, ``rounds``
    and ``run_rows`` decide the cost and not the result.
    """
    spark = docs.sparkSession
    # Different sets of that similarity have so many shingles in common at least.
    depth = min(depth, max(1, math.floor(min_similarity / (1 - min_similarity) + 1e-9))) if min_similarity < 1 else depth
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    common, place = _common_shingles(texts, shingle)
    order = spark.sparkContext.broadcast((common, place))
    fields = {"fp": T.LongType(), "sid": T.LongType(), "n": T.IntegerType(), "p": T.IntegerType(), "keys": T.ArrayType(T.LongType())}
    kind = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(name, x) for name, x in fields.items())])

    def compute(batches):
        for batch in batches:
            for start in range(0, len(batch), TEXTS):
                part = batch.slice(start, TEXTS)
                read = part.column(1).to_pylist()
                sets = [shingle_set(x, shingle) for x in read]
                prefix = [prefix_length(len(x), min_similarity) for x in sets]
                keys = [first_shingles(x, n + depth - 1, *order.value).view(np.int64) for x, n in zip(sets, prefix)]
                columns = [pa.array([fingerprint(x, 3) for x in read], pa.int64()), pa.array([_name(x) for x in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int32()), pa.array(prefix, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *fields])

    prints = materialize(texts.mapInArrow(compute, kind), "sets")
    distinct = prints.groupBy("sid").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("p").alias("p"), F.first("keys").alias("keys"))
    distinct = materialize(distinct, "distinct")
    # Fingerprints within max_diff bits, as links between the least sets that have them.
    owners = materialize(prints.select("fp", "sid").distinct(), "owners")
    owner = materialize(owners.groupBy("fp").agg(F.min("sid").alias("owner")), "owner")
    near = links(owner.select("fp"), max_diff, run_rows)
    near = near.join(owner.toDF("a", "x"), "a").join(owner.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    roots = components(near.union(owners.join(owner, "fp").filter("sid <> owner").select("sid", "owner")))
    remove(spark, owners, owner)

    def linked(pairs: DataFrame) -> None:
        """Judges candidates and adds those that are alike to the components."""
        nonlocal roots
        pairs = materialize(pairs, "pairs")
        if not pairs.isEmpty():
            alike = _verified(pairs, texts, distinct, min_similarity, shingle)
            new = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(alike))
            remove(spark, roots, alike)
            roots = new
        remove(spark, pairs)

    def rooted(rows: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    place, n = F.col("place") - F.col("n"), F.col("n")
    each = distinct.select(F.posexplode(F.slice("keys", F.lit(1), F.col("p"))).alias("place", "key"), "sid", "n")
    each = each.select("key", "sid", place.alias("at"), _ahead(place, n, min_similarity, F.ceil).alias("ahead"))
    # Half a key is enough to leave out most that only one set has.
    half = F.col("key").bitwiseAND((1 << 31) - 1).cast("int")
    several = each.groupBy(half.alias("half")).agg(F.count("*").alias("sets")).filter("sets > 1").select("half")
    shared = each.join(several, half == F.col("half"), "left_semi")
    shared = materialize(shared, "shared")
    share = shared.groupBy("sid").agg(F.count("*").alias("k")).join(distinct.select("sid", "n", "p"), "sid").select("sid", "n", F.floor(F.col("k") * 100 / F.col("p")).cast("int").alias("shared"))
    sizes = shared.groupBy("key").agg(F.count("*").alias("sets"), F.max("ahead").alias("ahead")).filter("sets > 1 AND ahead").drop("ahead")
    earlier = [F.lag("key", i).over(Window.partitionBy("sid").orderBy("at")) for i in range(1, EARLY + 1)]
    before = F.when(earlier[-1].isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*earlier))
    keys = shared.withColumn("before", before).join(share, "sid").join(sizes, "key").select("key", "sid", "n", "at", "before", "shared", "sets")
    keys = materialize(keys, "keys")
    remove(spark, shared)
    small, large = keys.filter(F.col("sets") <= block), keys.filter(F.col("sets") > block)
    for first in rounds:
        # Keys with fewer sets would be compared in whole, which the last round does.
        some = small.filter(F.col("sets") > first + 1).select("key", "sid", "n", "at", "before", "shared", F.lit(-1).alias("side"))
        pairs = _in_keys(rooted(some), min_similarity, first)
        linked(_counted(pairs.union(_with_first(rooted(large), first, min_similarity))))

    def dealt(rows: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
        """The rows of keys with open pairs as a table: those compared as they are, and those of frequent keys."""
        refined = (1 - min_similarity) * F.col("shingles")  # rows that refining makes, about
        many = F.col("cross") > F.greatest(refined, cross * F.col("sets"))
        rows = materialize(rows.join(_crossing(rooted(rows)), "key").select(*kept, "sets", many.alias("frequent")), "open")
        return rows.filter(~F.col("frequent")), rows.filter("frequent")

    kept = ["key", "sid", "n", "at", "before", "used"]
    usual, frequent = dealt(keys.select("key", "sid", "n", "at", "before", F.array("key").alias("used")), kept)
    pairs, level, wide = _counted(_in_keys(rooted(_blocks(usual, block)), min_similarity)), 2, []
    while not frequent.isEmpty():
        if level > depth:
            wide.append(_in_keys(rooted(_blocks(frequent, block)), min_similarity))
            break
        more, frequent = dealt(_refined(frequent, distinct, level), kept)
        wide.append(_in_keys(rooted(_blocks(more, block)), min_similarity))
        level += 1
    if wide:
        pairs = pairs.union(_screened(reduce(DataFrame.union, wide).select("a", "b").distinct(), distinct, min_similarity)).distinct()
    linked(pairs)
    joined = distinct.join(roots, distinct["sid"] == roots["node"], "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = materialize(joined.select("sid", "root").join(named, "root").select("sid", "component_id"), "components")
    remove(spark, distinct, keys, usual, roots)
    return prints.select("doc_id", "sid").join(ids, "sid").select("doc_id", "component_id")
