"""Near-duplicates against brute force: the Gray-order hierarchy, links and components, and the exact similarity join."""

import random

import numpy as np
import pandas as pd
import pytest

from talkgauge.llm import simhash as sh
from talkgauge.llm import similar as si
from talkgauge.llm.components import components as components_of
from talkgauge.llm.similar import similar_documents

LONG = "lorem ipsum dolor " * 7_000
DOCS = "doc_id long, text string, lang string, score string, row string, fp string"
MESSY = [(1, "Hello world, this is fine.", "en"), (2, None, "en"), (3, "", "fr"), (3, "", "fr"), (None, "Bonjour le monde", None), (4, " \n\t ", "fr"), (5, "12 34", "en"), (6, LONG, "en"), (7, LONG, "en"), (7, LONG, "en")]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(i, x, lang, "s", "r", "f") for i, x, lang in MESSY], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def components(prints, k):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= k):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def clustered(n, spread, seed=3):
    rng, out = random.Random(seed), set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(n):
            x = base
            for _ in range(rng.randint(0, spread)):
                x ^= 1 << rng.randint(0, 63)
            out.add(x)
    return np.array(sorted(out), dtype=np.uint64)


@pytest.mark.parametrize("max_diff, fanout", [(0, 4), (1, 2), (2, 4), (4, 8)])
def test_gray_index_finds_all_pairs(max_diff, fanout):
    prints = clustered(150, 6)
    prints = prints[np.argsort(sh.gray_rank(prints))]
    found = [(int(a), int(b)) for query, row in sh.GrayIndex(prints, fanout=fanout).search(prints, max_diff) for a, b in zip(query, row)]
    expected = {(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= max_diff).tolist()}
    assert set(found) == expected and len(found) == len(expected)


def test_patterns_of_runs_are_found(monkeypatch):
    """Upper nodes stand over masked patterns; small portions change nothing."""
    rng = random.Random(2)
    patterns, masks = (np.array([rng.getrandbits(64) for _ in range(100)], dtype=np.uint64) for _ in range(2))
    masks &= np.array([rng.getrandbits(64) for _ in range(100)], dtype=np.uint64)
    queries = np.array([rng.getrandbits(64) for _ in range(50)], dtype=np.uint64)
    expected = {(q, i) for q in range(50) for i in range(100) if (int(queries[q] ^ patterns[i]) & int(masks[i])).bit_count() <= 5}
    for frontier in (1_000_000, 8):
        monkeypatch.setattr(sh, "FRONTIER", frontier)
        found = [(int(a), int(b)) for query, row in sh.GrayIndex(patterns, masks).search(queries, 5) for a, b in zip(query, row)]
        assert set(found) == expected and len(found) == len(expected) > 0


def test_hierarchy_prunes_groups():
    """Over a real table: several levels, and whole groups left out on each below the top."""
    prints = np.unique(np.array([sh.fingerprint(x, 3) % 2**64 for x in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text], dtype=np.uint64))
    prints = prints[np.argsort(sh.gray_rank(prints))]
    index = sh.GrayIndex(prints)
    assert len(index.levels) >= 5 and len(index.levels[-1][0]) == 1
    sum(len(query) for query, _ in index.search(prints, 2))
    inner = range(1, 3)  # the levels above have few nodes that differ yet
    assert all(index.pruned[i] > 0.2 * index.met[i] for i in inner) and index.met[0] < 0.2 * len(prints) ** 2
    # Each shared bit is held once on the way down: own bits of a node and of those above it never meet.
    for depth in range(len(index.levels) - 1):
        upper = np.repeat(index.levels[depth + 1][1], index.fanout)[: len(index.levels[depth][1])]
        assert not (index.levels[depth][1] & upper).any()


def test_gray_rank():
    codes = np.array([i ^ i >> 1 for i in range(300)], dtype=np.uint64)
    assert sh.gray_rank(codes).tolist() == list(range(300))


@pytest.mark.parametrize("run_rows, visitors", [(1 << 20, 65_536), (50, 40), (7, 5)])
def test_links_of_clusters(spark, run_rows, visitors, monkeypatch):
    """No setting of the search changes the components; with small runs fingerprints visit many runs and copies of them."""
    monkeypatch.setattr(sh, "VISITORS_PER_ROW", 1)
    prints = clustered(200, 6)
    ids = prints.view(np.int64).tolist()
    table = spark.createDataFrame([(x,) for x in ids], "fp long")
    starts, nodes = sh.runs(table, run_rows)
    assert (len(starts) > 11) == (run_rows < 100) and (sh.copies(nodes, 2, visitors, 1).max() > 1) == (run_rows < 100)
    roots = {r.node: r.root for r in components_of(sh.links(table, 2, run_rows, visitors)).collect()}
    found = components(prints, 2)
    least = {}
    for x, c in zip(ids, found):
        least[c] = min(least.get(c, x), x)
    assert [roots.get(x, x) for x in ids] == [least[c] for c in found]


def test_links_are_a_forest(spark):
    """A dense ball of fingerprints makes fewer links than fingerprints and copies, not all pairs."""
    ball = [1 << a | 1 << b for a in range(40) for b in range(a)]
    found = sh.links(spark.createDataFrame([(x,) for x in ball], "fp long"), 2, 100).collect()
    roots = {r.node: r.root for r in components_of(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
    assert len(found) < 12 * len(ball) and len({roots.get(x, x) for x in ball}) == 1


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 0), (-5, 40), (300, 200), (200, 300), (7, 7)]
    roots = {r.node: r.root for r in components_of(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(roots.values()) == {-5, 200} and len(roots) == 43
    assert components_of(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_messy_texts(messy, nothing):
    rows = sh.near_duplicates(messy).collect()
    assert len(rows) == len(MESSY)
    got = {r.doc_id: r for r in rows}
    assert {got[i].component_id for i in (2, 3, 4)} == {2} and got[2].fingerprint == "0" * 16
    assert got[6].component_id == got[7].component_id == 6 and got[None].component_id is None
    assert sh.near_duplicates(nothing).count() == 0
    assert sh.fingerprint("One  two\x0bTHREE", 3) == sh.fingerprint("one two three", 3) != sh.fingerprint("one two\xa0three", 3)


def test_similar_documents(spark, messy, nothing):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("al", "be", "co", "du", "en", "fi") for b in ("ra", "to", "mi", "nu", "se", "lo", "ka")]
    rows, near = [], []
    for i in range(40):
        text = [rng.choice(words) for _ in range(240)]
        rows.append((10 * i, " ".join(text)))
        for j in range(1, 4):  # one word in eighty changed: a similarity of about .88
            rows.append((10 * i + j, " ".join("other" if n % 80 == 20 * j else w for n, w in enumerate(text))))
            near.append(10 * i + j)
        rows.append((10 * i + 9, " ".join([*text[:60], *(rng.choice(words) for _ in range(180))])))  # a shared passage only
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == i for i, _ in rows if i not in set(near)) and all(got[i] // 10 == i // 10 for i in near)
    assert sum(got[i] != i for i in near) >= 0.9 * len(near)
    assert similar_documents(nothing).count() == 0
    found = {r.doc_id: r.component_id for r in similar_documents(messy).collect()}
    assert found[6] == found[7] == 6 and {found[i] for i in (2, 3, 4)} == {2} and found[1] == 1


def _five(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _lengthened(n, seed):
    """n texts of 250 words of their own, each with a second one that words were appended to or cut from."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(250)]
        more = rng.randint(20, 100)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, *(f"w{rng.randint(0, 10**6)}" for _ in range(more))] if i % 2 else words[more:]))]
    return rows


def test_similar_documents_miss_no_pair(spark):
    rows = _lengthened(120, 6)
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike = {i: _jaccard(_five(rows[i][1]), _five(rows[i + 1][1])) >= 0.8 for i in range(0, len(rows), 2)}
    assert 20 < sum(alike.values()) < 100 and all(got[i + 1] == i for i in alike if alike[i])


@pytest.mark.parametrize("options", [{}, {"rounds": ()}, {"rounds": (), "cross": 2, "block": 5}, {"cross": 1, "depth": 1, "block": 3, "run_rows": 20}])
def test_similar_documents_equal_brute_force(spark, options):
    """Links at .8 and none below, in groups too whose texts are alike in part, whatever decides the cost."""
    rng = random.Random(8)
    rows = _lengthened(40, 7)
    for _ in range(3):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        for _ in range(25):
            at = rng.sample(range(200), rng.randint(2, 8))
            rows.append((len(rows), " ".join(f"x{rng.randint(0, 10**6)}" if i in at else w for i, w in enumerate(words))))
    prints, sets = [sh.fingerprint(x, 3) % 2**64 for _, x in rows], [_five(x) for _, x in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if (prints[a] ^ prints[b]).bit_count() <= 2 or _jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert [got[i] for i in range(len(rows))] == root and 20 < len(set(root)) < len(rows)




def test_frequent_passages_in_different_texts(spark):
    """A key that very many sets have, none of them alike, and some that are: refined keys and blocks miss nothing and link nothing else."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(8, 12)))) for i in range(300)]
    rows += [(1_000 + i, f"{x} more") for i, x in rows[:40]]
    prints, sets = [sh.fingerprint(x, 3) % 2**64 for _, x in rows], [_five(x) for _, x in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if (prints[a] ^ prints[b]).bit_count() <= 2 or _jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"cross": 8, "rounds": (2,)}, {"cross": 8, "depth": 1, "block": 50}):
        got = {r.doc_id: r.component_id for r in similar_documents(table, **options).collect()}
        assert [got[i] for i, _ in rows] == [rows[x][0] for x in root]
    assert si.prefix_length(10, 0.8) == 3 and si.prefix_length(0, 0.8) == 0


def test_near_misses_make_few_candidates(spark, monkeypatch):
    """Texts that share most shingles, all below .8: keys that stand too late for the similarity make no pairs, and copies among them are found."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(104)]
    rows = []
    for i in range(200):
        own = rng.sample(range(5, 100, 5), 3)
        rows.append((i, " ".join(f"x{i}y{n}" if n in own else w for n, w in enumerate(words))))
    rows += [(1_000 + i, f"{x} more") for i, x in rows[:20]]
    made, counted = [], si._counted

    def tally(pairs, *more):
        made.append(pairs.count())
        return counted(pairs, *more)

    monkeypatch.setattr(si, "_counted", tally)
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), rounds=()).collect()}
    prints, sets = [sh.fingerprint(x, 3) % 2**64 for _, x in rows], [_five(x) for _, x in rows]
    root = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if (prints[a] ^ prints[b]).bit_count() <= 2 or _jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert [got[i] for i, _ in rows] == [rows[x][0] for x in root] and len(set(root)) > 180
    assert 20 <= sum(made) <= 5 * len(rows)


def test_recall_and_precision_of_changed_words(spark):
    """Random word changes, by exact similarity: every pair of .8 or more is linked and none below it."""
    rng = random.Random(10)
    rows = []
    for i in range(150):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 400))]
        share = rng.choice([0.01, 0.02, 0.03])
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(f"x{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words))]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = lambda i: (sh.fingerprint(rows[i][1], 3) ^ sh.fingerprint(rows[i + 1][1], 3)).bit_count() <= 2
    alike = [_jaccard(_five(rows[i][1]), _five(rows[i + 1][1])) >= 0.8 or near(i) for i in range(0, len(rows), 2)]
    linked = [got[i + 1] == i for i in range(0, len(rows), 2)]
    assert 30 < sum(alike) < 120 and linked == alike
