"""Registered queries against their SQL, or against brute force over the same whole tables."""

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from talkgauge.llm import oracles, queries
from talkgauge.llm.decontaminate import MIN_WORDS
from talkgauge.llm.pii import Pseudonymizer


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.TOKENIZER)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_its_sql(same, name):
    same(queries.queries()[name], oracles.oracle_sql()[name])


def test_all_ten_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert all(any(name.startswith(f"op{n}_") for name in names) for n in range(1, 11)) and "pipeline" in names


def test_token_counts(spark, sf_dir, docs, tokenizer):
    lengths = np.array([len(x.ids) for x in tokenizer.encode_batch(docs.text.tolist(), add_special_tokens=False)])
    rows = queries.op1_token_counts(spark, sf_dir).collect()
    assert sorted(r.context_limit for r in rows) == sorted(set(lengths.tolist()))
    for r in rows:
        fits = lengths[lengths <= r.context_limit]
        assert (r.documents, r.documents_within, r.documents_over) == ((lengths == r.context_limit).sum(), len(fits), len(lengths) - len(fits))
        assert (r.tokens_within, r.tokens_over) == (fits.sum(), lengths.sum() - fits.sum())
        assert r.truncated_tokens == np.minimum(lengths, r.context_limit).sum() and r.dropped_tokens == lengths.sum() - r.truncated_tokens


def test_pii(spark, sf_dir, docs):
    back = Pseudonymizer(queries.PII_KEY, reverse=True)
    rows = queries.op3_pii(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    changed = 0
    for r in rows:
        assert back.text(r.text)[0] == docs.text[r.doc_id]
        changed += r.text != docs.text[r.doc_id]
        assert (r.text != docs.text[r.doc_id]) == any(r[f"n_{kind}"] for kind in queries.KINDS)
    assert changed


def _leaks(text: list[str], item: list[str]) -> bool:
    """Every alignment and every run in it: 13 matching words (or all of a shorter item) at 80 %."""
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    t, x, most = np.array([number.get(w, -1) for w in text]), np.array([number[w] for w in item]), min(13, len(item))
    padded = np.concatenate([np.full(len(x), -1), t, np.full(len(x), -1)])
    same = np.lib.stride_tricks.sliding_window_view(padded, len(x)) == x
    if len(x) < 11:
        return bool(same.all(axis=1).any())
    for row in same[same.sum(axis=1) >= most]:
        sums = np.concatenate([[0], np.cumsum(row)])
        matched, length = sums[None, :] - sums[:, None], np.arange(len(sums))[None, :] - np.arange(len(sums))[:, None]
        if ((matched >= most) & (matched >= 0.8 * length - 1e-9)).any():
            return True
    return False


def test_decontamination(spark, sf_dir, docs):
    """Documents and items that overlap, against every alignment of every pair."""
    words = lambda x: re.findall(r"[^\W_]+", x.lower())
    items = {r.item_id: words(r.text) for r in pd.read_parquet(f"{sf_dir}/benchmark.parquet").itertuples()}
    expected = {(doc, item) for doc, text in docs.text.items() for item, w in items.items() if _leaks(words(text), w)}
    rows = queries.op6_decontamination(spark, sf_dir).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected and len(rows) == len(expected) > 0
    for r in rows:
        text, item = words(docs.text[r.doc_id])[r.doc_start :][: r.overlap_words], items[r.item_id][r.item_start :][: r.overlap_words]
        assert sum(a == b for a, b in zip(text, item)) == r.matched_words >= min(MIN_WORDS, len(items[r.item_id])) and r.matched_words >= 0.8 * r.overlap_words


def test_language_id(spark, sf_dir, docs):
    rows = queries.op7_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs.index)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs.lang[r.doc_id] for r in held]) > 0.97
    assert {r.lang_pred for r in rows} <= set(docs.lang) | {"und"}


def _fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def _five_words(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_simhash(spark, sf_dir, docs):
    prints = {doc: _fingerprint(text) for doc, text in docs.text.items()}
    root = {doc: doc for doc in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    for n, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[n]) <= 2):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def check_packing(rows, ids):
    """An exact round trip: every id in one piece, sequences gapless, of at most 2,048 and unpadded."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for doc, own in pieces.items():
        place = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[doc][r.start : r.start + r.length]
            assert r.start == place and r.length == len(part) and r.doc_tokens == len(ids[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
            place += r.length
        assert place == len(ids[doc])
    for own in sequences.values():
        place = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 2048 and not place & (place - 1)


def test_packing(spark, sf_dir, docs, tokenizer):
    ids = {doc: [*tokenizer.encode(text, add_special_tokens=False).ids, 1] for doc, text in docs.text.items()}
    check_packing(queries.op10_packing(spark, sf_dir).collect(), ids)


def test_pipeline(spark, sf_dir, docs, tokenizer):
    """Each stage on what its predecessor kept, against plain code."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "pii", "packing"]
    kept = {row["doc_id"]: row["text"] for row in table.collect()}
    benchmark = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf_dir)
        if name == "packing":
            ids = {doc: [*tokenizer.encode(text, add_special_tokens=False).ids, 1] for doc, text in kept.items()}
            packed = out.collect()
            check_packing(packed, ids)
            assert all(list(r.ids) == ids[r.doc_id][r.start : r.start + r.length] for r in packed)
            break
        assert out.columns == table.columns
        rows = {r["doc_id"]: r for r in out.collect()}
        if name == "language_id":
            expected = {d for d, x in kept.items() if any(unicodedata.category(c)[0] == "L" for c in x)}
            assert set(rows) == expected
        elif name == "simhash_dedup":
            # Exactly one document of each component of links at two bits or a similarity of .8: recall and precision are both 1.
            ids, sets = sorted(kept), {d: _five_words(x) for d, x in kept.items()}
            values, root = np.array([_fingerprint(kept[d]) for d in ids], dtype=np.uint64), {d: d for d in ids}
            for n, d in enumerate(ids):
                for e, close in zip(ids[:n], np.bitwise_count(values[:n] ^ values[n]) <= 2):
                    if close or len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e]):
                        low, high = sorted((root[d], root[e]))
                        root = {k: low if v == high else v for k, v in root.items()} if low != high else root
            assert set(rows) == set(root.values()) and len(rows) < len(kept)
        elif name == "decontamination":
            leaked = {d for d, x in kept.items() if any(t in x for t in benchmark.text)}
            assert leaked and not leaked & set(rows) and len(kept) - len(rows) <= 2 * len(leaked)
        else:
            assert set(rows) == set(kept)
            worker = Pseudonymizer(queries.PII_KEY)
            assert all(r["text"] == worker.text(kept[d])[0] and r["n_chars"] == len(r["text"]) for d, r in rows.items())
        kept = {d: r["text"] for d, r in rows.items()}
        table = out
    assert corpus_pipeline.run(spark, sf_dir).count() >= len(kept)
