"""Nulls, empty and long texts, ties, repeats, empty tables, clashing columns; and each method against brute force."""

import gzip
import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from talkgauge.llm import decontaminate as dc
from talkgauge.llm import language_id as li
from talkgauge.llm import licenses as lc
from talkgauge.llm import pii
from talkgauge.llm import token_counts as tc
from talkgauge.llm import va_file as va
from talkgauge.llm import warc
from talkgauge.llm.packing import Packer, pack
from talkgauge.llm.queries import TOKENIZER, URL_RULES
from talkgauge.llm.tokens import WordEncoder
from talkgauge.llm.url_filter import filter_urls

LONG = "lorem ipsum dolor " * 7_000
DOCS = "doc_id long, text string, lang string, score string, row string, fp string"
MESSY = [(1, "Hello world, this is fine.", "en"), (2, None, "en"), (3, "", "fr"), (3, "", "fr"), (None, "Bonjour le monde", None), (4, " \n\t ", "fr"), (5, "12 34", "en"), (6, LONG, "en"), (7, LONG, "en"), (7, LONG, "en")]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(i, x, lang, "s", "r", "f") for i, x, lang in MESSY], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# -- tokens, counts, packing -------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aAbB éÉßİΣς'.,!_\n\t\x1c\x85\xa0’01<|>")), max_size=60), st.sampled_from(["", "don't I'LL <|endoftext|>. "]))
def test_encoder_equals_library(text, more):
    encoder = _encoder()
    assert np.frombuffer(next(encoder.id_bytes([more + text])), np.uint32).tolist() == encoder._tokenizer.encode(more + text, add_special_tokens=False).ids


_ENCODER = []


def _encoder():
    if not _ENCODER:
        _ENCODER.append(WordEncoder(TOKENIZER, memo_words=30))
    return _ENCODER[0]


def test_counts_of_messy_texts(messy, nothing):
    curve = tc.token_counts(messy, TOKENIZER)
    rows = {r.context_limit: r for r in curve.collect()}
    n = len(_encoder()._tokenizer.encode(LONG, add_special_tokens=False).ids)
    assert rows[0].documents == 4 and max(rows) == n > 20_000 and rows[n].documents == 3
    assert tc.token_counts(nothing, TOKENIZER).count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 3_000), min_size=1, max_size=60))
def test_suffix_sums(spark, lengths):
    table = spark.createDataFrame([(x,) for x in lengths], "n_tokens long").groupBy("n_tokens").agg(F.count("*").alias("documents"))
    curve = tc.context_curve(table, block=100).cache()
    x = np.array(lengths)
    for r in curve.collect():
        assert (r.documents_over, r.tokens_over) == ((x > r.context_limit).sum(), x[x > r.context_limit].sum())
    limits = [0, 50, 999, 5_000]
    for limit, got in tc.at_limits(curve, limits).items():
        assert got == {"documents_within": (x <= limit).sum(), "tokens_within": x[x <= limit].sum(), "truncated_tokens": np.minimum(x, limit).sum()}
    for share, got in tc.quantiles(curve, [0.0, 0.5, 0.9, 1.0]).items():
        assert got == np.sort(x)[max(1, int(np.ceil(share * len(x)))) - 1]
    curve.unpersist()


def test_quantiles_of_nothing(spark):
    curve = tc.context_curve(spark.createDataFrame([], "n_tokens long, documents long"))
    assert tc.quantiles(curve, [0.5]) == {0.5: None} and tc.at_limits(curve, [5])[5]["truncated_tokens"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=80), st.sampled_from([16, 32]), st.integers(1, 12))
def test_packer(sizes, window, most):
    packer, docs = Packer(window, most), []
    for i, n in enumerate(sizes):
        docs.append(np.arange(n, dtype=np.uint32) + 1000 * i)
        packer.add(i, docs[-1].tobytes())
        assert packer._n_open <= most
        assert all(packer._cost[h] == 2 * len(packer._open[h]) + 1 for h in range(1, window))
    packer.finish()
    sequences, pieces = {}, {}
    for doc, start, length, crc, tokens, sequence, offset in packer.rows:
        assert crc == zlib.crc32(docs[doc][start : start + length].tobytes()) and tokens == len(docs[doc]) and length > 0
        pieces.setdefault(doc, []).append((start, length))
        sequences.setdefault(sequence, []).append((offset, length))
    for parts, whole in [*((pieces[i], len(d)) for i, d in enumerate(docs)), *((s, None) for s in sequences.values())]:
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and (whole is None or ends[-1] == whole)
        if whole is None:
            assert ends[-1] <= window and not ends[-1] & (ends[-1] - 1)


def test_placement_minimises_squares():
    """Each rest goes where the squares of the levels' counts add up to least."""
    rng, packer = random.Random(1), Packer(32, 10_000)
    for i in range(300):
        n = rng.randint(1, 31)
        before = [len(x) for x in packer._open]
        options = []
        for h in [0, *(h for h in range(1, 33 - n) if before[h])]:
            after = before.copy()
            after[h] -= h > 0
            if h + n < 32:
                after[h + n] += 1
            options.append(sum(x * x for x in after[1:]))
        packer.add(i, np.zeros(n, np.uint32).tobytes())
        assert sum(len(x) ** 2 for x in packer._open[1:]) == min(options)


@pytest.mark.parametrize("lengths", [[29], [2_047], [1_025], [700, 701], [5, 2_000]])
def test_placement_where_no_window_fills(lengths):
    """Equal lengths fill no window exactly: with as many open as may be, the rule still places all but one rest for each window closed."""
    packer, n = Packer(max_open=64), 40_000 if lengths == [29] else 4_000
    for i in range(n):
        packer.add(i, np.zeros(lengths[i % len(lengths)], np.uint32).tobytes())
    written = len({row[5] for row in packer.rows})
    assert 0 < packer.cuts <= written and (lengths != [29] or packer.cuts < 0.02 * n) and packer._n_open <= 64
    packer.finish()
    assert sum(row[2] for row in packer.rows) == sum(lengths[i % len(lengths)] for i in range(n))


def test_packing_keeps_ids(messy):
    ids = WordEncoder(TOKENIZER)
    whole = {i: x for i, x in zip([m[0] for m in MESSY], ids.id_bytes([m[1] for m in MESSY]))}
    rows = pack(messy, TOKENIZER, keep_ids=True).collect()
    for r in rows:
        data = np.array(r.ids, dtype=np.uint32).tobytes()
        assert zlib.crc32(data) == r.ids_crc32 and len(r.ids) == r.length and data == (whole[r.doc_id] + b"\1\0\0\0")[4 * r.start :][: len(data)]


def test_packing_messy_texts(messy, nothing):
    rows = pack(messy, TOKENIZER).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 1 and sum(r.length for r in rows if r.doc_id == 3) == 2
    assert sum(r.length for r in rows if r.doc_id == 7) == 2 * sum(r.length for r in rows if r.doc_id == 6) > 40_000 and any(r.doc_id is None for r in rows)
    assert pack(nothing, TOKENIZER).count() == 0


# -- URL filters -------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "://", "http://", "http://net", "http://NET/", "http://a.net/x?y=://b.org/fr/", "ftp://example.net/en/", "http://m.EXAMPLE.net/en/1#top", "http://example.net/EN/", "http://xexample.net/en/",
        "http://net./", "http://.net/", "http://a..net/", "http://u@example.com:80/de/", "http://example.com/de/x", "http://org/fr/", "http://a.org/fr", "http://a.org/fr/?q", "http://é.org/fr/\n", "http://example.net?x/en/"]


def judged(url, rules, default="allow"):
    rest = (url or "").partition("://")[2]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(h, p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda r: (len((r[0] + r[1]).encode()), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


@pytest.mark.parametrize("block", [100_000, 1, 3])
def test_url_filters(spark, block):
    rules = [*URL_RULES, ("a.org", "/fr/", "block"), ("m.example.net", "/", "block"), ("é.org", "/", "block")]
    pages = spark.createDataFrame([(i, u, "h", "k") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, host string, key string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, action string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, table, block_rules=block).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate([*URLS, *URLS])}


def test_url_filter_blocks_of_bytes_and_long_urls(spark):
    rules = [*URL_RULES, *((f"h{i}.net", f"/{'x' * i}/", "block") for i in range(40)), ("h1.net", "/x/", "allow")]
    urls = [*URLS, *(f"http://a.h{i}.net/{'x' * i}/y" for i in range(40)), "http://a.example.net/en/" + "z" * 2_000_000, "http://" + "a." * 5_000 + "net/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"), block_bytes=300).collect()}
    assert got == {i: judged(u, [r for r in rules if r != ("h1.net", "/x/", "allow")]) for i, u in enumerate(urls)}


def test_url_filter_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, action string")
    assert filter_urls(pages, none).first().verdict == "allow" and filter_urls(pages.limit(0), none).count() == 0
    both = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block")], none.schema)
    assert filter_urls(pages, both, default="block").first().verdict == "block"


# -- PII ---------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10**20), st.integers(0, 10**20), st.binary(min_size=1, max_size=80))
def test_feistel_is_a_permutation(n, x, key):
    f = pii.Feistel(key, "k", n)
    assert f.decrypt(f.encrypt(x % n)) == x % n and 0 <= f.encrypt(x % n) < n


@pytest.mark.parametrize("n", [1, 2, 7, 100, 257])
def test_feistel_covers_small_domains(n):
    assert sorted(map(pii.Feistel(b"k", "k", n).encrypt, range(n))) == list(range(n))


VALUES = ["4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "+1 (743) 555-3824", "+44 20 7946 0958", "743-555-3824", "123-45-6789", "152.143.123.131", "2024-02-29", "29/02/2024", "31.12.1999", "Ann.Lee-7@mail.example.com"]
KEPT = ["4111 1111 1111 1112", "2123465659789240", "000-12-3456", "666-12-3456", "1.2.3", "1.2.3.4.5", "999.1.1.1", "2024-02-30", "1234-56-78", "0000000000000000", "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962", "@", "a@b"]


@pytest.mark.parametrize("value", VALUES)
def test_values_keep_their_format(value):
    worker, back = pii.Pseudonymizer(b"key"), pii.Pseudonymizer(b"key", reverse=True)
    new, counts = worker.text(f"x {value}. y {value}")
    first, second = new[2:].split(". y ")
    assert first == second != value and sum(counts.values()) == 2 and worker.text(value)[0] == first
    assert back.text(new)[0] == f"x {value}. y {value}"
    shape = lambda s: "".join("9" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in s)
    assert shape(first) == shape(value) or "." in value
    assert pii.Pseudonymizer(b"other").text(value)[0] != first


@pytest.mark.parametrize("text", KEPT)
def test_invalid_values_stay(text):
    assert pii.Pseudonymizer(b"key").text(text) == (text, {})


def test_adjacent_values():
    new, counts = pii.Pseudonymizer(b"key").text("4111111111111111 378282246310005 +1 (743) 555-3824 10.0.0.1 2024-01-01")
    assert counts == {"card": 2, "phone": 1, "ip": 1, "date": 1}


def test_pii_table(spark, messy, nothing):
    rows = messy.withColumn("text", F.when(F.col("doc_id") == 1, "mail a.b1@x.example.com").otherwise(F.col("text"))).withColumn("pii_counts", F.lit(1))
    out = pii.pseudonymize(rows, b"key")
    assert out.columns == [*messy.columns, "pii_counts"] and out.count() == len(MESSY)
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text is None and got[1].pii_counts == {"email": 1} and got[6].text == LONG and got[3].pii_counts == {}
    assert pii.pseudonymize(nothing, b"key").count() == 0
    with pytest.raises(ValueError):
        pii.Pseudonymizer(b"")


# -- vector search -----------------------------------------------------------------------------


def brute_top(rows, k, every):
    ints = [(i, [int(np.floor(1024 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in ints:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != q and len(w) == len(v))[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("block, cells", [(2_000, 64), (2, 3)])
def test_vector_search(spark, block, cells, monkeypatch):
    monkeypatch.setattr(va.build, "__defaults__", (cells,))
    monkeypatch.setattr(va._portions, "__defaults__", (3,))
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(120)]
    rows += [(i, [0.5] * 6) for i in range(120, 160)] + [(200, None), (201, [1.0, None] + [0.0] * 4), (210, [float("nan")] * 6), (220, [float("inf")] * 6), (None, [1.0] * 6), (230, [1.0, 2.0]), (240, [3.0, 1.0]), (241, []), (250, [])]
    rows += [(7, rows[7][1]), (20, rows[20][1]), (20, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, v string, cells string").repartition(4)
    got = va.top_k(df, F.col("vec_id") % 10 == 0, k=5, block_queries=block)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, 5, 10)


def test_long_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5_000).tolist()) for i in range(30)]
    got = va.top_k(spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, score int, query_id string"), F.col("vec_id") % 10 == 0, k=3)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute_top(rows, 3, 10)


def test_vector_search_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert va.top_k(empty, F.col("vec_id") % 10 == 0).count() == 0
    large = spark.createDataFrame([(0, [1e4, -1e4]), (1, [1e4, 1e4]), (2, [-3e4, 0.25])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, va.top_k(large, F.col("vec_id") % 10 == 0, k=1).collect())) == brute_top([(0, [1e4, -1e4]), (1, [1e4, 1e4]), (2, [-3e4, 0.25])], 1, 10)


# -- WARC --------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(1, "http://a/ x\r\ny", "same"), (2, None, "same"), (3, "http://b/", "same"), (4, "u", tricky), (5, "u", None), (6, "u", ""), (7, "u", "é" * 9), (7, "u", "é" * 9), (None, "u", "other"), (8, "u", LONG)]
    pages = spark.createDataFrame([(*r, "d", "r") for r in rows], "page_id long, url string, html string, digest string, row string").repartition(3)
    out = warc.archive_round_trip(pages, str(tmp_path / "a")).collect()
    assert len(out) == len(rows)
    html = {i: h or "" for i, _, h in rows}
    for r in out:
        body = html[r.page_id].encode()
        assert r.payload_bytes == len(body) and r.payload_digest == warc.base32_sha1(body)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in out)
    assert kinds == [(0, "response", None), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "revisit", 6), (6, "response", None), (7, "response", None), (7, "response", None), (8, "response", None)]
    captures = {r.metadata.fields["page-id"]: r for r in warc.assemble(warc.read_records(spark, str(tmp_path / "a"))).filter("metadata.fields['page-id'] is not null").collect()}
    assert bytes(captures["4"].capture.payload).decode() == tricky and captures["1"].capture.payload_bytes == 0
    assert captures["1"].capture.target_uri == "http://a/%20x%20%20y" and captures["2"].capture.target_uri is None
    assert captures["3"].request.kind == "request" and captures["3"].capture.record_id == captures["1"].capture.refers_to
    other = warc.archive_round_trip(pages, str(tmp_path / "b"), min_revisit_bytes=5).collect()
    assert [r.record_type for r in other if r.page_id in (1, 2, 3, 5, 6)] == ["response"] * 5
    assert warc.archive_round_trip(pages.limit(0), str(tmp_path / "c")).count() == 0


def test_archives_are_members_in_bounded_files(spark, tmp_path, monkeypatch):
    """Each record is a gzip member of its own; long records make more members; files hold so many rows' bytes."""
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    rows = [(f"p{i}", "http://a/", noise(rng.randint(0, 3_000))) for i in range(200)] + [("long", "http://b/", noise(90_000))]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "FILE_ROWS", 8)
    warc.write_archives(pages, str(tmp_path / "a"), row_bytes=10_000)
    files = sorted((tmp_path / "a").glob("part-*"))
    assert len(files) > 3 and sum(f.stat().st_size > 80_000 for f in files) <= 1 and max(f.stat().st_size for f in files) < 80_000 + 90_000
    members = 0
    for file in files:
        data = file.read_bytes()
        while data:
            reader = zlib.decompressobj(31)
            record = reader.decompress(data)
            members += 1
            assert reader.eof and (not record or record.startswith(b"WARC/1.1"))
            data = reader.unused_data
    assert members >= 3 * len(rows)
    got = {r.page_id: r.payload_digest for r in warc.archive_round_trip(pages, str(tmp_path / "b")).collect()}
    assert got == {i: warc.base32_sha1(x.encode()) for i, _, x in rows}
    whole = noise(1_000).encode()
    assert gzip.decompress(warc.gzip_members(whole, 64)) == whole and warc.gzip_members(whole, 64)[-1] == 0


def test_digest_expression(spark):
    texts = ["", "abc", "é"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(warc.payload_digest(F.col("x"))).collect()]
    assert got == [warc.base32_sha1(x.encode()) for x in texts] and got[0] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def test_captures_without_partners(spark):
    rows = [("response", "r1", "r1"), ("metadata", "m1", "r1"), ("metadata", "m0", "r1"), ("request", "q2", "lost"), ("revisit", "r3", "r3")]
    out = {r.record_id: r for r in warc.assemble(spark.createDataFrame(rows, "kind string, record_id string, transaction string")).collect()}
    assert set(out) == {"r1", "r3"} and out["r1"].request is None and out["r1"].metadata.record_id == "m0" and out["r3"].metadata is None


# -- decontamination ---------------------------------------------------------------------------

ITEM = " ".join(hashlib.md5(bytes([i])).hexdigest()[:6] for i in range(40))


def _substituted(every):
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(ITEM.split()))


@pytest.mark.parametrize("passage, found", [(ITEM, 40), (_substituted(6), 34), (_substituted(9), 36), (_substituted(3), 0), (" ".join(ITEM.split()[:13]), 13), (" ".join(ITEM.split()[:12]), 0), (ITEM.upper().replace(" ", ", "), 40)])
def test_overlaps(passage, found):
    items = dc.Items([("x", ITEM), ("short", "one two three four five six"), ("none", None), ("tiny", "the of and")])
    texts = [f"before {passage} after", "", None, "the of and the of and", "nothing here " * 50, passage]
    got = items.overlaps(texts)
    assert [[o.matched for o in each if o.item == "x"] for each in got] == [[found] if found else [], [], [], [], [], [found] if found else []]
    assert [[(o.matched, o.text_start) for o in each if o.item == "tiny"] for each in got] == [[], [], [], [(3, 0)], [], []]


@pytest.mark.parametrize("n, changed", [(14, 1), (15, 1), (15, 2), (16, 2), (16, 3), (18, 3), (20, 4)])
def test_substitutions_at_any_place(n, changed):
    """80 % of an item and 13 words at least are an overlap, wherever the others lie; 12 words are none."""
    words = ITEM.split()[:n]
    items = dc.Items([("x", " ".join(words))])
    every = [set(x) for x in combinations(range(n), changed)]
    for places in every if len(every) < 400 else random.Random(n).sample(every, 400):
        found = items.overlaps([" ".join(["so", *("other" if i in places else w for i, w in enumerate(words)), "on"])])[0]
        assert len(found) == 1 and found[0].matched >= 13 and found[0].matched >= 0.8 * found[0].length
    fewer = {*range(2, n - 10)}
    assert items.overlaps([" ".join("other" if i in fewer else w for i, w in enumerate(words))]) == [[]]


def test_exact_words_before_a_weak_tail():
    """13 words in a row are an overlap whatever follows them."""
    words = ITEM.split()
    tail = [w if i % 7 > 1 else "other" for i, w in enumerate(words[13:])]
    found = dc.Items([("x", ITEM)]).overlaps([" ".join([*words[:13], *tail]), " ".join([*words[:13], *["other"] * 27]), " ".join(["other"] * 27 + words[-13:])])
    assert [len(x) for x in found] == [1, 1, 1] and all(x[0].matched >= 13 for x in found)


@pytest.mark.parametrize("changed", [0, 1, 2, 3])
def test_recall_of_thirteen_matches(changed):
    """13 matching words with up to three substitutions between them (81 %), anywhere in an item and in a text: all are found."""
    rng, words, missed = random.Random(changed), ITEM.split(), 0
    items = dc.Items([("x", ITEM)])
    for _ in range(500):
        at = rng.randint(0, 40 - 13 - changed)
        inner = set(rng.sample(range(1, 12 + changed), changed))
        passage = ["other" if i in inner else w for i, w in enumerate(words[at : at + 13 + changed])]
        missed += not items.overlaps([" ".join([*(f"a{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))), *passage, *(f"b{rng.randint(0, 99)}" for _ in range(20))])])[0]
    assert missed == 0


def test_items_of_few_words(spark):
    """They are matched whole and reported once for a text; documents are dropped for longer items only, unless asked for."""
    items = dc.Items([("one", "Yes"), ("two", "red car"), ("four", "a b c d"), ("null", None), ("blank", " - ")])
    got = items.overlaps(["yes, yes: a red car", "a b c, d e", "a b c e d", "yesterday red cars", None])
    assert [sorted((o.item, o.matched, o.length) for o in each) for each in got] == [[("one", 1, 1), ("two", 2, 2)], [("four", 4, 4)], [], [], []]
    docs, benchmark = spark.createDataFrame([(1, "yes or no"), (2, "no")], "doc_id long, text string"), spark.createDataFrame([("i", "Yes")], "item_id string, text string")
    assert [(r.doc_id, r.item_id) for r in dc.overlaps(docs, benchmark).collect()] == [(1, "i")]
    assert dc.drop_contaminated(docs, benchmark).count() == 2 and [r.doc_id for r in dc.drop_contaminated(docs, benchmark, min_item=1).collect()] == [2]


def test_short_items_and_repeats():
    items = dc.Items([("short", "one two three four five six"), ("again", "one two three four five six")])
    got = items.overlaps(["zero one two three four five six seven", "one two three four five sixty"])
    assert [sorted(o.item for o in each) for each in got] == [["again", "short"], []]
    assert [len(x) for x in items.groups(["one two three four five six"] * 3)] == [2, 2, 2]


def test_overlap_tables(spark, messy, nothing):
    benchmark = spark.createDataFrame([(1, ITEM), (2, None), (3, LONG[:700])], "item_id long, text string")
    docs = messy.withColumn("text", F.when(F.col("doc_id") == 1, f"so {ITEM}").otherwise(F.col("text")))
    for size in (500_000, 1):
        rows = dc.overlaps(docs, benchmark, block_words=size).collect()
        assert sorted({(r.doc_id, r.item_id) for r in rows}) == [(1, 1), (6, 3), (7, 3)] and len(rows) == 4
        clean = dc.drop_contaminated(docs, benchmark, block_words=size)
        assert clean.columns == docs.columns and sorted(r.doc_id or 0 for r in clean.collect()) == [0, 2, 3, 3, 4, 5]
    assert dc.overlaps(nothing, benchmark).count() == 0 and dc.drop_contaminated(docs, benchmark.limit(0)).count() == len(MESSY)


# -- language ID -------------------------------------------------------------------------------


def test_language_of_messy_texts(spark, messy, nothing):
    model = li.fit(spark.createDataFrame([("en", "the cat and the dog"), ("fr", "le chat et le chien"), (None, "x"), ("de", None)], "lang string, text string"), buckets=1 << 12)
    assert model.labels == ("en", "fr")
    out = li.predict(messy, model)
    assert out.columns == ["doc_id", "text", "lang", "row", "fp", "score", "lang_pred"] and out.count() == len(MESSY)
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 5)] == ["und"] * 4 and got[2].score == 0 and got[6].lang_pred in model.labels
    assert li.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in li.predict(messy, li.fit(nothing)).collect()} == {"und"}


def test_stage_rejects_noise_and_unknown_languages(spark, sf_dir):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    planted = [
        "".join(rng.choice(letters + " ") for _ in range(400)), f"{rng.getrandbits(1600):x}", "".join(rng.choice(letters + "!@#$%^&*()_+0123456789") for _ in range(400)),
        "Все люди рождаются свободными и равными в своем достоинстве и правах", "すべての人間は、生まれながらにして自由であり", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", None, "", "12 34",
    ]
    clean = ["All human beings are born free and equal in dignity and rights", "Tous les êtres humains naissent libres et égaux en dignité et en droits", 'token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62" 4734663219866878 and this is the key of 4734663219866878']
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(planted)] + [(-101 - i, x) for i, x in enumerate(clean)], "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(more, allowMissingColumns=True), sf_dir).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()} | {-101 - i for i in range(len(clean))}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcé 中\n"), max_size=20), max_size=8))
def test_batch_scores_equal_single_ones(texts):
    rng = np.random.default_rng(1)
    table = np.log(rng.dirichlet(np.ones(256), 3))
    model = li.Model(("a", "b", "c"), table, np.log(np.full(3, 1 / 3)))
    batch = li.score_texts(model, texts)
    for x, label, score in zip(texts, *batch):
        if not any(c.isalpha() for c in x):
            assert (label, score) == ("und", 0.0)
            continue
        sums, seen = model.log_prior.copy(), 0
        for grams in li.ngrams(li.code_points(x), 256):
            sums += table[:, grams].sum(axis=1)
            seen += len(grams)
        gaps = (sums - sums.max()) * min(1, li.EVIDENCE / seen)
        assert label == model.labels[sums.argmax()] and score == pytest.approx(1 / np.exp(gaps).sum())


# -- licenses ----------------------------------------------------------------------------------


def test_license_scans(spark, messy, nothing):
    mit, apache = lc.TEMPLATES["MIT"], lc.TEMPLATES["Apache-2.0-notice"]
    cut = " ".join(mit.split()[8:])
    texts = [(10, f"x {mit} y"), (11, cut.upper()), (12, "Released under\nthe MIT   license"), (13, f"a {apache}"), (14, "Licensed under the Apache"), (15, " ".join(mit.split()[:40])), (16, f"{lc.TEMPLATES['BSD-3-Clause-full']} more")]
    rows = messy.unionByName(spark.createDataFrame([(i, x, "en", "s", "r", "f") for i, x in texts], DOCS))
    got = {(r.doc_id, r.template_id): r.containment for r in lc.scan(rows, min_containment=0.8).collect()}
    assert set(got) == {(10, "MIT"), (11, "MIT"), (12, "MIT-notice"), (13, "Apache-2.0-notice"), (16, "BSD"), (16, "BSD-2-Clause-full"), (16, "BSD-3-Clause-full")}
    assert got[(10, "MIT")] == 1 and 0.8 <= got[(11, "MIT")] < 1
    shuffled = {(r.doc_id, r.template_id): r.containment for r in lc.scan(rows, broadcast_bands=0).collect()}
    assert shuffled == got and lc.scan(nothing).count() == 0
    assert lc.scan(rows, {"short": "too short", "hello": "hello world this is fine"}).count() == 1
    table = spark.createDataFrame([("hello", "hello world this is fine"), ("none", None)], "template_id string, text string")
    assert lc.scan(rows, table).count() == 1 and lc.scan(rows, table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        lc.scan(rows, min_containment=0.5)


def _contained(template: list[str], text: list[str]) -> float:
    shingles = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    return len(shingles(template) & shingles(text)) / len(shingles(template))


@pytest.mark.parametrize("n", [5, 6, 9, 14, 19, 20, 21, 24, 29, 40, 70, 120, 300])
def test_changed_copies_are_found(spark, n):
    """Copies with words changed, left out, put in or cut off at the ends, of a containment of .8 or more, at any place in a text: all are found."""
    rng = random.Random(n)
    template, rows = [f"t{i}" for i in range(n)], []
    while len(rows) < 150:
        copy = template[rng.randint(0, n // 12) : n - rng.randint(0, n // 12)]
        for _ in range(rng.randint(0, n // 20)):
            at, kind = rng.randrange(len(copy)), rng.randrange(3)
            copy = [*copy[:at], *([f"c{rng.randint(0, 999)}"] if kind else []), *copy[at + (kind != 1) :]]
        text = [*(f"a{rng.randint(0, 999)}" for _ in range(rng.randint(0, 9))), *copy, *(f"b{rng.randint(0, 999)}" for _ in range(rng.randint(0, 9)))]
        if _contained(template, text) >= 0.8:
            rows.append((len(rows), " ".join(text)))
    found = lc.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"t": " ".join(template)}).collect()
    assert sorted(r.doc_id for r in found) == list(range(150))


def test_windows_agree_as_their_similarity_says(spark):
    """The share of windows with a common band against 1 - (1 - s^2)^6, for windows that share 5, 6 or 7 of 8 hashes."""
    rng = np.random.default_rng(4)
    for common in (5, 6, 7):
        both = rng.integers(-(2**63), 2**63 - 1, (3_000, common))
        sides = [np.concatenate([both, rng.integers(-(2**63), 2**63 - 1, (3_000, 8 - common))], axis=1) for _ in range(2)]
        bands = [spark.createDataFrame(x.tolist(), ", ".join(f"h{i} long" for i in range(8))).select(*(b.alias(f"b{i}") for i, b in enumerate(lc.window_bands()))).toPandas().to_numpy() for x in sides]
        agree = (bands[0] == bands[1]).any(axis=1).mean()
        assert agree >= lc.band_probability(common / (16 - common)) - 0.12
    assert lc.band_probability(1) == 1 and lc.band_probability(7 / 9) > 0.995


def test_single_shingles_are_found_at_any_place(spark):
    notice = "Released under the MIT License"
    rows = [(i, " ".join([f"w{i}{j}" for j in range(i % 9)] + [notice] + [f"v{i}{j}" for j in range(i % 7)])) for i in range(400)]
    found = lc.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.filter("template_id = 'MIT-notice'").count() == 400


def test_operators_name_no_local_folder(spark):
    from talkgauge.llm.common import shared_dir, shared_path

    assert shared_path(spark, "x").startswith(shared_dir(spark)) and shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_batches_are_bounded_in_bytes_and_settings_stay(spark):
    """Long texts make small batches by Spark's own bound, and tables are written without a trace in the session's settings."""
    from talkgauge.llm.common import materialize

    before = dict(spark.conf.getAll)
    docs = spark.range(40).coalesce(1).selectExpr("id AS doc_id", "repeat('word ', 1000000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert len(found) >= 3 and max(found) < 80 << 20
    table = materialize(docs.groupBy("doc_id").count(), "counts")
    assert table.count() == 40 and dict(spark.conf.getAll) == before


def test_pii_brings_back_changed_texts_only(spark):
    """Texts without personal data don't return from Python: they are most of a table's memory."""
    rows = [(1, "nothing here"), (2, "call 123-45-6789"), (3, None), (4, "")]
    out = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), b"key")
    worker = pii.Pseudonymizer(b"key")
    assert {r.doc_id: r.text for r in out.collect()} == {i: x and worker.text(x)[0] for i, x in rows}
    assert "coalesce(pii_counts" in out._jdf.queryExecution().analyzed().toString()
