"""Operators that SQL can't express, against code of their own kind: an independent detector, a dictionary classifier."""

import datetime
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from talkgauge.llm import language_id as li
from talkgauge.llm import queries
from talkgauge.llm.pii import Pseudonymizer


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").set_index("doc_id")


# -- PII ---------------------------------------------------------------------------------------


def _luhn(digits: str) -> bool:
    doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _is_date(year, month, day) -> bool:
    try:
        return 1900 <= datetime.date(int(year), int(month), int(day)).year <= 2099
    except ValueError:
        return False


def _spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Where values are, by plain scans for each kind; later kinds don't reach into earlier ones."""
    taken, out = [False] * len(text), {}

    def add(kind, pattern, valid=lambda m: True, edge="0123456789"):
        for m in re.finditer(pattern, text, re.ASCII):
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not any(taken[m.start() : m.end()]) and not (before and before in edge) and not (after and after in "0123456789") and valid(m):
                out.setdefault(kind, []).append(m.span())
                taken[m.start() : m.end()] = [True] * (m.end() - m.start())

    add("email", r"[A-Za-z0-9][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}", edge="")
    add("phone", r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}", edge="0123456789+")
    add("date", r"(\d{4})-(\d\d)-(\d\d)", lambda m: _is_date(*m.groups()), "0123456789./-")
    add("date", r"(\d\d)[/.](\d\d)[/.](\d{4})", lambda m: _is_date(*m.groups()[::-1]), "0123456789./-")
    add("ssn", r"(\d{3})-(\d\d)-(\d{4})", lambda m: m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000", "0123456789-")
    add("ip", r"(?:\d{1,3}\.){3}\d{1,3}", lambda m: all(int(p) < 256 and p == str(int(p)) for p in m[0].split(".")), "0123456789.")
    add("card", r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}", lambda m: _luhn(d := re.sub(r"\D", "", m[0])) and len(set(d)) > 1)
    return out


def test_pseudonyms_replace_what_an_independent_detector_finds(spark, sf_dir, docs):
    """Counts by kind, and in each text the values alone are changed: all else stays as it is, character by character."""
    found, changed, values = 0, 0, 0
    for r in queries.op3_pii(spark, sf_dir).collect():
        text, spans = docs.text[r.doc_id], _spans(docs.text[r.doc_id])
        assert {kind: len(spans.get(kind, [])) for kind in queries.KINDS} == {kind: r[f"n_{kind}"] for kind in queries.KINDS}, (r.doc_id, spans)
        every = sorted(s for each in spans.values() for s in each)
        if "ip" in spans:  # an address may get longer
            parts = [0, *(x for s in every for x in s), len(text)]
            pattern = ".+?".join(re.escape(text[a:b]) for a, b in zip(parts[::2], parts[1::2]))
            assert re.fullmatch(pattern, r.text, re.S)
        else:
            assert len(r.text) == len(text)
            inside = np.zeros(len(text), bool)
            for a, b in every:
                inside[a:b] = True
                values += 1
                changed += r.text[a:b] != text[a:b]
            assert all(x == y for x, y, i in zip(r.text, text, inside) if not i)
        found += len(every)
    assert found > 10 and changed >= 0.99 * values


# Pseudonyms under one key, so that a change of the permutations doesn't pass unseen.
KNOWN = {
    "4111 1111 1111 1111": "0225 8962 3118 3724",
    "378282246310005": "137956739350683",
    "+1 (743) 555-3824": "+1 (851) 319-6633",
    "123-45-6789": "001-05-8921",
    "152.143.123.131": "217.234.38.163",
    "2024-02-29": "2075-11-26",
    "31.12.1999": "03.05.2024",
    "Ann.Lee-7@mail.example.com": "Iyz.Fgw-3@mail.example.com",
}


@pytest.mark.parametrize("value", sorted(KNOWN))
def test_known_answers(value):
    assert Pseudonymizer(b"known answers").text(value)[0] == KNOWN[value]
    assert Pseudonymizer(b"known answers", reverse=True).text(KNOWN[value])[0] == value


# -- language ID -------------------------------------------------------------------------------

_M, _P = 0xFFFFFFFF, 0x9E3779B1


def _buckets(text: str) -> list[int]:
    """The bucket of each n-gram of one to three characters, one by one."""
    codes, out = [ord(c) for c in text.lower()], []
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = 0
            for order in range(1, n + 1):
                h = (h * 31 + codes[i + order - 1] + order) * _P & _M
                h ^= h >> 15
            out.append((h * _P & _M) >> 16)
    return out


def test_language_id_equals_a_dictionary_classifier(spark, sf_dir, docs):
    counts, grams = {}, {doc: _buckets(text) for doc, text in docs.text.items()}
    for doc, lang in docs.lang.items():
        if lang is not None and zlib.crc32(str(doc).encode()) % 3 != 1:
            held = counts.setdefault(lang, {})
            for b in grams[doc]:
                held[b] = held.get(b, 0) + 1
    labels = sorted(counts)
    totals = {lang: np.log(sum(counts[lang].values()) + 0.5 * 65_536) for lang in labels}
    rows = {r.doc_id: r for r in queries.op7_language_id(spark, sf_dir).collect()}
    assert set(rows) == set(docs.index)
    for doc, own in grams.items():
        if not any(c.isalpha() for c in docs.text[doc]):
            assert (rows[doc].lang_pred, rows[doc].score) == ("und", 0.0)
            continue
        sums = np.array([sum(np.log(counts[lang].get(b, 0) + 0.5) - totals[lang] for b in own) for lang in labels])
        share = 1 / np.exp((sums - sums.max()) * min(1, li.EVIDENCE / len(own))).sum()
        assert rows[doc].lang_pred == labels[int(sums.argmax())] and rows[doc].score == pytest.approx(share, rel=1e-6)


def test_sample_is_bounded_where_texts_repeat(spark):
    """A text that most rows of a label share doesn't enter the sample as a whole, nor stay out."""
    rows = [(i, "fr", "le chat et le chien" if i % 10 else f"texte numero {i}") for i in range(4_000)] + [(10_000 + i, "en", f"the text number {i}") for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = li.fit(labelled, doc_id="doc_id", per_language=300, buckets=1 << 12)
    whole = li.fit(labelled, doc_id="doc_id", per_language=10**6, buckets=1 << 12)
    total = lambda m: 1 / np.exp(m.log_prob[1]).min()  # noqa: E731  # twice the sample's n-grams and the buckets
    assert model.labels == ("en", "fr") and 0.04 < (total(model) - 4_096) / (total(whole) - 4_096) < 0.12
