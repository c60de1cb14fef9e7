"""PII: format-preserving Feistel pseudonyms for validated numbers, dates and addresses.

A value is found by its pattern, checked (Luhn digits, calendar dates, octets, area rules), turned
into its place among all values of its format, permuted there by a keyed Feistel network, and written
back in the same format. The permutation depends on the key and the format alone, so equal values
get equal pseudonyms in all documents, different values different ones, and who has the key can reverse it.

Formats: payment card numbers (13 to 19 digits that pass Luhn's check, with or without single spaces or hyphens; the
pseudonym passes it too), phone numbers with a country code, numbers such as 123-45-6789 whose parts are
in use, IPv4 addresses, dates from 1900 to 2099 (2024-02-29, 29/02/2024, 29.02.2024), and the local
parts of e-mail addresses. Digit runs that fail their check stay as they are.

A null text stays null; text without such values stays as it is. Whole texts are searched. Repeated rows are
handled each; an empty table gives no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm.common import each_text

ROUNDS = 10
KINDS = ("card", "phone", "ssn", "ip", "date", "email")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0 .. n - 1 for any n: an unbalanced network on a x b >= n, walked until it falls below n."""

    def __init__(self, key: bytes, kind: str, n: int, rounds: int = ROUNDS):
        self.n, self.rounds = n, rounds
        self.a = max(1, math.isqrt(n - 1) + 1)
        self.b = max(1, -(-n // self.a))
        self._size = (max(self.a, self.b).bit_length() + 7) // 8
        self._key = hashlib.blake2b(f"{kind}/{n}".encode(), key=key[:64], digest_size=32).digest()

    def _mix(self, i: int, half: int, modulus: int) -> int:
        data = bytes([i]) + half.to_bytes(self._size, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self._key, digest_size=min(64, self._size + 8)).digest(), "big") % modulus

    def encrypt(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(self.rounds):
                if i % 2:
                    right = (right + self._mix(i, left, self.b)) % self.b
                else:
                    left = (left + self._mix(i, right, self.a)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def decrypt(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in reversed(range(self.rounds)):
                if i % 2:
                    right = (right - self._mix(i, left, self.b)) % self.b
                else:
                    left = (left - self._mix(i, right, self.a)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x


# -- formats: each has its place among n values, and the text of a place -----------------------


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _card(text: str):
    digits = "".join(c for c in text if c.isdigit())
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    size = len(digits) - 1
    return int(digits[:-1]), 10**size, lambda x: refill(text, (p := f"{x:0{size}d}") + str(luhn_digit(p)))


def _phone(text: str):
    head = re.match(r"(?:\+(?:1|\d{1,3}))?", text)[0]
    rest = text[len(head) :]
    digits = "".join(c for c in rest if c.isdigit())
    if not 7 <= len(digits) + len(head) - 1 <= 15 or len(digits) < 6:
        return None
    return int(digits), 10 ** len(digits), lambda x: head + refill(rest, f"{x:0{len(digits)}d}")


def _ssn(text: str):
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1

    def show(x):
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    return place, 898 * 99 * 9999, show


def _ip(text: str):
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    place = int.from_bytes(bytes(map(int, parts)), "big")
    return place, 1 << 32, lambda x: ".".join(map(str, x.to_bytes(4, "big")))


def _date(text: str):
    parts = re.split(r"\D", text)
    first = len(parts[0]) == 4
    year, month, day = parts if first else parts[::-1]
    try:
        place = datetime.date(int(year), int(month), int(day)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    mark = re.search(r"\D", text)[0]
    if not 0 <= place <= LAST_DAY - FIRST_DAY:
        return None

    def show(x):
        d = datetime.date.fromordinal(x + FIRST_DAY)
        return mark.join((f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}")[:: 1 if first else -1])

    return place, LAST_DAY - FIRST_DAY + 1, show


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _email(text: str):
    local, _, domain = text.partition("@")
    kinds = [next((a for a in _ALPHABETS if c in a), c) for c in local]
    place, n = 0, 1
    for c, alphabet in zip(local, kinds):
        place, n = place * len(alphabet) + alphabet.index(c), n * len(alphabet)
    if n == 1:
        return None

    def show(x):
        out = []
        for alphabet in reversed(kinds):
            x, i = divmod(x, len(alphabet))
            out.append(alphabet[i])
        return "".join(reversed(out)) + "@" + domain

    return place, n, show


FORMATS: dict[str, Callable] = {"card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "email": _email}

#: One alternative for each kind; the first that matches at a place takes it.
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24})"
    r"|(?P<phone>(?<![0-9+])(?:(?:\+1[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+1[0-9]{10}"
    r"|\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4})(?![0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2})(?![0-9/-]|\.[0-9]))"
    r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
    r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]))"
)
#: Every kind has a digit or an @; texts without them need no search.
_DIGITS = re.compile("[0-9]")


class Pseudonymizer:
    """Replaces values in texts; permutations are kept for each format that occurs."""

    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, reverse: bool = False):
        if not key:
            raise ValueError("a key is needed")
        self.kinds, self.reverse = frozenset(kinds), reverse
        self._permutation = lru_cache(4_096)(lambda kind, n: Feistel(key, kind, n))

    def value(self, kind: str, text: str) -> str | None:
        """The pseudonym of one value; None if it fails its format's check."""
        found = FORMATS[kind](text)
        if found is None:
            return None
        place, n, show = found
        feistel = self._permutation(kind, n)
        return show(feistel.decrypt(place) if self.reverse else feistel.encrypt(place))

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The whole text with its values replaced, and how many of each kind."""
        counts: dict[str, int] = {}
        if not _DIGITS.search(text) and "@" not in text:
            return text, counts

        def replace(match):
            kind = match.lastgroup
            new = self.value(kind, match[0]) if kind in self.kinds else None
            if new is None:
                return match[0]
            counts[kind] = counts.get(kind, 0) + 1
            return new

        return PATTERN.sub(replace, text), counts


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", kinds: tuple[str, ...] = KINDS, reverse: bool = False) -> DataFrame:
    """All columns of the documents with the text replaced, and ``pii_counts`` (kind to number) in place of any column so named."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.IntegerType()))])
    arrow = pa.struct([("text", pa.string()), ("counts", pa.map_(pa.string(), pa.int32()))])

    @F.arrow_udf(kind)
    def replace(texts: pa.Array) -> pa.Array:
        worker = Pseudonymizer(key, kinds, reverse)
        out = []
        for x in each_text(texts):
            new, counts = (None, {}) if x is None else worker.text(x)
            out.append({"text": new if counts else None, "counts": sorted(counts.items())})  # only changed texts come back
        return pa.array(out, arrow)

    kept = [F.col(f"`{name}`") for name in docs.columns if name.lower() != "pii_counts"]
    found = docs.select(*kept, replace(F.col(text)).alias("pii_counts"))
    shown = [F.coalesce("pii_counts.text", F.col(f"`{name}`")).alias(name) if name == text else F.col(f"`{name}`") for name in docs.columns if name.lower() != "pii_counts"]
    return found.select(*shown, F.col("pii_counts.counts").alias("pii_counts"))
