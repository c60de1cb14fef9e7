"""Exact token ids through public tokenizer files, with a bounded memo of words.

The word-level vocabularies drop white space and never merge across it, so the ids of a text are
the ids of its space-separated pieces in order. Natural text repeats its words, which makes one
dictionary lookup per word enough for most of it; only pieces that are not in the memo reach the
tokenizer. The memo has two generations of a fixed number of entries, so its memory has a bound
whatever the corpus is; a piece that neither generation holds is encoded anew. A new piece of Latin letters with ASCII marks
behind it is two pre-tokens, whatever its case, so its ids are those of its lower-case letters,
which the memo often has, and those of its marks.
"""

from __future__ import annotations

import json
import os
import string
import sys
from array import array
from collections.abc import Iterable, Iterator

#: Entries in one generation of the memo; about 25 MB.
MEMO_WORDS = 150_000
#: Longer pieces (base64, text without spaces) are never kept.
MEMO_CHARS = 40
#: Marks that, behind letters, are one pre-token of their own; the apostrophe starts contractions.
MARKS = string.punctuation.replace("'", "")
#: Letters below this code point stay single letters when lower-cased and composed.
LATIN_END = "\u0130"
#: For Latin-1 texts: m for each mark (all but letters, digits and white space), x for all else.
_MARKED = bytes(0x6D if not chr(c).isalnum() and (not chr(c).isspace() or 0x1C <= c <= 0x1F) else 0x78 for c in range(256))
#: Different runs of marks that are kept.
MARK_RUNS = 2_000

_ENCODERS: dict[str, WordEncoder] = {}


class LetterEncoder:
    """Encodes lower-case words of letters, each followed by NUL, with the merges of a file.

    A word's last symbol differs from the same symbol inside a word. Here NUL stands for that end:
    joining it to the byte before it comes before all other merges, and the rest follow in the
    file's order, so rank by rank the same pairs are joined.
    """

    def __init__(self, path: str, end: str = "</w>"):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != end:
            raise ValueError(f"{path} has no word ends {end}")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [byte for byte in range(256) if byte not in set(shown)]
        byte_of = {chr(byte): byte for byte in shown} | {chr(256 + i): byte for i, byte in enumerate(hidden)}
        decode = lambda token: bytes(map(byte_of.__getitem__, token.removesuffix(end))) + b"\0" * token.endswith(end)
        vocab = model["vocab"]
        tokens = [*sorted(byte_of, key=byte_of.get), *(x + end for x in sorted(byte_of, key=byte_of.get))]
        tokens += ["".join(merge.split(" ") if isinstance(merge, str) else merge) for merge in model["merges"]]
        self._ids = [vocab[token].to_bytes(4, sys.byteorder) for token in tokens]
        ranks = {decode(token): rank for rank, token in enumerate(tokens)}
        self._encoding = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})

    def __call__(self, word: str) -> bytes:
        return b"".join(map(self._ids.__getitem__, self._encoding._encode_single_piece(word + "\0")))


class _Memo(dict):
    """Words with their ids; a word that isn't in it is learnt when it is asked for."""

    __slots__ = ("learn",)

    def __missing__(self, word: str) -> bytes:
        return self.learn(word)


class WordEncoder:
    """Encodes texts with a tokenizer file whose pre-tokenizer drops white space."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._letters = LetterEncoder(path)
        self._marks: dict[str, bytes] = {"": b""}
        self._memo_words = memo_words
        self._old: dict[str, bytes] = {}
        self._renew()

    def _renew(self) -> None:
        self._young = _Memo({"": b""})
        self._young.learn = self._learn

    def _learn(self, word: str) -> bytes:
        if (ids := self._old.get(word)) is None:
            ids = self._encode(word)
        if len(word) <= MEMO_CHARS:
            self._young[word] = ids
        return ids

    def _encode(self, word: str) -> bytes:
        base = word if word.isalpha() else word.rstrip(MARKS)
        if not base.isalpha() or not base.isascii() and max(base) >= LATIN_END:
            return array("I", self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        lower = base.lower()
        return self._letters(word) if lower == word else self._young[lower] + self._mark_ids(word[len(base) :])

    def _mark_ids(self, marks: str) -> bytes:
        if (ids := self._marks.get(marks)) is None:
            ids = array("I", self._tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
            if len(self._marks) < MARK_RUNS:
                self._marks[marks] = ids
        return ids

    @staticmethod
    def _split(text: str) -> list[str]:
        """Pieces of the text that pre-tokens don't cross.

        In Latin-1 prose these are lower-case words with commas and stops apart. Marks in a row are one pre-token, so a text
        that has any is split at white space alone, as is one with letters whose number may change when they are lower-cased.
        """
        try:
            plain = b"mm" not in text.encode("latin-1").translate(_MARKED)
        except UnicodeEncodeError:
            plain = False
        if plain:
            text = text.lower().replace(",", " ,").replace(".", " .")
        return text.replace("\n", " ").split(" ")

    def id_bytes(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as native unsigned 32-bit integers; null is the empty text."""
        for text in texts:
            if len(self._young) > self._memo_words:
                self._old = self._young
                self._renew()
            yield b"".join(map(self._young.__getitem__, self._split(text or "")))


def encoder(path: str) -> WordEncoder:
    """The process's encoder for a file; Python workers are reused, so the memo outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
