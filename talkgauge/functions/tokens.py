"""Tokens as array columns, and their expansion by lexicons."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge import lexicon
from talkgauge.functions import text as t


def words_array(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, sorted(words)))


def _without(tokens: Column, words: Iterable[str]) -> Column:
    """Order and repeats stay."""
    words = sorted(words)
    return F.filter(tokens, lambda x: ~x.isin(words))


def english_tokens(x: Column) -> Column:
    """Amounts, percentages, numbers with k or x, and words, contractions written out; without single letters and the tokenizer's stopwords.

    Contractions are found in the same pass as tokens; texts without an apostrophe are spared that.
    """
    lower = F.lower(t.fold_width(x))
    extract = lambda pattern: F.regexp_extract_all(lower, F.lit(f"({pattern})"), F.lit(1))
    long = {short.lower(): words.lower().split() for short, words in lexicon.CONTRACTIONS.items()}
    written = F.create_map(*[y for short, words in sorted(long.items()) for y in (F.lit(short), F.array(*map(F.lit, words)))])
    found = extract("|".join(rf"\b{short}\b" for short in sorted(long)) + "|" + lexicon.NUMBER_TOKEN)
    out = F.flatten(F.transform(found, lambda w: F.when(F.contains(w, F.lit("'")), F.element_at(written, w)).otherwise(F.array(w))))
    raw = F.when(F.contains(x, F.lit("'")), out).otherwise(extract(lexicon.NUMBER_TOKEN))
    stop = sorted(lexicon.STOPWORDS_EN_TOKENS)
    return F.filter(raw, lambda w: ~w.isin(stop) & ((F.length(w) > 1) | ~F.regexp_like(w, F.lit(r"^\p{L}$"))))


def drop_stopwords(tokens: Column, language: str) -> Column:
    return F.filter(_without(tokens, lexicon.stopwords(language)), lambda w: F.length(w) > 1)


def synonym_map(synonyms: dict[str, list[str]]) -> Column:
    """Of each word of an entry to all of the entry's words."""
    pairs = [x for word, words in sorted(synonyms.items()) for x in (F.lit(word), F.array(*map(F.lit, words)))]
    return F.create_map(*pairs)


def expand(tokens: Column, synonyms: dict[str, list[str]]) -> Column:
    """The distinct tokens and all words of the entries that they are in."""
    words = synonym_map(lexicon.reverse_synonyms(synonyms))
    return F.array_distinct(F.concat(tokens, F.flatten(F.transform(tokens, lambda w: F.coalesce(F.try_element_at(words, w), F.array().cast("array<string>"))))))


def expand_canonical(tokens: Column, synonyms: dict[str, list[str]] = lexicon.SYNONYMS_EN) -> Column:
    """Keyword-processor mode: a variant adds its entry's key only."""
    keys = F.create_map(*[x for key, words in sorted(synonyms.items()) for word in words for x in (F.lit(word), F.lit(key))])
    return F.array_distinct(F.concat(tokens, F.filter(F.transform(tokens, lambda w: F.try_element_at(keys, w)), lambda w: w.isNotNull())))


def expand_en(x: Column) -> Column:
    """English tokens, expanded, without stopwords."""
    return _without(expand(english_tokens(x), lexicon.SYNONYMS_EN), lexicon.STOPWORDS_EN)


def negation_bigrams(tokens: Column) -> Column:
    """``not_refund`` and so on: a negation directly before a business keyword."""
    negations, keywords = sorted(lexicon.NEGATIONS), sorted(lexicon.KEYWORDS_EN)
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1))), lambda a, b: F.when(a.isin(negations) & b.isin(keywords), F.concat_ws("_", a, b)))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def stem(tokens: Column, least: int = 5, always: Iterable[str] = ()) -> Column:
    """English stems of longer tokens and of stated ones; without NLTK the tokens as they are."""
    try:
        from nltk.stem import SnowballStemmer
    except ImportError:
        return tokens
    wanted = frozenset(always)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stems(rows: pa.Array) -> pa.Array:
        stemmer = SnowballStemmer("english")
        short = lambda w: w is None or len(w) < least and w.lower() not in wanted
        return pa.array([None if row is None else [w if short(w) else stemmer.stem(w) for w in row] for row in rows.to_pylist()], pa.list_(pa.string()))

    return stems(tokens)


# -- segmentation of text without spaces -------------------------------------------------------


class LongestMatch:
    """Cuts a text into the longest words of a lexicon, single characters elsewhere, runs of Latin letters and digits whole."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(w for w in words if w)
        self.longest = max(map(len, self.words), default=1)

    def __call__(self, x: str) -> list[str]:
        out, i = [], 0
        while i < len(x):
            n = next((n for n in range(min(self.longest, len(x) - i), 1, -1) if x[i : i + n] in self.words), 1)
            if n == 1 and x[i].isascii() and x[i].isalnum():
                while i + n < len(x) and x[i + n].isascii() and x[i + n].isalnum():
                    n += 1
            out.append(x[i : i + n])
            i += n
        return out


def _lexicon_words() -> set[str]:
    words = set(lexicon.KEYWORDS_ZH) | lexicon.STOPWORDS_CAN | lexicon.STOPWORDS_MAN | set(lexicon.TERM_WEIGHTS)
    return words | {w for key, values in lexicon.SYNONYMS_ZH.items() for w in [key, *values]}


def segmenter(language: str) -> Callable[[str], list[str]]:
    """The optional library for a language if it is installed; else longest match over the lexicons."""
    try:
        if language == "CAN":
            import pycantonese

            return pycantonese.segment
        import jieba

        return jieba.lcut
    except ImportError:
        return LongestMatch(_lexicon_words())


def segment(x: Column, language: str) -> Column:
    """Raw tokens of a text: English by pattern, Chinese by a segmenter over Arrow batches."""
    return english_tokens(x) if language == "ENG" else segment_with(x, None, language)


def segment_with(x: Column, split: Callable[[str], list[str]] | None, language: str = "CAN") -> Column:
    """Tokens by a function, or by the language's segmenter."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        words = split or segmenter(language)
        return pa.array([None if s is None else list(words(s)) for s in texts.to_pylist()], pa.list_(pa.string()))

    return cut(x)


def business_tokens(raw: Column, language: str) -> Column:
    """Without stopwords and single characters."""
    return drop_stopwords(raw, language)


def expanded_tokens(raw: Column, language: str) -> Column:
    """For overlaps: Chinese expands all tokens, stopwords included; English drops stopwords afterwards."""
    if language == "ENG":
        return _without(expand(raw, lexicon.SYNONYMS_EN), lexicon.STOPWORDS_EN)
    return expand(raw, lexicon.SYNONYMS_ZH)
