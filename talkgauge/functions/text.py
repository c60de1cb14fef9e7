"""Text as columns: cleaning, splitting, clipping, and times written as text."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge import lexicon

SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
COMPARISON = r"[^\x{4e00}-\x{9fff},.。，%()（）]+"
DISPLAY = r"[^\x{4e00}-\x{9fff}A-Za-z,.。，%()（）]+"
PUNCTUATION = ("。", "！", "？", "；", "，", ".", "!", "?", ";")
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def strip(x: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(x, SPACE, "")


def text_or_empty(x: Column, legacy_nan: bool = False) -> Column:
    """A missing text is empty; in the legacy reading it is the word ``nan``."""
    return F.coalesce(x, F.lit("nan" if legacy_nan else ""))


def clean_comparison(x: Column) -> Column:
    """Chinese characters and a few marks only."""
    return F.regexp_replace(x, COMPARISON, "")


def clean_display(x: Column) -> Column:
    """As for comparison, with Latin letters."""
    return F.regexp_replace(x, DISPLAY, "")


def fold_punctuation_zh(x: Column) -> Column:
    """Runs of commas and of stops become one full-width mark each."""
    return strip(F.regexp_replace(F.regexp_replace(x, "[,，]+", "，"), "[.。]+", "。"))


def fold_width(x: Column) -> Column:
    """Full-width forms of ASCII, and the wide space, in their usual width: the part of NFKC that transcripts need."""
    return F.translate(x, _WIDE, _NARROW)


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Unicode's NFKC, for text beyond full-width forms."""
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())


def fold_punctuation_en(x: Column, normalized: bool = False) -> Column:
    """English: usual widths, one mark for a run of commas or stops, stripped. Pass NFKC text with normalized=True."""
    return strip(F.regexp_replace(F.regexp_replace(x if normalized else fold_width(x), "[,，]+", ","), "[.。]+", "."))


def normalize_asr(x: Column) -> Column:
    """Frequent speech-to-text errors in Cantonese: single characters at once, then the longer ones."""
    singles: dict[str, str] = {}
    for word, errors in lexicon.ASR_ERRORS.items():
        for error in errors:
            if len(error) == 1 and error != word:
                singles.setdefault(error, word)
    x = F.translate(x, "".join(singles), "".join(singles.values()))
    for word, errors in lexicon.ASR_ERRORS.items():
        for error in errors:
            if len(error) > 1:
                # its characters may have been translated already
                x = F.replace(x, F.lit(error.translate(str.maketrans(singles))), F.lit(word))
    return x


def clean(x: Column, language: str) -> Column:
    """The text that comparisons use."""
    if language == "ENG":
        return fold_punctuation_en(x)
    if language == "MAN":
        return fold_punctuation_zh(clean_comparison(x))
    return normalize_asr(clean_comparison(x))


def clean_offline_en(x: Column) -> Column:
    """English for term statistics: words, digits and a few marks."""
    return F.regexp_replace(fold_width(x), r"[^\p{L}\p{N}_\s,.%()$]", "")


def expand_contractions(x: Column) -> Column:
    """``don't`` as ``do not`` and so on, in any case; texts without an apostrophe are left alone."""
    out = x
    for short, long in lexicon.CONTRACTIONS.items():
        out = F.regexp_replace(out, rf"(?i)\b{short}\b", long)
    return F.when(F.contains(x, F.lit("'")), out).otherwise(x)


def ends_with_punctuation(x: Column) -> Column:
    return F.right(x, F.lit(1)).isin(*PUNCTUATION)


def sentences(x: Column) -> Column:
    """Pieces between stops with over two characters; a long text without any is cut at wide commas; else the text itself."""
    pieces = lambda pattern, least: F.filter(F.transform(F.split(x, pattern), strip), lambda s: F.length(s) > least)
    by_stop, by_comma = pieces("[。！？.!?]+", 2), pieces("，", 10)
    return F.when(F.size(by_stop) > 0, by_stop).when((F.length(x) > 100) & (F.size(by_comma) > 0), by_comma).otherwise(F.array(strip(x)))


def clip(x: Column, n: int) -> Column:
    """The first n characters and an ellipsis, if there are more."""
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


# -- times -------------------------------------------------------------------------------------


def seconds_of(x: Column) -> Column:
    """Seconds of ``H:M:S``, ``M:S`` or a plain number; anything else and null are 0."""
    x = strip(x.cast("string"))
    parts = F.transform(F.split(x, ":"), lambda p: p.try_cast("double"))
    n, bad = F.size(parts), F.exists(parts, lambda p: p.isNull())
    number = F.when(F.regexp_like(x, F.lit(r"^[0-9]*\.?[0-9]+$")), x.try_cast("double"))
    total = F.when(n == 3, F.get(parts, F.lit(0)) * 3600 + F.get(parts, F.lit(1)) * 60 + F.get(parts, F.lit(2))).when(n == 2, F.get(parts, F.lit(0)) * 60 + F.get(parts, F.lit(1)))
    return F.coalesce(F.when(n == 1, number).when(~bad, total), F.lit(0.0))


def mmss(seconds: Column) -> Column:
    """``MM:SS``; minutes may pass 59; null, zero and less are ``00:00``."""
    whole = F.floor(F.coalesce(seconds.cast("double"), F.lit(0.0))).cast("long")
    shown = F.concat(F.lpad((whole / 60).cast("long").cast("string"), 2, "0"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))
    long = F.concat((whole / 60).cast("long").cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))
    return F.when(whole <= 0, "00:00").when(whole >= 6000, long).otherwise(shown)


def output_name(x: Column) -> Column:
    """The report's file name for an input's: ``.wav.csv`` and ``.csv`` give ``.xlsx``, a workbook gets ``_result``."""
    return (
        F.when(x.endswith(".wav.csv"), F.regexp_replace(x, r"\.wav\.csv$", ".xlsx"))
        .when(x.endswith(".csv"), F.regexp_replace(x, r"\.csv$", ".xlsx"))
        .otherwise(F.regexp_replace(x, r"\.xlsx?$", "_result.xlsx"))
    )
