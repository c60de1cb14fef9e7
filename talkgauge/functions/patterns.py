"""Score boosts for dates and amounts in a group's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkgauge import lexicon


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def has_date(x: Column, language: str) -> Column:
    patterns = lexicon.DATES["CAN" if language == "CAN" else "MAN"]
    return F.coalesce(F.regexp_like(x, F.lit(_any(patterns))), F.lit(False))


def has_number(x: Column, language: str) -> Column:
    """Amounts and percentages. In Cantonese, and only if there are none, also numbers of over four digits that are no years."""
    found = F.regexp_like(x, F.lit(_any(lexicon.NUMBERS["CAN" if language == "CAN" else "MAN"])))
    if language == "CAN":
        runs = F.regexp_extract_all(x, F.lit(r"(\p{Nd}{4,})"), F.lit(1))
        large = F.exists(runs, lambda n: (F.length(n) != 4) & ~n.try_cast("decimal(38,0)").between(1900, 2100))
        found = found | F.coalesce(large, F.lit(False))
    return F.coalesce(found, F.lit(False))


def dynamic_boost(point: Column, scripts: Column) -> Column:
    """For points about prices, by their name or by the words of their scripts."""
    named = F.regexp_like(F.lower(point), F.lit("|".join(lexicon.POINT_PRICE_WORDS)))
    spoken = F.regexp_like(F.lower(scripts), F.lit("|".join(lexicon.SCRIPT_PRICE_WORDS)))
    return F.when(F.coalesce(named, F.lit(False)) | F.coalesce(spoken, F.lit(False)), lexicon.DYNAMIC_BOOST).otherwise(0.0)


def boost(point: Column, date: Column, number: Column, dynamic: Column, table: dict[str, tuple[float, float]]) -> Column:
    """What a point's entry in the table adds for a date and for a number; a point without an entry gets the dynamic boost for a number."""
    out = F.when(number, dynamic).otherwise(0.0)
    for name, (for_date, for_number) in sorted(table.items()):
        added = F.when(date, F.lit(for_date)).otherwise(0.0) + F.when(number, F.lit(for_number)).otherwise(0.0)
        out = F.when(point == name, added).otherwise(out)
    return out


def boosted(score: Column, added: Column) -> Column:
    """Never over 1."""
    return F.least(F.lit(1.0), score + added)
