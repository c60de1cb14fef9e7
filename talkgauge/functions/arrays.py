"""Helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once: inside f it is a variable, not the expression anew."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def chars(x: Column) -> Column:
    """The characters (code points) of a text."""
    return F.regexp_extract_all(x, F.lit("(?s)(.)"), F.lit(1))
