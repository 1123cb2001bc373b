"""Column helpers for word arrays, built-in functions only."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
ALPHANUMERIC_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, gaps: str, lower: bool = False) -> Column:
    """The words of a text between ``gaps`` (a regular expression); null: none. ``lower``: A-Z only."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if lower:
        text = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(text, gaps), "")


def shifted(one: Column, two: Column, by: int, join: Callable[[Column, Column], Column]) -> Column:
    """join(one[i], two[i + by]) for every i where both exist."""
    n = F.greatest(F.least(F.size(one), F.size(two) - by), F.lit(0))
    return F.zip_with(F.slice(one, F.lit(1), n), F.slice(two, F.lit(by + 1), n), join)


def gram_hashes(hashes: Column, size: int) -> Column:
    """The hash of each run of ``size`` word hashes; shorter runs joined pairwise, so log2(size) passes."""
    if size == 1:
        return hashes
    half = 1 << ((size - 1).bit_length() - 1)
    join = lambda a, b: F.xxhash64(a, b)
    return let(gram_hashes(hashes, half), lambda one: shifted(one, one if size == 2 * half else gram_hashes(hashes, size - half), half, join))


def running_min(values: Column, size: int) -> Column:
    """The smallest of each run of ``size`` (a power of two) values."""
    if size == 1:
        return values
    return let(running_min(values, size // 2), lambda one: shifted(one, one, size // 2, lambda a, b: F.least(a, b)))
