"""String functions of the text queries."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_fold(text: Column) -> Column:
    """Lower case for A to Z only; other letters keep their case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fold_needle(needle: str, case_sensitive: bool, limit: int = 256) -> str:
    """The needle as it is compared: its first `limit` code points, folded unless case counts."""
    needle = needle[:limit]
    return needle if case_sensitive else needle.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once a row, however often it is used and wherever the optimizer puts it."""
    return F.transform(F.array(value), then)[0]


def running_sums(values: Column) -> Column:
    """0 and the sums of the first one, two, ... of an array of integers.

    Arrays grow by copies, so long ones are summed in blocks of about the square root of their size.
    """

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def blocks(xs: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(xs))).cast("int"))
        cut = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / size).cast("int")), lambda j: scan(F.slice(xs, j * size + 1, size)))
        return bind(cut, joined)

    def joined(sums: Column) -> Column:
        lifted = lambda before: F.transform(sums, lambda x, j: F.transform(F.slice(x, F.lit(2), F.size(x) - 1), lambda y: y + F.get(before, j)))
        return bind(scan(F.transform(sums, lambda x: F.element_at(x, -1))), lambda before: F.concat(F.array(F.lit(0)), F.flatten(lifted(before))))

    return bind(values, lambda xs: F.when(F.size(xs) <= 64, scan(xs)).otherwise(blocks(xs)))


def match_starts(text: Column, needle: str, case_sensitive: bool = True) -> Column:
    """0-based starts of all matches in a text, overlapping ones too; an empty needle has none.

    The text is cut before each match, so that the pieces' lengths add up to the starts.
    """
    needle = fold_needle(needle, case_sensitive)
    text = text if case_sensitive else ascii_fold(text)
    none = F.array().cast("array<int>")
    if not needle:
        return none
    lengths = F.transform(F.split(text, f"(?={re.escape(needle)})"), lambda piece: F.length(piece))
    sums = bind(running_sums(lengths), lambda at: F.slice(at, F.lit(1), F.size(at) - 1))
    # the first piece is before the first match, unless the text starts with one
    starts = bind(sums, lambda at: F.when(F.startswith(text, F.lit(needle)), at).otherwise(F.slice(at, F.lit(2), F.size(at))))
    return F.when(F.contains(text, F.lit(needle)), starts).otherwise(none)


def escape_literal(text: Column) -> Column:
    """Backslashes before parentheses and backslashes, as in a literal string."""
    return F.regexp_replace(text, r"([()\\])", r"\\$1")


def strip_subset_prefix(name: Column) -> Column:
    """A font name without the tag of six capitals and a plus that marks a subset."""
    return F.regexp_replace(name, "^[A-Z]{6}[+]", "")


def bounded(value: Column, size: int) -> Column:
    """The first size - 1 bytes of a binary value."""
    return F.substring(value, 1, size - 1)


def fixed(x: Column, digits: int) -> Column:
    """A number below 10^12 with so many decimals (3 at most), rounded by its exact binary value, halves to even.

    Java's formatter rounds the shortest decimal form instead, and halves up: 2.625 is 2.63 there, and 2.62 here.
    The number is split into two parts of few bits, whose products are exact, so that the sign of its distance
    from the middle between two results is exact too. Null for null."""
    scale, size = 10**digits, F.abs(x)
    wide = size * 134217729.0
    high = wide - (wide - size)
    low, n = size - high, F.floor(size * scale)
    over = (high * (2.0 * scale) - (2 * n + 1).cast("double")) + low * (2.0 * scale)
    n = n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))
