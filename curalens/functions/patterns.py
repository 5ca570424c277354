"""Patterns and digits of any script."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Decimal digits other than 0-9, in order of their code points, and what they stand for.
_DIGITS = [c for c in map(chr, range(0x80, 0x10000)) if c.isdecimal()]
_VALUES = "".join(str(int(c)) for c in _DIGITS)


def wide(pattern: str) -> str:
    r"""The pattern with ``\d \s \w \b`` and case as Unicode defines them."""
    return "(?U)" + pattern


def plain_digits(text: Column) -> Column:
    """Digits of all scripts as 0-9, so that a cast reads them."""
    return F.translate(text, "".join(_DIGITS), _VALUES)
