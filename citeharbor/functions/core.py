"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space in text clean-up.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set for a Java regex: ``\s`` under (?U) misses the four separators.
SPACE_CLASS = r"[\s\x1c-\x1f]"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    A lambda variable is never inlined, so ``body`` may use it many times
    without the expression being computed many times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: Column | str) -> Column:
    """Remove leading and trailing white space of any kind (linear time)."""
    return F.btrim(as_column(value), F.lit(WHITESPACE))


def non_empty(value: Column | str) -> Column:
    """NULL when the string is empty."""
    return F.nullif(as_column(value), F.lit(""))


def first_non_empty(*values: Column | str) -> Column:
    """First candidate that is neither NULL nor the empty string."""
    return F.coalesce(*[non_empty(v) for v in values])


def unicode_regex(pattern: str, ignore_case: bool = True) -> str:
    r"""Compile-time text of a Java regex whose ``\s``, ``\d`` and case folding cover Unicode."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern.replace(r"\s", SPACE_CLASS)


def quote_literal(text: str) -> str:
    """Escape ``text`` for use as a literal inside a regex."""
    return "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in text)
