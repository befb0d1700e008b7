"""String helpers with Python's idea of white space, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip and str.split treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_RUN = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def strip(text: Column) -> Column:
    """Trim every kind of white space from both ends (SQL ``trim`` only drops spaces)."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """White-space separated words of a text that is not blank."""
    return F.split(strip(text), WHITESPACE_RUN)


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is neither null nor blank, stripped."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in candidates])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``.

    Inside lambdas Catalyst does not share common subexpressions, so the value is
    bound as the single element of an array.
    """
    return F.transform(F.array(value), body).getItem(0)


def percent(done: Column, total: Column) -> Column:
    """Whole percent with half-even rounding, at most 100, and 0 where there is nothing to do."""
    share = F.coalesce(F.rint(done / F.nullif(total, F.lit(0)) * 100), F.lit(0.0))
    return F.least(share, F.lit(100.0)).cast("int")


def megabytes(n_bytes: Column) -> Column:
    return n_bytes / F.lit(1024 * 1024)


def reduction(before: Column, after: Column) -> Column:
    """Size reduction in percent; null where there was nothing to shrink."""
    return (before - after) / F.nullif(before, F.lit(0)) * 100


def file_stem(path: Column) -> Column:
    """Path without its last suffix; a leading dot of a name does not start a suffix."""
    return F.regexp_extract(path, r"(?s)^(.*?[^/])(?:\.[^./]+)?$", 1)


def suffixed_name(path: Column, suffix: str) -> Column:
    """``dir/a.b.pdf`` → ``dir/a.b<suffix>.pdf``."""
    stem = file_stem(path)
    return F.concat(stem, F.lit(suffix), F.substring(path, F.length(stem) + 1, F.length(path)))


def download_name(name: Column) -> Column:
    """Name offered to the client: always a PDF, ``document`` where no name was sent."""
    given = F.coalesce(F.nullif(name, F.lit("")), F.lit("document.pdf"))
    last = F.regexp_extract(given, "([^/]*)/*$", 1)
    return F.concat(file_stem(last), F.lit("_translated.pdf"))
