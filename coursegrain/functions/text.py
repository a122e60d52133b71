"""Text expressions that stay in the JVM, shared by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(c: Column | str) -> Column:
    """Maximal runs of letters and digits of any script, lower-cased, in order; null gives null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), 1)


def squeezed(c: Column | str) -> Column:
    """White-space runs as one blank, trimmed."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def compact(c: Column | str) -> Column:
    """Only the lower-cased letters and digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
