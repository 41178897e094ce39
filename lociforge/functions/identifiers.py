"""Column expressions for hand-typed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(col: Column | str) -> Column:
    """Trim blanks and tabs, upper-case and read ``-`` as ``_``; null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.translate(F.upper(F.btrim(col, F.lit(" \t"))), "-", "_")


def attribute_key(col: Column | str) -> Column:
    """Trim, lower-case, and turn each run of characters other than letters and digits into one ``_``."""
    col = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(F.trim(F.btrim(col, F.lit(" \t\r\n")))), r"[^\p{L}\p{N}]+", "_")


def locus_before_hap(marker: Column) -> Column:
    """The part of a marker name before ``_HAP_`` or ``_NOVEL_`` (any case)."""
    return F.regexp_replace(marker, r"(?i)_(hap|novel)_.*$", "")
