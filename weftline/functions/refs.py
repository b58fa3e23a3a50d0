"""References spelled unevenly: one key for all spellings, null for what is no reference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that stand for "no reference"
NO_REFERENCE = ("", "none", "n/a", "-", "unknown")


def ref_key(column: Column | str) -> Column:
    """Trimmed, lower-case key of a reference; null for null, blank and the words in NO_REFERENCE."""
    col = F.col(column) if isinstance(column, str) else column
    key = F.lower(F.regexp_replace(col, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.when(~key.isin(*NO_REFERENCE), key)


def id_key(column: Column | str) -> Column:
    """Trimmed, lower-case key of an id column (no word is excluded); null stays null."""
    col = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(col, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
