"""Application-key normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r\f\x0B]"


def normalize_key(c: Column) -> Column:
    """Trim blanks, collapse doubled backslashes, upper-case; empty becomes NULL.

    The source system's ``unicode_escape`` step is left out: it corrupts Cyrillic text and
    turns ``\\011`` into a tab.
    """
    s = F.regexp_replace(c.cast("string"), rf"^{BLANKS}+|{BLANKS}+$", "")
    s = F.replace(s, F.lit("\\\\"), F.lit("\\"))
    s = F.upper(s)
    return F.when(s != "", s)
