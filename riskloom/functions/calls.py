"""Call-recording file names: ``YYYYMMDDHHMMSS_ID_Phone,_Code1,_Code2.wav``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Removed suffixes (every occurrence, case-sensitive, in this order) and the time pattern.
REMOVED_SUFFIXES = (".wav", ".mp3")
TIME_PATTERN = "yyyyMMddHHmmss"
BLANKS = r"[ \t\n\r\f\x0B]"


def basename(path: Column) -> Column:
    """Last path component for both ``/`` and ``\\`` separators."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def linked_file_name(path: Column) -> Column:
    """File name of a path written in a link table: blanks around the path are no part of it."""
    return basename(F.regexp_replace(path, rf"^{BLANKS}+|{BLANKS}+$", ""))


def call_stem(name: Column) -> Column:
    stem = name
    for suffix in REMOVED_SUFFIXES:
        stem = F.replace(stem, F.lit(suffix), F.lit(""))
    return stem


def call_parts(stem: Column) -> Column:
    return F.split(stem, "_", -1)


def call_pieces(parts: Column) -> Column:
    """The remainder after time and id, re-joined with ``_`` and split on ``,``."""
    return F.split(F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "_"), ",", -1)


def call_fields(stem: Column, parts: Column, pieces: Column) -> list[Column]:
    """call_id, call_time, phone, codes, user_stem from the three intermediate columns."""
    codes_raw = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1)))
    codes = F.filter(
        F.transform(
            F.when(F.size(pieces) > 1, codes_raw).otherwise(F.array().cast("array<string>")),
            lambda x: F.regexp_replace(F.regexp_replace(x, r"^_+|_+$", ""), rf"^{BLANKS}+|{BLANKS}+$", ""),
        ),
        lambda x: x != "",
    )
    well_formed = F.size(parts) >= 3
    first = F.get(parts, 0)
    ts = F.when(first.rlike(r"^[0-9]{14}$"), F.try_to_timestamp(first, F.lit(TIME_PATTERN)).cast("timestamp_ntz"))
    return [
        F.when(well_formed, F.get(parts, 1)).otherwise(stem).alias("call_id"),
        F.when(well_formed, ts).alias("call_time"),
        F.when(well_formed, F.get(pieces, 0)).alias("phone"),
        F.when(well_formed, codes).otherwise(F.array().cast("array<string>")).alias("codes"),
        first.alias("user_stem"),
    ]


def parse_call_name(name: Column) -> Column:
    """Struct of call_id, call_time, phone, codes (array<string>) and user_stem.

    Fewer than three ``_`` parts: call_id is the stem, the rest NULL and codes empty.
    Otherwise part 0 is the time (NULL when it does not parse), part 1 the call id, and the
    remainder (re-joined with ``_``) split on ``,``: the first piece is the phone, the
    others are codes with ``_`` then blanks stripped, empties dropped.  (Table form with
    each intermediate computed once: ``operators.calls.parse_calls``.)
    """
    stem = call_stem(name)
    parts = call_parts(stem)
    return F.struct(*call_fields(stem, parts, call_pieces(parts)))
