"""Role resolution over ``df.schema`` (driver side, no Spark job).

The roles (group key, merge key, label, time, file-name and application columns) come from
column names and types.  Matching of names is case-sensitive, as in the source system; the
group key is renamed to one canonical name (``application_id``) before any join so that
Spark's case-insensitive resolution cannot make two spellings ambiguous.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CANONICAL_KEY = "application_id"

# Name lists in priority order.
GROUP_KEY_NAMES = ["APPLICATIONID", "applicationid", "session_id", "ID", "id", "call_id", "user_id", "client_id"]
MERGE_KEY_NAMES = ["APPLICATIONID", "applicationid", "call_id", "session_id", "ID", "id", "user_id"]
COMMON_COLUMN_NAMES = ["session_id", "ID", "id", "APPLICATIONID"]
LABEL_NAMES = ["is_fraud", "target", "fraud", "label", "class", "мошенничество", "метка", "fraud_flag"]
FILE_COLUMN_KEYWORDS = ["файл", "file", "name", "аудио"]
APPLICATION_COLUMN_KEYWORDS = ["application", "заявка", "номер"]

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_time(dt: T.DataType) -> bool:
    return isinstance(dt, TIME_TYPES)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def group_key(df: DataFrame) -> str | None:
    cols = set(df.columns)
    return next((c for c in GROUP_KEY_NAMES if c in cols), None)


def merge_key(left: DataFrame, right: DataFrame) -> str | None:
    both = set(left.columns) & set(right.columns)
    return next((c for c in MERGE_KEY_NAMES if c in both), None)


def common_column(left: DataFrame, right: DataFrame) -> str | None:
    right_cols = set(right.columns)
    hit = next((c for c in COMMON_COLUMN_NAMES if c in left.columns and c in right_cols), None)
    if hit:
        return hit
    # otherwise the first shared column in left column order (deterministic)
    return next((c for c in left.columns if c in right_cols), None)


def label_column(df: DataFrame) -> str | None:
    cols = set(df.columns)
    hit = next((c for c in LABEL_NAMES if c in cols), None)
    if hit:
        return hit
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    return numeric[-1] if numeric else None


def keyword_column(df: DataFrame, keywords: list[str]) -> str | None:
    """First column matching the keyword list, by keyword priority then column order."""
    lowered = [(c, c.lower()) for c in df.columns]
    for kw in keywords:
        for c, low in lowered:
            if kw in low:
                return c
    return None


def file_name_column(df: DataFrame) -> str | None:
    return keyword_column(df, FILE_COLUMN_KEYWORDS)


def application_column(df: DataFrame) -> str | None:
    return keyword_column(df, APPLICATION_COLUMN_KEYWORDS)


def columns_by_role(df: DataFrame, exclude: tuple[str, ...] = ()) -> dict[str, list[str]]:
    """Split columns into numeric / time / string (booleans, arrays and others are left out)."""
    roles: dict[str, list[str]] = {"numeric": [], "time": [], "string": []}
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if is_numeric(f.dataType):
            roles["numeric"].append(f.name)
        elif is_time(f.dataType):
            roles["time"].append(f.name)
        elif is_string(f.dataType):
            roles["string"].append(f.name)
    return roles
