"""Text expressions: per-value counts, explanation clean-up, readable feature names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: characters that are not "special" (Latin, digits, basic Cyrillic, blanks).
SPECIAL_PATTERN = r"[^a-zA-Z0-9а-яА-Я \t\n\r\f\x0B]"

# The readable-name map, in its natural (priority) order.
READABLE_NAMES = [
    ("amplitude_night_activity_ratio", "Активность ночью (%)"),
    ("amplitude_session_count", "Количество сессий"),
    ("amplitude_avg_session_duration", "Средняя длительность сессии (сек)"),
    ("amplitude_unique_event_types", "Разнообразие действий"),
    ("amplitude_weekend_ratio", "Активность в выходные (%)"),
    ("audio_mfcc_0_mean", "Тон голоса (аудио)"),
    ("audio_spectral_centroid_mean", "Качество речи (аудио)"),
    ("audio_rms_mean", "Громкость голоса"),
    ("audio_duration", "Длительность записи (сек)"),
]
# Word swaps applied after ``_`` -> blank.
WORD_SWAPS = [("amplitude", "поведение"), ("audio", "аудио")]


def digit_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{Nd}")).cast("bigint")


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}")).cast("bigint")


def has_special(c: Column) -> Column:
    return c.rlike(SPECIAL_PATTERN).cast("int")


# Fixed value: the whitespace set of Python's str.isspace / re ``\s``.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def clean_explanation(c: Column, limit: int = 500) -> Column:
    """Trim, newline runs and blank runs to one blank, cut to ``limit-3`` + '...'."""
    s = F.regexp_replace(c, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")
    s = F.regexp_replace(s, r"\n+", " ")
    s = F.regexp_replace(s, f"[{WHITESPACE}]+", " ")
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 3), F.lit("..."))).otherwise(s)


def readable_name(c: Column) -> Column:
    """Exact map hit, else first map key contained in the name, else a simplified title."""
    expr = None
    for key, label in READABLE_NAMES:
        cond = c == F.lit(key)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    for key, label in READABLE_NAMES:
        expr = expr.when(F.instr(c, key) > 0, F.lit(label))
    simple = F.replace(c, F.lit("_"), F.lit(" "))
    for a, b in WORD_SWAPS:
        simple = F.replace(simple, F.lit(a), F.lit(b))
    return expr.otherwise(F.initcap(simple))
