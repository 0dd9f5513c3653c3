"""Scores to risk bands, key factors, recommendations, confidence and rule explanations,
all as column expressions over one row (no per-row Python call)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import risk as R
from riskloom.functions.text import clean_explanation, readable_name

# Name patterns of bookkeeping features (lower-cased test) and value floors.
SKIP_PATTERNS = ["chunk", "source", "file_path", "_dup", "sample_id", "applicationid"]
MIN_ABS_VALUE = 0.001
FACTOR_MIN_ABS = 0.01
CONFIDENT_ABS = 0.1
TOP_FACTORS = 5
TOP_PROMPT_FEATURES = 8
# Explanation texts.
TXT_NIGHT = "Высокая ночная активность"
TXT_FEW_SESSIONS = "Малое количество сессий"
TXT_SHORT_SESSIONS = "Короткие сессии"
TXT_VERY_HIGH = "Крайне высокая вероятность мошенничества"
TXT_RAISED = "Повышенная вероятность мошенничества"
TXT_DEFAULT = "Модель выявила аномальные паттерны поведения"
TXT_NO_FEATURES = "Общая модель уверенности"
TXT_MODEL_SCORE = "Общая оценка модели"
JOIN = " | "


def is_important_name(name: str) -> bool:
    low = name.lower()
    return not any(p in low for p in SKIP_PATTERNS)


def feature_array(df: DataFrame, cols: list[str] | None = None, exclude: tuple[str, ...] = ()) -> Column:
    """array<struct<pos, name, value>> of the important features of a row (names tested on the
    driver, values on executors: numeric, non-NULL, |v| >= 0.001)."""
    from riskloom import schema as S
    cols = cols or [f.name for f in df.schema.fields if f.name not in exclude and S.is_numeric(f.dataType)]
    cols = [c for c in cols if is_important_name(c)]
    arr = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value"))
                    for i, c in enumerate(cols)])
    return F.filter(arr, lambda s: s["value"].isNotNull() & ~F.isnan(s["value"]) & (F.abs(s["value"]) >= MIN_ABS_VALUE))


def top_by_abs(features: Column, n: int) -> Column:
    """The n features with the largest |value|; ties keep feature order."""
    keyed = F.transform(features, lambda s: F.struct((-F.abs(s["value"])).alias("k"), s["pos"].alias("pos"),
                                                     s["name"].alias("name"), s["value"].alias("value")))
    return F.slice(F.array_sort(keyed), 1, n)


def key_factors(features: Column) -> Column:
    """Top five by |value| kept when |value| > 0.01 (array of struct name, value, readable)."""
    top = F.filter(top_by_abs(features, TOP_FACTORS), lambda s: F.abs(s["value"]) > FACTOR_MIN_ABS)
    return F.transform(top, lambda s: F.struct(s["name"].alias("name"), s["value"].alias("value"),
                                               readable_name(s["name"]).alias("readable")))


def pct1(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def key_factor_texts(features: Column, p: Column) -> Column:
    kf = key_factors(features)
    texts = F.transform(kf, lambda s: F.concat(s["readable"], F.lit(": "), F.format_string("%.2f", s["value"])))
    fallback = F.when(F.size(features) == 0, F.concat(F.lit(TXT_NO_FEATURES + ": "), pct1(p))) \
        .otherwise(F.concat(F.lit(TXT_MODEL_SCORE + ": "), pct1(p)))
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(fallback))


def important_count(features: Column) -> Column:
    return F.size(F.filter(features, lambda s: F.abs(s["value"]) > CONFIDENT_ABS))


def confidence(features: Column, p: Column) -> Column:
    k = F.when(F.size(features) > 0, important_count(features)).otherwise(F.lit(0))
    return R.confidence(p, k)


def _values_where(features: Column, pattern: str) -> Column:
    return F.filter(features, lambda s: F.instr(s["name"], pattern) > 0)


HITS = "array<struct<rule:string,value:double>>"


def feature_hits(features: Column) -> Column:
    """Rules fired by the features, in feature order (each feature tests the rules in turn): array<struct<rule, value>>;
    night activity > .3, session count < 5, session duration < 60 s."""
    return F.flatten(F.transform(features, lambda s: F.filter(F.array(
        F.when((F.instr(s["name"], "night_activity") > 0) & (s["value"] > 0.3),
               F.struct(F.lit("night_activity").alias("rule"), s["value"].alias("value"))),
        F.when((F.instr(s["name"], "session_count") > 0) & (s["value"] < 5),
               F.struct(F.lit("few_sessions").alias("rule"), s["value"].alias("value"))),
        F.when((F.instr(s["name"], "session_duration") > 0) & (s["value"] < 60),
               F.struct(F.lit("short_sessions").alias("rule"), s["value"].alias("value")))), lambda x: x.isNotNull())))


def with_probability(hits: Column, p: Column) -> Column:
    """The features' hits (NULL: none), then the probability rule (> .8 or > .5), else the default."""
    prob = F.when(p > 0.8, F.array(F.struct(F.lit("very_high_probability").alias("rule"), p.alias("value")))) \
        .when(p > 0.5, F.array(F.struct(F.lit("raised_probability").alias("rule"), p.alias("value")))) \
        .otherwise(F.array().cast(HITS))
    hits = F.concat(F.coalesce(hits, F.array().cast(HITS)), prob)
    default = F.array(F.struct(F.lit("default").alias("rule"), F.lit(None).cast("double").alias("value")))
    return F.when(F.size(hits) > 0, hits).otherwise(default)


def rule_hits(features: Column, p: Column) -> Column:
    """Fired rules in rule order, those of the features before that of the probability."""
    return with_probability(feature_hits(features), p)


def rule_text(hits: Column) -> Column:
    def one(s):
        return (F.when(s["rule"] == "night_activity", F.concat(F.lit(TXT_NIGHT + " ("), pct1(s["value"]), F.lit(")")))
                .when(s["rule"] == "few_sessions", F.concat(F.lit(TXT_FEW_SESSIONS + " ("), F.format_string("%.0f", s["value"]), F.lit(")")))
                .when(s["rule"] == "short_sessions", F.concat(F.lit(TXT_SHORT_SESSIONS + " ("), F.format_string("%.0f", s["value"]), F.lit(" сек)")))
                .when(s["rule"] == "very_high_probability", F.lit(TXT_VERY_HIGH))
                .when(s["rule"] == "raised_probability", F.lit(TXT_RAISED))
                .otherwise(F.lit(TXT_DEFAULT)))
    return F.concat(F.array_join(F.transform(hits, one), ". "), F.lit("."))


FEATURES = "array<struct<pos:int,name:string,value:double>>"


def key_parts(frame: DataFrame, feature_cols: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Adds what an explanation needs of the features alone, so that it is worked out once per key, before a join with the
    scored rows: ``feats``, ``factors`` (key factors), ``hits`` (the features' rules) and ``n_confident``."""
    x = frame.withColumn("feats", feature_array(frame, feature_cols, exclude))
    return x.select("*", key_factors(F.col("feats")).alias("factors"), feature_hits(F.col("feats")).alias("hits"), important_count(F.col("feats")).alias("n_confident"))


def explain_parts(scored: DataFrame, p: str = "fraud_probability") -> DataFrame:
    """``explain`` of rows that carry the columns of ``key_parts`` (NULL: a row without features)."""
    prob = F.col(p)
    band = R.band_by_threshold(prob)
    some = F.coalesce(F.size("feats") > 0, F.lit(False))
    texts = F.transform("factors", lambda s: F.concat(s["readable"], F.lit(": "), F.format_string("%.2f", s["value"])))
    score = F.concat(F.when(some, TXT_MODEL_SCORE + ": ").otherwise(TXT_NO_FEATURES + ": "), pct1(prob))
    factors = F.when(F.coalesce(F.size("factors") > 0, F.lit(False)), texts).otherwise(F.array(score))
    return scored.select(
        "*", band.alias("risk_level_rule"),
        clean_explanation(rule_text(with_probability(F.col("hits"), prob))).alias("llm_explanation"),
        F.array_join(factors, JOIN).alias("key_factors"),
        F.array_join(R.recommendations(band), JOIN).alias("recommendations"),
        R.confidence(prob, F.when(some, F.col("n_confident")).otherwise(0)).alias("explanation_confidence"))


def explain(scored: DataFrame, p: str = "fraud_probability", feature_cols: list[str] | None = None,
            exclude: tuple[str, ...] = ()) -> DataFrame:
    """Adds the explanation record of every scored row: risk level, explanation text, key
    factors and recommendations (joined by ' | '), confidence.  Rows that share their features by a key are better joined
    with ``key_parts`` of the keys and given to ``explain_parts``."""
    own = [c for c in ("feats", "factors", "hits", "n_confident") if c not in scored.columns]
    if len(own) < 4:
        raise ValueError("feats, factors, hits and n_confident are names of the explanation's own columns")
    return explain_parts(key_parts(scored, feature_cols, exclude), p).drop(*own)


# The fallback record and the prompt's template.
FALLBACK_TEXT = "Модель определила вероятность мошенничества %s на основе анализа поведенческих паттернов."
FALLBACK_FACTOR = "Общая оценка модели: %s"
FALLBACK_CONFIDENCE = 0.5
PROMPT = """Ты эксперт по банковской безопасности. Проанализируй данные и объясни, почему транзакция классифицирована как мошенническая.

Данные пользователя:
%s

Признаки модели:
%s

Вероятность мошенничества: %s

Дай структурированный ответ:
1. Основные подозрительные факторы (2-3 пункта)
2. Отклонения от нормального поведения
3. Рекомендуемые действия (конкретные)
4. Уровень уверенности

Ответ должен быть понятен банковскому аналитику. Максимум 150 слов."""


def fallback_record(scored: DataFrame, p: str = "fraud_probability") -> DataFrame:
    """The record of rows for which no explanation can be made: only the probability is used."""
    prob = F.col(p)
    band = R.band_by_threshold(prob)
    return scored.select(
        "*", band.alias("risk_level_rule"), F.format_string(FALLBACK_TEXT, pct1(prob)).alias("llm_explanation"),
        F.format_string(FALLBACK_FACTOR, pct1(prob)).alias("key_factors"),
        F.array_join(R.recommendations(band), JOIN).alias("recommendations"),
        F.lit(FALLBACK_CONFIDENCE).alias("explanation_confidence"))


def prompt_rows(scored: DataFrame, key: str, p: str = "fraud_probability", feature_cols: list[str] | None = None,
                exclude: tuple[str, ...] = (), user_fields: list[str] | None = None, carry: list[str] = ()) -> DataFrame:
    """Prompt text per row for an outside batch text job: the template with the user fields (all columns
    that are no features unless named) and the top 8 features; ``carry``: columns to keep beside it."""
    feats = feature_array(scored, feature_cols, exclude)
    top = top_by_abs(feats, TOP_PROMPT_FEATURES)
    feature_lines = F.transform(top, lambda s: F.concat(readable_name(s["name"]), F.lit(": "), F.format_string("%.3f", s["value"])))
    others = user_fields if user_fields is not None else [c for c in scored.columns if c not in (key, *(feature_cols or ()), *exclude)]
    user = F.concat_ws("\n", F.concat(F.lit("ID пользователя: "), F.col(key).cast("string")),
                       *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in others])
    feat_txt = F.when(F.size(feats) == 0, F.lit("Признаки не доступны")).otherwise(F.array_join(feature_lines, "\n"))
    return scored.select(key, p, *carry, F.format_string(PROMPT, user, feat_txt, pct1(F.col(p))).alias("prompt"))
