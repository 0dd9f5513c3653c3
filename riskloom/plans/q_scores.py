"""Scoring-layer queries on scores derived from events (p = value / 500) joined with the
per-user session and activity features."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.stats import round_doubles
from riskloom.functions.text import READABLE_NAMES, WHITESPACE, WORD_SWAPS, clean_explanation
from riskloom.functions import risk as R
from riskloom.operators import events as ev
from riskloom.operators import explain as EX
from riskloom.operators import report as RP
from riskloom.plans import fixtures as X
from riskloom.plans import q_events
from riskloom.plans.catalog import register, table
from riskloom.session import stored

FEATS = ["amplitude_session_count", "amplitude_avg_session_duration", "amplitude_std_session_duration",
         "amplitude_night_activity_ratio", "amplitude_weekend_ratio", "amplitude_event_count",
         "amplitude_unique_event_types", "amplitude_active_slots", "amplitude_events_per_hour",
         "amplitude_peak_hour", "amplitude_activity_variance"]
P = "fraud_probability"


def _scores(spark, sf):
    return X.scores(table(spark, sf, "events"))


def _key_features(spark, sf):
    """The features of every application, with what explanations need of them: written once, a row per key."""
    e = table(spark, sf, "events")
    f = ev.session_features(e, tiebreak=["event_id"]).join(ev.activity_features(e), ev.KEY)
    return stored(EX.key_parts(round_doubles(f.withColumn(ev.KEY, F.col(ev.KEY).cast("string"))), FEATS), "key-features")


def _scored_features(spark, sf, *cols):
    """The scored rows with columns of ``_key_features`` (all features if none is named)."""
    return _scores(spark, sf).join(_key_features(spark, sf).select(ev.KEY, *(cols or FEATS)), "application_id", "left")


SC = f"sc AS ({X.SCORES_SQL})"
FEAT_SQL = f"""
sc AS ({X.SCORES_SQL}),
ft AS (SELECT CAST(application_id AS VARCHAR) AS application_id, * EXCLUDE (application_id)
       FROM ({q_events.SESSION_SQL}) a JOIN ({q_events.ACTIVITY_SQL}) b USING (application_id)),
sf AS (SELECT sc.*, {", ".join(f"ft.{c}" for c in FEATS)} FROM sc LEFT JOIN ft USING (application_id)),
fa AS (SELECT sample_id, application_id, fraud_probability,
  list_filter([{", ".join(f"struct_pack(pos := {i}, name := '{c}', value := CAST({c} AS DOUBLE))" for i, c in enumerate(FEATS))}],
              lambda s: s.value IS NOT NULL AND NOT isnan(s.value) AND abs(s.value) >= 0.001) AS feats FROM sf)"""

CUT = ("CASE WHEN fraud_probability > 0 AND fraud_probability <= 0.3 THEN 'Низкий' "
       "WHEN fraud_probability > 0.3 AND fraud_probability <= 0.7 THEN 'Средний' "
       "WHEN fraud_probability > 0.7 AND fraud_probability <= 1.0 THEN 'Высокий' END")
RULE = ("CASE WHEN fraud_probability >= 0.7 THEN 'Высокий' WHEN fraud_probability >= 0.3 THEN 'Средний' ELSE 'Низкий' END")


@register("risk_bands", f"""WITH {SC}
SELECT sample_id, application_id, ROUND(fraud_probability, 6) AS fraud_probability, {CUT} AS risk_level,
  {RULE} AS risk_level_rule, CAST(fraud_probability > 0.5 AS INTEGER) AS prediction FROM sc""")
def q_risk_bands(spark, sf):
    return RP.with_bands(_scores(spark, sf))


@register("risk_summary", f"""WITH {SC},
a AS (SELECT COUNT(*) AS total, COUNT(CASE WHEN fraud_probability >= 0.2 THEN 1 END) AS suspicious,
  COUNT(CASE WHEN fraud_probability >= 0.7 THEN 1 END) AS high,
  COUNT(CASE WHEN fraud_probability >= 0.3 AND fraud_probability < 0.7 THEN 1 END) AS medium,
  COUNT(CASE WHEN fraud_probability >= 0.8 THEN 1 END) AS critical FROM sc)
SELECT total, suspicious, high, medium, critical, total - high - medium AS low,
  ROUND(suspicious / total, 6) AS suspicious_share, ROUND(high / total, 6) AS high_share,
  ROUND(medium / total, 6) AS medium_share, ROUND((total - high - medium) / total, 6) AS low_share,
  ROUND(critical / total, 6) AS critical_share FROM a""")
def q_risk_summary(spark, sf):
    return RP.risk_summary(_scores(spark, sf))


@register("fraud_patterns", f"""WITH {SC}
SELECT COUNT(*) AS total_cases, ROUND(AVG(fraud_probability), 6) AS avg_probability,
  COUNT(CASE WHEN fraud_probability > 0.7 THEN 1 END) AS high_risk,
  COUNT(CASE WHEN fraud_probability >= 0.3 AND fraud_probability <= 0.7 THEN 1 END) AS medium_risk,
  COUNT(CASE WHEN fraud_probability < 0.3 THEN 1 END) AS low_risk,
  CAST(COALESCE(COUNT(CASE WHEN fraud_probability > 0.7 THEN 1 END) > COUNT(*) * 0.3, FALSE) AS INTEGER) AS high_share_pattern
FROM sc WHERE fraud_probability > 0.2""")
def q_fraud_patterns(spark, sf):
    return RP.fraud_patterns(_scores(spark, sf))


@register("top_suspicious", f"""WITH {SC}
SELECT sample_id, application_id, ROUND(fraud_probability, 6) AS fraud_probability FROM sc
ORDER BY fraud_probability DESC, sample_id LIMIT 5""")
def q_top_suspicious(spark, sf):
    return RP.top_cases(_scores(spark, sf), 5)


@register("critical_cases", f"""WITH {SC}
SELECT sample_id, application_id, ROUND(fraud_probability, 6) AS fraud_probability FROM sc
WHERE fraud_probability >= 0.8 ORDER BY fraud_probability DESC, sample_id LIMIT 10""")
def q_critical_cases(spark, sf):
    return RP.top_cases(_scores(spark, sf), 10, min_p=0.8)


@register("case_list", f"""WITH {SC}
SELECT sample_id, application_id, ROUND(fraud_probability, 6) AS fraud_probability, {CUT} AS risk_level,
  {RULE} AS risk_level_rule, CAST(fraud_probability > 0.5 AS INTEGER) AS prediction,
  CASE WHEN fraud_probability >= 0.8 THEN 'risk-critical' WHEN fraud_probability >= 0.7 THEN 'risk-high'
       WHEN fraud_probability >= 0.3 THEN 'risk-medium' ELSE 'risk-low' END AS case_style,
  CASE WHEN fraud_probability >= 0.8 THEN 'КРИТИЧЕСКИЙ' ELSE {CUT} END AS case_label
FROM sc ORDER BY fraud_probability DESC, sample_id LIMIT 20""")
def q_case_list(spark, sf):
    return RP.case_list(_scores(spark, sf))


@register("important_features", f"""WITH {FEAT_SQL}
SELECT sample_id, CAST(len(feats) AS INTEGER) AS n_important,
  array_to_string(list_transform(feats, lambda s: s.name), ',') AS important_names FROM fa""")
def q_important_features(spark, sf):
    s = _scored_features(spark, sf)
    f = EX.feature_array(s, FEATS)
    return s.select("sample_id", F.size(f).alias("n_important"),
                    F.array_join(F.transform(f, lambda x: x["name"]), ",").alias("important_names"))


def _readable_sql(x: str) -> str:
    exact = " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in READABLE_NAMES)
    part = " ".join(f"WHEN contains({x}, '{k}') THEN '{v}'" for k, v in READABLE_NAMES)
    simple = f"replace({x}, '_', ' ')"
    for a, b in WORD_SWAPS:
        simple = f"replace({simple}, '{a}', '{b}')"
    title = (f"array_to_string(list_transform(string_split({simple}, ' '), "
             f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")
    return f"CASE {exact} {part} ELSE {title} END"


@register("key_factors", f"""WITH {FEAT_SQL},
k AS (SELECT sample_id, list_filter(list_slice(list_sort(list_transform(feats,
        lambda s: struct_pack(k := -abs(s.value), pos := s.pos, name := s.name, value := s.value))), 1, 5),
        lambda s: abs(s.value) > 0.01) AS top FROM fa),
u AS (SELECT sample_id, unnest(list_transform(top, lambda s, i: struct_pack(r := i, name := s.name, value := s.value))) AS t FROM k)
SELECT sample_id, CAST(t.r AS INTEGER) AS factor_rank, t.name AS feature, ROUND(t.value, 6) AS value,
  {_readable_sql("t.name")} AS readable FROM u""")
def q_key_factors(spark, sf):
    s = _scored_features(spark, sf, "factors")
    return s.select("sample_id", F.posexplode("factors").alias("i", "t")).select(
        "sample_id", (F.col("i") + 1).alias("factor_rank"), F.col("t.name").alias("feature"),
        F.col("t.value").alias("value"), F.col("t.readable").alias("readable"))


@register("readable_names", f"""WITH {FEAT_SQL},
n AS (SELECT DISTINCT unnest(list_transform(feats, lambda s: s.name)) AS feature FROM fa)
SELECT feature, {_readable_sql("feature")} AS readable FROM n""")
def q_readable_names(spark, sf):
    from riskloom.functions.text import readable_name
    s = _scored_features(spark, sf)
    n = s.select(F.explode(F.transform(EX.feature_array(s, FEATS), lambda x: x["name"])).alias("feature")).distinct()
    return n.select("feature", readable_name(F.col("feature")).alias("readable"))


REC_SQL = " ".join(f"WHEN {RULE} = '{band}' THEN '{' | '.join(texts)}'" for band, texts in R.RECOMMENDATIONS.items())


@register("recommendations", f"""WITH {SC}
SELECT sample_id, {RULE} AS risk_level_rule, CASE {REC_SQL} END AS recommendations FROM sc""")
def q_recommendations(spark, sf):
    s = _scores(spark, sf)
    band = R.band_by_threshold(F.col(P))
    return s.select("sample_id", band.alias("risk_level_rule"), F.array_join(R.recommendations(band), " | ").alias("recommendations"))


@register("confidence", f"""WITH {FEAT_SQL}
SELECT sample_id, ROUND(CAST(least(0.6::DOUBLE + CASE WHEN fraud_probability > 0.8 OR fraud_probability < 0.2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
  + least(0.03::DOUBLE * CASE WHEN len(feats) > 0 THEN len(list_filter(feats, lambda s: abs(s.value) > 0.1)) ELSE 0 END, 0.2::DOUBLE), 1.0::DOUBLE) AS DOUBLE), 6)
  AS explanation_confidence FROM fa""")
def q_confidence(spark, sf):
    s = _scored_features(spark, sf)
    return s.select("sample_id", EX.confidence(EX.feature_array(s, FEATS), F.col(P)).alias("explanation_confidence"))


def _rules_sql():
    per = []
    for c in FEATS:
        ok = f"{c} IS NOT NULL AND abs({c}) >= 0.001"
        if "night_activity" in c:
            per.append(f"CASE WHEN {ok} AND {c} > 0.3 THEN 'night_activity' END")
        if "session_count" in c:
            per.append(f"CASE WHEN {ok} AND {c} < 5 THEN 'few_sessions' END")
        if "session_duration" in c:
            per.append(f"CASE WHEN {ok} AND {c} < 60 THEN 'short_sessions' END")
    per.append("CASE WHEN fraud_probability > 0.8 THEN 'very_high_probability' "
               "WHEN fraud_probability > 0.5 THEN 'raised_probability' END")
    return f"NULLIF(concat_ws(',', {', '.join(per)}), '')"


@register("rule_explanation", f"""WITH {FEAT_SQL.split(",\nfa AS", 1)[0]}
SELECT sample_id, COALESCE({_rules_sql()}, 'default') AS rules FROM sf""")
def q_rule_explanation(spark, sf):
    s = _scored_features(spark, sf, "hits")
    hits = EX.with_probability(F.col("hits"), F.col(P))
    return s.select("sample_id", F.array_join(F.transform(hits, lambda h: h["rule"]), ",").alias("rules"))


WS = WHITESPACE


@register("clean_explanation", f"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g'),
                  '\\n+', ' ', 'g'), '[{WS}]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 497) || '...' ELSE t END AS cleaned,
       CAST(length(t) AS INTEGER) AS clean_length FROM c""")
def q_clean_explanation(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", clean_explanation(F.col("text")).alias("cleaned"),
                    F.length(clean_explanation(F.col("text"), limit=10 ** 9)).alias("clean_length"))


NUMBERS = r"-?[0-9]+([.][0-9]+)?(E-?[0-9]+)?"
PARTS = ("feats", "factors", "hits", "n_confident")


def _no_numbers(c: str):
    """Both engines give the numbers of these texts, but format halves differently; the values are compared elsewhere."""
    return F.regexp_replace(c, NUMBERS, "#").alias(c)


def _rule_text_sql():
    texts = {"night_activity": EX.TXT_NIGHT + " (#%)", "few_sessions": EX.TXT_FEW_SESSIONS + " (#)", "short_sessions": EX.TXT_SHORT_SESSIONS + " (# сек)",
             "very_high_probability": EX.TXT_VERY_HIGH, "raised_probability": EX.TXT_RAISED, "default": EX.TXT_DEFAULT}
    rules = f"COALESCE({_rules_sql()}, 'default')"
    case = " ".join(f"WHEN r = '{k}' THEN '{v}'" for k, v in texts.items())
    return f"array_to_string(list_transform(string_split({rules}, ','), lambda r: CASE {case} END), '. ') || '.'"


@register("explain", f"""WITH {FEAT_SQL},
tx AS (SELECT sample_id, application_id, fraud_probability, {_rule_text_sql()} AS llm_explanation FROM sf),
tf AS (SELECT *, list_filter(list_slice(list_sort(list_transform(feats,
        lambda s: struct_pack(k := -abs(s.value), pos := s.pos, name := s.name, value := s.value))), 1, 5), lambda s: abs(s.value) > 0.01) AS top FROM fa),
kf AS (SELECT sample_id, feats, CASE WHEN len(top) > 0 THEN array_to_string(list_transform(top, lambda s: {_readable_sql("s.name")} || ': #'), ' | ')
        WHEN len(feats) = 0 THEN '{EX.TXT_NO_FEATURES}: #%' ELSE '{EX.TXT_MODEL_SCORE}: #%' END AS key_factors FROM tf)
SELECT sample_id, application_id, ROUND(fraud_probability, 6) AS fraud_probability, {RULE} AS risk_level_rule, llm_explanation, key_factors,
  regexp_replace(CASE {REC_SQL} END, '{NUMBERS}', '#', 'g') AS recommendations,
  ROUND(CAST(least(0.6::DOUBLE + CASE WHEN fraud_probability > 0.8 OR fraud_probability < 0.2 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
  + least(0.03::DOUBLE * CASE WHEN len(feats) > 0 THEN len(list_filter(feats, lambda s: abs(s.value) > 0.1)) ELSE 0 END, 0.2::DOUBLE), 1.0::DOUBLE) AS DOUBLE), 6)
  AS explanation_confidence
FROM tx JOIN kf USING (sample_id)""")
def q_explain(spark, sf):
    x = EX.explain_parts(_scored_features(spark, sf, *PARTS), P)
    return x.select("sample_id", "application_id", P, "risk_level_rule", *[_no_numbers(c) for c in ("llm_explanation", "key_factors", "recommendations")],
                    "explanation_confidence")


PROMPT_SQL = "'" + EX.PROMPT.replace("'", "''").replace("%s", "' || {} || '") + "'"


@register("prompt_rows", f"""WITH {FEAT_SQL},
tf AS (SELECT *, list_slice(list_sort(list_transform(feats,
        lambda s: struct_pack(k := -abs(s.value), pos := s.pos, name := s.name, value := s.value))), 1, 8) AS top FROM fa)
SELECT sample_id, application_id, regexp_replace({PROMPT_SQL.format("'ID пользователя: ' || regexp_replace(application_id, '^[0-9]+$', '1') || chr(10) || 'sample_id: 1' || chr(10) || 'fraud_probability: 1'",
    f"CASE WHEN len(feats) = 0 THEN 'Признаки не доступны' ELSE array_to_string(list_transform(top, lambda s: {_readable_sql('s.name')} || ': 1'), chr(10)) END", "'1%'")},
  '{NUMBERS}', '#', 'g') AS prompt
FROM tf""")
def q_prompt_rows(spark, sf):
    scored = _scored_features(spark, sf)
    rows = EX.prompt_rows(scored, "application_id", P, FEATS, user_fields=["sample_id", P], carry=["sample_id"])
    return rows.select("sample_id", "application_id", _no_numbers("prompt"))


@register("fraud_report")
def q_fraud_report(spark, sf):
    return RP.fraud_report(EX.explain_parts(_scored_features(spark, sf, *PARTS), P), P)


@register("fallback_record", """
SELECT event_id AS sample_id, ROUND(value / 500, 6) AS fraud_probability,
  'Модель определила вероятность мошенничества % на основе анализа поведенческих паттернов.' AS llm_explanation,
  'Общая оценка модели: %' AS key_factors, 0.5 AS explanation_confidence
FROM events""")
def q_fallback_record(spark, sf):
    """The percentages are left out of the texts: the two engines format halves differently."""
    x = EX.fallback_record(_scores(spark, sf), P)
    texts = [F.regexp_replace(c, "[0-9.]+%", "%").alias(c) for c in ("llm_explanation", "key_factors")]
    return x.select("sample_id", P, *texts, "explanation_confidence")
