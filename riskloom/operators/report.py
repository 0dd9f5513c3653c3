"""Report tables over scored rows: band summary, pattern summary, top-k case lists, and
report text as rows (section, ord, line) so that no report passes through one task whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import risk as R
from riskloom.session import cut_lineage

# Thresholds of the band summary and the pattern summary.
SUSPICIOUS, HIGH, MEDIUM, CRITICAL = 0.2, 0.7, 0.3, 0.8
HIGH_SHARE_PATTERN = 0.3


def with_bands(scored: DataFrame, p: str = "fraud_probability") -> DataFrame:
    prob = F.col(p)
    return scored.withColumn("risk_level", R.band_by_cut(prob)).withColumn("risk_level_rule", R.band_by_threshold(prob)) \
        .withColumn("prediction", (prob > 0.5).cast("int"))


def risk_summary(scored: DataFrame, p: str = "fraud_probability") -> DataFrame:
    """One row: total, suspicious (>= .2), high (>= .7), medium [.3, .7), low (rest),
    critical (>= .8) and their shares."""
    x = F.col(p)
    total = F.count(F.lit(1))
    a = scored.agg(total.alias("total"), F.count(F.when(x >= SUSPICIOUS, 1)).alias("suspicious"),
                   F.count(F.when(x >= HIGH, 1)).alias("high"),
                   F.count(F.when((x >= MEDIUM) & (x < HIGH), 1)).alias("medium"),
                   F.count(F.when(x >= CRITICAL, 1)).alias("critical"))
    out = a.withColumn("low", F.col("total") - F.col("high") - F.col("medium"))
    for c in ("suspicious", "high", "medium", "low", "critical"):
        out = out.withColumn(f"{c}_share", F.try_divide(F.col(c).cast("double"), F.col("total").cast("double")))
    return out


def fraud_patterns(scored: DataFrame, p: str = "fraud_probability") -> DataFrame:
    """Over suspicious rows (p > .2): count, mean p, high (p > .7), medium [.3, .7], low
    (< .3), and the 'high share above 30 %' pattern flag."""
    x = F.col(p)
    s = scored.where(x > SUSPICIOUS)
    out = s.agg(F.count(F.lit(1)).alias("total_cases"), F.avg(x).alias("avg_probability"),
                F.count(F.when(x > HIGH, 1)).alias("high_risk"),
                F.count(F.when((x >= MEDIUM) & (x <= HIGH), 1)).alias("medium_risk"),
                F.count(F.when(x < MEDIUM, 1)).alias("low_risk"))
    return out.withColumn("high_share_pattern", F.coalesce(
        (F.col("high_risk") > F.col("total_cases") * HIGH_SHARE_PATTERN).cast("int"), F.lit(0)))


def top_cases(scored: DataFrame, n: int, p: str = "fraud_probability", key: str = "sample_id",
              min_p: float | None = None) -> DataFrame:
    """Top n by probability (ties: smallest key); a per-partition top-n then one merge of
    at most n rows per partition (TakeOrderedAndProject)."""
    s = scored if min_p is None else scored.where(F.col(p) >= min_p)
    return s.orderBy(F.col(p).desc(), F.col(key)).limit(n)


def case_list(scored: DataFrame, n: int = 20, p: str = "fraud_probability", key: str = "sample_id") -> DataFrame:
    top = top_cases(with_bands(scored, p), n, p, key)
    prob = F.col(p)
    return top.withColumn("case_style", R.case_style(prob)).withColumn(
        "case_label", R.case_label(prob, R.band_by_cut(prob)))


# The texts of the reports.
NO_CASES = "Подозрительных случаев не обнаружено."
PATTERN_HEADS = ("Основные паттерны:", "Рекомендации:")
PATTERN_HIGH = "- Высокая концентрация случаев высокого риска"
PATTERN_ALWAYS = ("- Требуется анализ временных паттернов", "- Рекомендуется проверка географических аномалий")
ADVICE_HIGH = "- Немедленно проверить случаи высокого риска"
ADVICE_ALWAYS = ("- Усилить мониторинг подозрительных операций", "- Обновить правила детекции")
NO_CRITICAL = "✅ Критических случаев (≥80%) не обнаружено."
IMMEDIATE = ("1. СРОЧНО проверить %d случаев высокого риска", "2. Заблокировать подозрительные операции до выяснения",
             "3. Связаться с клиентами для подтверждения операций", "4. Уведомить службу безопасности о критических случаях",
             "5. Создать инциденты в системе мониторинга")
NO_IMMEDIATE = "✅ Случаев, требующих немедленного вмешательства, не обнаружено."
MONITORING = ("1. Усилить наблюдение за %d случаями среднего риска", "2. Настроить дополнительные алерты на данные сессии",
              "3. Потребовать дополнительную аутентификацию при необходимости", "4. Мониторить поведение в течение следующих 24-48 часов")
SYSTEM = ("1. Регулярно переобучать модель на новых данных (раз в неделю)", "2. Анализировать ложноположительные срабатывания",
          "3. Настраивать пороги в зависимости от текущих угроз", "4. Документировать все случаи для улучшения модели",
          "5. Использовать объяснения LLM для обучения аналитиков")
MODEL_GOOD, MODEL_FAIR, MODEL_POOR = ("✅ Модель показывает отличное качество (AUC ≥ 0.85)", "⚠️  Модель показывает хорошее качество (AUC ≥ 0.75)",
                                      "❌ Модель требует улучшения (AUC < 0.75)")
FEW_FRAUDS = "⚠️  Низкая доля мошенничества - рассмотрите методы балансировки"
MANY_MISSING = "⚠️  Высокая доля пропусков - улучшите качество данных"
NEXT_STEPS = ("1. Протестируйте модель на новых данных", "2. Настройте пороги в зависимости от бизнес-требований",
              "3. Мониторьте качество модели в продакшене", "4. Регулярно переобучайте на новых данных")
FEW_FRAUDS_BELOW, MANY_MISSING_ABOVE, GOOD_AUC, FAIR_AUC = 0.05, 0.2, 0.85, 0.75


def report_rows(spark, sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of (section, ord, line) frames in section order."""
    frames = [df.select(F.lit(i).alias("section_no"), F.lit(name).alias("section"), "ord", "line")
              for i, (name, df) in enumerate(sections)]
    return reduce(DataFrame.unionByName, frames)


def pct(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def number(c: Column) -> Column:
    """With thousands separators."""
    return F.format_number(c.cast("long"), 0)


def lines(df: DataFrame, *parts: Column) -> DataFrame:
    """One row per line of a one-row frame; NULL lines are left out."""
    kept = F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())
    return df.select(F.posexplode(kept).alias("ord", "line"))


def one(line: Column) -> Column:
    return F.array(line)


def fixed(*texts: str) -> Column:
    return F.array(*map(F.lit, texts))


def summary_lines(summary: DataFrame) -> DataFrame:
    """Statistics section of the fraud report from the one-row band summary."""
    def line(text, c, share=None):
        tail = [F.lit(" ("), pct(F.coalesce(F.col(share), F.lit(0.0))), F.lit(")")] if share else []
        return one(F.concat(F.lit(text), number(F.col(c)), *tail))
    return lines(summary, line("- Всего проанализировано сессий: ", "total"),
                 line("- Подозрительных случаев (≥20%): ", "suspicious", "suspicious_share"),
                 line("- Высокий риск (≥70%): ", "high", "high_share"), line("- Средний риск (30-70%): ", "medium", "medium_share"),
                 line("- Низкий риск (<30%): ", "low"))


def pattern_lines(patterns: DataFrame) -> DataFrame:
    """Rule report on suspicious cases ('no cases' text when there are none)."""
    def text(c):
        return F.col(c).cast("string")
    high = F.col("high_risk")
    told = F.flatten(F.array(
        F.array(F.concat(F.lit("- Всего случаев: "), text("total_cases")), F.concat(F.lit("- Средняя вероятность: "), pct(F.col("avg_probability"))),
                F.concat(F.lit("- Высокий риск: "), text("high_risk")),
                F.concat(F.lit("- Распределение: Высокий("), text("high_risk"), F.lit(") Средний("), text("medium_risk"), F.lit(") Низкий("), text("low_risk"), F.lit(")")),
                F.lit(PATTERN_HEADS[0]), F.when(F.col("high_share_pattern") == 1, PATTERN_HIGH)),
        fixed(*PATTERN_ALWAYS, PATTERN_HEADS[1]), one(F.when(high > 0, ADVICE_HIGH)), fixed(*ADVICE_ALWAYS)))
    return lines(patterns, F.when(F.col("total_cases") == 0, fixed(NO_CASES)).otherwise(told))


def numbered(cases: DataFrame, p: str, key: str) -> DataFrame:
    """``ord`` in probability order (n is small: top-k lists)."""
    return cases.withColumn("ord", F.row_number().over(Window.orderBy(F.col(p).desc(), F.col(key))))  # over at most k rows


def case_lines(cases: DataFrame, p: str = "fraud_probability", key: str = "sample_id") -> DataFrame:
    """One line per listed case."""
    return numbered(cases, p, key).select("ord", F.concat(
        F.col("ord").cast("string"), F.lit(". "), F.col(key).cast("string"), F.lit(" - Риск: "), pct(F.col(p))).alias("line"))


def cut_text(c: str, n: int) -> Column:
    return F.concat(F.substring(F.coalesce(F.col(c), F.lit("")), 1, n), F.lit("..."))


def critical_lines(cases: DataFrame, p: str, key: str) -> DataFrame:
    """Risk, explanation, factors and actions of each critical case."""
    x = numbered(cases, p, key)
    parts = F.array(
        F.concat(F.col("ord").cast("string"), F.lit(". Сессия "), F.col(key).cast("string"), F.lit(" - Риск: "), pct(F.col(p))),
        F.concat(F.lit("   Объяснение: "), cut_text("llm_explanation", 150)), F.concat(F.lit("   Ключевые факторы: "), cut_text("key_factors", 120)),
        F.concat(F.lit("   Действия: "), cut_text("recommendations", 100)))
    return x.select("ord", F.posexplode(parts).alias("_i", "line")).select((F.col("ord") * 10 + F.col("_i")).alias("ord"), "line")


def top_lines(cases: DataFrame, p: str, key: str) -> DataFrame:
    """Probability, band, explanation, advice and confidence of each top case."""
    x = numbered(cases, p, key)
    parts = F.array(
        F.concat(F.col("ord").cast("string"), F.lit(". Заявка "), F.col(key).cast("string")),
        F.concat(F.lit("📊 Вероятность мошенничества: "), pct(F.col(p))), F.concat(F.lit("🎯 Уровень риска: "), F.col("risk_level")),
        F.concat(F.lit("🤖 LLM объяснение: "), cut_text("llm_explanation", 200)), F.concat(F.lit("⚡ Рекомендации: "), cut_text("recommendations", 150)),
        F.concat(F.lit("🎲 Уверенность объяснения: "), pct(F.col("explanation_confidence"))))
    return x.select("ord", F.posexplode(parts).alias("_i", "line")).select((F.col("ord") * 10 + F.col("_i")).alias("ord"), "line")


def fraud_report(explained: DataFrame, p: str = "fraud_probability", key: str = "sample_id", app_key: str = "application_id") -> DataFrame:
    """The detailed report over scored rows with their explanation records (``explain.explain``)."""
    rows = explained.withColumn("risk_level", R.band_by_cut(F.col(p)))
    summary = cut_lineage(risk_summary(rows, p))
    critical = F.col("critical")
    high, medium = F.col("high"), F.col("medium")
    found = F.format_string("🚨 НАЙДЕНО %d КРИТИЧЕСКИХ СЛУЧАЕВ:", critical)
    return report_rows(explained.sparkSession, [
        ("statistics", summary_lines(summary)),
        ("patterns", pattern_lines(fraud_patterns(rows, p))),
        ("critical_count", lines(summary, one(F.when(critical > 0, found).otherwise(NO_CRITICAL)))),
        ("critical_cases", critical_lines(top_cases(rows, 10, p, key, CRITICAL), p, key)),
        ("top_suspicious", top_lines(top_cases(rows, 5, p, key), p, app_key)),
        ("immediate_actions", lines(summary, F.when(high > 0, F.array(F.format_string(IMMEDIATE[0], high), *map(F.lit, IMMEDIATE[1:]))).otherwise(fixed(NO_IMMEDIATE)))),
        ("monitoring", lines(summary, F.when(medium > 0, F.array(F.format_string(MONITORING[0], medium), *map(F.lit, MONITORING[1:]))).otherwise(F.array().cast("array<string>")))),
        ("system", lines(summary, fixed(*SYSTEM))),
    ])


def training_report(quality: DataFrame, metrics: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """Training report rows: data quality, sizes, metrics, cross-validation, thresholds, top features,
    advice, next steps.  Metric columns that are missing or NULL print as N/A."""
    def line(text, c, form="%.4f"):
        have = c in metrics.columns
        value = F.col(c) if have else F.lit(None).cast("double")
        shown = number(value) if form == "count" else F.format_string(form, value)
        return F.concat(F.lit(text), F.when(value.isNotNull(), shown).otherwise("N/A"))
    q = lines(quality, F.array(
        F.concat(F.lit("- Образцов для обучения: "), number(F.col("n_rows"))),
        F.concat(F.lit("- Количество признаков: "), number(F.col("n_columns"))),
        F.concat(F.lit("- Доля мошенничества: "), F.format_string("%.2f%%", F.col("fraud_rate") * 100)),
        F.concat(F.lit("- Пропущенных значений: "), F.format_string("%.2f%%", F.col("missing_ratio") * 100)),
        F.concat(F.lit("- Числовых признаков: "), number(F.col("numeric_columns"))),
        F.concat(F.lit("- Категориальных признаков: "), number(F.col("category_columns")))))
    m = [("training", lines(metrics, F.array(line("- Размер обучающей выборки: ", "train_n", "count"), line("- Размер тестовой выборки: ", "n", "count")))),
         ("metrics", lines(metrics, F.array(
             line("- Test Accuracy: ", "accuracy"), line("- Test Precision: ", "precision"), line("- Test Recall: ", "recall"),
             line("- Test F1-Score: ", "f1"), line("- Test AUC-ROC: ", "auc"), line("- Average Precision: ", "average_precision")))),
         ("cross_validation", lines(metrics, F.array(line("- CV AUC (среднее): ", "cv_auc_mean"), line("- CV AUC (стд. откл.): ", "cv_auc_std")))),
         ("thresholds", lines(metrics, F.array(line("- Порог для точности 80%: ", "threshold_at_80"), line("- Recall при точности 80%: ", "recall_at_80"))))]
    sections = [("data_quality", q), *m]
    if importance is not None:
        top = numbered(importance.orderBy(F.col("importance").desc(), "feature").limit(10), "importance", "feature")
        sections.append(("top_features", top.select("ord", F.format_string("%2d. %s", "ord", "feature").alias("line"))))
    sections += [
        ("advice_model", lines(metrics, one(F.when(F.col("auc") >= GOOD_AUC, MODEL_GOOD).when(F.col("auc") >= FAIR_AUC, MODEL_FAIR).otherwise(MODEL_POOR)))),
        ("advice_data", lines(quality, F.array(F.when(F.col("fraud_rate") < FEW_FRAUDS_BELOW, FEW_FRAUDS),
                                               F.when(F.col("missing_ratio") > MANY_MISSING_ABOVE, MANY_MISSING)))),
        ("next_steps", lines(quality, fixed(*NEXT_STEPS)))]
    return report_rows(quality.sparkSession, sections)
