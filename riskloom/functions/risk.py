"""Risk bands and explanation rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band labels (low, medium, high) and the case-style label for >= 0.8.
LOW, MEDIUM, HIGH = "Низкий", "Средний", "Высокий"
CRITICAL = "КРИТИЧЕСКИЙ"

# Recommendation texts per band.
RECOMMENDATIONS = {
    HIGH: [
        "Немедленно заблокировать подозрительные операции",
        "Связаться с клиентом для подтверждения",
        "Провести дополнительную проверку документов",
        "Уведомить службу безопасности",
    ],
    MEDIUM: [
        "Усилить мониторинг операций пользователя",
        "Запросить дополнительную аутентификацию",
        "Проверить операции за последние 24 часа",
    ],
    LOW: [
        "Продолжить стандартный мониторинг",
        "Периодически пересматривать статус",
    ],
}


def band_by_threshold(p: Column) -> Column:
    """>= .7 high, >= .3 medium, else low."""
    return F.when(p >= 0.7, HIGH).when(p >= 0.3, MEDIUM).otherwise(LOW)


def band_by_cut(p: Column) -> Column:
    """Right-closed bins (0,.3], (.3,.7], (.7,1]; 0 and values outside give NULL."""
    return (F.when((p > 0) & (p <= 0.3), LOW).when((p > 0.3) & (p <= 0.7), MEDIUM)
            .when((p > 0.7) & (p <= 1.0), HIGH))


def case_style(p: Column) -> Column:
    """Case list style: >= .8 critical, >= .7 high, >= .3 medium, else low."""
    return (F.when(p >= 0.8, "risk-critical").when(p >= 0.7, "risk-high")
            .when(p >= 0.3, "risk-medium").otherwise("risk-low"))


def case_label(p: Column, band: Column) -> Column:
    return F.when(p >= 0.8, F.lit(CRITICAL)).otherwise(band)


def recommendations(band: Column) -> Column:
    expr = None
    for label, texts in RECOMMENDATIONS.items():
        arr = F.array(*[F.lit(t) for t in texts])
        expr = F.when(band == label, arr) if expr is None else expr.when(band == label, arr)
    return expr.otherwise(F.array(*[F.lit(t) for t in RECOMMENDATIONS[LOW]]))


def confidence(p: Column, important_count: Column) -> Column:
    """.6 + .2 at extreme p + min(.03 k, .2), capped at 1 (k = features with |v| > .1)."""
    c = F.lit(0.6) + F.when((p > 0.8) | (p < 0.2), 0.2).otherwise(0.0)
    c = c + F.least(important_count.cast("double") * 0.03, F.lit(0.2))
    return F.least(c, F.lit(1.0))
