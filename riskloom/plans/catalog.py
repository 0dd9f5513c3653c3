"""Query catalogue: every registered query reads the driver tables (or data Spark derives
from them) and has, where SQL can express it, an independent DuckDB oracle.

Doubles are rounded to 6 places on both sides; counts are BIGINT, hours INT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.stats import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def r6(expr: str, alias: str) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), 6) AS {alias}"


# load every query module so that it registers itself
def load_all() -> None:
    from riskloom.plans import q_apps, q_assemble, q_calls, q_events, q_metrics, q_ml, q_quality, q_scores, q_signals, q_sources  # noqa: F401
