"""Plan checks over the registered queries (sf0.001): no cartesian products or nested-loop
joins, Python only in the spectral stage, pruned parquet scans."""

from __future__ import annotations

import pytest

from riskloom.plans import catalog
from tests.conftest import SF_SMALL

catalog.load_all()

# queries that train models while the plan is built; checked by the oracle / rows-only runs
SLOW_TO_PLAN = {"train_forest", "cv_auc", "model_roundtrip", "score", "feature_importance", "model_info",
                "training_report", "scan_link_csv", "scan_chunks"}
PYTHON_ALLOWED = {"signal_features", "fuzzy_key_join_blocks"}
BAD_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NAMES = sorted(n for n in catalog.QUERIES if n not in SLOW_TO_PLAN)


@pytest.mark.parametrize("name", NAMES)
def test_plan_shape(spark, name):
    plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
    for node in BAD_NODES:
        assert node not in plan, f"{name}: {node}"
    if name not in PYTHON_ALLOWED:
        for node in PYTHON_NODES:
            assert node not in plan, f"{name}: {node}"


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(catalog.QUERIES["temporal_features"](spark, SF_SMALL))
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    assert scan and all("props" not in ln and "value" not in ln.split("ReadSchema")[-1] for ln in scan)
