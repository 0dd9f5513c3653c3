"""Every query with an oracle equals its DuckDB SQL on sf0.001 (the driver repeats this on
sf0.01); queries without one must at least run."""

from __future__ import annotations

import duckdb
import pytest

from riskloom.plans import catalog
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, canon


catalog.load_all()
ML = {"train_forest", "cv_auc", "model_roundtrip", "score", "feature_importance", "model_info", "training_report"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = catalog.QUERIES[name](spark, SF_SMALL)
    cur = con.execute(catalog.ORACLE[name])
    sc, sv = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    dc, dv = canon([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc
    assert len(sv) == len(dv)
    assert sv == dv


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n not in catalog.ORACLE and n not in ML))
def test_rows_only_queries_run(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    assert df.count() >= 0 and df.columns
