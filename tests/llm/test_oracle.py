"""The registered SQL of the training-data queries on the smallest tables."""

import duckdb
import pytest

from riskloom.llm import queries
from tests.conftest import SF_SMALL
from tools.check_oracle import TABLES, canon


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = queries.QUERIES[name](spark, SF_SMALL)
    cur = con.execute(queries.ORACLE[name])
    got = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    assert got == canon([d[0] for d in cur.description], cur.fetchall())
