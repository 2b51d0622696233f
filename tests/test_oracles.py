"""Every core query with SQL gives the rows of the SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from leafmill.queries import ORACLES, QUERIES
from leafmill.session import release


def _key(row):
    return tuple("NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(data + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(_key(r) for r in df.select(*cols).collect())
    rel = con.execute(ORACLES[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    release(spark)
    assert got == sorted(_key([r[names.index(c)] for c in cols]) for r in rel.fetchall())
