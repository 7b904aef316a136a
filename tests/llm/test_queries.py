import os

import duckdb
import pytest

from rooftop.llm.queries import ORACLE_SQL, QUERIES

from .conftest import SF


def norm(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(map(norm, r)) for r in res.fetchall())
    assert sorted(tuple(map(norm, r)) for r in df.select(*cols).collect()) == want


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
