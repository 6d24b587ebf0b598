import duckdb
import pytest

import __spark_entry__
from plumbline.llm.queries import oracle_sql, queries


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries()} and set(queries()) <= set(found)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = queries()[name](spark, data)
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
