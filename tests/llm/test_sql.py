import glob
import os

import duckdb
import pytest
from conftest import TESTDATA

from oddsmith.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{TESTDATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    frame = QUERIES[name](spark, TESTDATA)
    columns = sorted(frame.columns)
    result = duck.execute(ORACLES[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(row[names.index(c)] for c in columns) for row in result.fetchall())
    assert sorted(tuple(row[c] for c in columns) for row in frame.collect()) == theirs
