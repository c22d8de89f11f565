"""The queries of the training-data operators against their SQL on the smallest tables."""

import os

import pytest

from charterloom.llm import oracle, queries
from tests.test_entry import FOLDER, needs_data, rounded


def test_names():
    assert set(oracle.ORACLE) <= set(queries.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    got = queries.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle.ORACLE[name]})").fetchall()
    assert rounded(got.select(*columns).collect()) == rounded(expected)
