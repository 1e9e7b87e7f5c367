"""Every registered query equals its SQL; those without SQL give rows."""

import glob
import os

import duckdb
import pytest

from factorloom.plans import catalogue
from tests.conftest import SF


def rows(frame):
    cols = sorted(frame.columns)
    clean = lambda x: None if x is None or x != x else (round(x, 5) + 0.0 if isinstance(x, float) else int(x) if isinstance(x, bool) else x)
    return cols, sorted([tuple(map(clean, r)) for r in frame.select(cols).to_rows()], key=repr)


class Arrow:
    def __init__(self, table):
        self.table = table
        self.columns = table.column_names

    def select(self, cols):
        return Arrow(self.table.select(cols))

    def to_rows(self):
        return list(zip(*[c.to_pylist() for c in self.table.columns], strict=True)) if self.table.num_columns else []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = Arrow(catalogue.queries()[name](spark, SF).toArrow())
    if name in catalogue.oracle_sql():
        found = duck.sql(catalogue.oracle_sql()[name])
        table = found.to_arrow_table() if hasattr(found, "to_arrow_table") else found.arrow()
        assert rows(got) == rows(Arrow(table))
    assert len(got.to_rows()) > 0
