"""Every query gives the rows of its SQL."""

from pathlib import Path

import duckdb
import pytest

from harrow.queries import ORACLES, QUERIES
from scripts.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    return db


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    said = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert "DIFFERENT" not in said, said
