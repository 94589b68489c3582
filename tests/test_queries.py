"""Every query of the library against its SQL, on the small tables where they exist."""

import glob
import os

import pytest

import __spark_entry__ as entry
from corpusmill.plans.oracles import ORACLES
from corpusmill.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def canonical(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    mine = QUERIES[name](spark, SF)
    columns = sorted(mine.columns)
    other = duck.sql(ORACLES[name])
    assert columns == sorted(other.columns)
    theirs = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert canonical(tuple(r) for r in mine.select(*columns).collect()) == canonical(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) - set(ORACLES) == {"answers", "page_blocks"}


def test_rows_only_queries(spark):
    assert all(r.answer.isdigit() for r in QUERIES["answers"](spark, SF).collect())
    assert all(r.title for r in QUERIES["page_blocks"](spark, SF).collect())
    assert all(r.time.endswith("s") for r in QUERIES["human_sizes"](spark, SF).collect())
