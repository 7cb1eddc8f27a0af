"""Queries against their SQL on a panel with constant columns, which the larger tables have and sf0.001 lacks."""

import duckdb
import pytest

from marketloom.plans.catalogue import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def level(tmp_path_factory):
    """A folder whose line items are all taxed alike, and a connection to it: I2 and I7 are constant."""
    d, c = str(tmp_path_factory.mktemp("level")), duckdb.connect()
    c.execute(f"copy (select * replace (cast(0.08 as double) as l_tax) from '{DATA}/lineitem.parquet') to '{d}/lineitem.parquet'")
    c.execute(f"copy (select * from '{DATA}/orders.parquet') to '{d}/orders.parquet'")
    for t in ("lineitem", "orders"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return d, c


def both(spark, level, name):
    """Rows of a query and of its SQL, sorted as text: there NULL and NaN differ."""
    d, c = level
    want = c.execute(SQL[name])
    cols = [x[0] for x in want.description]
    return sorted(map(str, map(tuple, QUERIES[name](spark, d).select(*cols).collect()))), sorted(map(str, want.fetchall()))


def test_a_constant_leaves_no_share_to_cut(spark, level):
    got, want = both(spark, level, "importance_cut")
    assert got == want


def test_a_constant_counts_at_every_bound(spark, level):
    got, want = both(spark, level, "importance_counts")
    assert got == want


def test_a_constant_is_at_least_any_bound(spark, level):
    got, want = both(spark, level, "importance_at_least")
    assert got == want
