"""Importance queries against their SQL on odd panels."""

import duckdb
import pytest

from marketloom.operators import screening
from marketloom.plans.catalogue import SQL

from .test_constants import DATA, both


@pytest.fixture(scope="module")
def undated(tmp_path_factory):
    """A folder in which every second line item of an order has no ship date, and a connection to it."""
    d, c = str(tmp_path_factory.mktemp("undated")), duckdb.connect()
    c.execute(f"copy (select * replace (case when l_linenumber <> 2 then l_shipdate end as l_shipdate) from '{DATA}/lineitem.parquet') to '{d}/lineitem.parquet'")
    c.execute(f"copy (select * from '{DATA}/orders.parquet') to '{d}/orders.parquet'")
    for t in ("lineitem", "orders"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return d, c


def test_the_undated_day_is_last_where_importances_are_counted(spark, undated):
    got, want = both(spark, undated, "importance_counts")
    assert got == want


def test_the_undated_day_is_last_where_importances_are_cut(spark, undated):
    got, want = both(spark, undated, "importance_cut")
    assert got == want


@pytest.mark.parametrize("shown, rows", [("0.0", 0), ("CASE feature WHEN 'P1' THEN 3.0 WHEN 'M1' THEN 1.0 ELSE 0.0 END", 2)])
def test_a_total_of_zero_is_cut_as_in_sql(spark, undated, shown, rows):
    made = f"SELECT feature, CAST({shown} AS DOUBLE) AS importance FROM "
    names = "(SELECT explode(array('M1', 'P1', 'V1')) AS feature)"
    got = screening.importance_cut(spark.sql(made + names)).select("feature", "importance", "rank", "cumulative").collect()
    want = undated[1].execute(f"WITH i AS ({made} (SELECT unnest(['M1', 'P1', 'V1']) AS feature)), c AS ({SQL['importance_cut'].split('c AS (')[-1]}").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == rows
