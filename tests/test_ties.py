"""Tables with rows of equal keys: the SQL's rows, also where an order leaves ties or a key has several rows."""

import duckdb
import pytest

from mitoloom import catalog
from tests.test_catalog import rows

SF = "/root/testdata/sf0.001"


def compared(spark, folder, name, sql):
    """Spark's and DuckDB's rows over lineitem made by ``sql`` from the smallest scale's, in one thread."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"COPY ({sql.format(t=f'{SF}/lineitem.parquet')}) TO '{folder}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")
    return rows(catalog.QUERIES[name](spark, str(folder)).toPandas()), rows(con.execute(catalog.ORACLES[name]).df())


def test_first_ref_of_equal_reads_is_the_first_row(spark, tmp_path):
    """A fifth of the reads and alleles are null."""
    null = "CASE WHEN l_quantity % 5 = {k} THEN NULL ELSE {c} END AS {c}"
    sql = f"SELECT * REPLACE (l_orderkey % 2 AS l_orderkey, l_partkey % 20 AS l_partkey, 1 AS l_linenumber, {null.format(k=0, c='l_returnflag')}) FROM '{{t}}'"
    got, expected = compared(spark, tmp_path, "agg04_first_ref", f"SELECT * REPLACE ({null.format(k=1, c='l_orderkey')}) FROM ({sql})")
    assert len(expected) == 200 and got == expected


@pytest.mark.parametrize("copies", [2, 3])
def test_discrete_likelihood_pools_rows_of_one_key(spark, tmp_path, copies):
    got, expected = compared(spark, tmp_path, "scl15_discrete_ll", f"SELECT l_orderkey, l_partkey + 5 * k AS l_partkey, * EXCLUDE (l_orderkey, l_partkey, k) FROM '{{t}}', (SELECT unnest(range({copies})) AS k)")
    assert len(expected) > 1000 and got == expected
