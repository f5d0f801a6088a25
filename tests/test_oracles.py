"""Registered queries against their DuckDB SQL on the smallest tables (a third of them, to stay quick)."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from chronolith import plans
from chronolith.sources.driver_tables import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted({*sorted(plans.ORACLE_SQL)[::3], "a4_hotspots", "a7_defects", "j7_identical_symbols", "t1_stream_ingest"})


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in BASE_TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    return round(float(value), 9) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, duck, name):
    frame = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    relation = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    assert ours == sorted(repr(tuple(plain(row[i]) for i in order)) for row in relation.fetchall())


def test_entry_module_imports_and_registers(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["file_id", "path"]


def compared(spark, folder, name):
    """Sorted rows of a query over ``folder``, and those of its SQL over the tables that are there."""
    connection = duckdb.connect()
    for path in folder.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = plans.QUERIES[name](spark, str(folder))
    columns = sorted(frame.columns)
    return sorted(map(repr, map(tuple, frame.select(*columns).collect()))), sorted(map(repr, connection.sql(f"SELECT {', '.join(columns)} FROM ({plans.ORACLE_SQL[name]}) q").fetchall()))


def test_sql_follows_renames_to_their_end(spark, tmp_path):
    steps = range(2, 12)  # file 11 was file 10, that was file 9, and so on
    day = lambda k: dt.datetime(2020, 1, k)
    pq.write_table(pa.table({"c_custkey": [1], "c_name": ["A"], "c_nationkey": [1], "c_mktsegment": ["BUILDING"]}), tmp_path / "customer.parquet")
    orders = {"o_orderkey": [29 * k for k in steps], "o_custkey": [1] * 10, "o_orderdate": pa.array([day(k) for k in steps], pa.timestamp("us")), "o_orderpriority": ["5-LOW"] * 10}
    pq.write_table(pa.table(orders), tmp_path / "orders.parquet")
    pq.write_table(pa.table({"l_orderkey": [29 * k for k in steps], "l_partkey": list(steps), "l_quantity": [8.0] * 10}), tmp_path / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": list(range(1, 12)), "p_type": ["T"] * 11, "p_name": ["n"] * 11, "p_size": [1] * 11}), tmp_path / "part.parquet")
    ours, theirs = compared(spark, tmp_path, "g9_rename_lineage")
    assert ours == theirs and sum(r.split(", ")[1] == "11" for r in ours) == 11
    ours, theirs = compared(spark, tmp_path, "a3_file_activity")
    assert ours == theirs != []
