import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
if not os.path.isdir(TABLES):
    pytest.skip("the tables aren't here", allow_module_level=True)


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for path in glob.glob(f"{TABLES}/*.parquet"):
        spark.read.parquet(path).limit(0).write.parquet(str(d / os.path.basename(path)))
    return str(d)


@pytest.fixture(scope="module")
def null_tables(spark, tmp_path_factory):
    """Every table as twenty rows of which ids are kept and all other columns are NULL, the rows repeated."""
    from pyspark.sql import functions as F

    d = tmp_path_factory.mktemp("nulls")
    for path in glob.glob(f"{TABLES}/*.parquet"):
        df = spark.read.parquet(path).limit(10)
        rows = df.select(*[F.col(c) if c.endswith("_id") or c in ("source", "currency") else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        rows.union(rows).coalesce(1).write.parquet(str(d / os.path.basename(path)))
    return str(d)


CORE = [n for n in entry.queries() if not n.startswith("p") or n.startswith("p7_")]


@pytest.mark.parametrize("name", CORE)
def test_empty_tables(spark, empty_tables, name):
    assert entry.queries()[name](spark, empty_tables).count() >= 0


@pytest.mark.parametrize("name", CORE)
def test_null_columns_and_repeated_rows(spark, null_tables, name):
    assert entry.queries()[name](spark, null_tables).count() >= 0


def test_oracles_parse():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")
        assert name in entry.queries()
