import pytest
from check import compare, connect

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    rows, faults = compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], SF)
    assert faults == []
    assert rows > 0


def test_csv_round_trip_compares_whole_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    from listmill.workloads import archive_queries

    read = archive_queries.tables.read_export
    longer = spark.read.parquet(f"{SF}/documents.parquet").where("char_length(text) > 100").count()
    monkeypatch.setattr(archive_queries.tables, "read_export", lambda *args: (frame := read(*args)).withColumns(
        {c: F.substring(c, 1, 100) for c, kind in frame.dtypes if kind == "string"}))
    broken = archive_queries.csv_round_trip(spark, SF).where("subject IS NULL").count()
    assert broken >= longer > 0


def test_every_query_of_the_archives_has_sql():
    from listmill.workloads import registry

    assert registry.QUERIES.keys() == registry.ORACLES.keys()


def test_entry_is_lazy_and_has_the_commit_columns(spark):
    from listmill.schemas import COMMITS, names

    assert contract.entry(spark).columns == names(COMMITS)
