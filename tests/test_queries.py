"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

QUERIES, ORACLES = entry.QUERIES, entry.ORACLES


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    assert difference(spark, con, sf, name, QUERIES, ORACLES) is None


@pytest.mark.parametrize("name", ["stream_dedup_ingest", "stream_incremental_index"])
def test_stream_reads_a_folder_of_files(spark, sf, tmp_path, name):
    """Larger tables are folders: their files have other names than the table."""
    con = duck(sf)
    spark.read.parquet(f"{sf}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert difference(spark, con, str(tmp_path), name, QUERIES, ORACLES) is None
