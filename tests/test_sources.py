"""Sources: files without rows, names with odd characters."""

import re

from boxlake.sources import raw


def test_inventory_counts_files_without_rows(spark, tmp_path):
    """A first task without rows writes a file all the same."""
    path = str(tmp_path / "a b [x]{y}" / "games")
    spark.range(7).coalesce(1).write.parquet(path)
    spark.range(0).coalesce(1).write.mode("append").parquet(path)
    written = spark.read.schema("id long").parquet(re.sub(r"([\[\]{}])", r"\\\1", path))
    got = raw.raw_inventory(written).collect()
    assert [(r.endpoint, r.files, r.rows) for r in got] == [("games", len(written.inputFiles()), 7)] and got[0].bytes > 0


def test_inventory_query_with_an_empty_first_split(spark):
    from conftest import SMALL

    from boxlake.plans import entries

    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert entries.QUERIES["src3_raw_inventory"](spark, SMALL).first().all_files
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
