"""Rows whose work is far larger than their bytes are dealt to all tasks, however few splits their file has."""

import pytest

from shelfspark.plans import registry


@pytest.mark.parametrize("name", ["quarantine_records", "null_invalid_fields"])
def test_a_small_file_is_worked_on_by_all_tasks(spark, name):
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
