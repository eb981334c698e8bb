"""Session settings."""

import pytest

from factloom.session import TASK_BYTES, TASK_KEYS, _bytes, configure


@pytest.mark.parametrize("text, size", [("134217728b", 128 << 20), ("16m", 16 << 20), ("64KB", 64 << 10), ("5", 5), ("1g", 1 << 30)])
def test_sizes_as_spark_writes_them(text, size):
    assert _bytes(text) == size


@pytest.mark.parametrize("key", TASK_KEYS)
def test_tasks_read_bounded_pieces_and_smaller_limits_stay(spark, key):
    old = spark.conf.get(key)
    try:
        for given, wanted in (("128m", TASK_BYTES), ("1m", 1 << 20)):
            spark.conf.set(key, given)
            assert _bytes(configure(spark).conf.get(key)) == wanted
    finally:
        spark.conf.set(key, old)
