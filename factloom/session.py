"""Session settings the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "200",  # tasks that list folders; up to 10,000 folders had one each
}


# what a scan reads, and what shuffle partitions are merged to
TASK_KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
TASK_BYTES = 16 << 20  # packed columns grow by ten times and more in the sort or hash table of the task that reads them


def _bytes(text: str) -> int:
    """A size as Spark writes it, such as 134217728b or 16m."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings (UTC, adaptive plans, skew-join splitting) to a session.

    Scans are cut into splits of ``TASK_BYTES`` at most, and shuffle partitions merged to no more, so that the memory of a
    task that sorts or merges what it reads does not grow with the table; smaller limits of the session stay.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key in TASK_KEYS:
        if _bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        active = spark.sparkContext.getCheckpointDir()
        if active is not None:
            return active
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="factloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
