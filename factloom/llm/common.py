"""What the operators share: the word pattern, saved intermediate tables, running sums without a single task."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import checkpoint_root, configure

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_SHIPPED: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Session settings, batches that long texts fit in, and this package's code for the Python workers.

    The code goes to the executors as a Spark file, so it need not be installed there.
    """
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='factloom-code-')}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
    return spark


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def fresh_folder(spark: SparkSession) -> str:
    """Path of a folder that does not exist yet, in the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def saved(df: DataFrame, few_files: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it again: computed once, survives lost executors.

    ``few_files`` is for narrow tables that loops write again and again: at most four tasks per core write, each the
    partitions of several tasks in turn; the number grows with the cluster.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df = df.coalesce(4 * spark.sparkContext.defaultParallelism) if few_files else df
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case, all else unchanged; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, for use in nested lambdas."""
    return F.transform(F.array(value), body)[0]


def running_start(df: DataFrame, by: list[str], bucket: str, order: list, value: str, name: str = "start") -> DataFrame:
    """Sum of ``value`` over the rows before each row of its group, as column ``name``.

    Rows are in order of ``bucket``, then ``order``. Each (group, bucket) is summed by itself, and buckets are put
    together from their totals, so a group may hold any share of the rows. Null keys form a group. The column
    ``_number`` is the place in the bucket; (by, bucket, _number) identifies a row.
    """
    inner = Window.partitionBy(*by, bucket).orderBy(*order)
    before = inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = (df.withColumn("_number", F.row_number().over(inner))
            .withColumn("_inner", F.coalesce(F.sum(value).over(before), F.lit(0))))
    totals = df.groupBy(*by, bucket).agg(F.sum(value).alias("_total"))
    outer = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, bucket])],
                           F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_bucket_start"))
    on = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, bucket])]
    return (rows.join(totals, on).withColumn(name, F.col("_bucket_start") + F.col("_inner"))
            .drop("_inner", "_bucket_start", *[f"_k{i}" for i in range(len(by) + 1)]))
