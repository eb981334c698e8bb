"""Incremental versions: folder ingest, monthly counts, keep-first, codebook updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..stats.vectors import nearest_code, update_codebook


def read_arrivals(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """New files below ``path`` as a stream."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def ingest_stream(arrivals: DataFrame, out: str, checkpoint: str, partition_by=()) -> None:
    """Append everything that has arrived to a Parquet dataset and stop; finished files are remembered."""
    writer = (arrivals.writeStream.format("parquet").option("path", out)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append"))
    (writer.partitionBy(*partition_by) if partition_by else writer).start().awaitTermination()


def counts_by_month(df: DataFrame, date: str, by=()) -> DataFrame:
    """Reports per calendar month (year * 100 + month)."""
    return df.groupBy((F.year(date) * 100 + F.month(date)).alias("month"), *by).agg(F.count(F.lit(1)).alias("n"))


def counts_by_day_stream(arrivals: DataFrame, ts: str, by=(), late: str = "2 days") -> DataFrame:
    """Counts per day of a stream; a day is final once the watermark has passed it."""
    timed = arrivals.withColumn(ts, F.col(ts).cast("timestamp"))
    counts = (timed.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), *by)
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.select(F.to_date("w.start").alias("day"), *by, "n")


def counts_by_day_complete(closed: DataFrame, arrived: DataFrame, ts: str, by=()) -> DataFrame:
    """Counts of all days once the input has ended: ``closed`` days of the stream, and the open ones counted anew."""
    open_ = arrived.withColumn("day", F.to_date(ts)).join(closed.select("day").distinct(), "day", "left_anti")
    rest = open_.groupBy("day", *by).agg(F.count(F.lit(1)).alias("n"))
    return closed.select("day", *by, "n").unionByName(rest)


def latest_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest version of a codebook that ``codebook_stream`` has written."""
    versions = spark.read.parquet(state_path)
    return versions.where(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


def dedupe_stream(arrivals: DataFrame, key, ts: str, late: str = "1 hour") -> DataFrame:
    """First arrival per key; state is kept as long as the watermark allows duplicates."""
    timed = arrivals.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def codebook_stream(arrivals: DataFrame, state_path: str, checkpoint: str, vec: str, decay: float = 0.99) -> None:
    """Update a codebook per micro-batch of vectors.

    The state is one Parquet folder per version below ``state_path``; batch n reads version n and
    writes version n + 1, so a repeated batch gives the same result.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{state_path}/version={epoch}")
        near = nearest_code(batch, state, vec)
        update_codebook(state, near, decay, "code", vec).write.mode("overwrite").parquet(f"{state_path}/version={epoch + 1}")

    (arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
