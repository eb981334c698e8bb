"""Exact duplicates by content sort: range partitions by sampled splitters, external sort, neighbours compared in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import lower_ascii, saved

MAX_HOT = 10_000  # texts that can have rows / MAX_HOT rows or more: the bound of what is broadcast
START = 40        # characters of the normalised text in a splitter; the full text decides after that


def _ranged(docs: DataFrame, id_col: str, text: str, hot_rows: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """(rows, hot): sorted rows with their place among equal neighbours, and the hot rows before the sort."""
    hot_rows = max(hot_rows, docs.count() // MAX_HOT)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.xxhash64(F.lower(body)).alias("_digest")
    hot = (docs.select(digest).groupBy("_digest").count().where(F.col("count") >= hot_rows)
           .select(F.col("_digest").alias("_hot")))
    rows = (docs.withColumn("_digest", digest).join(F.broadcast(hot), F.col("_digest") == F.col("_hot"), "left")
            .withColumn("_salt", F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64(id_col), F.lit(salts))).otherwise(0))
            .withColumn("_start", lower_ascii(F.left(body, F.lit(START)))))
    largest_first = Window.partitionBy("_start", "_digest", "_salt", "_text").orderBy(F.col(id_col).desc_nulls_last())
    neighbours = largest_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = (rows.repartitionByRange("_start", "_digest", "_salt").withColumn("_text", lower_ascii(F.col(text)))
               .withColumn("_place", F.row_number().over(largest_first))
               .withColumn("_keep", F.first(id_col).over(neighbours))
               .withColumn("_size", F.count(F.lit(1)).over(neighbours)))
    return ordered, rows.where(F.col("_hot").isNotNull())


def content_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot_rows: int = 500,
                   salts: int = 64) -> DataFrame:
    """Groups of equal texts (A to Z in lower case, null as empty): the row with the largest id stays.

    Columns: id_col, keep_id, group_size, kept, text_sha256; one row per row of ``docs``.

    ``repartitionByRange`` samples splitters over the first START characters of the normalised text, a digest
    of the whole and a salt, and deals the rows by them; each partition is sorted externally by these and the text,
    so equal texts lie next to each other, and the window compares neighbours in full. The salt is 0 except for
    texts with many rows (``hot_rows``, at least 1 / MAX_HOT of all rows), found by counting digests: their rows go to
    ``salts`` neighbouring ranges, and one row for each of these is put together again. So a group of any size is
    spread over tasks, only short keys are sampled, and only totals of at most MAX_HOT groups are broadcast.

    Empty and null texts form one group. Null ids are smaller than all others; a group of null ids keeps a null
    id. If several rows share the largest id, one of them is kept. An empty table gives no rows. Other columns are
    ignored.
    """
    ordered, _ = _ranged(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_body")), "_id", "_body", hot_rows, salts)
    ranged = saved(ordered.select(
        "_id", F.col("_hot").isNotNull().alias("_hot"), "_salt", F.sha2("_text", 256).alias("text_sha256"), "_place",
        "_keep", "_size"))
    parts = ranged.where(F.col("_hot") & (F.col("_place") == 1))
    whole = parts.groupBy("text_sha256").agg(
        F.max(F.struct("_keep", F.col("_salt").alias("_of"))).alias("_best"), F.sum("_size").alias("_all"))
    joined = ranged.join(F.broadcast(whole), "text_sha256", "left")
    first = F.col("_place") == 1
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_hot"), F.col("_best._keep")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_all", "_size").cast("long").alias("group_size"),
        F.when(F.col("_hot"), first & (F.col("_salt") == F.col("_best._of"))).otherwise(first).alias("kept"),
        "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot_rows: int = 500,
                       salts: int = 64) -> DataFrame:
    """The rows that ``content_groups`` keeps, with all columns of ``docs``: one row of each group of equal texts."""
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no clash with helper columns
    key, body = (f"c{docs.columns.index(c)}" for c in (id_col, text))
    ordered, hot = _ranged(named, key, body, hot_rows, salts)
    best = (hot.groupBy(F.sha2(lower_ascii(F.col(body)), 256).alias("_sha"))
            .agg(F.max(F.struct(F.col(key), F.col("_salt").alias("_of"))).alias("_best")).select("_sha", "_best._of"))
    firsts = ordered.where(F.col("_place") == 1)
    sha = F.when(F.col("_hot").isNotNull(), F.sha2("_text", 256))
    kept = (firsts.withColumn("_own", sha).join(F.broadcast(best), F.col("_own") == F.col("_sha"), "left")
            .where(F.col("_hot").isNull() | (F.col("_salt") == F.col("_of"))))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
