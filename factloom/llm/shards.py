"""Shards under a byte limit by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import hash60
from .common import running_start, saved

BITS = 60
LEAF_BITS = 5  # leaves are this much finer than the mean shard


STEP = 6  # depths summed from one table of nodes


def _splits(items: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Shards at depths ``low`` to ``high`` of items (_hash, _bytes, _rows), one per prefix of ``high`` bits: item -> shard,
    and items that are too large themselves.

    A node of the directory is a shard if it fits its limit and its parent does not; above ``low`` nothing fits. Nodes are
    summed upwards, ``STEP`` depths from the nodes below them, so an item is met once per depth of the lowest step only.
    """
    sums = [F.sum("_bytes").alias("_bytes"), F.sum("_rows").alias("_rows")]
    tier = items.select(F.expr(f"shiftright(_hash, {BITS - high})").alias("prefix"), "_bytes", "_rows")
    nodes, top = tier.withColumn("depth", F.lit(high)), high
    while top > low:
        bottom = max(low, top - STEP)
        up = tier.select(F.explode(F.sequence(F.lit(bottom), F.lit(top - 1))).alias("depth"), "prefix", "_bytes", "_rows")
        up = saved(up.groupBy("depth", F.expr(f"shiftright(prefix, {top} - depth)").alias("prefix")).agg(*sums))
        nodes, tier, top = nodes.unionByName(up), up.where(F.col("depth") == bottom).drop("depth"), bottom
    split = nodes.where(F.col("_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_parent"))
    fits = nodes.where(F.col("_bytes") <= limit).withColumn("_parent", F.expr("shiftright(prefix, 1)"))
    found = (fits.where(F.col("depth") > low).join(split, ["depth", "_parent"], "left_semi")
             .unionByName(fits.where(F.col("depth") == low)))
    found = saved(found.select("depth", "prefix", F.col("_bytes").alias("shard_bytes"), F.col("_rows").alias("shard_rows")))
    depths = [r.depth for r in found.select("depth").distinct().collect()] or [low]  # at most one per bit
    chosen = (items.where(F.col("_bytes") <= limit).select("_hash", F.explode(F.array(*map(F.lit, sorted(depths)))).alias("depth"))
              .withColumn("prefix", F.expr(f"shiftright(_hash, {BITS} - depth)")).join(found, ["depth", "prefix"]))
    return chosen, items.where(F.col("_bytes") > limit)


def extendible_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, bytes, shard, depth, page, shard_bytes, shard_rows.

    A shard is a prefix of ``depth`` bits of the id's hash: shard = 2^depth + prefix. Only shards over
    ``limit_bytes`` (UTF-8 bytes of the text) are split on one more bit. The directory comes from byte sums: rows are
    summed in leaves 5 bits finer than the mean shard needs, leaves are rolled up depth by depth, and the shallowest
    prefix that fits is the shard; leaves that still do not fit go through the deeper bits by themselves. The result
    does not depend on where the leaves are cut.

    Rows that no bit separates (equal ids) and that exceed the limit are numbered into pages that fit; a single
    document above the limit has its page for itself. A null id is hashed by its text; a null text has 0 bytes. Repeated
    rows are stored each. An empty table gives no rows. Texts are not shuffled.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("_bytes"),
        hash60(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(F.col(text), F.lit("")))))
               ).alias("_full"))
    rows = saved(rows)
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    leaf_bits = min(BITS, LEAF_BITS + max(0, math.ceil(math.log2(max(1, total / limit_bytes)))))
    leaf = F.expr(f"shiftleft(shiftright(_full, {BITS - leaf_bits}), {BITS - leaf_bits})")
    rows = rows.withColumn("_leaf", leaf)
    leaves = rows.groupBy(F.col("_leaf").alias("_hash")).agg(F.sum("_bytes").alias("_bytes"),
                                                             F.count(F.lit(1)).alias("_rows"))
    shallow, large = _splits(saved(leaves), 0, leaf_bits, limit_bytes)
    shallow, large = saved(shallow), saved(large.select(F.col("_hash").alias("_leaf")))
    easy = rows.join(shallow.withColumnRenamed("_hash", "_leaf"), "_leaf").withColumn("page", F.lit(0).cast("long"))
    out = [easy]
    if leaf_bits < BITS and not large.isEmpty():
        hard = saved(rows.join(large, "_leaf"))
        keys = hard.groupBy(F.col("_full").alias("_hash")).agg(F.sum("_bytes").alias("_bytes"),
                                                               F.count(F.lit(1)).alias("_rows"))
        deep, equal = _splits(saved(keys), leaf_bits + 1, BITS, limit_bytes)
        out.append(hard.join(deep.withColumnRenamed("_hash", "_full"), "_full").withColumn("page", F.lit(0).cast("long")))
        out.append(_pages(hard.join(equal.select(F.col("_hash").alias("_full")), "_full", "left_semi"), limit_bytes))
    names = ["_id", "_bytes", "depth", "prefix", "page", "shard_bytes", "shard_rows"]
    result = out[0].select(*names)
    for part in out[1:]:
        result = result.unionByName(part.select(*names))
    return result.select(F.col("_id").alias(id_col), F.col("_bytes").alias("bytes"),
                         (F.expr("shiftleft(1L, depth)") + F.col("prefix")).alias("shard"), "depth", "page",
                         "shard_bytes", "shard_rows")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hash, numbered and cut into pages of as many rows as surely fit."""
    rows = saved(rows).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)).withColumn("_one", F.lit(1))
    numbered = running_start(rows, ["_full"], "_part", ["_bytes"], "_one", "_at")
    largest = rows.groupBy("_full").agg(F.greatest(F.lit(1), F.expr(f"{limit} div max(greatest(_bytes, 1))")).alias("_fit"))
    numbered = saved(numbered.join(largest, "_full").withColumn("page", F.expr("_at div _fit"))
                     .withColumn("depth", F.lit(BITS)).withColumn("prefix", F.col("_full")))
    pages = numbered.groupBy("_full", "page").agg(F.sum("_bytes").alias("shard_bytes"),
                                                  F.count(F.lit(1)).alias("shard_rows"))
    return numbered.join(pages, ["_full", "page"])


def write_shards(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Store ``docs`` in one folder per shard and page below ``path``; ids must be unique and not null here."""
    at = extendible_shards(docs, limit_bytes, id_col, text).select(id_col, "shard", "page")
    (docs.join(at, id_col).repartition("shard", "page").sortWithinPartitions("shard", "page", id_col)
     .write.partitionBy("shard", "page").parquet(path))
