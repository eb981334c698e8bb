"""Order-based building blocks that never gather a table, or one large group, in a single task.

Three ways are used, each exact:

* ``value_positions``: equal values are first merged by a partial aggregate, then ranked in value
  buckets whose offsets come from a small table. Quantiles, average ranks and cumulative
  distributions are read from it.
* ``hash_rank``: a random order is a uniform hash, so equal slices of the hash range are balanced
  buckets and a row's rank is its bucket offset plus its rank inside the bucket.
* ``entity_windows``: window functions per entity. An entity above ``hot_rows`` rows is cut into
  chunks of consecutive rows, each with the neighbouring rows its frames need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import hash60
from ..session import cut_lineage

MIN_BUCKETS = 256
HOT_ROWS = 4_000_000
CHUNK_ROWS = 250_000


def bucket_count(df: DataFrame, wanted: int | None = None) -> int:
    """Value buckets to use: a power of two from the number of shuffle partitions on."""
    if wanted is not None:
        return wanted
    partitions, n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MIN_BUCKETS
    while n < partitions:
        n *= 2
    return n


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi join on same-named columns where NULL matches NULL; the key columns come from the left."""
    if not on:
        raise ValueError("join needs at least one key")
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = None
    for c in on:
        term = left[c].eqNullSafe(renamed[f"_r_{c}"])
        cond = term if cond is None else cond & term
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{c}" for c in on])


def _with_bucket(df: DataFrame, value: str, base: DataFrame, col: str, buckets: int, out: str = "_b") -> DataFrame:
    """Attach the number of approximate quantiles of ``base[col]`` at or below ``value`` (0 to buckets - 1).

    The quantiles come from one scan without a shuffle of rows and are one small array; each step of
    the binary search is one column, so it stays in generated code.
    """
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    probs = [i / buckets for i in range(1, buckets)]
    cuts = base.agg(F.percentile_approx(col, probs, buckets * 4).alias("cuts")).scalar()
    marked, step = df.withColumns({"_cuts": cuts, out: F.lit(0)}), buckets // 2
    while step:
        above = F.get("_cuts", F.col(out) + F.lit(step - 1)) <= F.col(value)
        marked = marked.withColumn(out, F.col(out) + F.when(above, step).otherwise(0))
        step //= 2
    return marked.drop("_cuts")


def value_positions(df: DataFrame, col: str, by=(), buckets: int | None = None) -> DataFrame:
    """Distinct non-NULL values with ``n`` (copies), ``before`` (rows below) and ``total``, per group.

    Columns: the group columns, ``value``, ``n``, ``before``, ``total``.
    """
    by, buckets = list(by), bucket_count(df, buckets)
    # count(col) is 0 for the NULL value, so a computed column is not evaluated again by a pushed-down filter
    counts = df.groupBy(*by, F.col(col).alias("value")).agg(F.count(col).alias("n")).where("n > 0")
    counts = _with_bucket(counts, "value", df, col, buckets)
    per_bucket = counts.groupBy(*by, "_b").agg(F.sum("n").alias("_m"))
    across = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by, "_b",
        F.coalesce(F.sum("_m").over(across.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_m").over(across).alias("total"))
    inside = Window.partitionBy(*by, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (join_null_safe(counts.withColumn("_upto", F.sum("n").over(inside)), offsets, [*by, "_b"])
            .select(*by, "value", "n", (F.col("_offset") + F.col("_upto") - F.col("n")).alias("before"), "total"))


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float], by=(), buckets: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of ``probs`` (name -> share)."""
    by = list(by)
    pos = value_positions(df, col, by, buckets)
    last = F.col("total") - 1
    aggs, out = [F.max(last).alias("_last")], []
    for i, (name, p) in enumerate(probs.items()):
        at = last * F.lit(float(p))
        for side, spot in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("before") <= spot) & (spot < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(here, F.col("value"))).alias(f"_{side}{i}"))
        share = F.col("_last") * F.lit(float(p)) - F.floor(F.col("_last") * F.lit(float(p)))
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        out.append((lo + (hi - lo) * share).alias(name))
    return pos.groupBy(*by).agg(*aggs).select(*by, *out)


def average_rank(df: DataFrame, col: str, out: str = "rank", by=(), buckets: int | None = None) -> DataFrame:
    """Attach the 1-based rank of ``col``; tied rows share the mean of their ranks. NULL has no rank."""
    by = list(by)
    ranks = value_positions(df, col, by, buckets).select(
        *by, F.col("value").alias(col), (F.col("before") + (F.col("n") + 1) / 2).alias(out))
    return join_null_safe(df, ranks, [*by, col], "left")


def average_rank_of_stored(df: DataFrame, col: str, out: str = "rank", buckets: int | None = None) -> DataFrame:
    """``average_rank`` over a whole table that is stored, so that it can be counted first.

    A row goes to its value bucket once and is ranked there; nothing is joined but one row per bucket. Equal values
    share a bucket: where one holds over ``HOT_ROWS`` rows and four times the mean, equal values are merged first as in ``average_rank``.
    """
    wanted, buckets = buckets, bucket_count(df, buckets)
    marked = _with_bucket(df, col, df, col, buckets).withColumn("_b", F.when(F.col(col).isNull(), -1).otherwise(F.col("_b")))
    sizes = marked.groupBy("_b").agg(F.count(F.lit(1)).alias("_m")).collect()  # one row per bucket
    if max((r["_m"] for r in sizes), default=0) > max(HOT_ROWS, 4 * sum(r["_m"] for r in sizes) // buckets):
        return average_rank(df, col, out, buckets=wanted)
    starts, before = [], 0
    for r in sorted((r for r in sizes if r["_b"] >= 0), key=lambda r: r["_b"]):
        starts.append((r["_b"], before))
        before += r["_m"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_at int, _offset bigint"))
    inside = Window.partitionBy("_b").orderBy(col)
    ties = F.count(F.lit(1)).over(inside.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = marked.withColumns({"_r": F.rank().over(inside), "_ties": ties})
    rank = F.col("_offset") + F.col("_r") + (F.col("_ties") - 1) / 2
    return ranked.join(offsets, F.col("_b") == F.col("_at"), "left").withColumn(out, rank).drop("_b", "_r", "_ties", "_at", "_offset")


def cumulative_share(df: DataFrame, col: str, by=(), buckets: int | None = None) -> DataFrame:
    """Empirical distribution: per distinct value the share of rows below and the share up to it."""
    pos = value_positions(df, col, by, buckets)
    return pos.select(*by, "value", "n", "total",
                      (F.col("before") / F.col("total")).alias("share_below"),
                      ((F.col("before") + F.col("n")) / F.col("total")).alias("share_upto"))


def hash_rank(df: DataFrame, key, seed: int = 0, by=(), out: str = "rank", total: str = "total",
              buckets: int | None = None) -> DataFrame:
    """Attach the 1-based rank in a repeatable random order and the group's row count.

    ``key`` names the column(s) that identify a row.
    """
    by, keys, buckets = list(by), [key] if isinstance(key, str) else list(key), bucket_count(df, buckets)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if len(keys) > 1 else F.col(keys[0])
    hashed = df.withColumn("_h", hash60(text, seed)).withColumn("_b", F.expr(f"_h div {(1 << 60) // buckets}"))
    per_bucket = hashed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_m"))
    across = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by, "_b",
        F.coalesce(F.sum("_m").over(across.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_m").over(across).alias(total))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", *keys)
    ranked = join_null_safe(hashed.withColumn("_r", F.row_number().over(inside)), offsets, [*by, "_b"])
    return ranked.withColumn(out, F.col("_offset") + F.col("_r")).drop("_h", "_b", "_r", "_offset")


def with_position(df: DataFrame, order, name: str = "position") -> DataFrame:
    """Attach the 0-based position in a total order over the whole table.

    The table is range-partitioned, sorted and written to the shared checkpoint folder, so that its
    partitions stay fixed; positions are partition offsets plus the place inside the partition.
    """
    fixed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    marked = fixed.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftrightunsigned("_id", 33)
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_m"))
    # one row per partition of the sorted table
    offsets = sizes.select("_part", F.coalesce(
        F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return (marked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_id", "_part", "_offset"))


def running_total(df: DataFrame, order, col: str, out: str = "running", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cumulative sum of ``col`` over the whole table in a total order, in chunks of fixed length."""
    marked = with_position(df, order, "_pos").withColumn("_chunk", F.expr(f"_pos div {chunk_rows}"))
    sums = marked.groupBy("_chunk").agg(F.sum(col).alias("_s"))
    offsets = sums.select("_chunk", F.coalesce(
        F.sum("_s").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (marked.withColumn("_in", F.sum(col).over(inside)).join(offsets, "_chunk")
            .withColumn(out, F.col("_offset") + F.col("_in")).drop("_pos", "_chunk", "_in", "_offset"))


def entity_windows(df: DataFrame, by, order, columns=None, seq: str | None = None, before: int = 0,
                   after: int = 0, hot_rows: int = HOT_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Window columns per entity, safe for an entity that holds a large share of the table.

    ``columns`` maps a name to a function of the ordered window; its frame may reach at most
    ``before`` rows back and ``after`` rows ahead. ``seq`` names a 1-based row number to attach.
    ``order`` has to be a total order inside the entity.
    """
    by, order, columns = list(by), list(order), dict(columns or {})
    if max(before, after) > chunk_rows:
        raise ValueError("frames may not be longer than a chunk")

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        out = {name: fn(w) for name, fn in columns.items()}
        if seq:
            out[seq] = F.row_number().over(w).cast("bigint")
        return part.withColumns(out)

    hot = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*by)
    if hot.isEmpty():
        return plain(df)
    hot = cut_lineage(hot)  # at most table rows / hot_rows entities, read twice below
    cold_part = plain(join_null_safe(df, hot, by, "left_anti"))
    placed = with_position(join_null_safe(df, hot, by, "left_semi"), [*by, *order], "_pos")
    starts = placed.groupBy(*by).agg(F.min("_pos").alias("_start"))
    place = join_null_safe(placed, starts, by).withColumn("_seq", F.col("_pos") - F.col("_start") + 1)
    home = F.expr(f"(_seq - 1) div {chunk_rows}")
    inside = F.col("_seq") - 1 - home * chunk_rows
    # most rows belong to their own chunk only; rows near an edge are neighbours of the next one as well
    place = place.withColumn("_home", home)
    earlier = place.where((inside < after) & (F.col("_home") > 0)).withColumn("_chunk", F.col("_home") - 1)
    later = place.where(inside >= chunk_rows - before).withColumn("_chunk", F.col("_home") + 1)
    chunks = place.withColumn("_chunk", F.col("_home"))
    for edge, needed in ((earlier, after), (later, before)):
        chunks = chunks.unionByName(edge) if needed else chunks
    w = Window.partitionBy(*by, "_chunk").orderBy("_seq")
    hot_part = chunks.withColumns({name: fn(w) for name, fn in columns.items()}).where("_chunk = _home")
    if seq:
        hot_part = hot_part.withColumn(seq, F.col("_seq"))
    return cold_part.unionByName(hot_part.drop("_pos", "_start", "_seq", "_home", "_chunk"))
