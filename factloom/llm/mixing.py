"""Mixing sources to target weights: blocks, multinomial draws per shard, index permutations, a join by block index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import BLANK, running_start, saved, word_count
from .words import mixed

SLOTS_PER_TASK = 500_000
MAX_SOURCES = 100_000  # bound of what is collected and broadcast; more sources raise an error
WHOLE_WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def word_targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Words wanted of each source: ``share`` of all words by weight, at most ``cap`` times the source.

    What a cap cuts off goes to the other sources by weight, until none is above its cap.
    """
    targets, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if rest * weights[i] / total > cap * sizes[i]]
        for i in above:
            targets[i] = cap * sizes[i]
        if not above:
            for i in open_:
                targets[i] = rest * weights[i] / total
            break
        rest -= sum(targets[i] for i in above)
        open_ -= set(above)
    return targets


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Each ``index`` below ``size`` under a pseudorandom permutation of range(size): Feistel rounds, walked into range."""
    index, size, key = (np.asarray(a).astype(np.uint64) for a in (index, size, key))
    bits = np.ceil(np.log2(np.maximum(size, 2).astype(float))).astype(np.uint64)
    half = np.maximum((bits + np.uint64(1)) >> np.uint64(1), np.uint64(1))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            left, right = right, left ^ (mixed(right + k + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


class Plan:
    """Per-source numbers of a mix: sizes, targets, blocks, slots, and the words of the last slot."""

    def __init__(self, names: list, sizes: list[int], weights: list[float], share: float, cap: float, block: int):
        self.names, self.sizes, self.block = names, np.array(sizes, dtype=np.int64), block
        self.targets = word_targets(sizes, weights, share, cap)
        self.blocks = -(-self.sizes // block)
        wanted = np.array([round(t) for t in self.targets], dtype=np.int64)
        epochs = wanted // np.maximum(self.sizes, 1)
        rest = wanted - epochs * self.sizes
        self.slots = epochs * self.blocks + -(-rest // block)
        self.last_words = np.where(rest > 0, rest - (-(-rest // block) - 1) * block, block)


def _draws(plan: Plan, shards: int, per_shard: int, seed: int):
    total = int(plan.slots.sum())
    weights = plan.slots / max(total, 1)

    def run(batches):
        for batch in batches:
            out = []
            for shard in batch["shard"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
                counts = rng.multinomial(min(per_shard, total - shard * per_shard), weights)
                used = np.flatnonzero(counts)
                out.append(pd.DataFrame({"shard": shard, "source_at": used.astype(np.int32), "drawn": counts[used]}))
            yield pd.concat(out) if out else pd.DataFrame({"shard": [], "source_at": [], "drawn": []})
    return run


def _slots(plan: Plan, drawn: np.ndarray, seed: int):
    """Slots of (shard, source, drawn, start). A slot beyond its source's number goes to a source drawn too seldom."""
    over, under = np.maximum(drawn - plan.slots, 0), np.maximum(plan.slots - drawn, 0)
    over_start, under_end = np.cumsum(over) - over, np.cumsum(under)
    slots, blocks, last, block = plan.slots, plan.blocks, plan.last_words, plan.block

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                at = np.full(row.drawn, row.source_at, dtype=np.int64)
                number = row.start + np.arange(row.drawn, dtype=np.int64)
                beyond = number >= slots[row.source_at]
                if beyond.any():
                    rank = over_start[row.source_at] + number[beyond] - slots[row.source_at]
                    to = np.searchsorted(under_end, rank, side="right")
                    at[beyond] = to
                    number[beyond] = drawn[to] + rank - (under_end[to] - under[to])
                epoch, index = np.divmod(number, blocks[at])
                key = mixed(np.uint64(seed) + (at * 1_000_003 + epoch).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pd.DataFrame({"shard": row.shard, "source_at": at.astype(np.int32), "epoch": epoch,
                                    "block": permuted(index, blocks[at], key),
                                    "words": np.where(number == slots[at] - 1, last[at], block)})
    return run


def source_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, block_words: int = 128,
               slots_per_shard: int = 8192, seed: int = 17, id_col: str = "doc_id", text: str = "text",
               source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Mix the sources of ``docs`` by weight: (rows, spans).

    rows: one per row of ``docs``: row_source, row_bucket, row_number (its key), id_col, text_key, size (words),
    source_size, target. spans: one per piece of a document in a slot of the mix: the row's key, shard, epoch, block,
    from_word and n_words. ``shard`` is an output shard of ``slots_per_shard`` blocks.

    The words of a source, its documents in order of a hash bucket and id, form one stream that is cut into blocks of
    ``block_words`` (the last may be shorter). Every shard draws from a multinomial how many of its slots each source
    fills; a source's slots are numbered through all shards, and number i is block i of the source under a pseudorandom
    permutation, a new one for each pass. So a block comes once per pass, and no document more than ceil(target / size)
    times. Slots that a source drew beyond its target go to sources that drew too few, in order, so each source gives
    its target but for rounding and one short block; the last slot is cut to fit.

    Weights repeat over the sources in code point order, null last. A null or empty text has size 0 and is in no slot.
    Rows with equal id and text are interchangeable; a null id is allowed. An empty table gives empty results. Only
    numbers per source (MAX_SOURCES at most, else an error) are collected.
    """
    spark = docs.sparkSession
    buckets = max(32, docs.count() // 50_000)
    sized = saved(docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"),
                              F.col(source).alias("row_source"), word_count(F.col(text)).alias("size"),
                              F.pmod(F.xxhash64(F.col(id_col), F.coalesce(F.col(text), F.lit(""))), F.lit(buckets)).alias("row_bucket")))
    totals = sized.groupBy("row_source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.row_source is None, r.row_source or ""))
    names = [r.row_source for r in totals]
    plan = Plan(names, [r.n for r in totals], [weights[i % len(weights)] for i in range(len(names))], share, cap,
                block_words)
    sources = spark.createDataFrame(
        [(n, i, int(s), float(t)) for i, (n, s, t) in enumerate(zip(names, plan.sizes, plan.targets))],
        "name string, source_at int, source_size long, target double")
    rows = running_start(sized, ["row_source"], "row_bucket", [F.col(id_col), F.col("text_key")], "size")
    rows = (rows.withColumnRenamed("_number", "row_number")
            .join(F.broadcast(sources), F.col("row_source").eqNullSafe(F.col("name"))).drop("name"))
    rows = saved(rows)

    total = int(plan.slots.sum())
    shards = -(-total // slots_per_shard)
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    drawn = saved(spark.range(shards, numPartitions=parts).withColumnRenamed("id", "shard").mapInPandas(
        _draws(plan, shards, slots_per_shard, seed), "shard long, source_at int, drawn long"))
    sums = np.zeros(len(names), dtype=np.int64)
    for r in drawn.groupBy("source_at").agg(F.sum("drawn").alias("n")).collect():
        sums[r.source_at] = r.n
    starts = running_start(drawn.withColumn("_part", F.expr("shard div 4096")), ["source_at"], "_part", ["shard"], "drawn")
    # each row becomes up to a shard of slots, so the rows are few and the slots many: a given number of tasks makes them
    dealt = starts.select("shard", "source_at", "drawn", "start").repartition(max(1, -(-total // SLOTS_PER_TASK)), "shard")
    slots = dealt.mapInPandas(
        _slots(plan, sums, seed), "shard long, source_at int, epoch long, block long, words long")

    b = F.lit(block_words)
    end = F.col("start") + F.col("size")
    pieces = (rows.where("size > 0")
              .select("row_source", "row_bucket", "row_number", "source_at", "start", end.alias("end"),
                      F.explode(F.sequence(F.expr(f"start div {block_words}"),
                                           F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
              .withColumn("at", F.greatest(F.col("start"), F.col("block") * b))
              .withColumn("stop", F.least(F.col("end"), (F.col("block") + 1) * b)))
    # Spark guesses the size of slots from the few rows that make them and would send them all to the driver
    spans = (pieces.join(slots.hint("merge"), ["source_at", "block"])
             .withColumn("n_words", F.least(F.col("stop"), F.col("block") * b + F.col("words")) - F.col("at"))
             .where("n_words > 0")
             .select("row_source", "row_bucket", "row_number", "shard", "epoch", "block",
                     (F.col("at") - F.col("start")).alias("from_word"), "n_words"))
    return rows, spans


def taken_words(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with the words that the mix takes of each, repeats counted, as ``taken``."""
    key = ["row_source", "row_bucket", "row_number"]
    taken = spans.groupBy(*key).agg(F.sum("n_words").alias("taken")).toDF("_s", "_b", "_n", "taken")
    same = (F.col("row_source").eqNullSafe(F.col("_s")) & (F.col("row_bucket") == F.col("_b"))
            & (F.col("row_number") == F.col("_n")))
    return rows.join(taken, same, "left").drop("_s", "_b", "_n").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, rows: DataFrame, spans: DataFrame, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """The mix as documents: one row per pass and unbroken run of words that the mix takes of a document.

    Columns are those of ``docs``. A document taken whole keeps its text as it is; a part of one runs from its first
    to its last word. ``n_chars``, where there is such a column, is counted anew.
    """
    key = ["row_source", "row_bucket", "row_number", "epoch"]
    inner = Window.partitionBy(*key).orderBy("from_word")
    new = F.coalesce(F.lag(F.col("from_word") + F.col("n_words")).over(inner) != F.col("from_word"), F.lit(True))
    runs = (spans.withColumn("_run", F.sum(new.cast("int")).over(inner)).groupBy(*key, "_run")
            .agg(F.min("from_word").alias("from_word"), F.sum("n_words").alias("n_words"))
            .groupBy(*key[:3]).agg(F.sort_array(F.collect_list(F.struct("epoch", "from_word", "n_words"))).alias("_runs"))
            .toDF("_s", "_b", "_n", "_runs"))
    same = (F.col("row_source").eqNullSafe(F.col("_s")) & (F.col("row_bucket") == F.col("_b"))
            & (F.col("row_number") == F.col("_n")))
    runs = rows.join(runs, same).select(F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), "size", "_runs")
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # the table's own names cannot clash with those used here
    texts, id_name, text = docs.toDF(*own.values()), own[id_col], own[text]
    texts = texts.withColumn("_text_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    texts = texts.dropDuplicates([id_name, "_text_key"])
    words = F.regexp_extract_all(F.col(text), F.lit(WHOLE_WORD), F.lit(0))
    whole = F.transform("_runs", lambda r: F.col(text))
    parts = F.transform(F.array(words), lambda w: F.transform("_runs", lambda r: F.when(
        r["n_words"] == F.col("size"), F.col(text)).otherwise(F.regexp_replace(F.array_join(F.slice(
            w, (r["from_word"] + 1).cast("int"), r["n_words"].cast("int")), ""), f"^{BLANK}", ""))))[0]
    all_whole = F.forall("_runs", lambda r: r["n_words"] == F.col("size"))
    joined = (texts.join(runs, F.col(id_name).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")))
              .withColumn("_part", F.explode(F.when(all_whole, whole).otherwise(parts))))
    out = {c: F.col("_part" if n == text else n) for c, n in own.items()}
    if "n_chars" in out:
        out["n_chars"] = F.char_length("_part").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[v.alias(c) for c, v in out.items()])
