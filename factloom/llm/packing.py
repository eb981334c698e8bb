"""Best-fit packing of pieces into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import saved

Bins = list  # of lists of item numbers


def best_fit(lengths, items, bins: Bins, capacity: int) -> Bins:
    """Put ``items`` in their order into the fullest bin that takes them, or a new one."""
    free = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(free, (lengths[i], -1))
        if at < len(free):
            room, k = free.pop(at)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        insort(free, (room - lengths[i], k))
    return bins


def score(lengths, bins: Bins, capacity: int) -> tuple[int, float]:
    """Smaller is better: number of bins, then how unevenly they are filled."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossed(lengths, taker: Bins, giver: Bins, capacity: int, rng: np.random.Generator, filled: float = 0.995) -> Bins:
    """Inject well-filled bins of ``giver`` whole, remove bins with duplicates, best-fit what was displaced.

    Where no bin is filled that well, the fullest quarter counts.
    """
    good = [b for b in giver if sum(lengths[i] for i in b) >= filled * capacity]
    if not good:
        good = sorted(giver, key=lambda b: -sum(lengths[i] for i in b))[:max(1, len(giver) // 4)]
    injected = [list(good[k]) for k in rng.choice(len(good), size=max(1, len(good) // 2), replace=False)]
    inside = {i for b in injected for i in b}
    kept = [list(b) for b in taker if inside.isdisjoint(b)]
    displaced = [i for b in taker if not inside.isdisjoint(b) for i in b if i not in inside]
    return best_fit(lengths, sorted(displaced, key=lambda i: -lengths[i]), kept + injected, capacity)


def mutated(lengths, bins: Bins, capacity: int, rng: np.random.Generator, share: float = 0.1) -> Bins:
    """Empty the worst bins and a few at random, and best-fit their items again."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    n = max(1, int(share * len(bins)))
    out = {*order[:n], *(int(k) for k in rng.integers(0, len(bins), n))}
    loose = sorted((i for k in out for i in bins[k]), key=lambda i: -lengths[i] * rng.uniform(0.9, 1.1))
    return best_fit(lengths, loose, [list(b) for k, b in enumerate(bins) if k not in out], capacity)


def evolve(lengths, population: list[Bins], capacity: int, rng: np.random.Generator, size: int = 4,
           generations: int = 8) -> list[Bins]:
    """``size`` best packings after some generations, best first; ends early at the smallest possible number of bins.

    The population is filled up with best-fit packings of random orders, from which crossover has to find the good bins.
    """
    least = -(-sum(lengths) // capacity)
    ranked = sorted(((score(lengths, b, capacity), n, b) for n, b in enumerate(population)), key=lambda x: x[:2])
    made = len(ranked)
    while len(ranked) < size and (not ranked or ranked[0][0][0] > least):
        bins = best_fit(lengths, rng.permutation(len(lengths)).tolist(), [], capacity)
        insort(ranked, (score(lengths, bins, capacity), made, bins), key=lambda x: x[:2])
        made += 1
    for _ in range(generations):
        parents = ranked[:size]
        for _ in range(size):
            if ranked[0][0][0] <= least:
                return [bins for _, _, bins in ranked[:size]]
            a, b = rng.choice(len(parents), 2, replace=False) if len(parents) > 1 else (0, 0)
            child = crossed(lengths, parents[a][2], parents[b][2], capacity, rng)
            if rng.uniform() < 0.5:
                child = mutated(lengths, child, capacity, rng)
            insort(ranked, (score(lengths, child, capacity), made, child), key=lambda x: x[:2])
            made += 1
        ranked = ranked[:size]
    return [bins for _, _, bins in ranked[:size]]


def _numbers(bins: Bins, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _bins(numbers: np.ndarray) -> Bins:
    out: Bins = [[] for _ in range(int(numbers.max()) + 1)]
    for i, k in enumerate(numbers):
        out[k].append(i)
    return [b for b in out if b]


def _island(capacity: int, seed: int, last: bool):
    """One island of one block: items sorted by their number, own packings, and the elite that came in."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[~frame["_elite"]].sort_values("_item", ignore_index=True)
        block, island = int(own["_block"].iloc[0]), int(own["_island"].iloc[0])
        rng = np.random.default_rng([seed, block & 0x7FFFFFFF, island, int(last)])
        lengths = own["length"].tolist()
        population = []
        if own["_packings"].iloc[0] is not None and len(own["_packings"].iloc[0]):
            population = [_bins(k) for k in np.stack(own["_packings"].to_numpy()).T]
        came = frame[frame["_elite"]].sort_values("_item")
        if len(came):
            population.append(_bins(np.stack(came["_packings"].to_numpy())[:, 0]))
        best = evolve(lengths, population, capacity, rng)
        packings = np.stack([_numbers(b, len(own)) for b in best], axis=1)
        result = own[["_item", "length", "_block", "_island"]].copy()
        result["_packings"] = list(packings[:, :1] if last else packings)
        fills = np.bincount(packings[:, 0], weights=own["length"])
        result["_fill"] = fills[packings[:, 0]].astype(np.int64)
        result["_cost"] = float(len(fills)) - float((fills ** 2).sum()) / (float(capacity) ** 2 * (len(fills) + 1))
        return result
    return run


ISLAND = "_item long, length long, _block long, _island int, _packings array<int>, _fill long, _cost double"


def _packed(items: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """Items (_item, length) with _block, _bin and _fill of the best island of their block."""
    pools = (items.withColumn("_block", F.pmod(F.xxhash64("_item", F.lit(seed)), F.lit(blocks)))
             .withColumn("_island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
             .withColumn("_packings", F.lit(None).cast("array<int>")).withColumn("_elite", F.lit(False)))
    done = []
    for epoch in range(epochs):
        pools = saved(pools.groupBy("_block", "_island").applyInPandas(_island(capacity, seed + epoch, epoch == epochs - 1), ISLAND))
        # a cost lies less than one below its number of bins; blocks at the least possible number need no more
        short = (pools.groupBy("_block").agg(F.min("_cost").alias("_best"), F.sum("length").alias("_sum"))
                 .where(F.ceil("_best") > F.ceil(F.col("_sum") / (islands * capacity))).select("_block"))
        if epoch == epochs - 1 or (short := saved(short)).isEmpty():
            done.append(pools)
            break
        done.append(pools.join(short, "_block", "left_anti"))
        # elites migrate to the next island of their block
        pools = pools.join(short, "_block", "left_semi")
        elites = (pools.withColumn("_packings", F.slice("_packings", 1, 1)).withColumn("_elite", F.lit(True))
                  .withColumn("_island", F.expr(f"cast((_island + 1) % {islands} as int)")))
        pools = pools.withColumn("_elite", F.lit(False)).unionByName(elites)
    pools = done[0]
    for part in done[1:]:
        pools = pools.unionByName(part)
    best = (pools.groupBy("_block").agg(F.min(F.struct("_cost", "_island")).alias("_best"))
            .select("_block", F.col("_best._island").alias("_island")))
    return (pools.join(best, ["_block", "_island"])
            .select("_item", "length", "_block", F.col("_packings")[0].alias("_bin"), "_fill"))


def pack_pieces(pieces: DataFrame, capacity: int = 4096, block_items: int = 2000, islands: int = 2, epochs: int = 2,
                filled: float = 0.998, seed: int = 5) -> DataFrame:
    """``pieces`` (with a column ``length``, 1 to ``capacity``) with sequence_id and offset.

    Pieces are dealt at random into blocks of about ``block_items``. ``islands`` populations evolve packings of each
    block from random orders; in blocks above the least possible number of bins their elites migrate once per epoch, and
    the best packing is taken. Bins filled less than ``filled`` are
    opened and their pieces dealt into fewer blocks, level by level, down to one block, so nearly full sequences
    are all that is left. A piece of full length is a sequence by itself. Pieces in a sequence lie in the order of
    their numbers without gaps. Work per task is bounded by ``block_items``; repeated rows are packed each; an empty
    table gives no rows. Columns ``sequence_id`` and ``offset`` of ``pieces`` are replaced, all others stay.
    """
    own = {c: f"_c{i}" for i, c in enumerate(pieces.columns) if c != "length"}  # own names cannot clash with those used here
    numbered = saved(saved(pieces.select("length", *[F.col(f"`{c}`").alias(n) for c, n in own.items()]))
                     .withColumn("_item", F.monotonically_increasing_id()))
    items = numbered.select("_item", "length").where(F.col("length") < capacity)
    done = numbered.where(F.col("length") >= capacity).select(
        "_item", "length", F.lit(0).alias("_level"), F.col("_item").alias("_block"), F.lit(0).alias("_bin"))
    level, left = 1, items.count()
    while left:
        blocks = -(-left // block_items)
        packed = saved(_packed(items, blocks, capacity, islands, epochs, seed + 100 * level))
        loose = packed.where(F.col("_fill") < filled * capacity) if blocks > 1 else packed.limit(0)
        rest = loose.count()
        if blocks > 1 and rest > left // 2:  # hardly any bin can be filled: another level would not help
            loose, rest = packed.limit(0), 0
        full = packed if not rest else packed.where(F.col("_fill") >= filled * capacity)
        done = done.unionByName(full.select("_item", "length", F.lit(level).alias("_level"), "_block", "_bin"))
        items, left, level = loose.select("_item", "length"), rest, level + 1
    # a sequence is named by its smallest piece
    members = done.groupBy("_level", "_block", "_bin").agg(
        F.array_sort(F.collect_list(F.struct("_item", "length"))).alias("_members"))  # at most ``capacity`` pieces
    ends = F.aggregate(F.col("_members"), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all")),
                       lambda s, m: F.struct((s["at"] + m["length"]).alias("at"),
                                             F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])
    places = (members.withColumn("_ends", ends)
              .select(F.col("_members")[0]["_item"].alias("sequence_id"),
                      F.explode(F.arrays_zip(F.col("_members._item").alias("_item"), F.col("_ends").alias("offset"))).alias("_p"))
              .select("sequence_id", "_p._item", "_p.offset"))
    columns = [F.col(own.get(c, c)).alias(c) for c in pieces.columns if c not in ("sequence_id", "offset")]
    return numbered.join(places, "_item").select(*columns, "sequence_id", "offset")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """Sequences as arrays of ids, from packed pieces that carry their ``ids``."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
