"""Near duplicates by ProbMinHash: signatures of weighted shingles, bands, and exact probability Jaccard of candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import saved
from .graph import components
from .words import chunks, mixed, word_hashes

_STEP = 0x9E3779B97F4A7C15
STORED = "node long, elements binary, weights binary, halves binary, half_weights binary"
BLOCK = 1000  # members of a bucket in one side of a comparison


def weighted_shingles(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``k`` words (one run of all words if there are fewer) and how often each occurs."""
    n = len(hashes)
    if not n:
        return hashes, np.zeros(0)
    runs = np.zeros(max(n - k + 1, 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(k, n)):
            runs = mixed(runs * np.uint64(_STEP) + hashes[j:j + len(runs)])
    distinct, count = np.unique(runs, return_counts=True)
    return distinct, count.astype(float)


def prob_min_hash(parts: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Signatures (texts, m) of weighted sets: two sets agree in a component with their probability Jaccard similarity.

    Each element arrives in a Poisson process of its weight's rate; every arrival falls on a random component, which
    keeps the element that came first. An element stops when its next arrival is later than all components' first
    ones. Arrivals are drawn from the element's hash alone, round by round for all elements of all sets.
    """
    q = np.full(len(parts) * m, np.inf)
    sign = np.zeros(len(parts) * m, dtype=np.uint64)
    if not parts:
        return sign.reshape(0, m)
    element = np.concatenate([e for e, _ in parts])
    weight = np.concatenate([w for _, w in parts])
    owner = np.repeat(np.arange(len(parts)), [len(e) for e, _ in parts])
    at, round_ = np.zeros(len(element)), 0
    while len(element):
        round_ += 1
        draw = mixed(element ^ np.uint64(round_ * _STEP % (1 << 64)))
        at = at - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53) / weight
        latest = q.reshape(-1, m).max(axis=1)[owner]
        live = at < latest
        element, weight, owner, at, draw = element[live], weight[live], owner[live], at[live], draw[live]
        index = owner * m + (mixed(draw + np.uint64(1)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(q, index, at)
        first = q[index] == at
        sign[index[first]] = element[first]
    return sign.reshape(-1, m)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Sum over common elements d of 1 / sum over all d' of max(x[d'] / x[d], y[d'] / y[d]); elements are sorted."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    ratios, which = np.unique(x[i] / y[j], return_inverse=True)
    only = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    total = np.array([only[0] + r * only[1] + np.maximum(x[i], r * y[j]).sum() for r in ratios])
    return float((x[i] / total[which]).sum())


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            texts = batch["_text"].tolist()
            out = []
            for low, high in chunks([0 if t is None else len(t) for t in texts], 1 << 19):
                hashes, bounds = word_hashes(texts[low:high])
                place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
                spread = [mixed(hashes + (place + 1).astype(np.uint64) * np.uint64(c)) for c in (_STEP, 0xC2B2AE3D27D4EB4F)]
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(s, dtype=np.uint64)]) for s in spread]
                keys = [(s[bounds[1:]] - s[bounds[:-1]]).astype(np.int64) for s in sums]
                parts = [weighted_shingles(hashes[a:b], k) for a, b in zip(bounds[:-1], bounds[1:])]
                sign = prob_min_hash(parts, bands * rows).reshape(-1, bands, rows)
                short = mixed(sign.reshape(len(parts), -1)).astype(np.uint16).view(np.int16)
                band = np.repeat(np.arange(bands, dtype=np.uint64)[None] + np.uint64(1), len(parts), axis=0) * np.uint64(_STEP)
                for r in range(rows):
                    band = mixed(band + sign[:, :, r]) * np.uint64(3)
                band = band.astype(np.int64)
                out.append(pd.DataFrame({"k1": keys[0], "k2": keys[1],
                                         "bands": [b if len(p[0]) else b[:0] for b, p in zip(band, parts)],
                                         "short": list(short)}))
            yield pd.concat([batch[["_id", "_hash"]].reset_index(drop=True), pd.concat(out, ignore_index=True)], axis=1)
    return run


def _stored(k: int):
    """Shingles of each node in full, and short ones (32 bits, sorted) with weights only if not all are 1."""
    def run(batches):
        for batch in batches:
            texts, out = batch["_text"].tolist(), []
            for low, high in chunks([0 if t is None else len(t) for t in texts], 1 << 19):
                hashes, bounds = word_hashes(texts[low:high])
                for a, b in zip(bounds[:-1], bounds[1:]):
                    element, weight = weighted_shingles(hashes[a:b], k)
                    half = element.astype(np.uint32)
                    order = np.argsort(half, kind="stable")
                    out.append((element.tobytes(), weight.astype("<f4").tobytes(), half[order].tobytes(),
                                b"" if (weight == 1).all() else weight[order].astype("<f4").tobytes()))
            yield pd.DataFrame({"node": batch["node"], **{c: [x[i] for x in out] for i, c in enumerate(
                ("elements", "weights", "halves", "half_weights"))}})
    return run


def short_jaccard(a: np.ndarray, x: np.ndarray | None, b: np.ndarray, y: np.ndarray | None) -> float:
    """Probability Jaccard on sorted short shingles; equal short ones of one text count as one."""
    if x is None and y is None:
        at = np.searchsorted(b, a)
        common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return common / (len(a) + len(b) - common)
    ones = [np.ones(len(v)) if w is None else w.astype(float) for v, w in ((a, x), (b, y))]
    (p, i), (q, j) = (np.unique(v, return_index=True) for v in (a, b))
    return probability_jaccard(p, ones[0][i], q, ones[1][j])


def _across(least: float, agree: int):
    """Near pairs of one part of a bucket: members outside its largest component against all, if in other components."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame["key"].iat[0]
        sides = [frame[frame["first"]], frame[~frame["first"]]]
        found: list[tuple[int, int]] = []
        if all(len(s) for s in sides):
            node, part = ([s[c].to_numpy() for s in sides] for c in ("node", "part"))
            minor = sides[1]["minor"].to_numpy()
            short, bands = ([np.stack(s[c].to_numpy()) for s in sides] for c in ("short", "bands"))
            same = np.zeros((len(node[0]), len(node[1])), dtype=np.uint16)
            for c in range(short[0].shape[1]):
                same += short[0][:, c, None] == short[1][None, :, c]
            wanted = (same >= agree) & (part[0][:, None] != part[1]) & (~minor | (node[0][:, None] < node[1]))
            at = [[np.frombuffer(v, dtype=np.uint32) for v in s["halves"]] for s in sides]
            weight = [[np.frombuffer(v, dtype="<f4") if len(v) else None for v in s["half_weights"]] for s in sides]
            for i, j in zip(*np.nonzero(wanted)):
                shared = bands[0][i] == bands[1][j]
                if bands[0][i][shared.argmax()] == key and short_jaccard(at[0][i], weight[0][i], at[1][j], weight[1][j]) >= least - 0.02:
                    found.append((min(node[0][i], node[1][j]), max(node[0][i], node[1][j])))
        return pd.DataFrame(found, columns=["a", "b"])
    return run


def _verified(least: float):
    def run(batches):
        for batch in batches:
            value = np.array([probability_jaccard(*(np.frombuffer(v, dtype=kind).astype(kind if kind is np.uint64 else float)
                                                    for v, kind in zip(row, (np.uint64, "<f4", np.uint64, "<f4"))))
                              for row in zip(batch["ea"], batch["wa"], batch["eb"], batch["wb"])])
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": value >= least - 1e-9})
    return run


def near_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8,
               bands: int = 20, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """(members, parts): each row of ``docs`` with its text's node, and the component of each node that has links.

    A node is a distinct sequence of words (A to Z as a to z), so copies meet once. Nodes with an equal band are
    candidates. At first each band bucket compares its members with one of them, the one that meets most others in all
    its buckets, as the origin of copies does; linked nodes merge into components. In buckets whose members are still in
    different components, all members outside the bucket's largest component are then compared with all members of other
    components, block by block, and only near pairs leave a task. So every pair of a bucket is in one component or
    compared, and a group of near copies of any size costs a few comparisons per member that is linked to others.

    A pair is looked at in its first common band only, and only if its signatures agree in at least ``least`` - 4.5
    standard deviations of components. Links are confirmed by the exact probability Jaccard of stored shingles. Pairs of
    similarity s share a band with probability 1 - (1 - s^rows)^bands.
    """
    n = bands * rows
    agree = int(n * least - 4.5 * (n * least * (1 - least)) ** 0.5)
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
                         F.col(text).alias("_text"))
    kind = source.schema["_id"].dataType
    signed = saved(source.withColumn("_id", F.col("_id").cast("string")).mapInPandas(
        _signatures(k, bands, rows), "_id string, _hash long, k1 long, k2 long, bands array<long>, short array<short>")
        .withColumn("_id", F.col("_id").cast(kind)))
    nodes = saved(signed.groupBy("k1", "k2").agg(F.min(F.struct("_id", "_hash")).alias("_row"), F.first("bands").alias("bands"),
                                                 F.first("short").alias("short"))
                  .withColumn("node", F.monotonically_increasing_id()))
    held = nodes.select("node", F.explode("bands").alias("key"))
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = saved(held.join(shared, "key"))
    central = buckets.groupBy("node").agg(F.sum("size").alias("central"))

    wanted = buckets.select("node").distinct().join(nodes.select("node", "_row.*"), "node")
    texts = source.withColumnRenamed("_id", "_i").withColumnRenamed("_hash", "_h")
    picked = texts.join(wanted, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    shingles = saved(picked.select("node", F.col("_text")).mapInPandas(_stored(k), STORED).dropDuplicates(["node"]))

    sketches = saved(central.join(nodes.select("node", "bands", "short"), "node"))
    full = shingles.select("node", "elements", "weights")

    def confirmed(pairs: DataFrame) -> DataFrame:
        compared = (pairs.join(full.toDF("b", "eb", "wb"), "b").join(full.toDF("a", "ea", "wa"), "a")
                    .mapInPandas(_verified(least), "a long, b long, linked boolean"))
        return saved(compared.where("linked").select("a", "b"))

    # one member of each bucket against the others
    at = saved(buckets.select("key", "node").join(sketches, "node"))
    centre = at.groupBy("key").agg(F.max(F.struct("central", (-F.col("node")).alias("_order"), "node", "short")).alias("_p"))
    stars = (centre.select("key", F.col("_p.node").alias("_na"), F.col("_p.short").alias("_sa"))
             .join(at.select("key", F.col("node").alias("_nb"), F.col("short").alias("_sb")), "key")
             .where((F.col("_na") != F.col("_nb"))
                    & F.expr(f"size(filter(zip_with(_sa, _sb, (x, y) -> x = y), x -> x)) >= {agree}"))
             .select(F.least("_na", "_nb").alias("a"), F.greatest("_na", "_nb").alias("b")).distinct())
    links = confirmed(stars)
    parts = saved(components(links), few_files=True)

    # the rest of the buckets that hold several components
    at = (buckets.select("key", "node").join(parts, "node", "left")
          .select("key", "node", F.coalesce("component", "node").alias("part")))
    counts = at.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = (counts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("_major"), F.sum("n").alias("_all"))
             .where("_all > _major.n").select("key", F.col("_major.part").alias("_major"),
                                              F.ceil((F.col("_all") - F.col("_major.n")) / F.lit(BLOCK)).cast("int").alias("_minors"),
                                              F.ceil(F.col("_all") / F.lit(BLOCK)).cast("int").alias("_blocks")))
    open_ = (at.join(sizes, "key").withColumn("minor", F.col("part") != F.col("_major"))
             .withColumn("_i", F.pmod(F.hash("node"), F.col("_minors"))).withColumn("_j", F.pmod(F.hash("node"), F.col("_blocks"))))
    as_second = F.transform(F.sequence(F.lit(0), F.col("_minors") - 1),
                            lambda i: F.struct(i.alias("i"), F.col("_j").alias("j"), F.lit(False).alias("first")))
    as_first = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1),
                           lambda j: F.struct(F.col("_i").alias("i"), j.alias("j"), F.lit(True).alias("first")))
    tasks = (open_.withColumn("_t", F.explode(F.when(F.col("minor"), F.concat(as_second, as_first)).otherwise(as_second)))
             .select("key", "node", "part", "minor", "_t.*"))
    loaded = tasks.join(sketches.select("node", "bands", "short").join(shingles.select("node", "halves", "half_weights"), "node"), "node")
    others = saved(loaded.groupBy("key", "i", "j").applyInPandas(_across(least, agree), "a long, b long").distinct())
    parts = saved(components(links.unionByName(confirmed(others))), few_files=True)
    members = signed.select("_id", "_hash", "k1", "k2").join(nodes.select("k1", "k2", "node"), ["k1", "k2"])
    return members.select("_id", "_hash", "node"), parts


def _placed(members: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    placed = saved(members.join(parts, "node", "left").select(
        "_id", "_hash", F.coalesce("component", "node").alias("_class"), F.monotonically_increasing_id().alias("_row")))
    best = F.struct(F.col("_id").isNull().alias("_null"), "_id", "_row", "_hash")
    return placed, placed.groupBy("_class").agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("class_size"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8,
                 bands: int = 20, rows: int = 4) -> DataFrame:
    """One row per row of ``docs``: id_col, class_id (smallest id of its class), class_size, kept.

    Classes are the connected texts of probability Jaccard similarity ``least`` or more on runs of ``k`` words weighted
    by their number; see ``near_links``. Equal texts are in one class. Texts without words (null, empty, blank) are equal
    to each other and like nothing else; a text of fewer than ``k`` words is one run. The row with the smallest id is
    kept; null ids come last, and of several rows with that id one is kept. An empty table gives no rows.
    """
    members, parts = near_links(docs, id_col, text, k, least, bands, rows)
    placed, whole = _placed(members, parts)
    return placed.join(whole, "_class").select(
        F.col("_id").alias(id_col), F.col("_best._id").alias("class_id"), "class_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"))


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, least: float = 0.8,
                      bands: int = 20, rows: int = 4) -> DataFrame:
    """``docs`` without the rows that ``near_classes`` does not keep; rows of equal id and text stay or go together."""
    placed, whole = _placed(*near_links(docs, id_col, text, k, least, bands, rows))
    gone = (placed.join(whole.where("class_size > 1"), "_class")
            .where(~(F.col("_id").eqNullSafe(F.col("_best._id")) & (F.col("_hash") == F.col("_best._hash"))))
            .select(F.col("_id").alias("_gone_id"), F.col("_hash").alias("_gone_hash")))
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # the table's own names cannot clash with those used here
    digest = F.xxhash64(F.coalesce(F.col(own[text]), F.lit("")))
    kept = docs.toDF(*own.values()).join(gone, F.col(own[id_col]).eqNullSafe(F.col("_gone_id")) & (digest == F.col("_gone_hash")), "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in own.items()])
