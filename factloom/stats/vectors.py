"""Vectors as rows: scaling, medians, embeddings by lookup, codebooks, PCA, clusters and batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import dct_weight, manhattan, standardise_array
from ..operators.groups import attach_aggregates
from ..operators.order import exact_quantiles, hash_rank, join_null_safe
from ..session import cut_lineage

MAX_BOOK_VALUES = 4_000_000  # 32 MB per task
SENT_VALUES = 16_000_000  # numbers of the vectors used most, sent once per executor where not all are


def _vector(col: str):
    """An array column as a vector, which a summarizer adds up in one row per group."""
    return array_to_vector(F.col(col).cast("array<double>"))


def _collect_by_position(long: DataFrame, by, value: str, out: str) -> DataFrame:
    """(group, pos, value) to one array per group; arrays are as long as a vector."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("_v"))))
    return long.groupBy(*by).agg(F.transform(ordered, lambda s: s["_v"]).alias(out))


def fit_vector_scaler(*parts: DataFrame, vec: str = "vec") -> DataFrame:
    """(mean, sd) arrays (population sd) over the stacked sets: one row."""
    stacked = parts[0].select(vec)
    for part in parts[1:]:
        stacked = stacked.unionByName(part.select(vec))
    summary = Summarizer.metrics("mean", "variance", "count").summary(_vector(vec))
    stats = stacked.where(F.col(vec).isNotNull()).agg(summary.alias("s"))
    n = F.col("s.count")
    spread = F.sqrt((n - 1) / n)  # the summary's variance is that of a sample
    return stats.select(vector_to_array("s.mean").alias("mean"), F.transform(
        vector_to_array("s.variance"), lambda v: F.sqrt(F.greatest(v, F.lit(0.0))) * spread).alias("sd"))


def standardise_vectors(df: DataFrame, scaler: DataFrame, vec: str = "vec") -> DataFrame:
    """Apply a fitted scaler; a constant dimension becomes 0."""
    params = scaler.select(F.struct("mean", "sd").alias("p")).scalar()
    return (df.withColumn("_p", params)
            .withColumn(vec, standardise_array(vec, F.col("_p")["mean"], F.col("_p")["sd"])).drop("_p"))


def group_median_vector(df: DataFrame, by, vec: str, out: str = "median") -> DataFrame:
    """Exact element-wise median per group."""
    long = df.select(*by, F.posexplode(vec).alias("pos", "x"))
    med = exact_quantiles(long, "x", {"_m": 0.5}, [*by, "pos"])
    return _collect_by_position(med, by, "_m", out)


def distance_to_median(df: DataFrame, by, vec: str, out: str = "distance", distance=manhattan) -> DataFrame:
    """Attach the distance of every vector to its group's element-wise median."""
    med = group_median_vector(df, by, vec, "_median")
    return join_null_safe(df, med, list(by)).withColumn(out, distance(vec, "_median")).drop("_median")


def embed_by_lookup(df: DataFrame, key: str, tokens: str, vectors: DataFrame, word: str = "word",
                    vec: str = "vector", k: int = 0, out: str = "embedding") -> DataFrame:
    """One vector per text from the vectors of its known tokens; texts without any get NULL.

    ``k`` = 0 averages them; ``k`` > 0 takes the first k orthonormal DCT coefficients of every
    dimension, one block of dimensions per coefficient. Tokens travel without vectors: ``vectors`` of ``MAX_BOOK_VALUES`` numbers
    at most go to the tasks, more are joined. Sums are merged before the shuffle. For coefficients, the words that most tokens
    have are sent in any case, as many as ``SENT_VALUES`` numbers allow, and a vector travels with a token of the other words only.
    """
    book = cut_lineage(vectors.select(word, vec, F.monotonically_increasing_id().alias("_row")))
    size = F.coalesce(F.size(vec), F.lit(0))
    numbers, dims = book.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    small = numbers <= MAX_BOOK_VALUES
    sent = F.broadcast if small else lambda part: part
    words = df.select(key, F.posexplode(tokens).alias("_tpos", word))
    value = [F.col(vec)[i].cast("double") for i in range(dims)]

    def summed(rows: DataFrame, sums: list, name: str) -> DataFrame:
        # a number per column: a summary of vectors would sort and spill the vectors of all but a few texts
        sums = [s.alias(f"_s{i}") for i, s in enumerate(sums)]
        means = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *sums)
        return means.select(key, F.array(*[F.col(f"_s{i}") for i in range(len(sums))]).cast("array<double>").alias(name))

    if not k:
        return df.join(summed(words.join(sent(book.drop("_row")), word), [F.avg(v) for v in value], out), key, "left")
    from ..operators.order import entity_windows
    # the place counts the known tokens only; vectors come last, once per text and word
    hot, known = (book, words.join(F.broadcast(book.select(word, "_row")), word)) if small else _known_tokens(words, book, word, dims)
    found = entity_windows(known.drop(word), [key], ["_tpos", "_row"], seq="_seq")
    found = attach_aggregates(found, [key], {"_n": F.count(F.lit(1))})
    weights = [dct_weight(F.col("_seq") - 1, F.greatest(F.col("_n"), F.lit(k)), j).alias(f"_w{j}") for j in range(k)]
    sums = [F.sum(v * F.col(f"_w{j}")) for j in range(k) for v in value]
    # by text alone: the sums below then need no shuffle
    often = found if small else found.where("_sent")
    merged = often.repartition(key).select(key, "_row", *weights).groupBy(key, "_row").agg(
        *[F.sum(f"_w{j}").alias(f"_w{j}") for j in range(k)])
    scaled = merged.join(F.broadcast(hot.select("_row", vec)), "_row")
    if small:
        return df.join(summed(scaled, sums, out), key, "left")
    # rows with vectors go to their text before they are summed: a sum has k times the numbers of a vector
    rare = found.where("not _sent").select(key, "_row", *weights).join(book.select("_row", vec), "_row").repartition(key)
    both = df.join(summed(scaled, sums, "_often"), key, "left").join(summed(rare, sums, "_rare"), key, "left")
    added = F.zip_with("_often", "_rare", lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))
    return both.withColumn(out, F.when(F.col("_often").isNull(), F.col("_rare")).when(
        F.col("_rare").isNull(), F.col("_often")).otherwise(added)).drop("_often", "_rare")


def _known_tokens(words: DataFrame, book: DataFrame, word: str, dims: int) -> tuple[DataFrame, DataFrame]:
    """The part of a large ``book`` with the words used most, and the tokens that the book has; ``_sent`` are those of that part.

    Only the tokens of other words are shuffled to be looked up.
    """
    index = book.select(word, "_row")
    used = cut_lineage(words.groupBy(word).agg(F.count(F.lit(1)).alias("_uses"))
                       .join(index.groupBy(word).agg(F.count(F.lit(1)).alias("_rows")), word))
    rows = used.agg(F.coalesce(F.max("_rows"), F.lit(1))).first()[0]  # a word may have several vectors
    top = cut_lineage(used.orderBy(F.desc("_uses"), word).limit(max(1, SENT_VALUES // (dims * rows))).select(word))
    hot = cut_lineage(book.join(F.broadcast(top), word, "left_semi"))
    others = words.join(F.broadcast(top), word, "left_anti").join(index.join(F.broadcast(top), word, "left_anti"), word)
    rare = cut_lineage(others.drop(word).withColumn("_sent", F.lit(False)))
    often = words.join(F.broadcast(hot.select(word, "_row")), word).drop(word).withColumn("_sent", F.lit(True))
    return hot, often.unionByName(rare)


def _matrix(rows, field: str) -> np.ndarray:
    return np.array([r[field] for r in rows], dtype=np.float64)


def stacker():
    """A function from a series of vectors to a matrix that travels to the tasks by value, without this package."""
    def stack(series: pd.Series) -> np.ndarray:
        return np.stack(series.to_numpy()).astype(np.float64)
    return stack


def attach_codes(df: DataFrame, codebook: DataFrame, by: str, out: str, code: str = "code", code_vec: str = "code_vec") -> DataFrame:
    """Rows with the codeword that column ``by`` names, as ``out``; rows without one are left out.

    A codebook of ``MAX_BOOK_VALUES`` numbers at most goes to the tasks, so that no row travels for it; a larger one is joined.
    """
    book = codebook.select(F.col(code).alias("_code"), F.col(code_vec).alias(out))
    small = book.agg(F.coalesce(F.sum(F.size(out)), F.lit(0))).first()[0] <= MAX_BOOK_VALUES
    return df.join(F.broadcast(book) if small else book, F.col(by) == F.col("_code")).drop("_code")


def nearest_code(df: DataFrame, codebook: DataFrame, vec: str = "vec", code: str = "code", code_vec: str = "code_vec") -> DataFrame:
    """Attach the nearest codeword (lowest code on ties) and the Euclidean distance to it.

    The codebook's size is checked before it is sent to the tasks. A NULL vector gets a NULL code and distance.
    """
    size = codebook.agg(F.coalesce(F.sum(F.size(code_vec)), F.lit(0))).first()[0]
    if size > MAX_BOOK_VALUES:
        raise ValueError(f"codebook has more than {MAX_BOOK_VALUES} numbers")
    rows = codebook.select(code, code_vec).orderBy(code).collect()
    codes, book = np.array([r[code] for r in rows]), _matrix(rows, code_vec)
    half = (book ** 2).sum(axis=1) / 2
    code_type, stack = dict(codebook.dtypes)[code], stacker()

    @F.pandas_udf(f"struct<{code}:{code_type},distance:double>")
    def assign(v: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({code: pd.Series([None] * len(v), dtype=object), "distance": np.full(len(v), np.nan)})
        full = np.flatnonzero(v.notna().to_numpy())
        step = max(1, 4_000_000 // max(len(codes), 1))
        for start in range(0, len(full) if len(codes) else 0, step):
            at = full[start:start + step]
            x = stack(v.iloc[at])
            pick = np.argmin(half - x @ book.T, axis=1)
            out.loc[at, code] = codes[pick].astype(object)
            out.loc[at, "distance"] = np.sqrt(((x - book[pick]) ** 2).sum(axis=1))
        out["distance"] = out["distance"].astype(object).where(out["distance"].notna(), None)
        return out

    return df.withColumn("_c", assign(vec)).select(*[c for c in df.columns if c != code], "_c.*")


def update_codebook(state: DataFrame, assigned: DataFrame, decay: float = 0.99, code: str = "code",
                    vec: str = "vec", epsilon: float = 1e-5) -> DataFrame:
    """Decayed counts and sums per codeword and the new codeword = sums / (count + epsilon).

    ``state``: code, ema_count, ema_sum; codewords without new members decay as well.
    """
    counts = assigned.groupBy(code).agg(F.count(F.lit(1)).alias("_n"))
    sums = assigned.groupBy(code).agg(Summarizer.sum(_vector(vec)).alias("_s"))
    batch = counts.join(sums.select(code, vector_to_array("_s").alias("_sum")), code)
    keep, gain = F.lit(decay), F.lit(1 - decay)
    new_sum = F.when(F.col("_sum").isNull(), F.transform("ema_sum", lambda x: keep * x)).otherwise(
        F.zip_with("ema_sum", "_sum", lambda old, new: keep * old + gain * new))
    return (state.select(code, "ema_count", "ema_sum").join(batch, code, "left")
            .withColumn("ema_sum", new_sum)
            .withColumn("ema_count", keep * F.col("ema_count") + gain * F.coalesce("_n", F.lit(0)))
            .withColumn("code_vec", F.transform("ema_sum", lambda x: x / (F.col("ema_count") + F.lit(epsilon))))
            .select(code, "ema_count", "ema_sum", "code_vec"))


def _batches(df: DataFrame, key: str, vec: str, n: int, rows: int, seed: int, side: str) -> DataFrame:
    """Rows dealt into ``n`` batches; if there are fewer rows than batches, each row comes in several."""
    ranked = hash_rank(df.select(key, vec), key, seed, out="_rank", total="_total")
    dealt = ranked.withColumn("batch", F.expr(f"(_rank - 1) % {n}").cast("bigint"))
    if rows < n:
        dealt = dealt.withColumn("batch", F.explode(F.sequence(F.col("batch"), F.lit(n - 1).cast("bigint"), F.lit(rows).cast("bigint"))))
    return dealt.select("batch", F.lit(side).alias("side"), F.col(vec).alias("v"))


def mmd_by_batch(a: DataFrame, b: DataFrame, key: str, vec: str = "vec", batch_rows: int = 200, seed: int = 0) -> DataFrame:
    """Kernel mean discrepancy between two samples, per random batch: batch, n_a, n_b, mmd, pooled.

    Kernel exp(-mean squared difference / dimensions). Rows of both tables are dealt into the same
    number of batches, the larger table having at most ``batch_rows`` per batch; a task holds one
    batch and returns one row, so the work grows with the number of rows. A table with fewer rows than batches is dealt
    round and round, so that no batch is without a partner. ``pooled`` is the mean over all batches, weighted by their pairs.
    Rows without a vector are left out; no batches come out if one table is empty.
    """
    a, b = a.where(F.col(vec).isNotNull()), b.where(F.col(vec).isNotNull())
    rows_a, rows_b = a.count(), b.count()
    n = max(1, -(-max(rows_a, rows_b) // batch_rows))

    stack = stacker()

    def kernel(p, q):
        d2 = (p ** 2).sum(1)[:, None] + (q ** 2).sum(1)[None, :] - 2 * p @ q.T
        return np.exp(-np.maximum(d2, 0) / p.shape[1] ** 2).mean()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == "a"], pdf[pdf["side"] == "b"]
        x, y = stack(left["v"]), stack(right["v"])
        value = kernel(x, x) + kernel(y, y) - 2 * kernel(x, y)
        return pd.DataFrame({"batch": [pdf["batch"].iat[0]], "n_a": [len(left)], "n_b": [len(right)], "mmd": [value]})

    both = _batches(a, key, vec, n, rows_a, seed, "a").unionByName(_batches(b, key, vec, n, rows_b, seed + 1, "b"))
    both = both if rows_a and rows_b else both.limit(0)
    batches = both.groupBy("batch").applyInPandas(one, "batch bigint, n_a bigint, n_b bigint, mmd double")
    pairs = F.col("n_a") * F.col("n_b")
    pooled = batches.agg((F.sum(F.col("mmd") * pairs) / F.sum(pairs)).alias("pooled"))
    return batches.crossJoin(F.broadcast(pooled))


def pca_fit(df: DataFrame, vec: str = "vec", k: int | None = None, variance: float | None = None) -> DataFrame:
    """Principal components: component (1-based), share, cumulative, loading, mean.

    Either ``k`` components, or the fewest that explain ``variance``. Each loading's largest entry is
    positive. The covariance matrix (dimensions squared) is the only thing gathered.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = df.select(vec)
    dims = rows.select(F.size(vec).alias("d")).first()["d"]
    wide = rows.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("v"))
    model = PCA(k=dims if k is None else k, inputCol="v", outputCol="p").fit(wide)
    share = model.explainedVariance.toArray()
    total = np.cumsum(share)
    if k is None:
        k = dims if variance is None else int(np.searchsorted(total, variance - 1e-12) + 1)
    loads = model.pc.toArray()[:, :k].T
    loads = loads * np.sign(loads[np.arange(k), np.abs(loads).argmax(axis=1)])[:, None]
    mean = fit_vector_scaler(rows, vec=vec).first()["mean"]
    table = [(i + 1, float(share[i]), float(total[i]), [float(x) for x in loads[i]], mean) for i in range(k)]
    return df.sparkSession.createDataFrame(
        table, "component int, share double, cumulative double, loading array<double>, mean array<double>")


def _pca_params(model: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = model.orderBy("component").collect()
    return _matrix(rows, "loading"), np.array(rows[0]["mean"])


def pca_transform(df: DataFrame, model: DataFrame, vec: str = "vec", out: str = "components") -> DataFrame:
    """Coordinates of each centred vector along the components."""
    (loads, mean), stack = _pca_params(model), stacker()

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list((stack(v) - mean) @ loads.T)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(out, project(vec))


def pca_reconstruct(df: DataFrame, model: DataFrame, components: str = "components", out: str = "reconstructed") -> DataFrame:
    (loads, mean), stack = _pca_params(model), stacker()

    @F.pandas_udf("array<double>")
    def rebuild(c: pd.Series) -> pd.Series:
        return pd.Series(list(stack(c) @ loads + mean)) if len(c) else pd.Series([], dtype=object)

    return df.withColumn(out, rebuild(components))


def pca_errors(df: DataFrame, model: DataFrame, vec: str = "vec", out: str = "error") -> DataFrame:
    """Mean squared reconstruction error per row."""
    (loads, mean), stack = _pca_params(model), stacker()

    @F.pandas_udf("double")
    def error(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        x = stack(v) - mean
        return pd.Series(((x - x @ loads.T @ loads) ** 2).mean(axis=1))

    return df.withColumn(out, error(vec))


def pca_mse(df: DataFrame, model: DataFrame, vec: str = "vec") -> DataFrame:
    return pca_errors(df, model, vec, "_e").agg(F.avg("_e").alias("mse"))


def pca_anomaly(df: DataFrame, cols, k: int, fit_df: DataFrame | None = None) -> DataFrame:
    """Attach reconstructions ``<col>_out`` of numeric columns by k components and the squared ``error``.

    A linear stand-in for an autoencoder; fitted on ``fit_df`` (default: the table itself).
    """
    from .errors import squared_error
    as_vec = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    model = pca_fit((fit_df if fit_df is not None else df).select(as_vec.alias("_v")), "_v", k)
    coded = pca_reconstruct(pca_transform(df.withColumn("_v", as_vec), model, "_v", "_c"), model, "_c", "_r")
    wide = coded.withColumns({f"{c}_out": F.col("_r")[i] for i, c in enumerate(cols)})
    return squared_error(wide.drop("_v", "_c", "_r"), cols)


def project_2d(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Two coordinates per vector for plots (first two principal components)."""
    flat = pca_transform(df, pca_fit(df, vec, 2), vec, "_c")
    return flat.withColumn("x", F.col("_c")[0]).withColumn("y", F.col("_c")[1]).drop("_c")


def cluster_vectors(df: DataFrame, k: int, vec: str = "vec", q: float = 0.95, seed: int = 0,
                    outlier: int = -1) -> DataFrame:
    """k-means label and distance per vector; rows beyond the cluster's distance quantile get ``outlier``.

    A partitioning stand-in for density clustering.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    wide = df.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(wide)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    book = df.sparkSession.createDataFrame(centres, "cluster int, centre array<double>")
    near = cut_lineage(nearest_code(df, book, vec, "cluster", "centre"))  # read for the limits and for the result
    cut = exact_quantiles(near, "distance", {"_q": q}, ["cluster"])
    return (near.join(cut, "cluster")
            .withColumn("cluster", F.when(F.col("distance") > F.col("_q"), outlier).otherwise(F.col("cluster")))
            .drop("_q"))


def grid_metrics(df: DataFrame, fit, grid: list[dict], metrics) -> DataFrame:
    """One row per parameter set: run, parameters and metrics, ready for ``best_run``.

    ``fit(df, **params)`` returns a scored table, ``metrics`` maps names to aggregates of it.
    """
    rows = []
    for i, params in enumerate(grid):
        scored = fit(df, **params).agg(*[c.alias(m) for m, c in metrics.items()]).first()
        text = ",".join(f"{k}={v}" for k, v in sorted(params.items()))
        rows.append((f"run{i:04d}", text, *[float(scored[m]) for m in metrics]))
    schema = "run string, parameters string, " + ", ".join(f"{m} double" for m in metrics)
    return df.sparkSession.createDataFrame(rows, schema)
