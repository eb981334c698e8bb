"""Embeddings: distances, near pairs, medians, exemplars, codebooks, PCA, clusters and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx, vectors as vx
from ..operators import groups, sampling
from ..session import cut_lineage
from ..stats import density, errors, neighbours, pairs, tests, vectors as vs
from .base import query, round_columns, rounded
from .filings import _h

D = "list_transform(embedding, lambda x: x::DOUBLE)"
CENTRES = f"""long AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
centre AS (SELECT label AS code, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM long GROUP BY 1, 2) GROUP BY 1)"""
MEDIANS = f"""long AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
med AS (SELECT label, i, quantile_cont(x, 0.5) AS m FROM long GROUP BY 1, 2),
dist AS (SELECT vec_id, long.label, sum(abs(x - m)) AS d FROM long JOIN med ON long.label = med.label AND long.i = med.i GROUP BY 1, 2)"""


def _centres(t):
    long = t.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "v")))  # as long as a vector
    return means.groupBy(F.col("label").alias("code")).agg(F.transform(ordered, lambda s: s["v"]).alias("code_vec"))


@query(f"""WITH {CENTRES} SELECT vec_id, round(list_cosine_distance({D}, c), 6) AS cosine, round(list_distance({D}, c), 6) AS euclidean,
round(list_sum(list_transform(list_zip({D}, c), lambda z: abs(z[1] - z[2]))), 6) AS manhattan FROM embeddings JOIN centre ON label = code""")
def vector_distances(t):
    """Distances of every vector to its label's mean."""
    both = t.embeddings.join(_centres(t), F.col("label") == F.col("code"))
    out = both.select("vec_id", vx.cosine_distance("embedding", "code_vec").alias("cosine"),
                      vx.euclidean("embedding", "code_vec").alias("euclidean"), vx.manhattan("embedding", "code_vec").alias("manhattan"))
    return round_columns(out, ["cosine", "euclidean", "manhattan"])


RADIUS = 1.12  # about one pair in a thousand
PAIRS = f"""p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, a.embedding::DOUBLE[] AS va, b.embedding::DOUBLE[] AS vb,
list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"""


@query(f"WITH {PAIRS} SELECT id_a, id_b, round(d, 6) AS distance FROM p WHERE d <= {RADIUS}")
def near_pairs(t):
    near = pairs.near_pairs(t.embeddings, "vec_id", "embedding", RADIUS)
    return near.select("id_a", "id_b", rounded("distance").alias("distance"))


@query(f"""WITH {PAIRS}, n AS (SELECT id_a, id_b, d, list_cosine_distance(va, vb) AS c FROM p WHERE d <= {RADIUS})
SELECT id_a, id_b, round(d, 6) AS euclidean, round(c, 6) AS cosine,
rank() OVER (ORDER BY round(d, 9)) + (count(*) OVER (PARTITION BY round(d, 9)) - 1) / 2 AS rank_euclidean FROM n""")
def pair_metrics(t):
    """Several distances of the near pairs side by side, with ranks."""
    e = t.embeddings
    near = pairs.attach_pair_vectors(pairs.near_pairs(e, "vec_id", "embedding", RADIUS, carry=True), e, "vec_id", ["embedding"])
    metrics = {k: F.round(v, 9) for k, v in pairs.metric_set("embedding").items() if k != "manhattan"}
    ranked = pairs.pair_table(near, metrics, ["id_a", "id_b"])
    return round_columns(ranked, ["euclidean", "cosine"]).select("id_a", "id_b", "euclidean", "cosine", "rank_euclidean")


COS = "list_cosine_similarity({0}, {1})"


@query(f"""WITH {CENTRES}, {PAIRS}, n AS (SELECT id_a, id_b, va, vb, ca.c AS wa, cb.c AS wb FROM p JOIN embeddings ea ON ea.vec_id = id_a JOIN embeddings eb ON eb.vec_id = id_b
JOIN centre ca ON ca.code = ea.label JOIN centre cb ON cb.code = eb.label WHERE d <= {RADIUS})
SELECT id_a, id_b, round(abs({COS.format('vb', 'wa')} / ({COS.format('vb', 'wb')} * {COS.format('vb', 'va')} + 1e-6) - 1.0), 4) AS analogy FROM n""")
def analogy_distance(t):
    """3CosMul between near pairs, along the directions of their labels' means."""
    e, book = t.embeddings, cut_lineage(_centres(t))  # read several times below
    near = pairs.attach_pair_vectors(pairs.near_pairs(e, "vec_id", "embedding", RADIUS), e, "vec_id", ["embedding", "label"])
    near = vs.attach_codes(vs.attach_codes(near, book, "label_a", "code_vec_a"), book, "label_b", "code_vec_b")
    value = vx.three_cos_mul("embedding_a", "code_vec_a", "embedding_b", "code_vec_b")
    return near.select("id_a", "id_b", F.round(value, 4).alias("analogy"))


@query(f"""WITH {PAIRS}, n AS (SELECT * FROM p WHERE d <= {RADIUS}) SELECT id_a, id_b, CAST(s AS INTEGER) AS step,
CAST(i - 1 AS INTEGER) AS pos, round(va[i] + (vb[i] - va[i]) * s / 4, 6) AS x FROM n, range(0, 5) r(s), range(1, 65) q(i)""")
def interpolated(t):
    e = t.embeddings
    near = pairs.attach_pair_vectors(pairs.near_pairs(e, "vec_id", "embedding", RADIUS, carry=True), e, "vec_id", ["embedding"])
    steps = pairs.interpolate(near, "embedding_a", "embedding_b", 3, ["id_a", "id_b"])
    return steps.select("id_a", "id_b", "step", F.posexplode("point").alias("pos", "x")).withColumn("x", rounded("x"))


@query(f"WITH {MEDIANS} SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(m, 6) AS x FROM med")
def group_median(t):
    med = vs.group_median_vector(t.embeddings, ["label"], "embedding")
    return med.select("label", F.posexplode("median").alias("pos", "x")).withColumn("x", rounded("x"))


@query(f"""WITH {MEDIANS} SELECT vec_id, label, round(d, 6) AS distance, CAST(row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) AS INTEGER) AS rank FROM dist
QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) <= 30""")
def nearest_to_median(t):
    near = vs.distance_to_median(t.embeddings, ["label"], "embedding").withColumn("distance", F.round("distance", 9))
    ranked = groups.top_n_per_group(near, ["label"], [F.asc("distance"), F.asc("vec_id")], 30)
    return ranked.select("vec_id", "label", rounded("distance").alias("distance"), "rank")


@query(f"""WITH {MEDIANS}, n AS (SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) AS INTEGER) AS rank FROM dist)
SELECT vec_id, label, rank FROM n WHERE rank <= 30 QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_h('vec_id')}, vec_id) <= 4""")
def exemplars(t):
    near = vs.distance_to_median(t.embeddings, ["label"], "embedding").withColumn("distance", F.round("distance", 9))
    return sampling.exemplars(near, ["label"], "distance", "vec_id").select("vec_id", "label", "rank")


@query("""WITH long AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY 1)
SELECT vec_id, CAST(long.i - 1 AS INTEGER) AS pos, round((x - m) / s, 5) AS x FROM long JOIN s USING (i)""")
def standardise_vectors(t):
    e = t.embeddings.select("vec_id", F.col("embedding").alias("vec"))
    out = vs.standardise_vectors(e, vs.fit_vector_scaler(e))
    return out.select("vec_id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query(f"""WITH {CENTRES}, d AS (SELECT vec_id, code, list_distance({D}, c) AS d FROM embeddings, centre)
SELECT vec_id, code, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, code) = 1""")
def nearest_code(t):
    near = vs.nearest_code(t.embeddings.select("vec_id", "embedding"), _centres(t), "embedding")
    return round_columns(near, ["distance"]).select("vec_id", "code", "distance")


def _state(t):
    counts = t.embeddings.groupBy(F.col("label").alias("code")).agg(F.count("*").cast("double").alias("ema_count"))
    return _centres(t).join(counts, "code").select(
        "code", "ema_count", F.transform("code_vec", lambda x: x * F.col("ema_count")).alias("ema_sum"), "code_vec")


CODEBOOK_SQL = f"""WITH {CENTRES}, d AS (SELECT vec_id, code, list_distance({D}, c) AS d FROM embeddings, centre),
a AS (SELECT vec_id, code FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, code) = 1),
n AS (SELECT label AS code, count(*) AS n FROM embeddings GROUP BY 1), bn AS (SELECT code, count(*) AS n FROM a GROUP BY 1),
bs AS (SELECT code, i, sum(x) AS s FROM a JOIN long USING (vec_id) GROUP BY 1, 2)
SELECT n.code, CAST(i - 1 AS INTEGER) AS pos, round(0.9::DOUBLE * n.n + 0.1::DOUBLE * coalesce(bn.n, 0), 6) AS ema_count,
round((0.9::DOUBLE * c[i] * n.n + 0.1::DOUBLE * coalesce(s, 0)) / (0.9::DOUBLE * n.n + 0.1::DOUBLE * coalesce(bn.n, 0) + 1e-5), 5) AS x
FROM n JOIN centre ON centre.code = n.code JOIN range(1, 65) r(i) ON true LEFT JOIN bn ON bn.code = n.code LEFT JOIN bs ON bs.code = n.code AND bs.i = r.i""".replace("c[i]", "c[r.i]").replace("CAST(i - 1", "CAST(r.i - 1")


@query(CODEBOOK_SQL)
def codebook_update(t):
    """Decayed update of a codebook that starts as the label means."""
    state = _state(t)
    near = vs.nearest_code(t.embeddings.select("vec_id", F.col("embedding").alias("vec")), state)
    new = vs.update_codebook(state, near, 0.9)
    return new.select("code", rounded("ema_count").alias("ema_count"), F.posexplode("code_vec").alias("pos", "x")).withColumn("x", F.round("x", 5))


MMD_ROWS = 100


def _mmd_side(cond: str, seed: int) -> str:
    return f"""SELECT ((row_number() OVER (ORDER BY {_h('vec_id', seed)}, vec_id) - 1) % (SELECT b FROM nb)) AS batch, {D} AS v FROM embeddings WHERE {cond}"""


@query(f"""WITH nb AS (SELECT CAST(greatest(1, ceil(greatest(count(*) FILTER (label < 5), count(*) FILTER (label >= 5)) / {MMD_ROWS}.0)) AS BIGINT) AS b FROM embeddings),
x AS ({_mmd_side('label < 5', 0)}), y AS ({_mmd_side('label >= 5', 1)}),
xx AS (SELECT a.batch, avg(exp(-pow(list_distance(a.v, b.v), 2) / 4096)) AS k FROM x a JOIN x b ON a.batch = b.batch GROUP BY 1),
yy AS (SELECT a.batch, avg(exp(-pow(list_distance(a.v, b.v), 2) / 4096)) AS k FROM y a JOIN y b ON a.batch = b.batch GROUP BY 1),
xy AS (SELECT a.batch, avg(exp(-pow(list_distance(a.v, b.v), 2) / 4096)) AS k FROM x a JOIN y b ON a.batch = b.batch GROUP BY 1)
SELECT xx.batch, (SELECT count(*) FROM x WHERE x.batch = xx.batch) AS n_a, (SELECT count(*) FROM y WHERE y.batch = xx.batch) AS n_b,
round((xx.k + yy.k - 2 * xy.k) * 1000, 5) AS mmd,
round(sum((xx.k + yy.k - 2 * xy.k) * 1000 * (SELECT count(*) FROM x WHERE x.batch = xx.batch) * (SELECT count(*) FROM y WHERE y.batch = xx.batch)) OVER ()
  / sum((SELECT count(*) FROM x WHERE x.batch = xx.batch) * (SELECT count(*) FROM y WHERE y.batch = xx.batch)) OVER (), 5) AS pooled
FROM xx JOIN yy ON xx.batch = yy.batch JOIN xy ON xy.batch = xx.batch""")
def mean_discrepancy(t):
    """Kernel discrepancy between two halves of the labels, per random batch (times 1000)."""
    e = t.embeddings
    out = vs.mmd_by_batch(e.where("label < 5"), e.where("label >= 5"), "vec_id", "embedding", MMD_ROWS)
    return out.withColumns({c: F.round(F.col(c) * 1000, 5) for c in ("mmd", "pooled")})


@query("""WITH long AS (SELECT i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n FROM long GROUP BY 1),
k AS (SELECT long.i, max(n) AS n, avg(pow((x - m) / s, 3)) AS sk, avg(pow((x - m) / s, 4)) - 3 AS ku FROM long JOIN m ON long.i = m.i GROUP BY 1)
SELECT CAST(i - 1 AS INTEGER) AS dim, n, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, round(n / 6 * (sk * sk + ku * ku / 4), 5) AS jb FROM k""")
def normality(t):
    out = tests.normality(t.embeddings, "embedding")
    return round_columns(out, ["skewness", "kurtosis"]).select("dim", "n", "skewness", "kurtosis", F.round("jb", 5).alias("jb"))


@query()
def pca_components(t):
    model = vs.pca_fit(t.embeddings, "embedding", variance=0.8)
    return model.select("component", "share", "cumulative", F.posexplode("loading").alias("pos", "loading"))


@query("SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(embedding[i]::DOUBLE, 5) AS x FROM embeddings, range(1, 65) r(i)")
def pca_round_trip(t):
    """All components reproduce the vectors."""
    model = vs.pca_fit(t.embeddings, "embedding")
    back = vs.pca_reconstruct(vs.pca_transform(t.embeddings, model, "embedding"), model)
    return back.select("vec_id", F.posexplode("reconstructed").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query()
def pca_error(t):
    return vs.pca_mse(t.embeddings, vs.pca_fit(t.embeddings, "embedding", 10), "embedding")


@query()
def projection(t):
    return vs.project_2d(t.embeddings, "embedding").select("vec_id", "label", "x", "y")


@query()
def clusters(t):
    return vs.cluster_vectors(t.embeddings, 10, "embedding").select("vec_id", "label", "cluster", "distance")


@query()
def cluster_grid(t):
    """Coverage of several clusterings, best first."""
    e = t.embeddings
    member = F.col("cluster") != -1
    metrics = {"mean_distance": F.avg(F.when(member, F.col("distance"))), "share": F.avg(member.cast("double"))}
    runs = vs.grid_metrics(e, lambda df, k, q: vs.cluster_vectors(df, k, "embedding", q), [{"k": k, "q": 0.95} for k in (5, 10)], metrics)
    return groups.best_run(runs, "mean_distance", "run")


@query()
def cluster_agreement(t):
    """Cramer's V between found clusters and given labels."""
    return tests.cramers_v(vs.cluster_vectors(t.embeddings, 10, "embedding"), "cluster", "label")


WV = r"""tok AS (SELECT conv_id, turn, a, len(a) AS m FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS a FROM conversations)),
e AS (SELECT conv_id, turn, i, a[i] AS word FROM tok, range(1, 20000) r(i) WHERE i <= m),
voc AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS vec_id FROM (SELECT word, count(*) AS n FROM e GROUP BY 1)),
wv AS (SELECT word, embedding FROM voc JOIN embeddings USING (vec_id))"""


def _word_vectors(t):
    """The most frequent words of the conversations, each given one of the vectors."""
    tokens = t.conversations.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), tx.term_tokens("text").alias("a"))
    words = tokens.select(F.explode("a").alias("word"))
    ranked = sampling.with_sequence(groups.value_counts(words, "word", "c"), [F.desc("c"), F.asc("word")])
    vectors = ranked.withColumn("vec_id", F.col("sequence") - 1).join(t.embeddings, "vec_id").select("word", F.col("embedding").alias("vector"))
    return tokens, vectors


@query(f"""WITH {WV} SELECT conv_id, turn, CAST(j - 1 AS INTEGER) AS pos, round(avg(embedding[j]::DOUBLE), 6) AS x FROM e JOIN wv USING (word), range(1, 65) q(j) GROUP BY 1, 2, 3""")
def sentence_vectors(t):
    tokens, vectors = _word_vectors(t)
    out = vs.embed_by_lookup(tokens, "id", "a", vectors)
    return out.select("conv_id", "turn", F.posexplode("embedding").alias("pos", "x")).withColumn("x", rounded("x"))


@query(f"""WITH {WV}, f AS (SELECT conv_id, turn, embedding, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS s,
count(*) OVER (PARTITION BY conv_id, turn) AS n FROM e JOIN wv USING (word)), k AS (SELECT * FROM f, range(0, 2) c(k))
SELECT conv_id, turn, CAST(k * 64 + j - 1 AS INTEGER) AS pos, round(sum(embedding[j]::DOUBLE * CASE WHEN k = 0 THEN 1 / sqrt(greatest(n, 2))
ELSE sqrt(2.0 / greatest(n, 2)) * cos(pi() * k * (2 * s + 1) / (2 * greatest(n, 2))) END), 5) AS x FROM k, range(1, 65) q(j) GROUP BY 1, 2, 3""")
def sentence_vectors_dct(t):
    tokens, vectors = _word_vectors(t)
    out = vs.embed_by_lookup(tokens, "id", "a", vectors, k=2)
    return out.select("conv_id", "turn", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 5))


@query()
def yeo_johnson_dims(t):
    """Best power per vector dimension."""
    long = t.embeddings.select(F.posexplode("embedding").alias("dim", "x"))
    return tests.fit_yeo_johnson(long, "x", ["dim"], -2.0, 4.0, 0.25)


@query(f"""SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_h('vec_id', 3)}, vec_id) <= 5""")
def sample_per_label(t):
    return sampling.sample_n(t.embeddings, 5, "vec_id", 3, ["label"]).select("vec_id", "label")


@query()
def batch_errors(t):
    """Mean reconstruction error of random batches of real and of fake vectors."""
    e = t.embeddings.select(F.col("vec_id").alias("row_id"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    from ..features.inject import fake_truncated_normal
    cols = [f"x{i}" for i in range(64)]
    fake = fake_truncated_normal(e, cols, e.count())
    model = vs.pca_fit(e.select(F.array(*cols).alias("v")), "v", 4)

    def scored(df):
        return vs.pca_errors(df.select("row_id", F.array(*cols).alias("v")), model, "v")
    return errors.compare_batches(scored(e), scored(fake), "row_id", "error", 50)


K = 10


@query(f"""WITH d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS INTEGER) AS rank, neighbour, round(d, 6) AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) <= {K}""")
def nearest_neighbours(t):
    """The ten nearest other vectors of every vector."""
    return neighbours.nearest_neighbours(t.embeddings, "vec_id", "embedding", K).withColumn("distance", rounded("distance"))


@query()
def density_clusters(t):
    """Density clusters of all vectors with probability and outlier score."""
    found = density.density_clusters(t.embeddings, "vec_id", "embedding", min_size=5, k=K)
    return found.select("vec_id", "label", "cluster", "probability", "outlier_score")


@query()
def density_coverage(t):
    """How many density clusters there are and what share of the vectors they hold."""
    return groups.cluster_coverage(density.density_clusters(t.embeddings, "vec_id", "embedding", min_size=5, k=K), "cluster")


def _horner(coefs, x: str) -> str:
    out = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = f"({out}) * {x} + {c!r}"
    return f"({out})"


# fixed values: coefficients of the inverse normal (Acklam) and of the normal distribution (Abramowitz-Stegun 26.2.17), lowest power first
INVERSE = {"a": (2.506628277459239, -30.66479806614716, 138.357751867269, -275.9285104469687, 220.9460984245205, -39.69683028665376),
           "b": (1.0, -13.28068155288572, 66.80131188771972, -155.6989798598866, 161.5858368580409, -54.47609879822406),
           "c": (2.938163982698783, 4.374664141464968, -2.549732539343734, -2.400758277161838, -0.3223964580411365, -0.007784894002430293),
           "d": (1.0, 3.754408661907416, 2.445134137142996, 0.3224671290700398, 0.007784695709041462)}
NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
QUANTILE = (f"CASE WHEN p < 0.02425 THEN {_horner(INVERSE['c'], 'sqrt(-2 * ln(p))')} / {_horner(INVERSE['d'], 'sqrt(-2 * ln(p))')} "
            f"WHEN p > 0.97575 THEN -{_horner(INVERSE['c'], 'sqrt(-2 * ln(1 - p))')} / {_horner(INVERSE['d'], 'sqrt(-2 * ln(1 - p))')} "
            f"ELSE (p - 0.5) * {_horner(INVERSE['a'], '((p - 0.5) * (p - 0.5))')} / {_horner(INVERSE['b'], '((p - 0.5) * (p - 0.5))')} END")


@query(f"""WITH long AS (SELECT i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
o AS (SELECT dim, x, row_number() OVER (PARTITION BY dim ORDER BY x) AS k, count(*) OVER (PARTITION BY dim) AS n FROM long),
q AS (SELECT *, (k - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM o), s AS (SELECT *, {QUANTILE} AS m FROM q),
t AS (SELECT dim, max(n) AS n, 1 / sqrt(max(n)) AS u, sum(m * m) AS mm, sum(m * x) AS mx, var_pop(x) * count(*) AS ss,
  max(m) FILTER (k = n) AS m1, max(m) FILTER (k = n - 1) AS m2, max(x) FILTER (k = n) - max(x) FILTER (k = 1) AS d1,
  max(x) FILTER (k = n - 1) - max(x) FILTER (k = 2) AS d2 FROM s GROUP BY dim),
a AS (SELECT *, m1 / sqrt(mm) + {_horner(tests.LAST_WEIGHT, 'u')} AS a1, m2 / sqrt(mm) + {_horner(tests.NEXT_WEIGHT, 'u')} AS a2 FROM t),
f AS (SELECT dim, n, ln(n::DOUBLE) AS l, pow((mx - m1 * d1 - m2 * d2) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * d1 + a2 * d2, 2) / ss AS w FROM a),
z AS (SELECT dim, n, w, (ln(1 - w) - {_horner(tests.LARGE_MEAN, 'l')}) / exp({_horner(tests.LARGE_SD, 'l')}) AS z FROM f),
e AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS h FROM z),
r AS (SELECT *, exp(-z * z / 2) / 2.5066282746310002::DOUBLE * h * {_horner(NORMAL, 'h')} AS tail FROM e)
SELECT CAST(dim AS INTEGER) AS dim, n, round(w, 6) AS w, round(CASE WHEN z >= 0 THEN tail ELSE 1 - tail END, 4) AS p, CASE WHEN z >= 0 THEN tail ELSE 1 - tail END > 0.05 AS gaussian FROM r""")
def shapiro_wilk(t):
    """Whether each vector dimension is normally distributed."""
    return tests.shapiro_wilk(t.embeddings, "embedding").select("dim", "n", rounded("w").alias("w"), F.round("p", 4).alias("p"), "gaussian")
