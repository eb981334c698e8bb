import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions import vectors as vx
from factloom.operators import order
from factloom.stats import errors, pairs, tests as stests, tfidf, vectors as vs


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (240, 6)).round(3)
    x[100:180] = x[0]  # a third of the rows are copies of one vector
    return x


@pytest.fixture(scope="module")
def table(spark, points):
    return spark.createDataFrame([(i, [float(v) for v in p], i % 4) for i, p in enumerate(points)], "id bigint, vec array<double>, label int")


@pytest.mark.parametrize("anchors, block", [(1, 1000), (7, 1000), (16, 9)])
def test_near_pairs_against_brute_force(table, points, anchors, block):
    got = {(r.id_a, r.id_b): (r.copies_a, r.copies_b, r.distance)
           for r in pairs.near_pairs(table, "id", "vec", 1.6, anchors, block).collect()}
    distinct = {}
    for i, p in enumerate(points):
        distinct.setdefault(tuple(p), []).append(i)
    reps = sorted((ids[0], len(ids), np.array(p)) for p, ids in distinct.items())
    want = {(a[0], b[0]): (a[1], b[1], float(np.linalg.norm(a[2] - b[2])))
            for k, a in enumerate(reps) for b in reps[k + 1:] if np.linalg.norm(a[2] - b[2]) <= 1.6}
    assert set(got) == set(want) and len(want) > 50
    assert all(got[k][:2] == want[k][:2] and math.isclose(got[k][2], want[k][2], abs_tol=1e-9) for k in want)


def test_near_pairs_reports_each_pair_once(table):
    near = pairs.near_pairs(table, "id", "vec", 1.6, 16, 9)
    assert near.groupBy("id_a", "id_b").count().where("count > 1").isEmpty()
    assert pairs.near_pairs(table.where("id < 0"), "id", "vec", 1.0).count() == 0


def test_near_pairs_travel_once_per_block_not_per_root_of_the_rows(spark, monkeypatch):
    """Vectors that no distance tells apart: few cells, and tables of distances in small parts give the same pairs."""
    x = np.random.default_rng(5).normal(0, 1, (400, 8)).round(4)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id bigint, vec array<double>")
    taken, limit = [], type(df).limit
    monkeypatch.setattr(type(df), "limit", lambda self, n: taken.append(n) or limit(self, n))
    monkeypatch.setattr(pairs, "TASK_CELLS", 100)
    got = {(r.id_a, r.id_b) for r in pairs.near_pairs(df, "id", "vec", 2.5).collect()}
    assert taken == [8]  # 20 before: the root of the rows
    far = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert got == {(a, b) for a in range(400) for b in range(a + 1, 400) if far[a, b] <= 2.5} and len(got) > 50


@pytest.mark.parametrize("rows", [
    [(1, [0.0, 0.5]), (2, [0.0, 1.0]), (4, [1.0, 1.0]), (3, [9.0, 9.0]), (5, None)],
    [(1, [0.0, 0.5]), (1, [0.0, 0.5]), (2, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (3, [0.5, 0.5])],
    [(None, [0.0, 0.5]), (7, [0.0, 0.5]), (1, [0.0, 0.0]), (2, [0.0, 1.5]), (4, [0.0, 1.5])]])
def test_carried_vectors_are_those_of_the_join(spark, monkeypatch, rows):
    """One row per key, repeated keys and a null key beside another of its vector; pairs leave in small parts."""
    monkeypatch.setattr(pairs, "PART_PAIRS", 2)
    df = spark.createDataFrame(rows, "id int, vec array<float>")
    joined = pairs.attach_pair_vectors(pairs.near_pairs(df, "id", "vec", 2.0), df, "id", ["vec"])
    carried = pairs.attach_pair_vectors(pairs.near_pairs(df, "id", "vec", 2.0, carry=True), df, "id", ["vec"])
    assert carried.dtypes == joined.dtypes and carried.count()
    assert sorted(map(str, carried.collect())) == sorted(map(str, joined.collect()))


def test_pairs_are_not_joined_with_their_vectors(spark):
    from factloom.queries import QUERIES
    near = QUERIES["interpolated"](spark, "/root/testdata/sf0.001")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "SortMergeJoin" not in plan and "id_b" in plan
    assert plan.count("BroadcastHashJoin") <= 1  # the sizes of cells; two more before, or sorts and merges, for vectors


def test_pair_table_keeps_named_columns_only(spark):
    df = spark.createDataFrame([(0, 1, 2.0, [1.0]), (0, 2, 5.0, [2.0])], "id_a int, id_b int, d double, wide array<double>")
    out = pairs.pair_table(df, {"far": F.col("d") * 2}, ["id_a", "id_b"])
    assert set(out.columns) == {"id_a", "id_b", "far", "rank_far"}
    assert {(r.id_b, r.far, r.rank_far) for r in out.collect()} == {(1, 4.0, 1.0), (2, 10.0, 2.0)}


@pytest.mark.parametrize("most", [0, 100])
def test_attach_codes_sent_or_joined(spark, monkeypatch, most):
    monkeypatch.setattr(vs, "MAX_BOOK_VALUES", most)
    book = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (None, [5.0, 6.0])], "code int, code_vec array<double>")
    rows = spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 7), (10, 1)], "id int, label int")
    out = vs.attach_codes(rows, book, "label", "mean")
    assert sorted((r.id, r.label, r.mean) for r in out.collect()) == [(10, 1, [1.0, 2.0])] * 2 + [(11, 2, [3.0, 4.0])]


def test_pair_table_six_sentences(spark):
    """Pairs 0-1 and 4-5 lie near, 1-2 far; ranks agree with the distances."""
    vectors = {0: [1.0, 0.1], 1: [0.9, 0.2], 2: [-1.0, 0.3], 3: [-0.9, -0.4], 4: [0.1, 1.0], 5: [0.2, 0.9]}
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "id int, vec array<double>")
    near = pairs.attach_pair_vectors(pairs.near_pairs(df, "id", "vec", 10.0), df, "id", ["vec"])
    out = {(r.id_a, r.id_b): r for r in pairs.pair_table(near, pairs.metric_set("vec")).collect()}
    assert len(out) == 15 and out[0, 1].rank_euclidean < out[1, 2].rank_euclidean and out[4, 5].rank_cosine < out[1, 2].rank_cosine
    assert {out[0, 1].rank_euclidean, out[4, 5].rank_euclidean} == {1.5}
    ranks = pd.Series([r.cosine for r in out.values()]).rank()
    assert np.allclose(ranks, [r.rank_cosine for r in out.values()])
    steps = pairs.interpolate(near.where("id_a = 0 and id_b = 1"), "vec_a", "vec_b", 1, ["id_a"]).orderBy("step").collect()
    assert [r.step for r in steps] == [0, 1, 2] and np.allclose(steps[1].point, [0.95, 0.15])


def test_median_and_exemplars(table, points):
    med = {r.label: r.median for r in vs.group_median_vector(table, ["label"], "vec").collect()}
    for label in range(4):
        assert np.allclose(med[label], np.median(points[label::4], axis=0))
    near = vs.distance_to_median(table, ["label"], "vec")
    want = np.abs(points - np.array([med[i % 4] for i in range(len(points))])).sum(axis=1)
    assert np.allclose(near.orderBy("id").toPandas().distance, want)


def test_scaler(spark, table, points):
    scaler = vs.fit_vector_scaler(table, table.where("label = 0"))
    stacked = np.vstack([points, points[::4]])
    got = np.array([r.vec for r in vs.standardise_vectors(table, scaler).orderBy("id").collect()])
    assert np.allclose(got, (points - stacked.mean(0)) / stacked.std(0))
    flat = spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "vec array<double>")
    assert np.allclose(sorted(r.vec for r in vs.standardise_vectors(flat, vs.fit_vector_scaler(flat)).collect()), [[0.0, -1.0], [0.0, 1.0]])


def test_codebook(spark, table, points):
    book = spark.createDataFrame([(i, [float(v) for v in points[i * 5]]) for i in range(8)], "code int, code_vec array<double>")
    near = vs.nearest_code(table, book)
    d = np.linalg.norm(points[:, None] - points[None, [i * 5 for i in range(8)]], axis=2)
    got = near.orderBy("id").toPandas()
    assert list(got.code) == list(d.argmin(1)) and np.allclose(got.distance, d.min(1))
    state = book.select("code", F.lit(2.0).alias("ema_count"), F.transform("code_vec", lambda x: x * 2).alias("ema_sum"))
    new = {r.code: r for r in vs.update_codebook(state.unionByName(spark.createDataFrame([(99, 1.0, [1.0] * 6)], state.schema)), near, 0.9).collect()}
    n0 = (d.argmin(1) == 0).sum()
    assert new[0].ema_count == pytest.approx(0.9 * 2 + 0.1 * n0)
    want = (0.9 * 2 * points[0] + 0.1 * points[d.argmin(1) == 0].sum(0)) / (new[0].ema_count + 1e-5)
    assert np.allclose(new[0].code_vec, want)
    assert new[99].ema_count == pytest.approx(0.9) and np.allclose(new[99].ema_sum, 0.9)


def test_mmd_counts_every_row_once(table):
    a, b = table.where("label < 2"), table.where("label = 3")
    out = vs.mmd_by_batch(a, b, "id", batch_rows=25).toPandas()
    assert out.n_a.sum() == 120 and out.n_b.sum() == 60 and out.n_a.max() <= 25
    same = vs.mmd_by_batch(a, a, "id", batch_rows=1000)
    assert abs(same.first().mmd) < 1e-9


def test_mmd_value(table, points):
    got = vs.mmd_by_batch(table.where("label = 0"), table.where("label = 1"), "id", batch_rows=1000).first().mmd
    x, y = points[0::4], points[1::4]

    def k(p, q):
        return np.exp(-((p[:, None] - q[None]) ** 2).mean(2) / p.shape[1]).mean()
    assert got == pytest.approx(k(x, x) + k(y, y) - 2 * k(x, y), abs=1e-9)


def test_pca(table, points):
    model = vs.pca_fit(table, "vec")
    assert model.agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    some = vs.pca_fit(table, "vec", variance=0.5)
    assert some.orderBy(F.desc("component")).first().cumulative >= 0.5
    full = vs.pca_reconstruct(vs.pca_transform(table, model, "vec"), model).orderBy("id").collect()
    assert np.allclose([r.reconstructed for r in full], points)
    k2 = vs.pca_fit(table, "vec", 2)
    u, s, v = np.linalg.svd(points - points.mean(0), full_matrices=False)
    assert vs.pca_mse(table, k2, "vec").first().mse == pytest.approx((s[2:] ** 2).sum() / points.size)
    wide = table.select("id", *[F.col("vec")[i].alias(f"c{i}") for i in range(6)])
    scored = vs.pca_anomaly(wide, [f"c{i}" for i in range(6)], 2)
    assert scored.agg(F.avg("error")).first()[0] == pytest.approx((s[2:] ** 2).sum() / points.size)
    assert vs.project_2d(table, "vec").select("x", "y").count() == 240


def test_clusters(spark):
    rng = np.random.default_rng(1)
    data = [(int(i), [float(v) for v in rng.normal(10 * (i % 3), 0.5, 4)]) for i in range(150)]
    df = spark.createDataFrame(data, "id int, vec array<double>")
    out = vs.cluster_vectors(df, 3, "vec", 0.9).toPandas()
    assert 0.05 <= (out.cluster == -1).mean() <= 0.15
    kept = out[out.cluster >= 0]
    assert kept.groupby(kept.id % 3).cluster.nunique().max() == 1
    runs = vs.grid_metrics(df, lambda d, k: vs.cluster_vectors(d, k, "vec", 1.0), [{"k": 2}, {"k": 3}], {"m": F.avg("distance")})
    assert [r.parameters for r in runs.orderBy("m").collect()] == ["k=3", "k=2"]


def test_embeddings_by_lookup(spark):
    df = spark.createDataFrame([("a", ["x", "zz", "y", "x"]), ("b", []), ("c", ["y"])], "id string, t array<string>")
    words = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [4.0, 0.0])], "word string, vector array<double>")
    got = {r.id: r.embedding for r in vs.embed_by_lookup(df, "id", "t", words).collect()}
    assert np.allclose(got["a"], [2.0, 4 / 3]) and got["b"] is None and got["c"] == [4.0, 0.0]
    dct = {r.id: r.embedding for r in vs.embed_by_lookup(df, "id", "t", words, k=1).collect()}
    assert np.allclose(dct["a"], np.array([6.0, 4.0]) / math.sqrt(3))
    two = {r.id: r.embedding for r in vs.embed_by_lookup(df, "id", "t", words, k=2).collect()}
    pad = np.array([[4.0, 0.0], [0.0, 0.0]])  # fewer tokens than coefficients: padded with zeros
    basis = [[math.sqrt(1 / 2)] * 2, [math.cos(math.pi * (2 * i + 1) / 4) for i in range(2)]]
    assert np.allclose(two["c"], np.concatenate([np.array(b) @ pad for b in basis]))


@pytest.mark.parametrize("limit", [vs.MAX_BOOK_VALUES, 10])
def test_embeddings_carry_no_vector_per_token(spark, monkeypatch, limit):
    rng, k = np.random.default_rng(5), 3
    book = {f"w{i}": rng.normal(size=4) for i in range(30)}
    texts = {i: [f"w{j}" for j in rng.integers(0, 40, rng.integers(0, 25))] for i in range(40)}  # w30 and on are unknown
    df = spark.createDataFrame(list(texts.items()), "id long, t array<string>")
    words = spark.createDataFrame([(w, v.tolist()) for w, v in book.items()], "word string, vector array<double>")
    placed, real = [], order.entity_windows
    monkeypatch.setattr(order, "entity_windows", lambda df, *a, **o: placed.append(df.columns) or real(df, *a, **o))
    monkeypatch.setattr(vs, "MAX_BOOK_VALUES", limit)
    got = {r.id: r.embedding for r in vs.embed_by_lookup(df, "id", "t", words, k=k).collect()}
    mean = {r.id: r.embedding for r in vs.embed_by_lookup(df, "id", "t", words).collect()}
    for i, t in texts.items():
        x = np.array([book[w] for w in t if w in book])
        if not len(x):
            assert got[i] is None and mean[i] is None
            continue
        n = max(len(x), k)
        basis = [[math.sqrt((1 if j == 0 else 2) / n) * math.cos(math.pi * j * (2 * s + 1) / (2 * n)) for s in range(len(x))] for j in range(k)]
        assert np.allclose(got[i], (np.array(basis) @ x).ravel()) and np.allclose(mean[i], x.mean(axis=0))
    assert placed and all("vector" not in columns for columns in placed)
    for j in (0, k):  # an aggregate of objects would sort whole vectors
        assert "ObjectHashAggregate" not in vs.embed_by_lookup(df, "id", "t", words, k=j)._jdf.queryExecution().executedPlan().toString()


def test_embeddings_of_a_large_book_match_those_of_a_small_one(spark, monkeypatch):
    """Words used most are sent; repeated words, texts of one key, null keys and null vectors give the same sums."""
    rng = np.random.default_rng(8)
    rows = [(f"w{i % 25}", [float(v) for v in rng.normal(size=4)]) for i in range(30)] + [("w3", None), (None, [1.0] * 4)]
    texts = [(i // 2 if i % 9 else None, [f"w{min(j, 29)}" for j in rng.geometric(0.15, rng.integers(0, 20))] + [None]) for i in range(40)]
    words = spark.createDataFrame(rows, "word string, vector array<double>").coalesce(1)
    df = spark.createDataFrame(texts, "id long, t array<string>")
    want = sorted(map(str, vs.embed_by_lookup(df, "id", "t", words, k=2).withColumn(
        "embedding", F.transform("embedding", lambda x: F.round(x, 9) + 0.0)).collect()))
    monkeypatch.setattr(vs, "MAX_BOOK_VALUES", 10)
    for most in (1, 40, 1_000):
        monkeypatch.setattr(vs, "SENT_VALUES", most)
        got = vs.embed_by_lookup(df, "id", "t", words, k=2)
        assert sorted(map(str, got.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 9) + 0.0)).collect())) == want
        assert got.columns == ["id", "t", "embedding"]


def test_only_rare_words_bring_their_vectors(spark, monkeypatch):
    """A large book is not joined with every token: rows of words used most are merged and meet a broadcast."""
    monkeypatch.setattr(vs, "MAX_BOOK_VALUES", 10)
    df = spark.createDataFrame([(i, ["a"] * 30 + ["b"] * 20 + [f"r{i}"]) for i in range(20)], "id long, t array<string>")
    words = spark.createDataFrame([(w, [1.0, float(i)]) for i, w in enumerate(["a", "b", *[f"r{i}" for i in range(20)]])], "word string, vector array<double>")
    seen, real = [], order.entity_windows
    monkeypatch.setattr(order, "entity_windows", lambda df, *a, **o: seen.append(df) or real(df, *a, **o))
    monkeypatch.setattr(vs, "SENT_VALUES", 4)
    assert vs.embed_by_lookup(df, "id", "t", words, k=1).where("embedding is not null").count() == 20
    assert {(r["_sent"], r["count"]) for r in seen[0].groupBy("_sent").count().collect()} == {(True, 1000), (False, 20)}


def test_welch_and_cramer(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(1, 2, 80), rng.normal(0, 1, 50)
    df = spark.createDataFrame([(float(x), True) for x in a] + [(float(x), False) for x in b], "v double, f boolean")
    r = stests.welch_t(df, "v", "f").first()
    va, vb = a.var(ddof=1) / 80, b.var(ddof=1) / 50
    assert r.t == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
    assert r.df == pytest.approx((va + vb) ** 2 / (va ** 2 / 79 + vb ** 2 / 49))
    same = spark.createDataFrame([(i % 3, i % 3) for i in range(90)], "a int, b int")
    assert stests.cramers_v(same, "a", "b").first().cramers_v == pytest.approx(1.0)
    free = spark.createDataFrame([(i % 3, i // 3 % 3) for i in range(90)], "a int, b int")
    assert stests.cramers_v(free, "a", "b").first().cramers_v == 0.0


@pytest.mark.parametrize("kind", ["norm", "uniform", "expon", "powerlaw"])
def test_best_distribution(spark, kind):
    rng = np.random.default_rng(4)
    data = {"norm": rng.normal(5, 2, 3000), "uniform": rng.random(3000), "expon": rng.exponential(3, 3000), "powerlaw": rng.power(4, 3000)}[kind]
    df = spark.createDataFrame([(float(x), i) for i, x in enumerate(data)], "x double, i int")
    out = stests.best_distribution(df, ["x"])
    best = out.where("best").first()
    # a power law of shape 1 is the uniform distribution
    assert best.distribution in ({kind, "powerlaw"} if kind == "uniform" else {kind}) and best.p > 0.01
    x = np.sort(data)
    cdf = (x - x.min()) / (x.max() - x.min())
    n = np.arange(1, 3001)
    want = max(np.abs(n / 3000 - cdf).max(), np.abs((n - 1) / 3000 - cdf).max())
    assert out.where("distribution = 'uniform'").first().d == pytest.approx(want)


def test_yeo_johnson(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(math.exp(x)) - 1, g) for g in ("a", "b") for x in np.abs(rng.normal(2, 0.4, 1500))] + [(None, "a")], "x double, g string")
    for r in stests.fit_yeo_johnson(df, "x", ["g"]).collect():
        assert abs(r["lambda"]) < 0.35  # log1p makes it normal
    assert abs(stests.fit_yeo_johnson(df, "x").first()["lambda"]) < 0.3
    vals = spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "x double")
    assert [round(r[0], 6) for r in vals.select(stests.yeo_johnson("x", 1.0)).collect()] == [-2.0, 0.0, 3.0]
    assert [round(r[0], 6) for r in vals.select(stests.yeo_johnson("x", 0)).collect()] == [-4.0, 0.0, round(math.log(4), 6)]
    assert [round(r[0], 6) for r in vals.select(stests.yeo_johnson("x", 2)).collect()] == [round(-math.log(3), 6), 0.0, 7.5]


def test_normality(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([([float(a), float(b)],) for a, b in zip(rng.normal(0, 1, 800), rng.exponential(1, 800))], "v array<double>")
    assert {r.dim: r.gaussian for r in stests.normality(df, "v").collect()} == {0: True, 1: False}


def test_class_tfidf(spark):
    df = spark.createDataFrame([(0, "The cat sat. Cat a"), (0, "cat dog"), (1, "dog the bird")], "c int, t string")
    got = {(r.c, r.word): r for r in tfidf.class_tfidf(df, "c", "t", ["the"]).collect()}
    assert set(got) == {(0, "cat"), (0, "sat"), (0, "dog"), (1, "dog"), (1, "bird")}
    assert got[0, "cat"].tf == pytest.approx(3 / 5) and got[0, "cat"].idf == pytest.approx(math.log(3 / 3))
    assert got[1, "dog"].score == pytest.approx(0.5 * math.log(3 / 2))
    top = tfidf.class_top_words(tfidf.class_tfidf(df, "c", "t", ["the"]), "c", 2, ["sat"], 1)
    assert {(r.c, r.word) for r in top.collect()} == {(0, "dog"), (1, "bird")}
    assert "the" in tfidf.default_stop_words()


def test_errors(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 1, 1.5, 1.0, 0.5), (2, 0.0, 0.0, 0, 0.0, 0.0, 0.0)],
                               "id int, p double, v double, v_ispos int, p_out double, v_out double, v_ispos_out double")
    got = {r.id: r.error for r in errors.recon_error(df, ["p"], ["v"]).collect()}
    assert got == {1: (0.5 + 1.0 * 1.5) / 2, 2: 0.0}
    wide = spark.createDataFrame([(1, 0.1, 0.9, 0.5)], "id int, t_a double, t_b double, v double")
    top = errors.top_fields_per_row(wide, ["id"], {"t": ["t_a", "t_b"], "v": ["v"]}, 3).first()
    assert (top.field_1, top.error_1, top.field_2, top.error_2, top.field_3) == ("t", 0.9, "v", 0.5, None)
    acc = errors.accuracy(spark.createDataFrame([(1, 1, 2, 2), (1, 0, 2, 2)], "a int, b int, c int, d int"), [("x", "a", "b"), ("y", "c", "d")]).first()
    assert tuple(acc) == (0.5, 1.0, 0.5)
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.lit(1.0).alias("error"))
    batches = errors.compare_batches(rows, rows.where("row_id < 300"), "row_id", "error", 150).toPandas()
    assert batches.n.sum() == 1300 and sorted(batches[batches.is_fake].n) == [150, 150] and len(batches) == 9


def test_three_cos_mul_variants(spark):
    df = spark.createDataFrame([([1.0, 0.2], [0.3, 1.0], [0.5, 0.6], [1.0, -0.4])], "a array<double>, wa array<double>, b array<double>, wb array<double>")
    signed = df.select(vx.three_cos_mul("a", "wa", "b", "wb", absolute=False)).first()[0]
    assert abs(signed) == pytest.approx(df.select(vx.three_cos_mul("a", "wa", "b", "wb")).first()[0])


def test_welch_small_sample(spark):
    df = spark.createDataFrame([(v, f) for f, vs_ in ((True, (1.0, 2.0, 4.0)), (False, (5.0, 6.0, 9.0))) for v in vs_], "v double, f boolean")
    got = stests.welch_t(df, "v", "f").first()
    assert got.df == pytest.approx(3.6697, abs=1e-3) and got.p == pytest.approx(0.0486, abs=5e-4)
    same = stests.welch_t(spark.createDataFrame([(1.0, True), (2.0, True), (1.0, False), (2.0, False)], "v double, f boolean"), "v", "f").first()
    assert same.t == 0 and same.p == pytest.approx(1.0)


def test_small_partner_is_in_every_batch(spark):
    a = spark.range(1000).select(F.col("id"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    b = spark.range(3).select(F.col("id"), F.array(F.rand(3), F.rand(4)).alias("vec"))
    got = vs.mmd_by_batch(a, b, "id", batch_rows=100).collect()
    assert len(got) == 10 and all(r.n_a == 100 and r.n_b == 1 and r.mmd is not None for r in got)
    assert got[0].pooled == pytest.approx(sum(r.mmd for r in got) / 10)
    assert vs.mmd_by_batch(a, b.limit(0), "id").count() == 0


def test_null_vectors_have_no_code(spark):
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 1.0])], "code int, code_vec array<double>")
    df = spark.createDataFrame([(1, [0.9, 1.2]), (2, None), (3, [0.1, 0.0])], "id int, vec array<double>")
    got = {r.id: (r.code, r.distance) for r in vs.nearest_code(df, book).collect()}
    assert got[1][0] == 1 and got[2] == (None, None) and got[3] == (0, pytest.approx(0.1))


def test_shapiro_wilk_against_known_values(spark):
    """The weights example of Shapiro and Wilk (1965): W is 0.79 for these eleven weights; small and odd inputs."""
    from factloom.stats.tests import shapiro_wilk
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    got = shapiro_wilk(spark.createDataFrame([([float(w)],) for w in weights], "v array<double>"), "v").first()
    assert got.n == 11 and abs(got.w - 0.79) < 0.005 and 0.003 < got.p < 0.015 and not got.gaussian
    even = shapiro_wilk(spark.createDataFrame([([float(i), 1.0, None if i else 2.0],) for i in range(3)], "v array<double>"), "v").collect()
    found = {r.dim: r for r in even}
    assert abs(found[0].w - 1) < 1e-9 and found[0].p == 1.0 and found[1].w is None and 2 not in found


def test_max_by_field_does_not_deal_rows_by_column(spark):
    """All rows of one column must not meet in one task, whatever Spark would choose for the join."""
    from factloom.operators.groups import max_by_field
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.7), (1, "c", 0.1), (2, "a", 0.2), (None, "b", 0.3)], "id int, name string, error double")
        mapping = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "column string, field string")
        out = max_by_field(rows, ["id"], "name", "error", mapping)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r.id, r.field, r.error) for r in out.collect()} == {(1, "x", 0.7), (1, "y", 0.1), (2, "x", 0.2), (None, "x", 0.3)}
    finally:
        spark.conf.set(key, old)
