import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from factloom.features import encode, inject, scale, split
from factloom.stats import errors, tests as stests

VALUES = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=30)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(VALUES)
def test_encode_decode_round_trip(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    scaled, params = scale.log_standardise(encode.apply_cat(df, ["v"]), ["v"])
    back = {r.id: r.v for r in scale.un_log_scale(scaled, params).collect()}
    for i, v in enumerate(values):
        assert (back[i] is None) == (v is None)
        assert v is None or math.isclose(back[i], v, rel_tol=1e-6, abs_tol=1e-6)


def test_indicators(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,), (None,)], "v double")
    got = [tuple(r) for r in encode.apply_cat(df, ["v"]).select("v", "v_ispos", "v_notna").collect()]
    assert got == [(2.0, 0, 1), (0.0, 1, 1), (3.0, 1, 1), (0.0, 0, 0)]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, v double")
    scaled, params = scale.log_standardise(df, ["v"])
    assert [r.v for r in scaled.collect()] == [0.0, 0.0]
    assert all(math.isclose(r.v, 5.0) for r in scale.un_log_scale(scaled, params).collect())
    limits = scale.fit_minmax(df, ["v"])
    assert [r.v for r in scale.minmax_scale(df, limits).collect()] == [None, None]


def test_levels_and_one_hot(spark):
    df = spark.createDataFrame([(1, "b", 9), (2, "a", 7), (3, None, 7), (4, "b", None)], "id int, t string, n int")
    levels = encode.fit_levels(df, ["t", "n"])
    assert encode.level_names(levels, ["t", "n"]) == {"t": ["a", "b"], "n": ["7", "9"]}
    codes = encode.encode_levels(df, levels, ["t", "n"])
    assert [tuple(r) for r in codes.orderBy("id").collect()] == [(1, 2, 2), (2, 1, 1), (3, None, 1), (4, 2, None)]
    assert [r.t for r in encode.decode_levels(codes, levels, ["t"]).orderBy("id").collect()] == ["b", "a", None, "b"]
    hot = encode.one_hot(df, "t", ["a", "b"])
    assert [(r.t_a, r.t_b) for r in hot.orderBy("id").collect()] == [(0, 1), (1, 0), (0, 0), (0, 1)]
    assert encode.one_hot_mapping({"t": ["a", "b"]}, ["n"]) == [("t_a", "t"), ("t_b", "t"), ("n", "n")]
    # a level that holds nearly all rows is split like any other
    assert encode.fit_levels(df, ["t", "n"], hot_rows=1).exceptAll(levels).isEmpty()


def test_decode_records(spark):
    df = spark.createDataFrame([(1, "x", 3.7, 100), (2, "y", 99.25, 17000), (3, "x", 0.0, 5)], "id int, t string, v double, d int")
    logged = df.withColumn("v", F.log1p("v"))
    limits = scale.fit_minmax(logged, ["v", "d"])
    enc = encode.one_hot(scale.minmax_scale(logged, limits), "t", ["x", "y"])
    got = encode.decode_records(enc, {"t": ["x", "y"]}, limits, logged=["v"], integers=["d"]).orderBy("id").collect()
    assert [(r.t, r.v, r.d) for r in got] == [("x", 3.7, 100.0), ("y", 99.25, 17000.0), ("x", 0.0, 5.0)]


def test_splits(spark, partitions):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 70))
    by_row = split.split_random(df, "id", (0.6, 0.3, 0.1), 1)
    counts = {r.split: r["count"] for r in by_row.groupBy("split").count().collect()}
    assert sum(counts.values()) == 3000 and abs(counts["train"] - 1800) < 120 and abs(counts["test"] - 300) < 80
    assert by_row.exceptAll(split.split_random(df.repartition(9), "id", (0.6, 0.3, 0.1), 1)).isEmpty()
    pure = split.split_by_group(df, "g", (0.5, 0.3, 0.2), 2).groupBy("g").agg(F.count_distinct("split").alias("k"))
    assert pure.where("k > 1").isEmpty()
    exact = Counter(r.split for r in split.split_exact(df, "id", 0.67).collect())
    assert exact == {"train": 2010, "valid": 663, "test": 327}
    fixed = Counter(r.split for r in split.split_counts(df, "id", 130, 65).collect())
    assert fixed == {"test": 130, "valid": 65, "train": 2805}


def test_injected_rows_are_found(spark):
    """A thousand random rows score higher than real ones, p < 0.001."""
    real = spark.range(5000).select((F.col("id") % 10).cast("double").alias("a"), (F.lit(100.0) + F.col("id") % 7).alias("b"))
    both = inject.inject_uniform_rows(real, 1000, {"a": (0, 50, 0), "b": (0, 1000, 2)}, 5)
    assert both.groupBy("is_random").count().where("is_random").first()["count"] == 1000
    scored = errors.squared_error(both.withColumns({"a_out": F.lit(4.5), "b_out": F.lit(103.0)}), ["a", "b"])
    t = stests.welch_t(scored, "error", "is_random").first()
    assert t.t > 0 and t.p < 0.001
    top = errors.top_anomalies(scored.withColumn("row_id", F.monotonically_increasing_id()), 10, flag="is_random")
    assert top.count() == 10 and top.where("is_random").isEmpty()


def test_injected_dates(spark):
    df = spark.createDataFrame([(17000, 17003, 1, 1, 1, 2, 3, 4, 3, 1)],
                               "day int, system_day int, trans_date_mth int, trans_date_dom int, trans_date_dow int, system_date_mth int, system_date_dom int, system_date_dow int, delay int, debit int")
    got = inject.inject_uniform_rows(df, 300, {"day": (17000, 18000, 0), "delay": (-2, 30, 0)}, 1, trans_day="day", delay="delay", debit="debit").where("is_random")
    ok = ((F.col("system_day") == F.col("day") + F.col("delay")) & (F.month(F.date_from_unix_date("system_day")) == F.col("system_date_mth"))
          & (F.dayofweek(F.date_from_unix_date("day")) == F.col("trans_date_dow")) & F.col("delay").between(-2, 30))
    assert got.where(~ok).isEmpty() and 60 < got.where("debit = 1").count() < 140


def test_fake_rows_stay_in_range(spark):
    df = spark.range(1, 2001).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("k"), F.exp(F.col("id") / 400).alias("e"))
    fake = inject.fake_truncated_normal(df, ["a", "k", "e"], 4000, 1)
    r = fake.agg(F.min("a"), F.max("a"), F.avg("a"), F.min("k"), F.max("k"), F.min("e"), F.count("*"), F.count("e")).first()
    assert r[0] >= 1 and r[1] <= 2000 and abs(r[2] - 1000) < 30 and r[3] == r[4] == 3.0 and r[5] >= 1 and r[6] == r[7] == 4000


def test_label_noise_and_masks(spark):
    df = spark.range(4000).withColumn("y", (F.col("id") % 2).cast("int"))
    flipped = inject.flip_labels(df, "y", "id", 0.05).where(F.col("y") != F.col("id") % 2).count()
    assert 120 < flipped < 280
    r = inject.smooth_labels(df, "y", "id").groupBy(F.col("id") % 2).agg(F.min("y"), F.max("y")).orderBy("(id % 2)").collect()
    assert tuple(r[0])[1:] == (0.0, 0.0) and 0.7 <= r[1][1] < 0.75 and 1.15 < r[1][2] < 1.2
    wide = encode.apply_cat(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), ["a", "b"])
    assert inject.leave_one_out(wide, ["a"])["a"].columns == ["b", "b_ispos", "b_notna"]
    grid = inject.normal_grid(spark, 3)
    assert grid.count() == 9 and grid.where("row = 1 and col = 1").first().x == pytest.approx(0)
