"""Order-based building blocks against brute force, with ties, NULLs and one group holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.operators import order, sampling, sequences as seq


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 900
    group = np.where(np.arange(n) < 300, "hot", [f"g{i % 40}" for i in range(n)])
    value = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.normal(0, 50, n), 1))  # one value in a third of the rows
    return pd.DataFrame({"id": np.arange(n), "g": group, "v": value, "t": rng.integers(0, 50, n)})


@pytest.fixture(scope="module")
def table(spark, frame):
    df = spark.createDataFrame(frame)
    return df.unionByName(spark.createDataFrame([(9001, "g1", None, 1), (9002, None, 5.0, 2), (9003, None, None, 2)], df.schema))


def test_quantiles_by_group(table, frame, partitions):
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.999, "e": 1.0}
    got = order.exact_quantiles(table, "v", probs, ["g"], buckets=16).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert np.allclose(got.loc[g], np.quantile(part.v, list(probs.values())))
    assert np.allclose(got.loc[[None]].iloc[0] if None in got.index else got[got.index.isna()].iloc[0], 5.0)


def test_quantiles_of_table(spark, table, frame):
    got = order.exact_quantiles(table, "v", {"p": 0.37}, buckets=8).first().p
    assert np.isclose(got, np.quantile([*frame.v, 5.0], 0.37))
    assert order.exact_quantiles(table.where("id < 0"), "v", {"p": 0.5}).first().p is None
    dates = spark.sql("select date'2020-01-01' + cast(id as int) d from range(9)")
    assert str(order.value_positions(dates, "d").where("before = 4").first().value) == "2020-01-05"


def test_average_rank(table, frame):
    got = order.average_rank(table.where("g is not null and v is not null"), "v", "r", ["g"], 8).toPandas().set_index("id").r
    want = frame.set_index("id").groupby("g").v.rank()
    assert np.allclose(got.sort_index(), want.sort_index())


def test_cumulative_share(table):
    rows = order.cumulative_share(table.where("g = 'hot'"), "v").orderBy("value").collect()
    assert rows[0].share_below == 0 and rows[-1].share_upto == 1
    assert all(abs(a.share_upto - b.share_below) < 1e-12 for a, b in zip(rows, rows[1:]))


def test_hash_rank_is_a_permutation(table, partitions):
    got = order.hash_rank(table, "id", 3).select("id", "rank", "total").toPandas()
    assert sorted(got["rank"]) == list(range(1, 904)) and set(got.total) == {903}
    again = order.hash_rank(table.repartition(5), "id", 3).select("id", "rank").toPandas()
    assert dict(zip(got.id, got["rank"])) == dict(zip(again.id, again["rank"]))
    per = order.hash_rank(table, "id", 3, ["g"]).groupBy("g").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("d"), F.count("*").alias("n"))
    assert per.where("m <> n or d <> n").isEmpty()


def test_position_and_running_total(table, frame, partitions):
    got = order.with_position(table.where("v is not null"), [F.desc("v"), F.asc("id")]).toPandas().sort_values("position")
    assert list(got.position) == list(range(901))
    assert list(got.id) == list(got.sort_values(["v", "id"], ascending=[False, True]).id)
    run = order.running_total(table.where("v is not null"), ["t", "id"], "v", chunk_rows=100).toPandas().sort_values(["t", "id"])
    assert np.allclose(run.running, run.v.cumsum())


@pytest.mark.parametrize("hot, chunk", [(100, 10), (250, 7), (0, 4)])
def test_hot_entities_give_the_same_windows(table, hot, chunk):
    columns = {"lag": lambda w: F.lag("v", 2).over(w), "lead": lambda w: F.lead("v", 3).over(w),
               "near": lambda w: F.collect_list("id").over(w.rowsBetween(-2, 3))}
    plain = order.entity_windows(table, ["g"], ["t", "id"], columns, "s", 2, 3)
    split = order.entity_windows(table, ["g"], ["t", "id"], columns, "s", 2, 3, hot_rows=hot, chunk_rows=chunk)
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_sliding_sequences_of_a_hot_entity(table):
    plain = seq.sliding_sequences(table, ["g"], ["t", "id"], ["id"], 4)
    split = seq.sliding_sequences(table, ["g"], ["t", "id"], ["id"], 4, hot_rows=100, chunk_rows=5)
    assert plain.exceptAll(split).isEmpty() and plain.count() == split.count() > 0
    assert plain.groupBy("g", "sequence_grp").count().where("count <> 4").isEmpty()


def test_samples(table):
    a = sampling.sample_n(table, 5, "id", 1, ["g"]).toPandas()
    assert a.groupby("g", dropna=False).size().max() == 5 and len(a[a.g == "hot"]) == 5
    big = sampling.sample_n(table, 1200, "id", 1)
    assert big.count() == 903  # more than there is: everything
    assert sampling.sample_n(table, 10, "id", 1).count() == 10
    numbered = sampling.with_sequence(table, ["id"]).toPandas().sort_values("id")
    assert list(numbered.sequence) == list(range(1, 904))
    assert sampling.sample_n(table, 1000, "id", 2, ["g"]).count() == 903


def test_bad_arguments(table):
    with pytest.raises(ValueError):
        order.value_positions(table, "v", buckets=10)
    with pytest.raises(ValueError):
        order.entity_windows(table, ["g"], ["id"], {}, before=9, chunk_rows=3)


@pytest.mark.parametrize("hot", [10, 4_000_000])
def test_rank_of_a_stored_table_joins_no_rows(spark, table, monkeypatch, hot):
    """Ties, NULL and NaN rank as in average_rank; a third of the rows with one value are merged first where that is hot."""
    monkeypatch.setattr(order, "HOT_ROWS", hot)
    df = table.unionByName(spark.createDataFrame([(9004, "g1", float("nan"), 1), (9005, "g1", -0.0, 1), (9006, "g1", 0.0, 1)], table.schema))
    ranked = order.average_rank_of_stored(df, "v", "r", 16)
    want = {r.id: r.r for r in order.average_rank(df, "v", "r").collect()}
    assert {r.id: r.r for r in ranked.collect()} == want and ranked.columns == [*df.columns, "r"] and len(want) == 906
    grouped = ranked._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [v")
    assert (grouped > 0) == (hot == 10)  # equal values merged, then joined
    assert order.average_rank_of_stored(df.where("id < 0"), "v", "r").count() == 0
