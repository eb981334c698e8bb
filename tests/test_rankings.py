import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.stats.rankings import larger_before, rank_correlation

SCHEMA = "g string, x double, y bigint"


def brute(frame: pd.DataFrame) -> dict:
    x, y = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
    i, j = np.triu_indices(len(frame), 1)
    dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
    rx, ry = frame["x"].rank().to_numpy(), frame["y"].rank().to_numpy()
    out = {"n": len(frame), "concordant": int((dx * dy > 0).sum()), "discordant": int((dx * dy < 0).sum()),
           "tied_left": int((dx == 0).sum()), "tied_right": int((dy == 0).sum()), "tied_both": int(((dx == 0) & (dy == 0)).sum())}
    free = (len(i) - out["tied_left"]) * (len(i) - out["tied_right"])
    out["tau_b"] = (out["concordant"] - out["discordant"]) / free ** 0.5 if free else None
    out["rho"] = float(np.corrcoef(rx, ry)[0, 1]) if free else None
    return out


def check(row, want):
    for name, value in want.items():
        got = row[name]
        assert got is None if value is None else float(got) == pytest.approx(value, abs=1e-9), name


def sample(n=700):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 60, n) / 4
    y = np.where(rng.uniform(size=n) < 0.5, x * 4 + rng.integers(0, 9, n), rng.integers(0, 90, n))
    groups = np.array(["hot", "b", None, "one sided", "single"], dtype=object)[rng.choice(5, n, p=[.6, .2, .15, .03, .02])]
    rows = [(g, float(a), int(b)) for g, a, b in zip(groups, x, y) if g != "single"]
    rows = [(g, 1.0, b) if g == "one sided" else (g, a, b) for g, a, b in rows]
    return rows + [("single", 1.0, 1)] + rows[:80]  # some rows are copies


@pytest.mark.parametrize("block_rows", [5, 100_000])
def test_against_all_pairs(spark, block_rows):
    rows = sample()
    lost = [("hot", None, 3), ("hot", 2.0, None), ("hot", float("nan"), 4), ("only nulls", None, None)]
    df = spark.createDataFrame(rows + lost, SCHEMA)
    got = {r.g: r for r in rank_correlation(df, "x", "y", ["g"], block_rows).collect()}
    frame = pd.DataFrame(rows, columns=["g", "x", "y"])
    assert set(got) == {r[0] for r in rows}
    for g in got:
        check(got[g], brute(frame[frame["g"].isna() if g is None else frame["g"] == g]))
    check(rank_correlation(df, "x", "y", (), block_rows).first(), brute(frame))


def test_same_and_opposite_order(spark):
    df = spark.range(5000).selectExpr("id", "-id AS back", "id % 7 AS few")
    assert rank_correlation(df, "id", "id", (), 50).select("tau_b", "rho", "discordant").first()[:] == (1.0, 1.0, 0)
    row = rank_correlation(df, "id", "back", (), 50).first()
    assert (row.tau_b, row.rho, int(row.discordant)) == (-1.0, -1.0, 5000 * 4999 // 2)


def test_many_copies_go_beyond_64_bits():
    from factloom.stats.rankings import _count_block
    many = 1 << 40
    frame = pd.DataFrame({"a": [0, 1], "b": [1, 0], "w": [many, many]})
    assert _count_block([], "a", "b")(frame)["discordant"].tolist() == [str(many * many)]


def test_empty_table(spark):
    assert rank_correlation(spark.createDataFrame([], SCHEMA), "x", "y", ["g"]).count() == 0
    assert rank_correlation(spark.createDataFrame([], SCHEMA), "x", "y").count() == 0


def test_larger_before():
    rng = np.random.default_rng(1)
    r, w = rng.integers(0, 40, 200), rng.integers(1, 5, 200)
    assert larger_before(r, w).tolist() == [int(w[:i][r[:i] > r[i]].sum()) for i in range(200)]


@pytest.mark.parametrize("kind", ["double", "float", "date", "timestamp", "decimal(9,2)", "decimal(30,2)"])
def test_small_groups_take_no_blocks(spark, monkeypatch, kind):
    """Groups that fit a block are counted whole; only larger ones are placed and cut into blocks."""
    from factloom.stats import rankings
    far = 0 if kind == "decimal(30,2)" else 1 << 60  # beside a NULL, keys that no double can hold
    rows = [(None if g is None else far + len(g), float(int(x * 4)), y) for g, x, y in sample(300)]
    df = spark.createDataFrame(rows, "g bigint, x double, y bigint")
    cast = {"date": F.date_from_unix_date(F.col("x").cast("int")), "timestamp": F.timestamp_micros(F.col("x").cast("long"))}
    df = df.withColumn("x", cast.get(kind, F.col("x").cast(kind)))
    placed, general = [], rankings._sums_of_large
    monkeypatch.setattr(rankings, "_sums_of_large", lambda df, *a: placed.append(df.select("g").distinct().count()) or general(df, *a))
    frame = pd.DataFrame(rows, columns=["g", "x", "y"]).assign(g=pd.Series([g for g, _, _ in rows], dtype=object))
    for block_rows in (1000, 60):
        got = {r.g: r for r in rank_correlation(df, "x", "y", ["g"], block_rows).collect()}
        assert set(got) == {g for g, _, _ in rows}
        for g in got:
            check(got[g], brute(frame[frame["g"].isna() if g is None else frame["g"] == g]))
    larger = (frame.groupby("g", dropna=False).size() > 60).sum()
    assert 0 < larger < len(got) and placed == ([len(got)] * 2 if kind == "decimal(30,2)" else [larger])
