import pytest
from pyspark.sql import functions as F

from factloom.operators import boxes, dedupe, filters, groups, joins, reshape, sequences as seq, sets, sparsity


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


FACTS = "report int, tag string, uom string, version string, value double"


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([
        (1, "Cash", "USD", "us-gaap/2018", 10.0), (1, "Cash", "EUR", "us-gaap/2018", 9.0), (1, "Debt", "EUR", "custom", 5.0),
        (2, "Cash", "USD", "ifrs/2017", 7.0), (2, "Cash", "USD", "us-gaap/2018", 8.0), (2, "Units", "shares", "dei", 3.0),
        (3, "Cash", "GBP", "us-gaap", None), (3, "Units", "USD", "dei", 1.0)], FACTS)


def test_unit_priority(spark, facts):
    pr = dedupe.priority_from_counts(facts, "uom", F.col("uom").rlike("^[A-Z]{3}$"))
    assert rows(pr, "priority") == [("USD", 0), ("EUR", 1), ("GBP", 2)]
    skipped = dedupe.priority_from_counts(facts, "uom", F.col("uom").rlike("^[A-Z]{3}$"), skip=1)
    assert rows(skipped, "priority") == [("EUR", 0), ("GBP", 1)]
    ranked = dedupe.with_priority(facts, skipped, "uom")
    assert {r.uom: r.priority for r in ranked.collect()} == {"EUR": 0, "GBP": 1, "USD": 2, "shares": 2}


def test_priority_dedupe_leaves_one_row_per_key(facts, partitions):
    pr = dedupe.priority_from_counts(facts, "uom", F.col("uom").rlike("^[A-Z]{3}$"))
    one = dedupe.dedupe_by_priority(dedupe.with_priority(facts, pr, "uom"), ["report", "tag"], "priority", ["uom", "version", "value"])
    assert dedupe.duplicate_keys(one, ["report", "tag"]).isEmpty()
    assert rows(one.select("report", "tag", "uom", "value"), "report", "tag") == [
        (1, "Cash", "USD", 10.0), (1, "Debt", "EUR", 5.0), (2, "Cash", "USD", 7.0), (2, "Units", "shares", 3.0),
        (3, "Cash", "GBP", None), (3, "Units", "USD", 1.0)]


def test_audits(facts):
    assert rows(dedupe.duplicate_keys(facts, ["report", "tag"]), "report") == [(1, "Cash", 2), (2, "Cash", 2)]
    mixed = dedupe.ambiguous_groups(facts.withColumn("m", F.when(F.col("uom").rlike("^[A-Z]{3}$"), "c").otherwise("o")), ["tag"], "m")
    assert rows(mixed, "tag") == [("Units", 2)]
    assert dedupe.drop_groups(facts, mixed, ["tag"]).where("tag = 'Units'").isEmpty()


def test_convert_currency(spark, facts):
    wide = spark.createDataFrame([(201801, 2.0, 4.0), (201802, 0.0, None)], "YearMonth int, EUR double, GBP double")
    rates = joins.unpivot_rates(wide)
    assert rates.count() == 3
    df = spark.createDataFrame([(201801, "EUR", 10.0), (201802, "EUR", 10.0), (201802, "GBP", 10.0), (201801, "USD", 10.0),
                                (201801, "shares", 10.0), (201901, "GBP", 1.0)], "month int, uom string, value double")
    got = {(r.month, r.uom): r.value_usd for r in joins.convert_currency(df, rates).collect()}
    assert got == {(201801, "EUR"): 5.0, (201802, "EUR"): None, (201802, "GBP"): None, (201801, "USD"): 10.0, (201801, "shares"): 10.0, (201901, "GBP"): None}


def test_map_items_and_suffixes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "item string, v int")
    mapping = spark.createDataFrame([("a", "X"), ("b", "X"), ("d", "Y"), ("a", "X")], "item string, item_mapped string")
    assert rows(joins.map_items(df, mapping).select("item", "v"), "v") == [("X", 1), ("X", 2)]
    both = joins.join_suffixed(df, df.withColumn("w", F.lit(0)), "item")
    assert both.columns == ["item", "v_x", "v_y", "w"]
    assert joins.zip_by_key(df, df, "item").columns == ["item", "v", "v_2"]


def test_lookup_elements(spark):
    df = spark.createDataFrame([(1, ["b", "a", "zz", "b"]), (2, []), (3, ["zz"])], "id int, t array<string>")
    table = spark.createDataFrame([("a", 10), ("b", 20)], "w string, n int")
    got = joins.lookup_elements(df, "id", "t", table, "w", "n", "codes")
    assert rows(got.select("id", "codes"), "id") == [(1, [20, 10, 20]), (2, []), (3, [])]


def test_pivot_drops_null_index_and_keeps_null_cells(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (2, "b", 1.0), (None, "a", 9.0)], "k int, c string, v double")
    assert rows(reshape.pivot_facts(df, ["k"], "c", "v", ["a", "b"]), "k") == [(1, 3.0, None), (2, None, 1.0)]
    assert rows(reshape.spread(df, ["k"], "c", "v", ["a", "b"], 0.0), "k") == [(1, 4.0, 0.0), (2, 0.0, 1.0)]


def test_filters(spark):
    df = spark.createDataFrame([(19991231, "Stock"), (20000101, None), (20190801, "x"), (20190731, "restocked")], "d int, u string")
    assert rows(filters.filter_period(df, "d").select("d"), "d") == [(20000101,), (20190731,)]
    assert filters.exclude_containing(df, "u", "STOCK").count() == 2
    assert filters.value_columns(df.withColumn("u_ispos", F.lit(1)), ["d"]) == ["u"]
    spec = filters.col_spec(df.withColumn("u_notna", F.lit(1)))
    assert [(r.name, r.kind) for r in spec.orderBy("sequence").collect()] == [("d", "value"), ("u", "value"), ("u_notna", "binary")]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r.x for r in filters.nan_to_null(nan).collect()] == [None, 1.0]
    trimmed = filters.between_quantiles(spark.range(101).withColumn("w", F.col("id")), ["id", "w"], 0.1, 0.9)
    assert rows(trimmed.agg(F.min("id"), F.max("id"))) == [(10, 90)]


def wide(spark):
    data = [(i, 1.0 if i % 2 else None, 1.0 if i % 3 else None, 1.0 if i % 5 else None, None) for i in range(60)]
    return spark.createDataFrame(data, "id int, a double, b double, c double, d double")


def test_completeness(spark):
    df, cols = wide(spark), list("abcd")
    assert {r.column: r.filled for r in sparsity.completeness_columns(df, cols).collect()} == {"a": 30, "b": 40, "c": 48, "d": 0}
    assert sparsity.completeness_rows(df, cols).where("id = 7").first().filled == 3
    slim = sparsity.reduce_sparsity(df, cols, 30, 1)
    assert slim.columns == ["id", "b", "c"] and slim.count() == 32
    assert sparsity.pattern_counts(df, cols).agg(F.sum("n")).first()[0] == 60


def test_column_subsets_against_brute_force(spark):
    from itertools import combinations
    df, cols = wide(spark), list("abcd")
    pdf = df.toPandas()
    got = {r.column_qty: (tuple(r.column_list), r.complete_rows) for r in sparsity.best_column_subset(df, cols, [1, 2, 3, 4, 9]).collect()}
    for k in (1, 2, 3):
        counts = {c: len(pdf.dropna(subset=list(c))) for c in combinations("abcd", k)}
        best = max(counts.values())
        assert got[k] == (next(c for c in combinations("abcd", k) if counts[c] == best), best)
    assert set(got) == {1, 2, 3}  # "d" is empty
    import numpy as np
    rng = np.random.default_rng(3)
    many = [f"c{i}" for i in range(130)]  # more columns than bits of a long
    filled = rng.uniform(size=(400, 130)) < np.linspace(0.3, 0.9, 130)
    table = spark.createDataFrame([tuple(1 if x else None for x in row) for row in filled], ", ".join(f"{c} int" for c in many))
    best = {r.column_qty: r for r in sparsity.best_column_subset(table, many, [1, 2, 3]).collect()}
    pairs = {c: int((filled[:, c[0]] & filled[:, c[1]]).sum()) for c in combinations(range(130), 2)}
    assert best[2].complete_rows == max(pairs.values()) and best[2].tried < len(pairs)
    triple = max(int((filled[:, a] & filled[:, b] & filled[:, c]).sum()) for a, b, c in combinations(range(60, 130), 3))
    assert best[3].complete_rows >= triple
    one = sparsity.best_column_subset(table, many[70:86], [1, 2, 3, 4])
    for most in (1, 40):  # the same from levels that are tables, from the first or a later level on
        assert rows(sparsity.best_column_subset(table, many[70:86], [1, 2, 3, 4], most), "column_qty") == rows(one, "column_qty")
    wide_sets = sparsity.best_column_subset(table, many, [2], 10).first()  # masks of several longs
    assert (wide_sets.column_list, wide_sets.complete_rows) == (best[2].column_list, best[2].complete_rows)
    steps = sparsity.greedy_complete_columns(table, many[::-1], 0.7).orderBy("column_qty").collect()
    kept, rows_left = [], None
    for c in range(129, -1, -1):
        n = int(filled[:, [*kept, c]].all(axis=1).sum())
        if rows_left is None or n >= 0.7 * rows_left:
            kept.append(c)
            rows_left = n
    assert [r.column for r in steps] == [f"c{c}" for c in kept] and steps[-1].complete_rows == rows_left
    greedy = sparsity.greedy_complete_columns(df, ["c", "b", "a"], 0.6)
    assert rows(greedy, "column_qty") == [(1, "c", 48), (2, "b", 32)]


def test_groups(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 3.0), ("b", 3, None), ("b", 4, -1.0), (None, 5, 2.0)], "g string, id int, v double")
    assert rows(groups.best_per_group(df.where("g is not null"), ["g"], "v", ["id"]), "g") == [("a", 2, 3.0), ("b", 4, -1.0)]
    assert rows(groups.value_counts(df, "g"), "g") == [("a", 2), ("b", 2)]
    assert rows(groups.attach_aggregates(df, ["g"], {"m": F.max("v")}).select("id", "m"), "id") == [(1, 5.0), (2, 5.0), (3, -1.0), (4, -1.0), (5, 2.0)]
    assert rows(groups.lump_top_n(df, "g", 1).groupBy("g").count(), "g") == [(None, 1), ("Other", 2), ("a", 2)]
    assert [r.g for r in groups.lump_top_n(df, "g", 5).orderBy("id").collect()] == ["a", "a", "b", "b", None]
    assert rows(groups.histogram_edges(df, "v", -1.0, 5.0, 3), "bin") == [(1, 1), (2, 1), (3, 2)]
    assert groups.best_run(df, "v", "id").first().id == 4
    assert rows(groups.concat_group(df.where("g is not null"), ["g"], "id", ["id"], 1, "-"), "g", "part") == [
        ("a", 0, "1"), ("a", 1, "2"), ("b", 0, "3"), ("b", 1, "4")]
    p = {r.column: r for r in groups.profile(df).collect()}
    assert (p["v"].n_missing, p["v"].n_distinct, p["g"].n_distinct, p["g"].mean) == (1, 4, 2, None)


def test_sequences(spark):
    from datetime import date
    days = [date(2018, 1, 1), date(2018, 4, 1), date(2018, 7, 1), date(2018, 12, 31), date(2019, 3, 31)]
    df = spark.createDataFrame([("x", d, i) for i, d in enumerate(days)] + [("y", days[0], 9)], "crn string, d date, ref int")
    gaps = seq.with_interval_months(df, ["crn"], "d", ["ref"])
    assert [r.interval_months for r in gaps.orderBy("crn", "ref").collect()] == [3, 3, 3, 6, 3, 0]
    runs = seq.with_run_number(gaps, ["crn"], "interval_months", ["d", "ref"])
    assert [r.run for r in runs.orderBy("crn", "ref").collect()] == [1, 2, 3, 1, 1, 1]
    loose = seq.with_run_number(gaps, ["crn"], "interval_months", ["d", "ref"], islands=False)
    assert [r.run for r in loose.orderBy("crn", "ref").collect()] == [1, 2, 3, 1, 4, 1]
    assert rows(seq.entities_with_min_sequence(runs, ["crn"], "interval_months", 3), "crn") == [("x", 3, 3)]
    assert seq.rows_with_min_sequence(runs, ["crn"], "interval_months", 3, 3).count() == 4
    assert seq.first_n(df, ["crn"], ["d", "ref"], 2).count() == 2


def test_nine_reports_give_six_windows(spark):
    df = spark.createDataFrame([("x", i, ch, 0.0 if i == 0 else float(i)) for i, ch in enumerate("ABCDEFGHI")] + [("y", i, "Z", 1.0) for i in range(3)],
                               "crn string, i int, ref string, v double")
    win = seq.sliding_sequences(df, ["crn"], ["i"], ["ref", "v"], 4)
    texts = win.groupBy("sequence_grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "ref"))), lambda s: s["ref"]), "").alias("t"))
    assert [r.t for r in texts.orderBy("sequence_grp").collect()] == ["ABCD", "BCDE", "CDEF", "DEFG", "EFGH", "FGHI"]
    growth = seq.window_growth(win, ["crn", "sequence_grp"], "v").where("step = 2").orderBy("sequence_grp").collect()
    assert [r.growth for r in growth[:2]] == [0.0, 3.0]
    scaled = seq.scale_to_byte(seq.window_growth(win, ["crn", "sequence_grp"], "v"), "growth")
    assert scaled.agg(F.max("growth_255")).first()[0] == 255


def test_tensor_reshape(spark):
    """Twelve reports of ten features as three samples of four steps, numbers 0 to 119."""
    df = spark.range(12).select((F.col("id") / 4).cast("int").alias("s"), (F.col("id") % 4).alias("o"),
                                *[(F.col("id") * 10 + j).alias(f"f{j}") for j in range(10)])
    t = seq.to_sequences(df.repartition(5), ["s"], "o", [f"f{j}" for j in range(10)])
    flat = [x for r in t.orderBy("s").collect() for step in r.steps for x in step]
    assert flat == [float(i) for i in range(120)]
    back = seq.from_sequences(t, ["s"], ["a"] + [f"b{j}" for j in range(9)])
    assert back.count() == 12 and back.where("s = 1 and step = 1").first().a == 40.0


def test_current_previous(spark):
    df = spark.createDataFrame([("c", "r", "20171231", "Cash", 1), ("c", "r", "20161231", "Cash", 2), ("c", "r", "20151231", "Cash", 3), ("c", "r", None, "Cash", 4)],
                               "crn string, rd string, close string, item string, v int")
    got = seq.tag_current_previous(df, ["crn", "rd"], "close", "item")
    assert rows(got.select("item", "v"), "v") == [("Cash_curr", 1), ("Cash_prev", 2)]


def test_sets(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, t string")
    assert sets.union_distinct(a, a).count() == 2
    assert sets.union_all(a, a.drop("t")).where("t is null").count() == 3
    assert sets.except_keys(a, a.where("k = 1"), "k").count() == 1


def test_boxes(spark):
    nested = spark.createDataFrame([("1.png", [(5, 10, 20, 30, 40), (10, 10, 20, 28, 55)]), ("2.png", [(1, 4, 4, 0, 1)])],
                                   "filename string, boxes array<struct<label:int,width:int,height:int,top:int,left:int>>")
    flat = boxes.explode_records(nested, "boxes")
    assert flat.count() == 3
    one = boxes.coalesce_boxes(boxes.spread_labels(flat, "box_seq", "label"))
    r = one.where("filename = '1.png'").first()
    assert (r.x0, r.y0, r.x1, r.y1, r.digit_count, r.label_1, r.label_2, r.label_3) == (40, 28, 65, 50, 2, 5, 10, 11)
    grown = boxes.expand_boxes(one.withColumns({"img_width": F.lit(66), "img_height": F.lit(60)}))
    g = grown.where("filename = '1.png'").first()
    assert (g.x0_new, g.x1_new, g.y0_new, g.y1_new) == (38, 66, 26, 52)
    s = grown.where("filename = '2.png'").first()
    assert (s.x0_new, s.y0_new) == (1, 0)
    good, bad = boxes.label_count_check(grown)
    assert (good.count(), bad.count()) == (2, 0)
    assert [r.filename for r in boxes.min_resolution(grown).collect()] == ["1.png"]


def test_pixels(spark):
    px = spark.createDataFrame([("a", x, y, float(x + 10 * y)) for x in range(1, 5) for y in range(1, 5)] + [("c", x, y, 3.0) for x in (1, 2) for y in (1, 2)],
                               "filename string, x int, y int, value double")
    lines = boxes.pixels_to_matrix(px)
    assert lines.where("filename = 'a' and y = 2").first().line == [21.0, 22.0, 23.0, 24.0]
    assert boxes.matrix_to_pixels(lines).exceptAll(px).isEmpty()
    assert boxes.standardise_by(px, ["filename"], "value").where("filename = 'c' and value is not null").isEmpty()
    small = boxes.resize_pixels(px, 2).where("filename = 'a'")
    assert rows(small.select("x", "y", "value"), "y", "x") == [(1, 1, 11.0), (2, 1, 13.0), (1, 2, 31.0), (2, 2, 33.0)]
    assert boxes.resize_pixels(px, 8).groupBy("filename").count().where("count <> 64").isEmpty()
    box = spark.createDataFrame([("a", 3, 3, 3, 3)], "filename string, x0_new int, x1_new int, y0_new int, y1_new int")
    crop = boxes.crop_pixels(px, box)
    assert rows(crop.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*"))) == [(1, 3, 1, 3, 9)]
    agree = seq.order_agreement(px.where("filename = 'a'"), ["filename"], ["x", "y"], ["y", "x"])
    assert agree.where("agrees").count() == 4
