"""Token arrays, nested records and images as pixel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx, vectors as vx
from ..operators import boxes
from ..plans import text as plan
from ..session import cut_lineage
from .base import query, round_columns, rounded

ARR = r"list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> '')"


def _tokens(t):
    return t.documents.select("doc_id", tx.words("text").alias("tokens"))


@query(f"""WITH a AS (SELECT doc_id, len({ARR}) AS n FROM documents) SELECT doc_id, CAST(n AS INTEGER) AS n FROM a
WHERE n >= 10 AND n <= floor((SELECT quantile_cont(n, 0.9) FROM a))""")
def token_crop(t):
    tokens = cut_lineage(_tokens(t))  # tokenised once, read for the limit and for the crop
    return plan.crop_by_length(tokens, "tokens", 10, 0.9).select("doc_id", F.size("tokens").alias("n"))


@query(f"""WITH a AS (SELECT doc_id, {ARR} AS a FROM documents), p AS (SELECT doc_id, list_filter([list_position(a, 'the'), list_position(a, 'and'), list_position(a, 'de')],
lambda x: x > 0) AS p FROM a) SELECT doc_id, CAST(i - 1 AS INTEGER) AS k, CAST(p[i] - 1 AS INTEGER) AS at FROM p, range(1, 4) r(i) WHERE i <= len(p)""")
def token_positions(t):
    found = plan.with_searchwords(_tokens(t), "tokens", ["the", "and", "de"])
    return found.select("doc_id", F.posexplode("positions").alias("k", "at"))


@query(f"""WITH a AS (SELECT item_id, {ARR} AS a FROM benchmark), p AS (SELECT item_id, list_concat(list_concat(a[1:len(a) - 1],
list_transform(range(0, greatest(0, 60 - len(a))), lambda x: '[PAD]')), a[len(a):len(a)]) AS p FROM a)
SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, p[i] AS token, CASE WHEN p[i] = '[PAD]' THEN 1 ELSE 0 END AS mask FROM p, range(1, 2000) r(i) WHERE i <= len(p)""")
def pad_and_mask(t):
    padded = t.benchmark.select("item_id", tx.pad_tokens(tx.words("text"), 60, "[PAD]").alias("p"))
    both = padded.select("item_id", F.arrays_zip(F.col("p"), tx.padding_mask("p", "[PAD]").alias("m")).alias("z"))
    return both.select("item_id", F.posexplode("z").alias("pos", "r")).select("item_id", "pos", F.col("r.p").alias("token"), F.col("r.m").alias("mask"))


@query(f"""WITH a AS (SELECT item_id, {ARR} AS a FROM benchmark)
SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, a[i] AS given, a[i + 1] AS wanted FROM a, range(1, 2000) r(i) WHERE i < len(a)""")
def teacher_pairs(t):
    given, wanted = tx.teacher_pairs(tx.words("text"))
    pairs = t.benchmark.select("item_id", F.arrays_zip(given.alias("g"), wanted.alias("w")).alias("z"))
    return pairs.select("item_id", F.posexplode("z").alias("pos", "r")).select("item_id", "pos", F.col("r.g").alias("given"), F.col("r.w").alias("wanted"))


@query(f"""WITH a AS (SELECT item_id, len({ARR}) AS n FROM benchmark) SELECT item_id, CAST(i AS INTEGER) AS step, CAST(n - i AS INTEGER) AS hidden
FROM a, range(1, 2000) r(i) WHERE i <= n""")
def lookahead_mask(t):
    """Per step the number of later steps hidden by the mask."""
    masks = t.benchmark.select("item_id", F.posexplode(tx.lookahead_mask(tx.words("text"))).alias("p", "hidden"))
    return masks.select("item_id", (F.col("p") + 1).alias("step"), "hidden")


@query(f"""WITH a AS (SELECT item_id, list_transform({ARR}, lambda x, i: CASE WHEN i % 3 = 0 THEN '##' || x ELSE x END) AS a FROM benchmark)
SELECT item_id, replace(replace(replace(array_to_string(list_concat(list_concat(['[CLS]'], a), ['[SEP]']), ' '), ' ##', ''), '[CLS]', ''), '[SEP]', '') AS text FROM a""")
def join_wordpieces(t):
    pieces = F.transform(tx.words("text"), lambda x, i: F.when((i + 1) % 3 == 0, F.concat(F.lit("##"), x)).otherwise(x))
    marked = F.concat(F.array(F.lit("[CLS]")), pieces, F.array(F.lit("[SEP]")))
    return t.benchmark.select("item_id", tx.join_wordpieces(marked).alias("text"))


def _layers(t):
    """Each vector cut into 8 layers of 8 numbers."""
    layers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("embedding", k * 8 + 1, F.lit(8)))
    return t.embeddings.select("vec_id", layers.alias("layers"))


@query("""SELECT vec_id, CAST(j - 1 AS INTEGER) AS pos, round(list_sum(list_transform([4, 5, 6, 7], lambda k: embedding[k * 8 + j]::DOUBLE)), 6) AS last_four,
round(list_sum(list_transform([1, 2, 3, 4, 5, 6], lambda k: embedding[k * 8 + j]::DOUBLE)) / 6, 6) AS inner_mean, round(embedding[16 + j]::DOUBLE, 6) AS third
FROM embeddings, range(1, 9) r(j)""")
def layer_vectors(t):
    """Sum of the last layers, mean between the markers, and one layer."""
    l = _layers(t).select("vec_id", F.arrays_zip(
        vx.sum_last("layers", 4).alias("s"), vx.mean_vectors("layers", 1, 1).alias("m"), vx.element_at_vec("layers", 2).alias("e")).alias("z"))
    out = l.select("vec_id", F.posexplode("z").alias("pos", "r")).select(
        "vec_id", "pos", F.col("r.s").alias("last_four"), F.col("r.m").alias("inner_mean"), F.col("r.e").cast("double").alias("third"))
    return round_columns(out, ["last_four", "inner_mean", "third"])


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round((embedding[i]::DOUBLE + 1) / 2, 6) AS shifted, round(embedding[i]::DOUBLE, 6) AS back FROM embeddings, range(1, 65) r(i)""")
def range_shifted(t):
    s = t.embeddings.select("vec_id", vx.range_shift("embedding", -1.0, 2.0).alias("s"))
    both = s.select("vec_id", F.arrays_zip("s", vx.de_range_shift("s", -1.0, 2.0).alias("b")).alias("z"))
    return both.select("vec_id", F.posexplode("z").alias("pos", "r")).select("vec_id", "pos", rounded(F.col("r.s")).alias("shifted"), rounded(F.col("r.b")).alias("back"))


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i <= 64 THEN round(embedding[i]::DOUBLE, 6) WHEN i = 65 THEN label ELSE len(embedding) END AS x FROM embeddings, range(1, 67) r(i)""")
def concat_vectors(t):
    both = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.col("label").cast("double"), F.size("embedding").cast("double")))
    return t.embeddings.select("vec_id", F.posexplode(both).alias("pos", "x")).withColumn("x", rounded("x"))


# --- boxes: line items of an order as digits of an image --------------------------------------------

BOX_SQL = """b AS (SELECT l_orderkey AS filename, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box_seq,
l_linenumber AS label, CAST(l_quantity AS INTEGER) AS width, CAST(20 + l_partkey % 17 AS INTEGER) AS height, CAST(l_suppkey % 50 AS INTEGER) AS "top",
CAST(l_partkey % 90 AS INTEGER) AS "left" FROM lineitem)"""
COAL_SQL = BOX_SQL + """, c AS (SELECT filename, min("left") AS x0, min("top") AS y0, max("left" + width) AS x1, max("top" + height) AS y1, count(*) AS digit_count,
""" + ", ".join(f"coalesce(min(label) FILTER (box_seq = {i}), 11) AS label_{i}" for i in range(1, 7)) + " FROM b GROUP BY 1)"
BIG_SQL = COAL_SQL + """, x AS (SELECT *, CAST(greatest(round_even(x0 - (x1 - x0) * 0.1, 0), 0) AS INTEGER) AS x0_new, CAST(least(round_even(x1 + (x1 - x0) * 0.1, 0), 128) AS INTEGER) AS x1_new,
CAST(greatest(round_even(y0 - (y1 - y0) * 0.1, 0), 0) AS INTEGER) AS y0_new, CAST(least(round_even(y1 + (y1 - y0) * 0.1, 0), 80) AS INTEGER) AS y1_new FROM c)"""


def _nested(t):
    """Orders as images with an array of boxes."""
    box = F.struct(F.col("l_linenumber").alias("label"), F.col("l_quantity").cast("int").alias("width"),
                   (20 + F.col("l_partkey") % 17).cast("int").alias("height"), (F.col("l_suppkey") % 50).cast("int").alias("top"),
                   (F.col("l_partkey") % 90).cast("int").alias("left"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", box.alias("box"))
    return (t.lineitem.groupBy(F.col("l_orderkey").alias("filename"))
            .agg(F.transform(F.array_sort(F.collect_list(place)), lambda s: s["box"]).alias("boxes")))


def _coalesced(t):
    return boxes.coalesce_boxes(boxes.spread_labels(boxes.explode_records(_nested(t), "boxes"), "box_seq", "label"))


def _expanded(t):
    sized = _coalesced(t).withColumns({"img_width": F.lit(128), "img_height": F.lit(80)})
    return boxes.expand_boxes(sized)


@query(f'WITH {BOX_SQL} SELECT filename, CAST(box_seq AS INTEGER) AS box_seq, label, width, height, "top", "left" FROM b')
def nested_boxes(t):
    return boxes.explode_records(_nested(t), "boxes")


@query(f"WITH {COAL_SQL} SELECT filename, x0, y0, x1, y1, digit_count, {', '.join(f'label_{i}' for i in range(1, 7))} FROM c")
def coalesced_boxes(t):
    return _coalesced(t)


@query(f"WITH {BIG_SQL} SELECT filename, x0_new, x1_new, y0_new, y1_new FROM x")
def expanded_boxes(t):
    return _expanded(t).select("filename", "x0_new", "x1_new", "y0_new", "y1_new")


@query(f"WITH {BIG_SQL} SELECT filename, digit_count FROM x WHERE (x1_new - x0_new) * (y1_new - y0_new) >= 64 * digit_count * 9")
def enough_pixels(t):
    return boxes.min_resolution(_expanded(t), 64 * 9).select("filename", "digit_count")


@query(f"""WITH {COAL_SQL} SELECT filename, digit_count, digit_count = {' + '.join(f'(CASE WHEN label_{i} <> 11 THEN 1 ELSE 0 END)' for i in range(1, 7))} AS consistent FROM c""")
def label_counts(t):
    good, bad = boxes.label_count_check(_coalesced(t))
    both = good.withColumn("consistent", F.lit(True)).unionByName(bad.withColumn("consistent", F.lit(False)))
    return both.select("filename", "digit_count", "consistent")


# --- pixels: a vector of 64 numbers as an 8 x 8 image -----------------------------------------------

PX_SQL = """px AS (SELECT vec_id AS filename, CAST((i - 1) % 8 + 1 AS INTEGER) AS x, CAST((i - 1) // 8 + 1 AS INTEGER) AS y, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i))"""


def _pixels(t):
    return (t.embeddings.select(F.col("vec_id").alias("filename"), F.posexplode("embedding").alias("i", "v"))
            .select("filename", (F.col("i") % 8 + 1).alias("x"), F.floor(F.col("i") / 8 + 1).cast("int").alias("y"), F.col("v").cast("double").alias("value")))


@query(f"WITH {PX_SQL} SELECT filename, x - 1 AS x, y - 2 AS y, round(value, 6) AS value FROM px WHERE x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 8")
def cropped_pixels(t):
    window = t.embeddings.select(F.col("vec_id").alias("filename"), F.lit(3).alias("x0_new"), F.lit(5).alias("x1_new"), F.lit(4).alias("y0_new"), F.lit(7).alias("y1_new"))
    return round_columns(boxes.crop_pixels(_pixels(t), window), ["value"]).select("filename", "x", "y", "value")


@query(f"""WITH {PX_SQL}, s AS (SELECT filename, min(value) AS lo, max(value) AS hi, avg(value) AS m, stddev_samp(value) AS sd FROM px GROUP BY 1)
SELECT px.filename, x, y, round((value - m) / sd, 3) AS z FROM px JOIN s USING (filename)""")
def standardised_pixels(t):
    return boxes.standardise_by(_pixels(t), ["filename"], "value").withColumnRenamed("value", "z").select("filename", "x", "y", "z")


@query(f"""WITH {PX_SQL}, s AS (SELECT filename, min(value) AS lo, max(value) AS hi FROM px GROUP BY 1)
SELECT px.filename, x, y, round((value - lo) / hi, 6) AS value FROM px JOIN s USING (filename)""")
def rescaled_pixels(t):
    return round_columns(boxes.rescale_by(_pixels(t), ["filename"], "value"), ["value"]).select("filename", "x", "y", "value")


@query(f"""WITH {PX_SQL} SELECT filename, CAST(a AS INTEGER) AS x, CAST(b AS INTEGER) AS y, round(value, 6) AS value FROM px, range(1, 13) p(a), range(1, 13) q(b)
WHERE x = (a - 1) * 8 // 12 + 1 AND y = (b - 1) * 8 // 12 + 1""")
def resized_pixels(t):
    return round_columns(boxes.resize_pixels(_pixels(t), 12), ["value"]).select("filename", "x", "y", "value")


@query(f"WITH {PX_SQL} SELECT filename, x, y, round(value, 6) AS value FROM px")
def pixel_matrix(t):
    """Pixels to image lines and back."""
    return round_columns(boxes.matrix_to_pixels(boxes.pixels_to_matrix(_pixels(t))), ["value"])
