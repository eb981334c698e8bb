"""Nested boxes, box geometry and images as pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .groups import attach_aggregates

BLANK_LABEL = 11


def explode_records(df: DataFrame, array_col: str, position: str = "box_seq") -> DataFrame:
    """One row per nested record, with its 1-based position and its fields as columns."""
    others = [c for c in df.columns if c != array_col]
    return (df.select(*others, F.posexplode(array_col).alias("_p", "_r"))
            .select(*others, (F.col("_p") + 1).alias(position), "_r.*"))


def spread_labels(df: DataFrame, position: str, label: str, n: int = 6, blank: int = BLANK_LABEL) -> DataFrame:
    """One label column per position, ``blank`` where the row has another position."""
    return df.withColumns({f"label_{i}": F.when(F.col(position) == i, F.col(label)).otherwise(F.lit(blank))
                           for i in range(1, n + 1)})


def coalesce_boxes(df: DataFrame, image: str = "filename", n: int = 6) -> DataFrame:
    """One box around all boxes of an image, the digit count and the label at each position."""
    corner = {"x0": F.min("left"), "y0": F.min("top"), "x1": F.max(F.col("left") + F.col("width")),
              "y1": F.max(F.col("top") + F.col("height"))}
    labels = [F.min(f"label_{i}").alias(f"label_{i}") for i in range(1, n + 1)]
    return df.groupBy(image).agg(*[c.cast("int").alias(k) for k, c in corner.items()],
                                 F.count(F.lit(1)).alias("digit_count"), *labels)


def expand_boxes(df: DataFrame, share: float = 0.1, image_width: str = "img_width",
                 image_height: str = "img_height") -> DataFrame:
    """Grow a box by a share of its size on every side, inside the image."""
    out = {}
    for axis, limit in (("x", image_width), ("y", image_height)):
        lo, hi = F.col(f"{axis}0"), F.col(f"{axis}1")
        out[f"{axis}0_new"] = F.greatest(F.bround(lo - (hi - lo) * share), F.lit(0.0)).cast("int")
        out[f"{axis}1_new"] = F.least(F.bround(hi + (hi - lo) * share), F.col(limit).cast("double")).cast("int")
    return df.withColumns(out)


def _label_count(n: int, blank: int):
    return sum((F.when(F.col(f"label_{i}") != blank, 1).otherwise(0) for i in range(1, n + 1)), F.lit(0))


def label_count_check(df: DataFrame, n: int = 6, blank: int = BLANK_LABEL) -> tuple[DataFrame, DataFrame]:
    """(consistent, mismatched): images whose digit count equals, or differs from, their label count."""
    same = F.col("digit_count") == _label_count(n, blank)
    return df.where(same), df.where(~same)


def min_resolution(df: DataFrame, pixels_per_digit: int = 64) -> DataFrame:
    """Images with enough pixels per digit in the grown box."""
    area = (F.col("x1_new") - F.col("x0_new")) * (F.col("y1_new") - F.col("y0_new"))
    return df.where(area >= F.col("digit_count") * pixels_per_digit)


def crop_pixels(pixels: DataFrame, boxes: DataFrame, image: str = "filename") -> DataFrame:
    """Pixels inside the grown box (one pixel of margin), with the origin moved to 1, 1.

    ``pixels``: image, x, y, value, 1-based; ``boxes``: image, x0_new, x1_new, y0_new, y1_new.
    """
    keep = boxes.select(image, "x0_new", "x1_new", "y0_new", "y1_new")
    inside = (F.col("x").between(F.col("x0_new") - 1, F.col("x1_new") + 1)
              & F.col("y").between(F.col("y0_new") - 1, F.col("y1_new") + 1))
    shift = {a: F.col(a) - F.greatest(F.col(f"{a}0_new") - 2, F.lit(0)) for a in ("x", "y")}
    return pixels.join(keep, image).where(inside).withColumns(shift).drop("x0_new", "x1_new", "y0_new", "y1_new")


def rescale_by(df: DataFrame, by, col: str) -> DataFrame:
    """Per group: (value - min) / max; a zero maximum gives NULL."""
    stats = attach_aggregates(df, by, {"_lo": F.min(col), "_hi": F.max(col)})
    return stats.withColumn(col, F.try_divide(F.col(col) - F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def standardise_by(df: DataFrame, by, col: str, digits: int | None = 3) -> DataFrame:
    """Per group z-score with the sample sd, rounded; a constant group gives NULL."""
    stats = attach_aggregates(df, by, {"_m": F.avg(col), "_s": F.stddev_samp(col)})
    z = F.try_divide(F.col(col) - F.col("_m"), F.col("_s"))
    return stats.withColumn(col, z if digits is None else F.round(z, digits)).drop("_m", "_s")


def resize_pixels(pixels: DataFrame, n: int = 32, image: str = "filename") -> DataFrame:
    """Nearest-neighbour resize of every image to n x n (1-based pixels).

    Each source pixel is written to the target cells it covers, so no grid is joined.
    """
    sized = attach_aggregates(pixels, [image], {"_w": F.max("x"), "_h": F.max("y")})

    def targets(c: str, size: str):
        # target t (0-based) reads source floor(t * size / n), so source s serves t in [ceil(s*n/size), ceil((s+1)*n/size) - 1]
        s = F.col(c) - 1
        first = F.ceil(s * n / F.col(size)).cast("int")
        last = (F.ceil((s + 1) * n / F.col(size)) - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last))
    return (sized.withColumn("_tx", F.explode(targets("x", "_w"))).withColumn("_ty", F.explode(targets("y", "_h")))
            .withColumn("x", F.col("_tx") + 1).withColumn("y", F.col("_ty") + 1).drop("_w", "_h", "_tx", "_ty"))


def pixels_to_matrix(pixels: DataFrame, image: str = "filename") -> DataFrame:
    """One row per image line: image, y, and the values ordered by x."""
    line = F.array_sort(F.collect_list(F.struct("x", "value")))
    return pixels.groupBy(image, "y").agg(F.transform(line, lambda s: s["value"]).alias("line"))


def matrix_to_pixels(lines: DataFrame, image: str = "filename") -> DataFrame:
    """Back to one row per pixel."""
    return (lines.select(image, "y", F.posexplode("line").alias("_p", "value"))
            .select(image, (F.col("_p") + 1).alias("x"), "y", "value"))
