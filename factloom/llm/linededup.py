"""Repeated runs of lines: winnowed line fingerprints, runs grown both ways around them, later copies deleted."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import saved

COMMON_SHARE = 1000  # a key with more than this part of all rows is common: there are at most so many


def line_digests(text: str | None) -> tuple[list[int], list[int], list[bytes]]:
    """(number, words, digest) of the lines with words; blanks around a line do not count."""
    lines = [(i, x) for i, line in enumerate((text or "").split("\n")) if (x := line.encode("utf-8", "surrogatepass").strip())]
    return [i for i, _ in lines], [len(x.split()) for _, x in lines], [xxhash.xxh3_128_digest(x) for _, x in lines]


def _windows(words: list[int], least_words: int) -> set[tuple[int, int]]:
    """(from, to) of the shortest runs of ``least_words`` words: from every line one to the right, one to the left."""
    total = [0, *accumulate(words)]
    spans = set()
    for i in range(len(words)):
        end = bisect_left(total, total[i] + least_words)
        if end < len(total):
            spans.add((i, end))
        start = bisect_right(total, total[i + 1] - least_words) - 1
        if start >= 0:
            spans.add((start, i + 1))
    return spans


def minima(words: list[int], digests: list[bytes], least_words: int) -> dict[int, list[tuple[int, int]]]:
    """The fingerprints of a text: lines of smallest digest, the leftmost of equals, of a window, with these windows."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in sorted(_windows(words, least_words)):
        out.setdefault(min(range(a, b), key=digests.__getitem__), []).append((a, b))
    return out


def content_key(digests: list[bytes]) -> tuple[int, int]:
    """Two longs that stand for the content of a run of lines."""
    key = xxhash.xxh3_128_intdigest(b"".join(digests))
    return (key >> 64) - (1 << 63), (key & (1 << 64) - 1) - (1 << 63)


def fingerprint(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


LINES = "_id string, _hash long, numbers array<int>, words array<int>, digests binary, places array<int>, anchors array<long>"
RUNS = "_id string, _hash long, k1 long, k2 long, first int, last int"


def _read(batches, least_words: int):
    """One row per text of enough words: its lines and its fingerprints with their places."""
    for batch in batches:
        rows = []
        for key, h, body in zip(batch["_id"], batch["_hash"], batch["_text"]):
            numbers, words, digests = line_digests(body)
            places = sorted(minima(words, digests, least_words))
            if places:
                rows.append((key, h, numbers, words, b"".join(digests), places, [fingerprint(digests[p]) for p in places]))
        yield pd.DataFrame(rows, columns=["_id", "_hash", "numbers", "words", "digests", "places", "anchors"])


def _grow(batches, least_words: int):
    """Runs around the joined places of a text, line by line to both sides until they hold enough words."""
    for batch in batches:
        rows = []
        for key, h, numbers, words, joined, wanted in zip(*(batch[c] for c in ("_id", "_hash", "numbers", "words", "digests", "wanted"))):
            digests = [joined[i:i + 16] for i in range(0, len(joined), 16)]
            found, wanted = minima(list(words), digests, least_words), set(wanted)
            rows += [(key, h, *content_key(digests[a:b]), numbers[a], numbers[b - 1])
                     for place, spans in found.items() if place in wanted for a, b in spans]
        yield pd.DataFrame(rows, columns=["_id", "_hash", "k1", "k2", "first", "last"])


def _met(rows: DataFrame, groups: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``groups``, one row per key with its number of rows ``_n``, a key of any share of the rows.

    Common keys, at most ``COMMON_SHARE`` by construction, are broadcast; the others are joined as Spark decides.
    """
    total = groups.agg(F.sum("_n")).first()[0] or 0
    common = F.col("_n") * COMMON_SHARE > total
    often, seldom = groups.where(common).drop("_n"), groups.where(~common).drop("_n")
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(often), on, how).unionByName(rest.join(seldom, on, how))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """(_id, _hash, removed): for each text with any, the numbers of its lines in later copies of runs of lines.

    A run is one or more whole lines in a row with ``least_words`` words or more; its first copy, by id (null last),
    then place, stays whole, and all lines of later copies go, but for those that the first copy itself holds. Winnowing:
    in each window of that many words the line of smallest hash is the fingerprint, so equal runs have equal
    fingerprints. Per text its line hashes and the places of its fingerprints are stored. Fingerprints that occur
    once need no further look; the places of the others are joined to their texts' line hashes, and around each
    the run is grown line by line to both sides. Grown runs meet their first copy by content: the first place of a
    fingerprint alone would not do, as its copies may stand in several contexts. Every line of a repeated run, to both
    its ends, lies in a grown run. Fingerprints and runs are counted and reduced to their first place by partial
    aggregates; no group is gathered. Rows of equal id and text count as one document.
    """
    kind = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).cast("string").alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
                         F.col(text).alias("_text"))
    lines = saved(source.mapInPandas(lambda batches: _read(batches, least_words), LINES))
    marks = lines.select("_id", "_hash", F.inline(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("places").alias("place"))))
    twice = saved(marks.groupBy("anchor").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    wanted = (_met(marks, twice, ["anchor"], "left_semi").groupBy("_id", "_hash")
              .agg(F.collect_set("place").alias("wanted")).toDF("_i", "_h", "wanted"))  # at most a text's lines
    known = lines.join(wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")))
    near = saved(known.select("_id", "_hash", "numbers", "words", "digests", "wanted")
                 .mapInPandas(lambda batches: _grow(batches, least_words), RUNS).withColumn("_id", F.col("_id").cast(kind)).select(
        "k1", "k2", F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), F.col("_hash").alias("hash"),
                             F.col("first").alias("first"), F.col("last").alias("last")).alias("at")))
    firsts = saved(near.groupBy("k1", "k2").agg(F.min("at").alias("one"), F.max("at").alias("_other"), F.count(F.lit(1)).alias("_n"))
                   .where(F.col("one") != F.col("_other")).drop("_other"))
    later = _met(near, firsts, ["k1", "k2"], "inner").where(F.col("at") != F.col("one"))
    same = (F.col("at.id").eqNullSafe(F.col("one.id"))) & (F.col("at.hash") == F.col("one.hash"))
    span = F.sequence("at.first", "at.last")
    gone = F.when(same, F.filter(span, lambda i: (i < F.col("one.first")) | (i > F.col("one.last")))).otherwise(span)
    lost = later.select(F.col("at.id").alias("_id"), F.col("at.hash").alias("_hash"), F.explode(gone).alias("_line"))
    return (lost.distinct().groupBy("_id", "_hash").agg(F.sort_array(F.collect_list("_line")).alias("removed")))


def line_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """One row per row of ``docs``: id_col, n_lines, n_removed and the numbers of removed lines (from 0).

    Null and empty texts have one empty line and lose nothing; see ``repeated_lines``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sizes = docs.select(F.col(id_col).alias("_i"), F.xxhash64(body).alias("_h"), F.size(F.split(body, "\n")).cast("long").alias("n_lines"))
    gone = repeated_lines(docs, id_col, text, least_words)
    joined = sizes.join(gone, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select(F.col("_i").alias(id_col), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """``docs`` with the lines of later copies taken out of the texts; all columns and rows stay, also empty texts.

    Other columns may have any names.
    """
    gone = repeated_lines(docs, id_col, text, least_words)
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # the table's own names cannot clash with those used here
    key, body = F.col(own[id_col]), F.col(own[text])
    joined = docs.toDF(*own.values()).join(
        gone, key.eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(body, F.lit(""))) == F.col("_hash")), "left")
    cut = F.array_join(F.filter(F.split(body, "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    result = F.when(F.col("removed").isNull(), body).otherwise(cut)
    return joined.select(*[(result if c == text else F.col(n)).alias(c) for c, n in own.items()])
