"""Quality rules: base counts, and distance of a document's character classes and common words from its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BLANK, let

RUN = 8                # words in a repeated window
MAX_LANGUAGES = 256    # up to so many rows of references, one per language, are broadcast
CLASSES = ["lower", "upper", "digit", "blank", "stop", "other"]
SYMBOLS = r"[^#*$%&|<>]+"
MARKS = [chr(c) for c in range(0x30, 0x7F)]  # one character per common word


def repeat_words(words: Column, run: int = RUN) -> Column:
    """Words inside windows of ``run`` words that occur twice or more in the text, the first time included.

    ``run`` is a power of two. Windows are compared by 64-bit hashes, put together from those of their halves. Texts without a repeated window end after one hash
    set; for others the windows are sorted, and the places of equal neighbours are merged.
    """
    def covered(places):
        gaps = F.transform(places, lambda p, i: F.when(
            i < F.size(places) - 1, F.least(F.lit(run), F.get(places, i + 1) - p)).otherwise(run))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def repeated(windows):
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(
            (x["h"] == F.get(s, i - 1)["h"]), F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))),
            lambda x: x["i"])))
        return let(places, covered)

    def doubled(hashes, width):
        if width == run:
            return let(F.slice(hashes, F.lit(1), F.size(hashes) - (run - 1)), lambda w: F.when(
                F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(repeated(w)))
        joined = F.zip_with(hashes, F.slice(hashes, F.lit(1 + width), F.size(hashes)), lambda a, b: F.xxhash64(a, b))
        return let(joined, lambda h: doubled(h, 2 * width))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= run, 0).otherwise(let(hashed, lambda h: doubled(h, 1))).cast("long")


def class_counts(text: Column, rest: Column) -> list[Column]:
    """Characters of each class; ``rest`` is the text without letters."""
    n, upper = F.char_length(text), F.char_length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    left = F.char_length(rest)
    digit, stop = (F.char_length(F.regexp_replace(rest, p, "")) for p in (r"[^\p{Nd}]+", r"[^.,]+"))
    blank = F.char_length(F.regexp_replace(rest, r"[^\x20\x09-\x0D]+", ""))
    return [n - left - upper, upper, digit, blank, stop, left - digit - blank - stop]


def _marks(text: Column) -> Column:
    """The common words of a text, in order, as one character each: that of the word's rank."""
    marks = F.array(*[F.lit(m) for m in MARKS])
    found = F.regexp_extract_all(F.lower(text), F.col("common_pattern"), F.lit(0))
    return F.array_join(F.transform(found, lambda w: F.get(marks, F.array_position("common_words", w).cast("int") - 1)), "")


def divergence(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (square root, base 2) of a histogram of counts from reference shares."""
    def part(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def whole(p):
        terms = F.zip_with(p, shares, lambda x, q: (part(x, (x + q) / 2) + part(q, (x + q) / 2)) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)))

    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, let(F.transform(counts, lambda c: c / total), whole))


def language_references(docs: DataFrame, text: str, lang: str, common: int) -> DataFrame:
    """One row per language: class shares, its ``common`` most frequent words and the shares of their counts and the rest.

    Counts cover all texts; equal counts are ordered by the word. Null is a language of its own.
    """
    rows = docs.select(F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_rest", F.regexp_replace("_text", r"\p{L}+", ""))
    counts = class_counts(F.col("_text"), F.col("_rest"))
    classes = (rows.select("_lang", *[c.cast("long").alias(n) for c, n in zip(counts, CLASSES)]).groupBy("_lang")
               .agg(*[F.sum(n).alias(n) for n in CLASSES])
               .select("_lang", F.array(*CLASSES).cast("array<double>").alias("_c"))
               .select("_lang", F.transform("_c", lambda x: x / F.greatest(F.lit(1.0), F.aggregate(
                   "_c", F.lit(0.0), lambda a, b: a + b))).alias("class_shares")))
    words = rows.select("_lang", F.explode(F.split(F.lower("_text"), r"[^\p{L}]+")).alias("_w"))
    seen = words.where("_w <> ''").groupBy("_lang", "_w").agg(F.count(F.lit(1)).alias("_n"))
    total = seen.groupBy("_lang").agg(F.sum("_n").alias("_all"))
    order = Window.partitionBy("_lang").orderBy(F.col("_n").desc(), "_w")
    top = (seen.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= common)
           .groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("_rank", "_w", "_n"))).alias("_top")))
    joined = top.toDF("_l2", "_top").join(total.toDF("_l3", "_all"), F.expr("_l2 <=> _l3"))
    return classes.join(joined, F.expr("_lang <=> _l2"), "left").select(
        F.col("_lang").alias("ref_lang"), "class_shares",
        F.col("_top._w").alias("common_words"), F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(
            F.col("_top._w"), "|"), F.lit(r")(?!\p{L})")).alias("common_pattern"),
        F.concat(F.transform("_top", lambda x: x["_n"] / F.col("_all")), F.array(
            F.lit(1.0) - F.aggregate("_top", F.lit(0.0), lambda a, x: a + x["_n"] / F.col("_all")))).alias("word_shares"))


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", common: int = 20,
           class_limit: float = 0.25, word_limit: float = 0.30, least_chars: int = 200, least_words: int = 50) -> DataFrame:
    """One row per row of ``docs``: id_col, base counts, base_failed, class_distance, word_distance, kept.

    Base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (see the module's rules). A document is kept if
    the base rules pass and neither distance from its language's reference is above its limit. The class distance is
    judged from ``least_chars`` characters on, the word distance from ``least_words`` words on; shorter texts pass.
    Null texts count as empty: no words, so the base rules fail. Null ``lang`` is a language of its own. Rows are
    judged one by one; nothing but the references (one row per language) is brought together. They are broadcast
    up to MAX_LANGUAGES, above that Spark decides how they are joined. Other columns and repeated ids do not matter.
    """
    if not 0 < common <= len(MARKS):
        raise ValueError(f"1 to {len(MARKS)} common words")
    references = language_references(docs, text, lang, common)
    if docs.select(lang).distinct().limit(MAX_LANGUAGES + 1).count() <= MAX_LANGUAGES:
        references = F.broadcast(references)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.join(references, F.expr("_lang <=> ref_lang"), "left")
    rows = rows.withColumn("_rest", F.regexp_replace("_text", r"\p{L}+", "")).withColumn(
        "_words", F.array_remove(F.split("_text", BLANK), ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = class_counts(F.col("_text"), F.col("_rest"))
    marks = F.array(*[F.lit(m) for m in MARKS])
    rows = rows.select(
        "_id", F.size("_words").cast("long").alias("n_words"),
        F.array(*[c.cast("double") for c in counts]).alias("_classes"), "class_shares", "word_shares",
        F.char_length(F.regexp_replace("_rest", SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        let(_marks(F.col("_text")), lambda s: F.transform(F.slice(marks, F.lit(1), F.size("common_words")), lambda m: (
            F.octet_length(s) - F.octet_length(F.replace(s, m, F.lit("")))).cast("double"))).alias("_found"))
    rows = rows.withColumn("_found", F.coalesce("_found", F.array().cast("array<double>")))
    found = F.aggregate("_found", F.lit(0.0), lambda a, b: a + b)
    all_words = F.concat("_found", F.array(F.greatest(F.lit(0.0), F.col("n_words") - found)))
    chars = F.aggregate("_classes", F.lit(0.0), lambda a, b: a + b)
    rows = rows.select(
        F.col("_id").alias(id_col), "n_words", (chars - F.get("_classes", F.lit(3))).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        F.when(chars >= least_chars, F.round(divergence(F.col("_classes"), F.col("class_shares")), 6)).alias("class_distance"),
        F.when(F.col("n_words") >= least_words, F.round(divergence(all_words, F.col("word_shares")), 6)).alias("word_distance"))
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > class_limit) | (
        F.coalesce(F.col("word_distance"), F.lit(0.0)) > word_limit)
    return rows.withColumn("kept", ~F.col("base_failed") & ~far)
