"""Class TF-IDF: which words set one class of texts apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import term_tokens
from ..operators.groups import top_n_per_group


def default_stop_words() -> list[str]:
    """The English stop words that ship with Spark."""
    from pyspark.ml.feature import StopWordsRemover
    return StopWordsRemover.loadDefaultStopWords("english")


def class_tfidf(df: DataFrame, cls: str, text: str, stop_words=None) -> DataFrame:
    """(class, word, n, tf, idf, score).

    tf = share of the word among the class's words; idf = ln(number of texts / total count of the word).
    Texts are never joined together: words are counted per class, merged before the shuffle.
    """
    stop = default_stop_words() if stop_words is None else list(stop_words)
    # rows without a class are left out here, so that both uses of the counts share one shuffle
    tokens = df.where(F.col(cls).isNotNull()).select(cls, F.explode(term_tokens(text)).alias("word")).where("word is not null")
    if stop:
        tokens = tokens.where(~F.col("word").isin(*stop))
    counts = tokens.groupBy(cls, "word").agg(F.count(F.lit(1)).alias("n"))
    per_class = counts.groupBy(cls).agg(F.sum("n").alias("_w"))
    # a word has at most one row per class
    per_word = F.sum("n").over(Window.partitionBy("word"))
    texts = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    return (counts.withColumn("_t", per_word).join(per_class, cls)
            .withColumn("tf", F.col("n") / F.col("_w"))
            .withColumn("idf", F.ln(texts / F.col("_t")))
            .withColumn("score", F.col("tf") * F.col("idf"))
            .select(cls, "word", "n", "tf", "idf", "score"))


def class_top_words(scored: DataFrame, cls: str, n: int = 20, exclude=(), show: int = 12) -> DataFrame:
    """The n best words per class; of these, without the excluded ones, the first ``show``."""
    best = top_n_per_group(scored, [cls], [F.desc("score"), F.asc("word")], n, "rank")
    kept = best.where(~F.col("word").isin(*exclude)) if exclude else best
    return top_n_per_group(kept, [cls], [F.asc("rank")], show, "place").drop("rank")
