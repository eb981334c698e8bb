"""Running text to keyword sentences, clauses, cause/effect pairs and token sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators.order import exact_quantiles
from ..operators.sets import union_all


def keyword_sentences(df: DataFrame, key: str, text: str, keywords, min_words: int = 5) -> DataFrame:
    """(key, sentence_ref, text): sentences of at least ``min_words`` words with any keyword."""
    found = df.select(key, F.posexplode(tx.sentences(tx.strip_markers(text))).alias("sentence_ref", "text"))
    return found.where(tx.contains_keyword("text", keywords) & (tx.word_count("text") >= min_words))


def keyword_clauses(df: DataFrame, key: str, text: str, keywords) -> DataFrame:
    """(key, sentence_ref, clause_ref, text): qualifying clauses of keyword sentences, else the sentence with -1."""
    rows = keyword_sentences(df, key, text, keywords)
    return (rows.select(key, "sentence_ref", F.explode(tx.clauses_with_keyword("text", keywords)).alias("c"))
            .select(key, "sentence_ref", "c.clause_ref", "c.text"))


def cause_effect(df: DataFrame, key: str, text: str, connectives: dict[str, bool], min_words: int = 5) -> DataFrame:
    """(key, searchword, incidence, effect, cause) around connectives.

    ``connectives`` maps a word to whether the cause comes last ('because') or first ('therefore').
    ``incidence`` numbers the sentences with the word in a text.
    """
    clean = df.select(key, tx.strip_markers(text).alias("_t"))
    parts = []
    for word, cause_last in connectives.items():
        pattern = rf"(?U){tx.SENTENCE_START}\b{tx.quoted(word)}\b{tx.SENTENCE_END}"
        rows = clean.select(key, F.posexplode(tx.sentences("_t", pattern)).alias("incidence", "_s"))
        before, after = tx.around_keyword("_s", word)
        effect, cause = (before, after) if cause_last else (after, before)
        parts.append(rows.select(key, F.lit(word).alias("searchword"), "incidence",
                                 tx.ascii_only(effect).alias("effect"), tx.ascii_only(cause).alias("cause"),
                                 effect.alias("_e"), cause.alias("_c"))
                     .where((tx.word_count("_e") >= min_words) & (tx.word_count("_c") >= min_words)).drop("_e", "_c"))
    return union_all(*parts)


def crop_by_length(df: DataFrame, arr: str, low: int, q: float, fit_df: DataFrame | None = None) -> DataFrame:
    """Rows whose array length lies between ``low`` and a quantile of the lengths of ``fit_df``."""
    base = df if fit_df is None else fit_df
    limit = exact_quantiles(base.select(F.size(arr).alias("_n")), "_n", {"_q": q}).scalar()
    return df.withColumn("_limit", F.floor(limit)).where(F.size(arr).between(F.lit(low), F.col("_limit"))).drop("_limit")


def with_searchwords(df: DataFrame, arr: str, words) -> DataFrame:
    """Positions of the wanted tokens in each token array; rows without any are left out."""
    return df.withColumn("positions", tx.token_positions(arr, words)).where(F.size("positions") > 0)
