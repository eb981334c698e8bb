"""The corpus pipeline: toxic documents go, copies go, near copies go, sources are mixed, and the mix is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from factloom.llm import exact, mixing, neardup, packing, tokens, toxicity
from factloom.llm.common import documents, ready, saved
from factloom.llm.queries import tokenizer_path

BLOCK_WORDS = 512


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, taught by the labels, does not score 0.5 or more."""
    ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    may_learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    return toxicity.toxicity_scores(docs, labels, may_learn).where("predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ready(spark)
    return exact.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ready(spark)
    return neardup.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents and parts of documents that a mix of the sources takes, once per pass."""
    ready(spark)
    rows, spans = mixing.source_mix(docs, block_words=BLOCK_WORDS)
    return mixing.mixed_documents(docs, rows, spans)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    ready(spark)
    return packing.pack_pieces(tokens.token_pieces(docs, tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("packing", pack)]

ORACLE_SQL = None  # a trained network, near duplicates and a genetic search are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each works on the saved table of the one before."""
    ready(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
