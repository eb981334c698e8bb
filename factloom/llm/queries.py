"""Registered queries of the numbered operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, exact, language, linededup, manifest, mixing, neardup, packing, patched, pseudonyms, quality, shards, tokens, toxicity
from .common import documents, fresh_folder, ready
from .manifest_sql import manifest_sql
from .quality_sql import quality_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARD_BYTES = 1 << 20
PSEUDONYM_KEY = b"a key for tests only"  # a user passes a secret one


def register(sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(ready(spark), folder)
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return run
    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY {LOWERED} ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256({LOWERED}) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY {LOWERED})""")
def op10_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    return exact.content_groups(documents(spark, folder))


@register(f"""
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, ''))) || ':0'), 1, 15))::BIGINT AS k
           FROM documents),
n AS (SELECT d AS depth, k >> (60 - d) AS prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
      FROM h, range(0, 61) r(d) GROUP BY ALL),
a AS (SELECT h.doc_id, h.bytes, n.*, row_number() OVER (PARTITION BY h.doc_id ORDER BY n.depth) AS rn
      FROM h JOIN n ON n.prefix = h.k >> (60 - n.depth) AND n.shard_bytes <= {SHARD_BYTES})
SELECT doc_id, bytes, (1::BIGINT << depth) + prefix AS shard, depth::INTEGER AS depth, 0::BIGINT AS page, shard_bytes, shard_rows
FROM a WHERE rn = 1""")
def op6_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.extendible_shards(documents(spark, folder), SHARD_BYTES)


@register()
def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows, spans = mixing.source_mix(documents(spark, folder))
    return mixing.taken_words(rows, spans).select("doc_id", "size", F.col("source_size"), "target", "taken")


@register()
def op8_grouping_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_pieces(tokens.token_pieces(documents(spark, folder), tokenizer_path()))


def _crc(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@register()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scores = toxicity.toxicity_scores(documents(spark, folder), labels, _crc(5) != 0, keep=["doc_id"])
    return scores.select("doc_id", F.coalesce(_crc(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@register()
def op3_probminhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_classes(documents(spark, folder))


@register()
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    found = language.languages(documents(spark, folder), _crc(4) != 2)
    return found.select("doc_id", F.coalesce(_crc(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@register(quality_sql())
def op2_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder))


@register()
def op7_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonyms.pseudonymised(documents(spark, folder), PSEUDONYM_KEY).select("doc_id", "text", "n_values")


@register()
def op9_winnowed_lines(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.line_report(documents(spark, folder))


@register()
def op11_patched_blocks(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark)
    patched.write_token_files(documents(spark, folder), path, tokenizer_path("byte_bpe_50k.json"))
    return patched.read_token_files(spark, path).drop("file")


@register(manifest_sql())
def op12_butterfly_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.tamper_report(documents(spark, folder))


@register()
def op13_pointer_jumping(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.link_report(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
