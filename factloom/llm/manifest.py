"""Merkle manifest of a table by butterfly exchange.

Leaves of a group lie in order in blocks of fanout^levels, each block a task's work: its subtree and every leaf's siblings
inside. Then, round by round, each block takes the roots of the aligned group of ``fanout`` subtrees around its own (one
from a partner block in each), hashes the common ancestor itself, as all its partners do, and keeps the others as proof. After
the last round every block knows the root and its upper proof; nothing is handed down. The groups' roots form the
leaves of one more tree in the same way.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.order import join_null_safe, with_position
from .common import saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<before:string,after:string>>"


def record_text(columns) -> Column:
    """Each value as its UTF-8 byte count, a colon and the value; null as a minus sign."""
    def one(c):
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))
    return F.concat(*[one(c) for c in columns])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def proof_digest(proof: Column) -> Column:
    """Hash of all siblings of a proof, level by level, left to right; of nothing where there are none."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _subtree(fanout: int, levels: int):
    """All leaves of one block: their siblings inside it, and the block's root."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_at", ignore_index=True)
        n, total = len(frame), int(frame["_n"].iat[0])
        nodes, before, after = frame["_leaf"].tolist(), [[] for _ in range(n)], [[] for _ in range(n)]
        size, wide = 1, total  # leaves under a node; nodes of this level in the whole group
        for _ in range(levels):
            if wide <= 1:
                break
            for i in range(n):
                k = i // size
                first = k - k % fanout
                before[i].append("".join(nodes[first:k]))
                after[i].append("".join(nodes[k + 1:first + fanout]))
            nodes = [_hash(nodes[k:k + fanout]) for k in range(0, len(nodes), fanout)]
            size, wide = size * fanout, -(-wide // fanout)
        out = frame[["_g", "_block", "_at"]].copy()
        out["_before"], out["_after"], out["_root"] = before, after, nodes[0]
        return out
    return run


def _blocks_climb(blocks: DataFrame, fanout: int) -> DataFrame:
    """Rounds of the exchange over blocks (_g, _block, _blocks, _root): (_g, _block, _root of the group, _upper proof).

    In round r the subtree of fanout^r blocks that starts at s, the last one maybe with fewer, is asked through its block
    number (own number mod its size), so that answers are spread over its blocks. Rows are blocks, not leaves.
    """
    state = saved(blocks.withColumn("_upper", F.array().cast(SIBLINGS)), few_files=True)
    most = state.agg(F.max("_blocks")).first()[0] or 0
    reach = 1  # blocks under a node
    while reach < most:
        own = F.expr(f"_block div {reach}")
        ask = (state.where(F.col("_blocks") > reach)
               .withColumn("_k", own % fanout)
               .withColumn("_s", F.explode(F.sequence(own - own % fanout, own - own % fanout + fanout - 1)))
               .where(F.col("_s") * reach < F.col("_blocks"))
               .withColumn("_ask", F.expr(f"_s * {reach} + (_block % {reach}) % least({reach}, _blocks - _s * {reach})")))
        told = state.select(F.col("_g").alias("_tg"), F.col("_block").alias("_ask_block"), F.col("_root").alias("_told"))
        met = ask.join(told, (ask["_g"] == told["_tg"]) & (ask["_ask"] == told["_ask_block"]))
        swapped = (met.groupBy("_g", "_block").agg(F.first("_blocks").alias("_blocks"), F.first("_upper").alias("_upper"), F.first("_k").alias("_k"),
                                                   F.array_sort(F.collect_list(F.struct("_s", "_told"))).alias("_all"))  # fanout at most
                   .withColumn("_all", F.transform("_all", lambda t: t["_told"])).withColumn("_k", F.col("_k").cast("int")))
        sibling = F.struct(F.array_join(F.slice("_all", F.lit(1), F.col("_k")), "").alias("before"),
                           F.array_join(F.slice("_all", F.col("_k") + 2, F.lit(fanout)), "").alias("after"))
        up = swapped.select("_g", "_block", "_blocks", digest(F.array_join("_all", "")).alias("_root"),
                            F.concat("_upper", F.array(sibling)).cast(SIBLINGS).alias("_upper"))
        still = state.where(F.col("_blocks") <= reach).select("_g", "_block", "_blocks", "_root", "_upper")
        state = saved(up.unionByName(still), few_files=True)
        reach *= fanout
    return state.select("_g", "_block", "_root", "_upper")


def group_trees(leaves: DataFrame, order: list, leaf: str, group: str, fanout: int = 3, levels: int = 7) -> DataFrame:
    """``leaves`` with ``root`` and ``proof`` of the tree of their ``group`` in the order of ``order``.

    While a level has several nodes, every ``fanout`` consecutive ones, the last run maybe fewer, become the hash of
    their hashes; a lone leaf is its own root. ``proof`` lists, from the leaf up, the hashes ``before`` and ``after`` its node
    in the run. Nulls of ``group`` are a group. Positions come from ranges of the whole table, so a group may have
    any share of the rows; a task holds fanout^levels leaves.
    """
    spot = F.struct(F.col(group).alias("g"))  # never null, so it joins and groups as one value
    placed = with_position(leaves, [F.col(group).asc_nulls_first(), *order], "_pos")
    sizes = placed.groupBy(group).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n"))
    placed = join_null_safe(placed, sizes, [group]).withColumn("_at", F.col("_pos") - F.col("_start")).drop("_pos", "_start")
    width = fanout ** levels
    placed = saved(placed.withColumn("_g", digest(F.to_json(spot))).withColumn("_block", F.expr(f"_at div {width}")))
    inside = saved(placed.select("_g", "_block", "_at", "_n", F.col(leaf).alias("_leaf")).groupBy("_g", "_block").applyInPandas(
        _subtree(fanout, levels), "_g string, _block long, _at long, _before array<string>, _after array<string>, _root string"))
    blocks = (inside.groupBy("_g", "_block").agg(F.first("_root").alias("_root"))
              .join(placed.groupBy("_g").agg(F.expr(f"(max(_n) + {width - 1}) div {width}").alias("_blocks")), "_g"))
    upper = _blocks_climb(blocks.select("_g", "_block", "_blocks", "_root"), fanout)
    lower = F.zip_with("_before", "_after", lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    found = (inside.drop("_root").join(upper, ["_g", "_block"])
             .select("_g", "_at", F.col("_root").alias("root"), F.concat(lower, F.col("_upper")).cast(SIBLINGS).alias("proof")))
    return placed.join(found, ["_g", "_at"]).drop("_g", "_at", "_n", "_block")


def manifest(docs: DataFrame, fields=FIELDS, id_col: str = "doc_id", group: str = "source", extra: dict | None = None,
             fanout: int = 3, levels: int = 7) -> DataFrame:
    """One row per row of ``docs``: id_col, group, leaf, subroot, root, proof.

    A leaf is the hash of the row's ``fields`` (see ``record_text``); the rows of a ``group`` in order of ``id_col``, nulls first
    and equal ids by their leaf, form a tree with ``subroot`` on top, and the subroots, in order of the group's bytes and null
    first, the tree with ``root``. ``proof`` runs from the leaf to the root. ``extra`` adds columns (name -> expression over
    ``docs``). Texts are hashed where they are read. Repeated rows are leaves each; an empty table gives no rows;
    other columns are not read, so their names do not matter. ``group`` is text.
    """
    own = {"key": F.col(id_col), "group": F.col(group), "leaf": digest(record_text(fields)), **{f"x{i}": e for i, e in enumerate((extra or {}).values())}}
    leaves = docs.select(*[e.alias(f"_{n}") for n, e in own.items()])
    below = group_trees(leaves, [F.col("_key").asc_nulls_first(), F.col("_leaf")], "_leaf", "_group", fanout, levels)
    below = saved(below.withColumnsRenamed({"root": "_subroot", "proof": "_lower"}))
    groups = below.groupBy("_group").agg(F.first("_subroot").alias("_subroot")).withColumn("_all", F.lit("all"))
    above = group_trees(groups, [F.col("_group").asc_nulls_first()], "_subroot", "_all", fanout, levels)
    whole = join_null_safe(below, above.select("_group", "root", "proof"), ["_group"])
    return whole.select(F.col("_key").alias(id_col), F.col("_group").alias(group), F.col("_leaf").alias("leaf"),
                        F.col("_subroot").alias("subroot"), "root", F.concat("_lower", "proof").alias("proof"),
                        *[F.col(f"_x{i}").alias(n) for i, n in enumerate(extra or {})])


def tamper_report(docs: DataFrame, fanout: int = 3, levels: int = 7) -> DataFrame:
    """The manifest's digests, and which rows still verify after the text of every other document lost its newlines.

    Documents with an even crc32 of their id are tampered with; a null id is not. The proof stays that of the manifest.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = [F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")) if c == "text" else c for c in FIELDS]
    rows = manifest(docs, extra={"claim": digest(record_text(tampered))}, fanout=fanout, levels=levels)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                      folded(F.col("claim"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
