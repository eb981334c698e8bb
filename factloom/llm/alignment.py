"""Alignment of two tokenizers' tokens over the same bytes by pointer jumping, and counts of linked ids."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import saved
from .vocab import BAD, SECOND, Both, ByteLevel, Pieces, kept

BATCH_TOKENS = 1 << 20  # documents are aligned together until they have so many tokens
GROUP_CELLS = 1 << 22  # links of ids that are made at once


def _holders(ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of the token, of those that end at ``ends``, that holds the last byte of each token of the other side."""
    at_byte = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    return at_byte[others - 1].astype(np.int64)


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For all tokens of A, then of B, the B token that ends their group.

    ``a_end`` and ``b_end`` are the byte ends of tokens that tile the same bytes. Every token points to the token of the
    other side that overlaps it and reaches farthest to the right, or to itself if none reaches farther than a B token or as far as an
    A token; doubling the pointers until they rest leads each to the last token of its component. Several documents one
    after the other are one tiling, as both sides end with each document.
    """
    n = len(a_end)
    to_b = _holders(b_end, a_end)  # reaches at least as far as the A token
    to_a = _holders(a_end, b_end)
    own = np.arange(n, n + len(b_end))
    pointer = np.concatenate([n + to_b, np.where(a_end[to_a] > b_end, to_a, own)])
    while True:
        after = pointer[pointer]
        if np.array_equal(after, pointer):
            return pointer - n
        pointer = after


def group_numbers(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the group of each A and each B token, in their order, and how many groups there are."""
    if not len(a_end):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    last = terminals(a_end, b_end)
    ends = np.zeros(len(b_end), dtype=bool)
    ends[last] = True
    number = (np.cumsum(ends) - 1)[last]
    return number[:len(a_end)], number[len(a_end):], int(ends.sum())


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and copies of every id of a group."""
    key, copies = np.unique(group << 32 | ids, return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, copies


def linked_ids(a_group, a_ids, b_group, b_ids, groups: int, owner: np.ndarray):
    """(owner, A id << 32 | B id, links) for all pairs of ids that share a group; equal ones of an owner are added up.

    Copies of an id in a group are counted, not listed. Groups are taken in slices of about GROUP_CELLS pairs.
    """
    ga, ia, ca = _distinct(a_group, a_ids)
    gb, ib, cb = _distinct(b_group, b_ids)
    many = np.bincount(gb, minlength=groups)
    first = np.cumsum(many) - many
    per_row = many[ga]
    cut = np.searchsorted(np.cumsum(per_row), np.arange(GROUP_CELLS, int(per_row.sum()) + GROUP_CELLS, GROUP_CELLS), "left") + 1
    out, start = [], 0
    for stop in [*cut.tolist(), len(ga)]:
        stop = min(stop, len(ga))
        if stop <= start:
            continue
        reps = per_row[start:stop]
        row = np.repeat(np.arange(start, stop), reps)
        other = first[ga[row]] + np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
        out.append((owner[ga[row]], ia[row] << 32 | ib[other], ca[row] * cb[other]))
        out = [_merged(out)] if len(out) > 3 else out
        start = stop
    return _merged(out)


def _merged(parts):
    owner, key, links = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*parts) if parts else ([], [], [])))
    if not len(key):
        return owner, key, links
    low, small = int(links.max()).bit_length(), (1 << 17) - 1
    if int(((key | key >> 32) & 0xFFFFFFFF).max()) <= small and int(owner.max()).bit_length() + 34 + low < 64:
        # in one number, which sorts without an order, where both vocabularies have at most 2^17 ids
        wide = np.sort((owner << 34 | key >> 32 << 17 | key & small) << low | links)
        links, wide = wide & ((1 << low) - 1), wide >> low
        first = np.flatnonzero(np.append(True, wide[1:] != wide[:-1]))
        wide = wide[first]
        return wide >> 34, (wide >> 17 & small) << 32 | wide & small, np.add.reduceat(links, first)
    order = np.lexsort((key, owner))
    owner, key, links = owner[order], key[order], links[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))
    return owner[new], key[new], np.add.reduceat(links, np.flatnonzero(new))


class Aligner:
    """Both encoders, the byte lengths of their ids, and the ids as text."""

    def __init__(self, path_a: str, path_b: str):
        a, b = kept(ByteLevel, path_a, True), kept(Pieces, path_b)
        self.both = Both(a, b)
        self.len_a, self.len_b = (np.array([len(e) for e in x.entries()], dtype=np.int64) for x in (a, b))
        size = max(len(self.len_a), len(self.len_b))
        self.names = np.array([f"{i}{s}" for s in ",|;" for i in range(size)], dtype=object)
        self.size = size

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Per text: ids of both sides, or nothing where it is empty or one side does not spell a blank and the text."""
        return [self._sides(np.frombuffer(ids, "<u4"), t) if t else None for ids, t in zip(self.both.ids(texts), texts)]

    def _sides(self, mixed: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        second = mixed >= SECOND
        a, b = mixed[~second], mixed[second]
        if not len(b) or (b == BAD).any():
            return None
        b ^= np.uint32(SECOND)
        wide = len(text.encode("utf-8", "replace")) + 1  # the byte level spells every text; the lengths are checked all the same
        return (a, b) if self.len_a[a].sum() == wide == self.len_b[b].sum() else None

    def align(self, texts: list[str | None], with_groups: bool = False):
        """Per text: n_a, n_b, n_groups, n_links, groups as text or its digest, pairs of ids and their links."""
        found = self.tokens([t or "" for t in texts])
        full = [k for k, f in enumerate(found) if f]
        n_a, n_b, n_groups = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        words, pairs, counts = [""] * len(texts), [()] * len(texts), [()] * len(texts)
        n_links = np.zeros(len(texts), dtype=np.int64)
        if full:
            a, b = (np.concatenate([found[k][s] for k in full]).astype(np.int64) for s in (0, 1))
            n_a[full], n_b[full] = ([len(found[k][s]) for k in full] for s in (0, 1))
            of_a, of_b, total = group_numbers(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
            owner = np.empty(total, dtype=np.int64)
            owner[of_b] = np.repeat(full, n_b[full])
            n_groups[:] = np.bincount(owner, minlength=len(texts))
            of_both = np.bincount(of_a, minlength=total), np.bincount(of_b, minlength=total)
            np.add.at(n_links, owner, of_both[0] * of_both[1])
            who, key, times = linked_ids(of_a, a, of_b, b, total, owner)
            ends = np.searchsorted(who, np.arange(len(texts) + 1))
            listed = self._listed(of_a, a, of_b, b, *of_both)
            at = 0
            for k in full:
                pairs[k], counts[k] = key[ends[k]:ends[k + 1]], times[ends[k]:ends[k + 1]]
                size = int(n_a[k] + n_b[k])
                text = "".join(listed[at:at + size])[:-1]
                words[k] = text if with_groups else hashlib.sha256(text.encode()).hexdigest()
                at += size
        return n_a, n_b, n_groups, n_links, words, pairs, counts

    def _listed(self, of_a, a, of_b, b, many_a, many_b) -> list[str]:
        """All ids group by group, those of A first, each with the sign behind it."""
        to_a, to_b = np.cumsum(many_a), np.cumsum(many_b)
        at_a, at_b = np.arange(len(a)) + (to_b - many_b)[of_a], np.arange(len(b)) + to_a[of_b]
        cell = np.zeros(len(a) + len(b), dtype=np.int64)  # a comma, if nothing else
        cell[to_a + to_b - many_b - 1], cell[to_a + to_b - 1] = self.size, 2 * self.size
        cell[at_a] += a
        cell[at_b] += b
        return self.names[cell].tolist()


def alignments(docs: DataFrame, path_a: str, path_b: str, text: str = "text", with_groups: bool = False) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups_sha256 (or ``groups``), pairs and links.

    A is a byte-level BPE file that encodes a blank and the text, B a sentencepiece model that adds the blank itself. Their
    tokens are cut into groups where both end at the same byte. ``groups`` reads ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the
    distinct (A id << 32 | B id) that share a group, ``links`` how often each does. Null and empty texts, and texts that the tokens do
    not spell, have no tokens, no groups and an empty digest. Columns of ``docs`` with these names are replaced.
    """
    out = ["n_a", "n_b", "n_groups", "n_links", "groups" if with_groups else "groups_sha256", "pairs", "links"]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        aligner = kept(Aligner, path_a, path_b)
        for batch in batches:
            names = batch.schema.names
            texts = [None if t is None else t.decode("utf-8", "replace") for t in batch.column(names.index("_text")).to_pylist()]
            rest = batch.drop_columns(["_text"])
            start, size = 0, 0
            for stop in range(1, len(texts) + 1):
                size += len(texts[stop - 1] or "")
                if size >= BATCH_TOKENS or stop == len(texts):
                    columns = aligner.align(texts[start:stop], with_groups)
                    yield pa.RecordBatch.from_arrays(rest.slice(start, stop - start).columns + [pa.array(c, t) for c, t in zip(columns, kinds)],
                                                     rest.schema.names + out)
                    start, size = stop, 0

    keep = [c for c in docs.columns if c not in out]
    body = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("binary").alias("_text"))
    schema = ", ".join([f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
                       + [f"{n} {k}" for n, k in zip(out, ["long"] * 4 + ["string", "array<long>", "array<long>"])])
    return body.mapInArrow(run, schema).withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many rows ids are linked, and whether no other B id is linked in more to this A id.

    At most as many rows as pairs of ids of the two vocabularies, whatever the number of documents.
    """
    counts = saved(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents")))
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("_a")).agg(F.max("documents").alias("_most"))
    return (counts.withColumn("_a", first).join(highest, "_a")
            .select("pair", "documents", (F.col("documents") == F.col("_most")).alias("best")))


def link_report(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links whose pair is linked in as many documents as any pair of its A id, ``count_sum`` adds the
    documents of all links. Rows are told apart by a number of their own, so null and repeated ids and repeated rows are
    counted each. The counts are joined as Spark decides from the size of their saved table. An empty table gives no rows.
    """
    aligned = saved(alignments(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text")), path_a, path_b))
    aligned = aligned.withColumn("_row", F.monotonically_increasing_id())
    counts = saved(pair_counts(aligned))
    links = aligned.select("_row", F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("links").alias("n"))).alias("_p")).select("_row", "_p.*")
    sums = links.join(counts, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("documents")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.join(sums, "_row", "left").select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
