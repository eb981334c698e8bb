"""Token files in patched frame-of-reference blocks.

A file is a row of segments, each closed by a newline byte (the text writer of Spark puts it there, so files come from
its commit protocol and can lie in any store). All numbers are little-endian:

    "PFOR", documents u4, ids u8, blocks u4, bytes of the keys u4, bytes of the blocks u8
    per document: length of its key i4 (-1: null); then the keys in UTF-8; per document: number of ids u8
    per block: its first byte, counted from the first block, u8
    blocks

A block holds BLOCK ids: lowest id u4, width u1, number of exceptions u1, bytes of an exception's high part u1 (1, 2 or
4); the low ``width`` bits of id - lowest, packed from the lowest bit; positions of the exceptions, u1 each; their high parts. The
width covers the share ``covered`` of the block's differences, the rest are exceptions. A last, shorter block is filled up.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import saved
from .vocab import ByteLevel, kept

BLOCK = 128
HEAD, MAGIC = struct.Struct("<4sIQIIQ"), b"PFOR"
FIXED = 7  # bytes of a block before its packed bits
SEGMENT_IDS = 1 << 20  # a segment is closed after the document that reaches them
FILE_SEGMENTS = 16


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of bits of each number below 2^32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def encode_blocks(ids: np.ndarray, covered: float = 0.9) -> tuple[bytes, np.ndarray]:
    """Blocks of ``ids`` (unsigned 32-bit) and the first byte of each."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.empty(0, dtype="<u8")
    x = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1])]).astype(np.int64).reshape(n, BLOCK)
    low = x.min(axis=1)
    x -= low[:, None]
    place = min(BLOCK, max(1, int(np.ceil(covered * BLOCK)))) - 1
    width = _bits(np.partition(x, place, axis=1)[:, place])
    high = x >> width[:, None]
    block, at = np.nonzero(high)
    high = high[block, at]
    count = np.bincount(block, minlength=n)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, block, high)
    part = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    ends = np.cumsum(FIXED + BLOCK // 8 * width + count * (1 + part))
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(ends[-1], dtype=np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[starts + 4], out[starts + 5], out[starts + 6] = width, count, part
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(x[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, count=int(w), bitorder="little")
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        out[(starts[rows] + FIXED)[:, None] + np.arange(packed.shape[1])] = packed
    rank = np.arange(len(block)) - (np.cumsum(count) - count)[block]
    first = starts[block] + FIXED + BLOCK // 8 * width[block]
    out[first + rank] = at
    for j in range(4):
        has = part[block] > j
        out[(first + count[block] + rank * part[block] + j)[has]] = (high[has] >> 8 * j) & 255
    return out.tobytes(), starts.astype("<u8")


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks at ``starts`` in ``data`` (bytes), in this order, the filling included."""
    starts, n = starts.astype(np.int64), len(starts)
    low = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4").reshape(n).astype(np.int64)
    width, count, part = (data[starts + k].astype(np.int64) for k in (4, 5, 6))
    out, data = np.zeros((n, BLOCK), dtype=np.uint32), np.append(data, np.zeros(4, dtype=np.uint8))
    for w in np.unique(width[width > 0]):
        rows, bit = np.flatnonzero(width == w), np.arange(BLOCK) * w
        packed = data[(starts[rows] + FIXED)[:, None] + np.arange(BLOCK // 8 * w + 4)]
        found = np.zeros((len(rows), BLOCK), dtype=np.uint64 if w > 25 else np.uint32)
        for j in range((int(w) + 14) // 8):  # bytes that a number may lie in
            found |= packed[:, (bit >> 3) + j].astype(found.dtype) << found.dtype.type(8 * j)
        out[rows] = found >> (bit & 7).astype(found.dtype) & found.dtype.type((1 << int(w)) - 1)
    block = np.repeat(np.arange(n), count)
    rank = np.arange(len(block)) - (np.cumsum(count) - count)[block]
    first = starts[block] + FIXED + BLOCK // 8 * width[block]
    high = np.zeros(len(block), dtype=np.int64)
    for j in range(4):
        has = part[block] > j
        high[has] |= data[(first + count[block] + rank * part[block] + j)[has]].astype(np.int64) << 8 * j
    out[block, data[first + rank]] |= (high << width[block]).astype(np.uint32)
    out += low[:, None].astype(np.uint32)
    return out.astype("<u4", copy=False).reshape(-1)


def segment(keys: list[str | None], ids: list[bytes], covered: float = 0.9) -> bytes:
    """Documents as a segment without its closing newline."""
    names = [None if k is None else k.encode() for k in keys]
    blob = b"".join(k or b"" for k in names)
    counts = np.array([len(i) // 4 for i in ids], dtype="<u8")
    payload, starts = encode_blocks(np.frombuffer(b"".join(ids), dtype="<u4"), covered)
    return b"".join([HEAD.pack(MAGIC, len(keys), int(counts.sum()), len(starts), len(blob), len(payload)),
                     np.array([-1 if k is None else len(k) for k in names], dtype="<i4").tobytes(), blob, counts.tobytes(),
                     starts.tobytes(), payload])


class Segment:
    """A segment of a file's bytes from ``at`` on; ``end`` is the byte behind its newline."""

    def __init__(self, data: bytes, at: int):
        magic, docs, self.n_ids, blocks, names, size = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no token segment at byte {at}")
        at += HEAD.size
        lengths = np.frombuffer(data, "<i4", docs, at)
        at += 4 * docs
        self.keys = []
        for n in lengths:
            self.keys.append(None if n < 0 else data[at:at + n].decode())
            at += max(n, 0)
        self.counts = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.starts = np.frombuffer(data, "<u8", blocks, at)
        at += 8 * blocks
        self.blocks = np.frombuffer(data, np.uint8, size, at)
        self.end = at + size + 1

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to before ``last``; only the blocks that hold them are decoded."""
        last = self.n_ids if last is None else min(last, self.n_ids)
        if first >= last:
            return np.empty(0, dtype="<u4")
        found = decode_blocks(self.blocks, self.starts[first // BLOCK:-(-last // BLOCK)])
        return found[first % BLOCK:first % BLOCK + last - first]


def segments(data: bytes):
    at = 0
    while at < len(data):
        part = Segment(data, at)
        yield part
        at = part.end


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id",
                      text: str = "text", covered: float = 0.9) -> None:
    """Token ids of all ``docs`` as files in a new folder ``path``, in ascending order of ``id_col``, nulls first.

    Every row is a document, also one with a null or repeated id (rows of one id lie in order of their text's hash): the ids
    of its text, none for a null text, and ``end_id``. Rows are dealt by ranges of (id, hash, place in the input), so no id,
    however frequent, ends in one task. A segment ends with the document that reaches SEGMENT_IDS ids and a file
    after FILE_SEGMENTS segments. An empty table gives no segment. Other columns are not read.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder, keys, ids, size = kept(ByteLevel, tokenizer_path), [], [], 0
        for batch in batches:
            for key, body in zip(batch.column("_key").to_pylist(), batch.column("_text").to_pylist()):
                keys.append(key)
                ids.append(encoder.ids((body or b"").decode("utf-8", "replace")) + end)
                size += len(ids[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([segment(keys, ids, covered)], pa.binary())], ["_segment"])
                    keys, ids, size = [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([segment(keys, ids, covered)], pa.binary())], ["_segment"])

    order = [F.col("_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_tie"),
                       F.monotonically_increasing_id().alias("_row"), F.col(text).cast("binary").alias("_text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = dealt.select(F.col("_id").cast("string").alias("_key"), "_text").mapInArrow(run, "_segment binary")
    # a cast keeps the bytes as they are
    made.select(F.col("_segment").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select(F.regexp_extract("path", r"[^/]*$", 0).alias("file"), "content"))


def _with_start(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``start`` of rows (file, at) from the number of ids per file: a sum over one row per file."""
    number = [F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), F.regexp_extract("file", r"-c(\d+)", 1).cast("long")]
    before = Window.orderBy(*number).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "file").withColumn("start", F.col("_offset") + F.col("_at")).drop("_offset", "_at")


def read_token_files(spark: SparkSession, path: str, id_type: str = "bigint", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: id_col, start, n_tokens, ids_crc32, file, and ``ids`` if asked for.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is that of the ids as little-endian unsigned 32-bit
    numbers, read from the blocks. A file is read by one task. Without ids the rows are saved, so files are read once.
    """
    names = ["file", "_key", "_at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                at = 0
                for part in segments(data.as_py()):
                    flat, ends = part.ids(), np.cumsum(part.counts)
                    ids = [flat[e - n:e] for e, n in zip(ends, part.counts)]
                    columns = [pa.array([file] * len(ids), pa.string()), pa.array(part.keys, pa.string()),
                               pa.array(at + ends - part.counts, pa.int64()), pa.array(part.counts, pa.int64()),
                               pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())]
                    columns += [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat.astype(np.int64), pa.int64()))] * with_ids
                    yield pa.RecordBatch.from_arrays(columns, names)
                    at += part.n_ids

    def sizes(batches):
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([sum(p.n_ids for p in segments(data.as_py()))], pa.int64())],
                                                 ["file", "_n"])

    schema = "file string, _key string, _at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = _files(spark, path).mapInArrow(run, schema)
    if with_ids:
        per_file = _files(spark, path).mapInArrow(sizes, "file string, _n long")
    else:
        rows = saved(rows)
        per_file = rows.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    found = _with_start(rows, per_file).withColumn("_key", F.col("_key").cast(id_type))
    return found.select(F.col("_key").alias(id_col), "start", "n_tokens", "ids_crc32", "file", *["ids"] * with_ids)


def id_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Ids ``first`` to before ``last`` of all files in one row of numbers: position, id. Only blocks that hold them are decoded."""
    def sizes(batches):
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([sum(p.n_ids for p in segments(data.as_py()))], pa.int64())],
                                                 ["file", "_n"])

    def run(batches):
        for batch in batches:
            for offset, data in zip(batch.column("start").to_pylist(), batch.column("content")):
                for part in segments(data.as_py()):
                    ids = part.ids(max(0, first - offset), max(0, last - offset))
                    at = max(offset, first) + np.arange(len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ids.astype(np.int64), pa.int64())], ["position", "id"])
                    offset += part.n_ids

    per_file = saved(_files(spark, path).mapInArrow(sizes, "file string, _n long"))
    spans = _with_start(per_file.withColumn("_at", F.lit(0).cast("long")), per_file)
    inside = spans.where((F.col("start") < last) & (F.col("start") + F.col("_n") > first))
    return _files(spark, path).join(inside, "file").select("start", "content").mapInArrow(run, "position long, id long")
