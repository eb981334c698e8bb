"""Texts to pieces of token ids."""

from __future__ import annotations

import zlib
from array import array
from sys import byteorder

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHED_WORDS = 1_000_000  # per Python worker, about 150 bytes each
ASCII_LETTERS, STOPS = frozenset(b"abcdefghijklmnopqrstuvwxyz"), frozenset(b",.")


def pack(parts) -> bytes:
    ids = array("I", [x.id for x in parts])
    if byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def _byte_alphabet() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as its own character and the others as 256, 257, ..."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class WordCache(dict):
    """Token ids of words as bytes. White space never joins tokens, so a text's ids are those of its words in a row.

    The same holds between a letter and one comma or full stop at a word's end, and the vocabulary is in lower case, so
    a word is looked up without them. A word of Latin letters in lower case is one piece of the pre-tokenizer and goes
    straight to the merges. Texts that might spell a special token are left as they are.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merges, self.alphabet = self.tokenizer.model, _byte_alphabet()

    def encode(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word[-1] in STOPS and len(word) > 1 and word[-2] in ASCII_LETTERS:
            packed = self[word[:-1]] + self[word[-1:]]
        elif word.isalpha():  # ASCII letters only
            packed = pack(self.merges.tokenize(word.decode()))
        else:
            text = word.decode("utf-8", "replace")
            if text.isalpha() and max(text) <= "\xff" and text == text.lower():
                packed = pack(self.merges.tokenize("".join([self.alphabet[b] for b in word])))
            else:
                packed = self.encode(word)
        if len(self) < CACHED_WORDS:
            self[word] = packed
        return packed

    def ids(self, text: bytes | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers; bytes.split() takes ASCII white space only."""
        text = text or b""
        if b"<|" in text:
            return b"".join(map(self.encode, text.split()))
        return b"".join(map(self.__getitem__, text.lower().split()))


_CACHES: dict[str, WordCache] = {}  # lives as long as the Python worker


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, most: int = 4096, id_col: str = "doc_id",
                 text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, and the ids themselves as ``ids`` if asked for.

    A document is the ids of its text and ``end_id``; one longer than ``most`` is cut into pieces of ``most`` ids, the
    last may be shorter. A null text counts as empty, so every row gives at least the end id. The tokenizer must drop
    white space, as the public word-level vocabulary does; its file is read by each worker at ``tokenizer_path``.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        cache = _CACHES.get(tokenizer_path)
        if cache is None:
            cache = _CACHES[tokenizer_path] = WordCache(tokenizer_path)
        for batch in batches:
            keys, parts, pieces = batch.column("_id").to_pylist(), [], []
            for row, body in enumerate(batch.column("_text").to_pylist()):
                data = cache.ids(body) + end
                for at in range(0, len(data), 4 * most):
                    part = data[at:at + 4 * most]
                    pieces.append((keys[row], at // (4 * most), at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        parts.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            if not pieces:
                continue
            columns = [pa.array(c, t) for c, t in zip(zip(*pieces), kinds)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.list_(pa.int32()))] * with_ids, names)

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text).cast("binary").alias("_text"))
    schema = "_id string, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = rows.mapInArrow(run, schema)
    return pieces.withColumn("_id", F.col("_id").cast(docs.schema[id_col].dataType)).withColumnRenamed("_id", id_col)
