"""Encoders of public vocabularies that look words up in a cache, and the bytes of their entries."""

from __future__ import annotations

import re
from array import array
from functools import partial
from itertools import accumulate, chain
from sys import byteorder

import numpy as np

CACHED_CHUNKS = 600_000  # per dictionary and Python worker, about 200 bytes each
BAD = 0xFFFFFFFF  # stands for a chunk whose tokens do not spell it
SECOND = 1 << 31  # marks the ids of the second of two vocabularies

# A blank after something else than white space always starts a new piece in both vocabularies. Texts with white space
# after a blank, a blank at the end or what may be a special token are encoded as a whole.
HARD = re.compile(r" (?:[\s\u180e\u2581]|$)|<\||\u2581 ")
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
WORD = re.compile(f"[{LATIN}]+")
HEAD = re.compile(f"(?<![^ ])[{LATIN}]+")  # letters behind a blank or at the start
SIGNS = r"!-&(-/:-@\[-`{-~"  # punctuation other than the apostrophe


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes are themselves, the others 256, 257, ... in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {chr(b if b in own else next(rest)): b for b in range(256)}


class Chunks(dict):
    """Chunk of a text -> its ids as little-endian 32-bit numbers; a chunk of ``later`` stands behind a blank.

    Tokens join neither lines nor letters and the punctuation behind them, so such chunks are put together from their parts.
    """

    def __init__(self, encode, signs: str, first: Chunks | None = None):
        super().__init__()
        self.encode, self.first = encode, self if first is None else first
        self.signed = re.compile(f"([{LATIN}]+)([{signs}][{SIGNS}]*)") if signs else re.compile("(?!)")

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            found = self.encode(chunk)
        elif signed := self.signed.fullmatch(chunk):
            found = self[signed[1]] + self.first[signed[2]]
        elif "\n" in chunk and chunk != "\n":
            parts = chunk.split("\n")
            if not all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
                return self.encode(chunk)
            line = self.first["\n"]
            return self[parts[0]] + b"".join([line + self.first[p] for p in parts[1:]])
        else:
            found = self.encode(chunk)
        if len(self) < CACHED_CHUNKS:
            self[chunk] = found
        return found


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library. ``plain``: strings of special tokens are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.merges, self.signs = self.tokenizer.model, {b: c for c, b in byte_alphabet().items()}
        self.first = Chunks(self.chunk, SIGNS)
        self.later = Chunks(partial(self.chunk, blank=" "), SIGNS, self.first)
        self._entries: list[bytes] | None = None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def chunk(self, chunk: str, blank: str = "") -> bytes:
        """Letters, with or without a blank before them, are one piece of the pre-tokenizer and go straight to the merges."""
        if WORD.fullmatch(chunk):
            piece = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.signs)
            return packed([t.id for t in self.merges.tokenize(self.signs[32] + piece if blank else piece)])
        return self.whole(blank + chunk)

    def ids(self, text: str) -> bytes:
        """Ids of a text, equal to those of encoding it as a whole."""
        if HARD.search(text):
            return self.whole(text)
        head, *rest = text.split(" ")
        return (self.first[head] if head else b"") + b"".join(map(self.later.__getitem__, rest))

    def entries(self) -> list[bytes]:
        """Bytes of every id."""
        if self._entries is None:
            alphabet, size = byte_alphabet(), self.tokenizer.get_vocab_size(with_added_tokens=True)
            names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
            self._entries = [bytes(alphabet[c] for c in n) if all(c in alphabet for c in n) else n.encode() for n in names]
        return self._entries


class Pieces:
    """A ``sentencepiece`` model that puts a blank before a text by itself and keeps all white space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self._entries = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(e) for e in self._entries], dtype=np.int64)
        # merges only make pieces of the model, so text comes apart between signs that no piece has side by side
        joined = {m[1] for p in names for m in re.finditer(f"(?<=[{LATIN}])(?=([{SIGNS}]))", p)}
        self.signs = "".join("\\" + c for c in map(chr, range(33, 127)) if re.match(f"[{SIGNS}]", c) and c not in joined)
        self.apart = not any("\n" in p for p in names)
        self.line = self.model.encode("\n")
        first = Chunks(self.inner, self.signs)
        self.later = Chunks(self.checked, self.signs, first)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, num_threads=1), dtype="<u4").tobytes()

    def spelt(self, ids: list[int], text: str, mark: int = 0) -> bytes:
        if b"".join([self._entries[i] for i in ids]) != text.encode("utf-8", "replace"):
            ids = [BAD]
        return packed([i | mark for i in ids] if mark else ids)

    def checked(self, text: str, mark: int = 0) -> bytes:
        """Ids of a text, or one BAD if they do not spell a blank and the text."""
        return self.spelt(self.model.encode(text, num_threads=1), " " + text, mark)

    def inner(self, text: str, mark: int = 0) -> bytes:
        """Ids of what follows a newline or letters, without a blank before it."""
        return self.spelt(self.model.encode("\n" + text, num_threads=1)[len(self.line):], text, mark)

    def words(self, words: list[str], mark: int = 0) -> list[bytes]:
        """Ids of each of several texts as ``checked`` gives them, from one call of the model."""
        found = self.model.encode(words, num_threads=1) if words else []
        flat = np.array([*chain.from_iterable(found)], dtype="<u4")
        ends, sizes = np.cumsum([len(f) for f in found], dtype=np.int64), np.append(0, np.cumsum(self.lengths[flat]))
        texts = [b" " + w.encode("utf-8", "replace") for w in words]
        # all spell all, and each has the bytes of its own text
        if b"".join([self._entries[i] for i in flat.tolist()]) != b"".join(texts) or sizes[ends].tolist() != [*accumulate(map(len, texts))]:
            return [self.spelt(f, " " + w, mark) for f, w in zip(found, words)]
        data, ends = (flat | np.uint32(mark)).tobytes(), (4 * ends).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def ids(self, text: str) -> bytes:
        """Ids of a text as ``checked`` gives them for the whole, with a BAD where a chunk is not spelt."""
        if not self.apart or HARD.search(" " + text):
            return self.checked(text)
        return b"".join(map(self.later.__getitem__, text.split(" ")))

    def entries(self) -> list[bytes]:
        return self._entries


class Both:
    """Ids of a byte-level file for a blank and a text, and of a sentencepiece model for the text, from one cache.

    A chunk holds the ids of the first, then those of the second with SECOND set; chunks are looked up once for both.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.first = Chunks(lambda c: a.chunk(c) + b.inner(c, SECOND), b.signs)
        self.later = Chunks(lambda c: a.chunk(c, " ") + b.checked(c, SECOND), b.signs, self.first)

    def learn(self, chunks: set[str]) -> None:
        """Encodes the new words that ``chunks`` begin with, all in one call of the model."""
        words = list({*HEAD.findall(" ".join(chunks.difference(self.later)))}.difference(self.later))
        for word, second in zip(words, self.b.words(words, SECOND)):
            self.later[word] = self.a.chunk(word, " ") + second

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of both sides of every text, in any mixture of the sides; a BAD where the second does not spell a chunk."""
        parts = [None if not self.b.apart or HARD.search(" " + t) else t.split(" ") for t in texts]
        self.learn({*chain.from_iterable(p for p in parts if p)})
        found = [b"".join(map(self.later.__getitem__, p)) if p else self.a.whole(" " + t) + self.b.checked(t, SECOND)
                 for p, t in zip(parts, texts)]
        while len(self.later) > CACHED_CHUNKS:  # the last ones were learnt for these texts only
            self.later.popitem()
        return found


_KEPT: dict = {}  # lives as long as the Python worker


def kept(kind, *args):
    """One encoder per worker and file."""
    if (kind, args) not in _KEPT:
        _KEPT[kind, args] = kind(*args)
    return _KEPT[kind, args]
