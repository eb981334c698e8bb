"""Language by hierarchical discrimination: the family first, then one-versus-one linear support vector machines."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .words import chunks, mixed

# Families of language codes; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl af fy lb sv da no nb nn is yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg".split(),
    "indic": "hi bn pa gu mr ne ur".split(),
    "turkic": "tr az kk uz ky".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "semitic": "ar he mt am".split(),
}
BIGRAMS, TRIGRAMS = 2048, 4096
MAX_LANGUAGES, MAX_SAMPLE = 256, 8000
UNKNOWN = "und"

_LETTERS = np.full(256, 32, dtype=np.uint8)  # letters of ASCII in lower case and bytes of other characters; all else blank
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def family(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes), language)


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def features(texts: list[str]) -> np.ndarray:
    """Square roots of relative frequencies of hashed byte bigrams and trigrams of whole texts in lower case."""
    width = BIGRAMS + TRIGRAMS
    out = np.empty((len(texts), width), dtype=np.float32)
    data = [b" " + t.lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    for low, high in chunks([len(d) for d in data], 1 << 19):
        raw = _LETTERS[np.frombuffer(b"".join(data[low:high]), dtype=np.uint8)].astype(np.uint64)
        owner = np.repeat(np.arange(high - low), [len(d) for d in data[low:high]])[:-2]
        two = raw[:-2] * np.uint64(256) + raw[1:-1]
        three = two * np.uint64(256) + raw[2:]
        for at, size, code in ((0, BIGRAMS, two), (BIGRAMS, TRIGRAMS, three)):
            used = raw[1:-1] != 32  # n-grams of letters, with a blank at a word's edge
            bucket = (mixed(code[used] + np.uint64(size)) % np.uint64(size)).astype(np.int64)
            counts = np.bincount(owner[used] * size + bucket, minlength=(high - low) * size).reshape(-1, size)
            out[low:high, at:at + size] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    return np.concatenate([x - mean, np.ones((len(x), 1), dtype=x.dtype)], axis=1), mean


def _plain(w: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Weights for centred vectors (offset last) as weights for the vectors themselves."""
    return np.concatenate([w[:-1], w[-1:] - mean @ w[:-1]])


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights of a softmax regression (last row: offsets) by gradient steps with momentum; classes weigh the same."""
    x, mean = _centred(x)
    goal = np.eye(classes, dtype=np.float32)[y] / np.bincount(y, minlength=classes)[y][:, None] / classes
    share = goal.sum(axis=1, keepdims=True)
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(8):  # the steepest direction bounds the step
        v = x.T @ (share[:, 0] * (x @ v))
        steepest = np.linalg.norm(v)
        v /= max(steepest, 1e-9)
    rate = 1 / (0.5 * steepest + decay)
    w, speed = np.zeros((x.shape[1], classes), dtype=np.float32), 0.0
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - rate * (x.T @ (p * share - goal) + decay * w)
        w = w + speed
    return _plain(w, mean)


def svm_fit(x: np.ndarray, sign: np.ndarray, steps: int = 200, cost: float = 100.0) -> np.ndarray:
    """Linear support vector machine (last entry: offset): averaged subgradient steps on the regularised hinge loss."""
    x, centre = _centred(x)
    weight = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1)).astype(np.float32)
    w, total = np.zeros(x.shape[1], dtype=np.float32), np.zeros(x.shape[1], dtype=np.float32)
    for t in range(1, steps + 1):
        inside = sign * (x @ w) < 1
        w = w - (1 / (t + 10)) * (w - cost * ((sign * weight * inside) @ x))
        total += w if 2 * t > steps else 0
    return _plain(total / (steps - steps // 2), centre)


class Model:
    """Families, their languages, the family regression and one machine per pair of languages of a family."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        self.families = sorted({family(c) for c in self.languages})
        self.members = [[c for c in self.languages if family(c) == f] for f in self.families]
        y = np.array([self.families.index(family(c)) for c in languages], dtype=np.int64)
        self.family_weights = softmax_fit(x, y, len(self.families)) if len(self.families) > 1 else None
        names = np.array(languages)
        self.pairs = {}
        for codes in self.members:
            for a, b in combinations(codes, 2):
                rows = (names == a) | (names == b)
                self.pairs[a, b] = svm_fit(x[rows], np.where(names[rows] == a, 1, -1).astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not known or not self.languages:
            return names, score
        x = features([texts[i] for i in known])
        x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
        p = np.ones((len(x), 1))
        if self.family_weights is not None:
            z = x @ self.family_weights
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = p / p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for f, codes in enumerate(self.members):
            rows = np.flatnonzero(best == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(codes)))
            for (i, a), (j, b) in combinations(enumerate(codes), 2):
                margin = 1 / (1 + np.exp(-np.clip(2 * (x[rows] @ self.pairs[a, b]), -30, 30)))
                votes[:, i] += margin
                votes[:, j] += 1 - margin
            winner = votes.argmax(axis=1)
            sure = votes.max(axis=1) / max(len(codes) - 1, 1) if len(codes) > 1 else np.ones(len(rows))
            for r, w, s in zip(rows, winner, sure):
                names[known[r]], score[known[r]] = codes[w], p[r, f] * s
        return names, score


def _vectors(batches):
    for batch in batches:
        yield pd.DataFrame({"lang": batch["lang"], "x": [v.tobytes() for v in features(batch["_text"].tolist())]})


def fit(docs: DataFrame, may_learn, text: str = "text", lang: str = "lang", id_col: str = "doc_id", most: int = 400) -> Model:
    """A model from at most about ``most`` texts of each language (MAX_SAMPLE in all), chosen by a hash of the id."""
    usable = docs.where(may_learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = usable.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    most = min(most, MAX_SAMPLE // max(len(counts), 1))
    uniform = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col).cast("string")), F.lit(1_000_000)) / 1_000_000
    wanted = F.lit(False)
    for r in counts:
        wanted = wanted | ((F.col(lang) == r["lang"]) & (uniform < F.lit(min(1.0, most / r["n"]))))
    rows = usable.where(wanted).select(F.col(lang).alias("lang"), F.col(text).alias("_text"))
    found = sorted((r["lang"], bytes(r["x"])) for r in rows.mapInPandas(_vectors, "lang string, x binary").collect())
    if not found:
        return Model(np.zeros((0, BIGRAMS + TRIGRAMS), dtype=np.float32), [])
    return Model(np.stack([np.frombuffer(x, dtype=np.float32) for _, x in found]), [c for c, _ in found])


def languages(docs: DataFrame, may_learn, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
              most: int = 400) -> DataFrame:
    """id_col, lang_pred and score (0 to 1) of every row, from its whole text.

    The score is the family's probability times the mean vote for the language within the family. Null texts and
    texts without a letter are ``und`` with score 0; so are all if nothing may be learned. Null or repeated ids are kept
    as they are; rows with a null ``lang`` teach nothing. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, may_learn, text, lang, id_col, most))

    def run(batches):
        for batch in batches:
            names, score = model.value.predict(batch["_text"].tolist())
            yield pd.DataFrame({"_id": batch["_id"], "lang_pred": names, "score": score})

    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text).alias("_text"))
    found = rows.mapInPandas(run, "_id string, lang_pred string, score double")
    return found.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "lang_pred", "score")
