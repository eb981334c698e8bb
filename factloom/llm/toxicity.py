"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy, over overlapping windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import BLANKS, chunks, mixed, word_hashes

WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15   # hashed word and character n-gram vectors
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 16, 8, 8
GRAMS = (3, 4, 5)
WINDOW, STRIDE = 32, 16


class Texts:
    """Distinct words of some texts with their character n-grams, and the words of each text as numbers of them."""

    def __init__(self, texts: list[str | None]):
        sizes = [0 if t is None else len(t) for t in texts]
        parts = [word_hashes(texts[a:b]) for a, b in chunks(sizes, 1 << 20)] or [word_hashes([])]
        hashes = np.concatenate([h for h, _ in parts])
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])
        distinct, first, self.words = np.unique(hashes, return_index=True, return_inverse=True)
        self.n = len(distinct)
        self.word_rows = (distinct >> np.uint64(7)).astype(np.int64) % WORD_ROWS
        data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        raw = np.frombuffer(b" " * 8 + b" ".join(data) + b" " * 8, dtype=np.uint8)
        inside = ~BLANKS[raw]
        start = np.flatnonzero(inside[1:] & ~inside[:-1])[first] + 1 if self.n else np.zeros(0, dtype=np.int64)
        stop = np.flatnonzero(~inside[1:] & inside[:-1])[first] + 1 if self.n else np.zeros(0, dtype=np.int64)
        low = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
        low[~inside] = 32
        size = stop - start  # n-grams start one byte before the word, at a blank
        rows, owners = [], []
        for n in GRAMS:
            count = np.maximum(size + 3 - n, 1)
            owner = np.repeat(np.arange(self.n, dtype=np.int32), count)
            at = np.repeat(start - 1 - np.concatenate([[0], np.cumsum(count)[:-1]]) if self.n else start, count) + np.arange(count.sum())
            code = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                code = code * np.uint64(257) + low[np.minimum(at + k, len(low) - 1)]
            rows.append(((mixed(code) >> np.uint64(9)) % np.uint64(CHAR_ROWS)).astype(np.int32))
            owners.append(owner)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        self.gram_rows = np.concatenate(rows)[order]
        self.gram_count = np.bincount(owner, minlength=self.n)

    def vectors(self, model: dict, which: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of the distinct words: word vector, and sum of n-gram vectors / sqrt(number)."""
        out = np.empty((self.n, WORD_DIM + CHAR_DIM), dtype=np.float32)
        out[:, :WORD_DIM] = model["word"][self.word_rows]
        if self.n:
            out[:, WORD_DIM:] = gram_sums(model["char"], self.gram_rows, self.gram_count)
        return out

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, end of the text) of every window; neighbours overlap by half, the last reaches the end."""
        sizes = np.diff(self.bounds)
        count = np.where(sizes > 0, np.maximum(-(-(sizes - WINDOW) // STRIDE), 0) + 1, 0)
        text = np.repeat(np.arange(len(sizes)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return text, self.bounds[text] + place * STRIDE, self.bounds[text + 1]


def gram_sums(table: np.ndarray, rows: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of the table rows of each word / sqrt(number); words with many n-grams first, so that each step is a slice."""
    order = np.argsort(-count, kind="stable")
    start, left = (np.cumsum(count) - count)[order], count[order]
    total = np.zeros((len(count), table.shape[1]), dtype=np.float32)
    for k in range(int(left[0])):
        m = np.searchsorted(-left, -k, side="left")
        total[:m] += table[rows[start[:m] + k]]
    out = np.empty_like(total)
    out[order] = total / np.sqrt(left)[:, None]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    shapes = {"word": (WORD_ROWS, WORD_DIM), "char": (CHAR_ROWS, CHAR_DIM), "A": (2 * h, ATTENTION), "v": (ATTENTION,),
              "o": (2 * h,), "b": (1,), "c": (ATTENTION,)}
    for side in "fb":
        shapes |= {f"W{side}": (d, 3 * h), f"a{side}": (3 * h,), f"U{side}": (h, 2 * h), f"N{side}": (h, h)}
    return {k: rng.normal(0, 0.1 if k in ("word", "char") else 0.3, s).astype(np.float32) if k[0] not in "abc" or k == "char"
            else np.zeros(s, dtype=np.float32) for k, s in shapes.items()}


def _run(model, side: str, a: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: list | None):
    """States (windows, steps, HIDDEN) of one direction; ``a`` holds the words' input to the gates."""
    n, steps = ids.shape
    h, out = np.zeros((n, HIDDEN), dtype=np.float32), np.empty((n, steps, HIDDEN), dtype=np.float32)
    U, N = model[f"U{side}"], model[f"N{side}"]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        x = a[ids[:, t]]
        gates = _sigmoid(x[:, :2 * HIDDEN] + h @ U)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN:] + (r * h) @ N)
        m = mask[:, t, None]
        if keep is not None:
            keep.append((t, h, z, r, new))
        h = h + m * z * (new - h)
        out[:, t] = h
    return out


def forward(model, vectors: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window: states of both directions, pooled by attention."""
    sides = []
    for side in "fb":
        steps = None if keep is None else keep.setdefault(side, [])
        sides.append(_run(model, side, vectors @ model[f"W{side}"] + model[f"a{side}"], ids, mask, steps))
    states = np.concatenate(sides, axis=2)
    u = np.tanh(states @ model["A"] + model["c"])
    e = np.where(mask > 0, u @ model["v"], -1e9)
    alpha = np.exp(e - e.max(axis=1, keepdims=True))
    alpha /= alpha.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", alpha, states)
    if keep is not None:
        keep |= {"states": states, "u": u, "alpha": alpha, "pooled": pooled}
    return pooled @ model["o"] + model["b"][0]


def backward(model, vectors, ids, mask, keep, dlogit) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters and of the distinct words' vectors."""
    g = {"o": keep["pooled"].T @ dlogit, "b": dlogit.sum(keepdims=True)}
    dpooled = dlogit[:, None] * model["o"]
    alpha, states, u = keep["alpha"], keep["states"], keep["u"]
    dalpha = np.einsum("nh,nth->nt", dpooled, states)
    dstates = alpha[:, :, None] * dpooled[:, None, :]
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
    du = de[:, :, None] * model["v"] * (1 - u * u)
    g["v"] = np.einsum("ntk,nt->k", u, de)
    g["A"] = np.einsum("nth,ntk->hk", states, du)
    g["c"] = du.sum(axis=(0, 1))
    dstates += du @ model["A"].T
    dvectors = np.zeros_like(vectors)
    for k, side in enumerate("fb"):
        U, N = model[f"U{side}"], model[f"N{side}"]
        gU, gN, dh = np.zeros_like(U), np.zeros_like(N), np.zeros((len(ids), HIDDEN), dtype=np.float32)
        da_words = np.zeros((len(vectors), 3 * HIDDEN), dtype=np.float32)
        for t, h, z, r, new in reversed(keep[side]):
            dh = dh + dstates[:, t, k * HIDDEN:(k + 1) * HIDDEN]
            m = mask[:, t, None]
            dz, dnew = dh * m * (new - h), dh * m * z
            dh = dh * (1 - m * z)
            dn = dnew * (1 - new * new)
            dq = dn @ N.T
            gN += (r * h).T @ dn
            dgates = np.concatenate([dz * z * (1 - z), dq * h * r * (1 - r)], axis=1)
            gU += h.T @ dgates
            dh = dh + dq * r + dgates @ U.T
            np.add.at(da_words, ids[:, t], np.concatenate([dgates, dn], axis=1))
        g |= {f"U{side}": gU, f"N{side}": gN, f"W{side}": vectors.T @ da_words, f"a{side}": da_words.sum(axis=0)}
        dvectors += da_words @ model[f"W{side}"].T
    return g, dvectors


def _gather(texts: Texts, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = first[:, None] + np.arange(WINDOW)
    mask = (at < end[:, None]).astype(np.float32)
    return texts.words[np.minimum(at, end[:, None] - 1)], mask


def window_logits(model, texts: Texts, first, end, batch: int = 2048) -> np.ndarray:
    vectors, out = texts.vectors(model), np.empty(len(first), dtype=np.float32)
    for k in range(0, len(first), batch):
        ids, mask = _gather(texts, first[k:k + batch], end[k:k + batch])
        out[k:k + batch] = forward(model, vectors, ids, mask)
    return out


def _start_vectors(model, texts: Texts, labels: np.ndarray) -> np.ndarray:
    """Set one component of the vectors to log-odds of words and n-grams; gives each word's evidence."""
    start = np.concatenate([[0], np.cumsum(texts.gram_count)])
    seen = {k: np.zeros((2, size)) for k, size in (("word", WORD_ROWS), ("char", CHAR_ROWS))}
    for i, y in enumerate(labels.astype(int)):
        used = np.unique(texts.words[texts.bounds[i]:texts.bounds[i + 1]])
        count = texts.gram_count[used]
        at = np.repeat(start[used] - np.cumsum(count) + count, count) + np.arange(count.sum())
        seen["word"][y][np.unique(texts.word_rows[used])] += 1
        seen["char"][y][np.unique(texts.gram_rows[at])] += 1
    texts_of = np.maximum([(labels == 0).sum(), (labels == 1).sum()], 1)
    for k, (n, p) in seen.items():
        odds = np.log((p + 0.5) / (texts_of[1] + 1)) - np.log((n + 0.5) / (texts_of[0] + 1))
        model[k][:, 0] = np.clip(odds * (p + n) / (p + n + 2), -2, 4)
    return model["word"][texts.word_rows, 0] + np.maximum.reduceat(model["char"][texts.gram_rows, 0], start[:-1])


def train(bodies: list[str], labels, weights=(1.0, 1.0), epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> dict:
    """A model from texts with labels 0 or 1. Labels are of texts, so the windows that show the label are learned too.

    At first the window of a positive text with the strongest word evidence counts as positive, later those that the
    model scores highest; of negative texts come the highest and random windows. A fifth of the texts is kept for
    turning the highest window's logit into a probability; there, ``weights`` are those of the two labels, so that a
    sample with more positives than the corpus does not raise the scores.
    """
    rng, labels = np.random.default_rng(seed), np.asarray(labels, dtype=np.float32)
    model, texts = new_model(rng), Texts(bodies)
    text, first, end = texts.windows()
    model["scale"] = np.array([1.0, 0.0])
    if not len(first) or labels.min() == labels.max():
        model["b"][:] = 0 if not len(labels) else np.clip(20 * labels.mean() - 10, -10, 10)
        return model
    fit_text = rng.uniform(size=len(labels)) < 0.8 if labels.sum() >= 50 else np.ones(len(labels), dtype=bool)
    evidence = _start_vectors(model, texts, np.where(fit_text, labels, 0))
    padded = np.concatenate([evidence[texts.words], [-9.0]])
    strength = np.array([padded[a:min(a + WINDOW, e)].max() for a, e in zip(first, end)])
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items() if k not in ("word", "char", "scale")}
    squares = {k: np.full(len(model[k]), 1e-6, dtype=np.float32) for k in ("word", "char")}
    gram_start = np.concatenate([[0], np.cumsum(texts.gram_count)])
    step = 0
    for epoch in range(epochs):
        order = np.lexsort((-strength, text))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        positive = np.flatnonzero(fit_text[text] & (labels[text] > 0) & (rank < 2))
        negative = fit_text[text] & (labels[text] == 0)
        hard = np.flatnonzero(negative & (rank == 0))
        easy = np.flatnonzero(negative & (rank > 0))
        easy = rng.choice(easy, min(len(easy), len(hard)), replace=False)
        repeat = max(1, min(8, (len(hard) + len(easy)) // (4 * max(len(positive), 1))))
        chosen = rng.permutation(np.concatenate([np.tile(positive, repeat), hard, easy]))
        for k in range(0, len(chosen), batch):
            some = chosen[k:k + batch]
            ids, mask = _gather(texts, first[some], end[some])
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            counts = texts.gram_count[used]
            at = np.repeat(gram_start[used] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            grams, owner = texts.gram_rows[at], np.repeat(np.arange(len(used)), counts)
            share = (1 / np.sqrt(counts)).astype(np.float32)
            char = gram_sums(model["char"], grams, counts)
            vectors = np.concatenate([model["word"][texts.word_rows[used]], char], axis=1)
            keep: dict = {}
            logit = forward(model, vectors, local, mask, keep)
            dlogit = ((_sigmoid(logit) - labels[text[some]]) / len(some)).astype(np.float32)
            g, dvectors = backward(model, vectors, local, mask, keep, dlogit)
            step += 1
            for name, grad in g.items():
                m, s = moments[name]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                model[name] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
            for name, rows, grad in (("word", texts.word_rows[used], dvectors[:, :WORD_DIM]),
                                     ("char", grams, (dvectors[:, WORD_DIM:] * share[:, None])[owner])):
                seen, to = np.unique(rows, return_inverse=True)
                total = np.zeros((len(seen), grad.shape[1]), dtype=np.float32)
                np.add.at(total, to, grad)
                squares[name][seen] += (total ** 2).mean(axis=1)
                model[name][seen] -= 0.02 * total / np.sqrt(squares[name][seen])[:, None]
        if epoch in (0, 2, epochs - 1):
            strength = window_logits(model, texts, first, end)
    highest = np.full(len(labels), -np.inf)
    np.maximum.at(highest, text, strength)
    held = (~fit_text if (~fit_text).any() else fit_text) & np.isfinite(highest)
    model["scale"] = _probability_scale(highest[held], labels[held], np.where(labels[held] > 0, weights[1], weights[0]))
    return model


def _probability_scale(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and offset that turn logits into probabilities: regularised logistic regression by Newton steps."""
    x, w = np.stack([logit, np.ones_like(logit)], axis=1), np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (p - label)) + 0.1 * (w - [1.0, 0.0])
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
    return w if w[0] > 0 else np.array([1.0, 0.0])


def text_scores(model: dict, bodies: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each text from its highest window; 0 for a text without words."""
    out = np.zeros(len(bodies))
    sizes = [0 if t is None else len(t) for t in bodies]
    for low, high in chunks(sizes, 1 << 19):
        texts = Texts(bodies[low:high])
        text, first, end = texts.windows()
        if not len(first):
            continue
        highest = np.full(high - low, -np.inf)
        np.maximum.at(highest, text, window_logits(model, texts, first, end))
        scale = model["scale"]
        out[low:high] = np.where(np.isfinite(highest), _sigmoid(scale[0] * highest + scale[1]), 0)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn, id_col: str, text: str,
                    most: int) -> tuple[list[tuple[str, int]], tuple[float, float]]:
    """The sample, and how many rows one of each label stands for: at most about ``most`` texts of each label (0, 1) of rows that may be learned, chosen by a hash of the id."""
    rows = labels.where(may_learn & F.col(label).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    counts = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    uniform = F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1_000_000)) / 1_000_000
    wanted = F.lit(False)
    for value, n in counts.items():
        wanted = wanted | ((F.col("_label") == value) & (uniform < F.lit(min(1.0, most / n))))
    chosen = rows.where(wanted)
    found = (docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
             .join(F.broadcast(chosen), "_id").select("_text", "_label"))  # about 2 * ``most`` rows, checked by counts
    weights = tuple(max(1.0, counts.get(k, 0) / most) for k in (0, 1))
    return sorted((r["_text"], int(r["_label"])) for r in found.collect()), weights


def toxicity_scores(docs: DataFrame, labels: DataFrame, may_learn, id_col: str = "doc_id", text: str = "text",
                    label: str = "toxic", most: int = 1000, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with score (0 to 1) and predicted (1 from 0.5 on).

    The model is fitted on the driver on a sample of ``labels`` rows for which ``may_learn`` holds: ``most`` (about)
    texts of each label, fewer where there are fewer. Every text is scored whole, by all its windows of 32 words that
    start 16 words apart. Null, empty and blank texts score 0. Without labels of both kinds every text with words
    has the label there is, or 0. Rows with null or repeated ids are scored like others; null labels teach nothing.
    """
    sample, weights = labelled_sample(docs, labels, label, may_learn, id_col, text, most)
    model = train([t for t, _ in sample], [y for _, y in sample], weights)
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.col(text).alias("t"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("s"))

    def run(batches):
        for batch in batches:
            score = text_scores(held.value, batch.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("s"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=["s", "score", "predicted"])

    scored = rows.mapInArrow(run, f"s {rows.schema['s'].dataType.simpleString()}, score double, predicted int")
    return scored.select(*[F.col(f"s.c{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")
