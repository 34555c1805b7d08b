"""Quality rules: counts of words and repeats, and a calibrated logistic regression on hashed n-grams.

The regression sees, of every whole text, hashed word unigrams and bigrams (a bigram of one word with itself has a
place of its own) and character n-grams of one to three, each kind as shares of the text's n-grams of that kind. It is
fitted by gradient descent on a bounded sample of whole rows labelled for quality, calibrated on a held-back part by Platt's
method, and a text is kept from a probability of KEEP. Scoring runs over Arrow batches; a row never leaves its task.

Null and empty texts have no words and fail the base rule. Without labels of both kinds the method keeps what passes
the base rule. Documents whose labels conflict teach nothing; of repeated doc_ids one row teaches. Repeated rows give
repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosespark.llm.common import labelled, mix64, slices, text_bytes

#: Labelled rows a class that the fit sees, whole, and characters that they hold together at most; places of each kind
#: of n-gram; probability to keep.
ROWS_PER_CLASS, CHARS_IN_ALL, BITS, KEEP, SEED = 600, 16_000_000, 16, 0.5, 23
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50
#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def repeat_words(h: np.ndarray) -> int:
    """Words inside 3-word windows that come twice or more."""
    if h.size < 4:
        return 0
    w = mix64(h[:-2] * _P1 ^ mix64(h[1:-1] * _P2 ^ mix64(h[2:] * _P3)))
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(s.size, bool)
    twice[1:] |= same
    twice[:-1] |= same
    if not twice.any():
        return 0
    covered = np.zeros(h.size, bool)
    at = order[twice]
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def base_counts(text: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS.encode()))
    return len(words), chars, symbols, dup_lines(text), repeat_words(h)


def characters(texts: list[bytes]) -> np.ndarray:
    """The code points of UTF-8 texts, one after another."""
    return np.frombuffer(b"".join(texts).decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)


def _grams(x: np.ndarray) -> list[np.ndarray]:
    """Places of the character n-grams of a buffer of code points, by n; each is its last character's place."""
    high = np.uint32(32 - BITS)
    one = (x * np.uint32(0x9E3779B1)) >> high
    two = (x[1:] * np.uint32(0x85EBCA77) ^ x[:-1] * np.uint32(0x9E3779B1)) * np.uint32(0xC2B2AE3D) >> high
    three = (x[2:] * np.uint32(0x01000193) ^ x[1:-1] * np.uint32(0x9E3779B1) ^ x[:-2] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> high
    return [one, two, three]


def _word_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    pairs = mix64(h[:-1] * _P1 ^ h[1:] * _P2) & mask
    pairs[h[:-1] == h[1:]] = 0
    return (h >> np.uint64(64 - BITS)).astype(np.int64), pairs.astype(np.int64)


KINDS, PLACES = 5, 1 << BITS


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places (kind * PLACES + place) and shares of one text."""
    h = word_hashes(text.split())
    kinds = [*_word_places(h), *_grams(characters([text]))] if h.size else []
    at, share = [], []
    for k, x in enumerate(kinds):
        if x.size:
            u, n = np.unique(x, return_counts=True)
            at.append(u.astype(np.int64) + k * PLACES)
            share.append(n / x.size)
    return (np.concatenate(at), np.concatenate(share)) if at else (np.zeros(0, np.int64), np.zeros(0))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of sigmoid(a * score + b), fitted by Newton steps with a little ridge."""
    mean, sd = float(score.mean()), float(score.std() or 1.0)
    z = (score - mean) / sd
    a, b = 0.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(30):
        p = sigmoid(a * z + b)
        g = x.T @ (weight * (p - y)) + 1e-2 * np.array([a, 0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 4 / max(1e-9, float(np.abs(d).max())))
        a, b = a - d[0], b - d[1]
    return a / sd, b - a * mean / sd


class Model:
    """Weights of the regression, and its calibration."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def raw(self, texts: list[bytes], hashes: list[np.ndarray]) -> np.ndarray:
        """Scores before calibration, the n-grams of all texts looked up together."""
        n = len(texts)
        out = np.full(n, self.bias)
        sizes = np.array([h.size for h in hashes])
        h = np.concatenate(hashes) if n else np.zeros(0, np.uint64)
        if h.size:
            one, two = _word_places(h)
            owner = np.repeat(np.arange(n), sizes)
            out += np.bincount(owner, self.weights[one], n) / np.maximum(sizes, 1)
            inner = owner[1:] == owner[:-1]
            out += np.bincount(owner[1:][inner], self.weights[two[inner] + PLACES], n) / np.maximum(sizes - 1, 1)
        full = [t if s else b"" for t, s in zip(texts, sizes.tolist(), strict=True)]
        lens = np.array([len(t) if t.isascii() else len(t.decode("utf-8", "replace")) for t in full])
        buffer = characters(full)
        if buffer.size:
            owner = np.repeat(np.arange(n, dtype=np.int32), lens)
            for k, x in enumerate(_grams(buffer)):
                if x.size:
                    inner = owner[k:] == owner[: owner.size - k]
                    w = self.weights[(k + 2) * PLACES : (k + 3) * PLACES].take(x) * inner
                    out += np.bincount(owner[k:], w, n) / np.maximum(lens - k, 1)
        return out

    def probability(self, texts: list[bytes], hashes: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.a * self.raw(texts, hashes) + self.b)


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> Model | None:
    """Full-batch Adagrad on four fifths of the rows, calibration on the rest (by row hash)."""
    if len(set(y.tolist())) < 2:
        return None
    rows = [features(t) for t in texts]
    part = np.array([xxhash.xxh3_64_intdigest(t, seed=SEED) % 5 == 0 for t in texts])
    if len(set(y[part].tolist())) < 2 or len(set(y[~part].tolist())) < 2:
        part = np.zeros(len(texts), bool)
    train = np.flatnonzero(~part)
    at = np.concatenate([rows[i][0] for i in train])
    val = np.concatenate([rows[i][1] for i in train])
    row = np.repeat(np.arange(len(train)), [rows[i][0].size for i in train])
    t, balance = y[train].astype(float), np.where(y[train] == 1, 0.5 / max(1, (y[train] == 1).sum()), 0.5 / max(1, (y[train] == 0).sum()))
    w, b = np.zeros(KINDS * PLACES), 0.0
    gw, gb = np.full_like(w, 1e-8), 1e-8
    for _ in range(150):
        e = balance * (sigmoid(np.bincount(row, val * w[at], len(train)) + b) - t)
        g = np.bincount(at, val * e[row], w.size) + 1e-7 * w
        gw += g * g
        gb += e.sum() ** 2
        w -= 0.5 * g / np.sqrt(gw)
        b -= 0.5 * e.sum() / np.sqrt(gb)
    model = Model(w, b, 1.0, 0.0)
    held = np.flatnonzero(part) if part.any() else train
    score = model.raw([texts[i] for i in held], [word_hashes(texts[i].split()) for i in held])
    model.a, model.b = platt(score, y[held].astype(float), weight[held])
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample: ROWS_PER_CLASS labelled rows a class, whole, of CHARS_IN_ALL characters in all."""
    rows, counts = labelled(docs, labels, "quality", ROWS_PER_CLASS, CHARS_IN_ALL, SEED)
    if not rows:
        return None
    y = np.array([r[2] for r in rows])
    share = {k: counts.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.array([share[k] for k in y.tolist()])
    return fit([r[1].encode("utf-8", "replace") for r in rows], y, weight / weight.mean())


def judge(docs: DataFrame, model: Model | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(1))
            counts, scores = [], []
            for i, k in slices(np.array([len(t) for t in texts])):
                hashes = []
                for t in texts[i:k]:
                    words = t.split()
                    h = word_hashes(words)
                    hashes.append(h)
                    counts.append(base_counts(t, words, h))
                scores.append(model.probability(texts[i:k], hashes) if model else np.ones(k - i))
            c = np.array(counts, np.int64).reshape(-1, 5)
            p = np.concatenate(scores) if scores else np.zeros(0)
            failed = (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_SHARE * c[:, 0])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c[:, k]) for k in range(5)], pa.array(failed), pa.array(~failed & (p >= KEEP)), pa.array(p)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, learn(docs, labels))
