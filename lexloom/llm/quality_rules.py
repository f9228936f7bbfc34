"""Operator 9: quality rules, a hashed n-gram logistic regression scored in Arrow batches.

Words, word pairs and byte 4-grams are hashed into `DIM` buckets, counts damped
by log1p and the vector scaled to length one. Logistic regression is trained on
at most `max_rows` labelled rows (those of the smallest hashed ids), Platt
scaling on every fifth of them turns the score into a probability, and fixed
thresholds decide. Two plain rules (`base_failed`) come first.

Defined results: null and empty texts have no words, so the base rules fail
them. Without labelled rows of both classes there is no model and the base
rules alone decide. Labels of one document that disagree count as the lowest.
Every input row gives one output row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import ROWS, SPACES, frugal, map_batches

DIM = 1 << 13
#: Rows with a smaller probability of being good are rejected.
KEEP_AT = 0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_TRAINING_ROWS = 4000
SYMBOLS = "#*$%&|<>"
#: Odd multipliers of the bucket hashes.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias) + self.offset, -40, 40)))


def features(raw: bytes, words: list[bytes]) -> np.ndarray:
    """The unit-length hashed vector of a text."""
    shift = np.uint64(64 - DIM.bit_length() + 1)
    x = np.zeros(DIM)
    if words:
        h = np.fromiter(map(crc32, words), np.uint64, len(words))
        x += np.bincount(((h + np.uint64(1)) * MIX[0] >> shift).astype(np.int64), minlength=DIM)
        x += np.bincount((((h[:-1] * MIX[1]) ^ h[1:]) * MIX[0] >> shift).astype(np.int64), minlength=DIM)
    for at in range(0, max(0, len(raw) - 3), 1 << 20):  # long texts in pieces, to bound memory
        b = np.frombuffer(raw, np.uint8, min(len(raw) - at, (1 << 20) + 3), at).astype(np.uint64)
        g = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24)
        x += np.bincount(((g + np.uint64(1 << 33)) * MIX[0] >> shift).astype(np.int64), minlength=DIM)
    x = np.log1p(x)
    return x / (np.sqrt(x @ x) or 1.0)


def repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    if len(count) == len(windows):
        return 0
    n = reach = 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            n += i + 3 - max(reach, i)
            reach = i + 3
    return n


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


def training_rows(df: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_rows: int) -> DataFrame:
    """(k, y, x): the bounded sample in a fixed order; x holds the places and values of the vector. Its ids are at most `max_rows`, so they are broadcast."""
    ids = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).dropna().groupBy("k").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(max_rows)
    )

    def vectors(rows: dict) -> dict:
        out = []
        for t in rows["t"]:
            raw = (t or "").encode("utf-8", "replace")
            x = features(raw, raw.split())
            at = np.flatnonzero(x)
            out.append(at.astype(np.uint16).tobytes() + x[at].astype(np.float32).tobytes())
        return {"k": rows["k"], "y": rows["y"], "x": out}

    texts = df.select(df[key].alias("k"), df[text].alias("t"))
    return map_batches(texts.join(F.broadcast(ids), "k").withColumn("k", F.col("k").cast("string")), vectors, "k string, y int, x binary").orderBy("k", "x").limit(max_rows)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> QualityModel | None:
    """Accelerated gradient descent on four rows of five, Platt scaling on the fifth."""
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2:
        held[:] = False
    # both classes weigh the same and held-out rows nothing, so that no part of the matrix is copied
    weight = np.where(held, 0.0, np.where(y > 0, 0.5 / max(1, y[~held].sum()), 0.5 / max(1, (1 - y[~held]).sum())))
    w, v, bias, bv = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    for k in range(steps):
        m = k / (k + 3)
        look, lb = w + m * v, bias + m * bv
        g = weight * (1 / (1 + np.exp(-np.clip(x @ look.astype(np.float32) + lb, -40, 40))) - y)
        v, bv = m * v - 4.0 * (g.astype(np.float32) @ x + penalty * look), m * bv - 4.0 * g.sum()
        w, bias = w + v, bias + bv
    some = held if held.any() else ~held
    s, t = (x @ w.astype(np.float32) + bias)[some], y[some]
    slope, offset = 1.0, 0.0
    pos, neg = (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2)  # Platt's smoothed targets
    target = np.where(t > 0, pos, neg)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * s + offset, -40, 40)))
        r, h = p - target, p * (1 - p) + 1e-9
        grad = np.array([(r * s).sum() + 1e-3 * (slope - 1), r.sum()])
        hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum()]])
        d = np.linalg.solve(hess, grad)
        slope, offset = slope - float(np.clip(d[0], -1, 1)), offset - float(np.clip(d[1], -1, 1))
    return QualityModel(w, float(bias), float(slope), float(offset))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_TRAINING_ROWS) -> QualityModel | None:
    """The model, fitted in one executor task from at most `max_rows` vectors (131 MB at the default); the driver gets its weights alone."""

    def learn(batches):
        import pyarrow as pa

        x, y = np.zeros((max_rows, DIM), np.float32), []
        for batch in batches:
            for label_, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                buffer = raw.as_buffer()
                n = buffer.size // 6
                x[len(y), np.frombuffer(buffer, np.uint16, n)] = np.frombuffer(buffer, np.float32, n, 2 * n)
                y.append(label_)
        if (m := fit(x[: len(y)], np.array(y, np.float64))) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), *(pa.array([v]) for v in (m.bias, m.slope, m.offset))], names=["weights", "bias", "slope", "offset"])

    rows = training_rows(df, labels, key, text, label, max_rows).mapInArrow(frugal(learn), "weights binary, bias double, slope double, offset double").collect()
    return QualityModel(np.frombuffer(rows[0].weights), rows[0].bias, rows[0].slope, rows[0].offset) if rows else None


def verdict(text: str | None, model: QualityModel | None, keep_at: float) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good of one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, again = len(words), repeated(words)
    failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
    p = None if model is None else round(float(model.probability(features(raw, words))), 6)
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), again, failed, not failed and (p is None or p >= keep_at), p


def passing(df: DataFrame, model: QualityModel | None, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of `df`, all columns, whose text is kept."""
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for first in range(0, b.num_rows, ROWS):
                some = b.slice(first, ROWS)
                yield some.filter(pa.array([verdict(t, sent.value, keep_at)[6] for t in some.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(frugal(run), df.schema)


def quality(df: DataFrame, model: QualityModel | None, key: str = "doc_id", text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Per row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, p_good (null without a model)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def score(rows: dict) -> dict:
        out = [verdict(t, sent.value, keep_at) for t in rows["text"]]
        names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept p_good".split()
        return {key: rows[key]} | {c: [o[i] for o in out] for i, c in enumerate(names)}

    kind = df.schema[key].dataType.simpleString()
    return map_batches(
        df.select(key, df[text].alias("text")), score,
        f"{key} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double",
    )
