"""Quality rules: counts of a text against fixed limits, then a trained verdict.

The verdict is a logistic regression over hashed word and byte n-grams, fitted on a
bounded sample of labelled rows and calibrated (Platt) on a fifth of them. A feature is
the share of its n-gram among the text's n-grams of that kind, so the score of a text is
a mean of weights per kind: scoring is one gather and one running sum over a batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import WordBatch, calibration_fold, labelled_sample, sigmoid, slices, sums_between, texts_of

#: Labelled rows that the regression is fitted on, at most about so many.
SAMPLE = 2_000
BITS = 16
GRAM = 4
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Calibrated probability of good quality from which a text is kept.
KEEP_FROM = 0.5
STEPS, RATE, RIDGE = 80, 0.3, 1e-4
#: Shares are small numbers; this brings them to the order of one.
SCALE = 16.0
STEP = 1 << 20

_SYMBOLS = re.compile(rb"[^#*$%&|<>]+")


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    data = text.encode()
    words = data.split()
    word_chars = sum(map(len, words)) if len(data) == len(text) else len(b"".join(words).decode())
    symbols = len(_SYMBOLS.sub(b"", data))
    lines = [line for line in data.split(b"\n") if line.split()]
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    repeats = 0
    if windows and len(set(windows)) < len(windows):
        seen = Counter(windows)
        last = 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeats += at + WINDOW - max(at, last)
                last = at + WINDOW
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeats


def _families(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per kind of n-gram: buckets, and where each text's begin and end."""
    words = WordBatch(texts)
    down = np.uint64(64 - BITS)
    yield (words.hashes >> down).astype(np.int64), words.first[:-1], words.first[1:]
    pairs, left = words.pairs()
    edges = np.searchsorted(left, words.first)
    yield (pairs * np.uint64(0x9E3779B97F4A7C15) >> down).astype(np.int64) + (1 << BITS), edges[:-1], edges[1:]
    grams, n = words.grams(GRAM)
    yield (grams >> down).astype(np.int64) + (2 << BITS), words.starts, words.starts + n


def sparse_features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of every text, each bucket once."""
    found: list[list] = [[] for _ in texts]
    for buckets, starts, stops in _families(texts):
        for k, (a, b) in enumerate(zip(starts.tolist(), stops.tolist())):
            if b > a:
                own, n = np.unique(buckets[a:b], return_counts=True)
                found[k].append((own, (SCALE * n / (b - a)).astype(np.float32)))
    return [(np.concatenate([f[0] for f in own]), np.concatenate([f[1] for f in own])) if own else (np.zeros(0, np.int64), np.zeros(0, np.float32)) for own in found]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        for buckets, starts, stops in _families(texts):
            total += SCALE * sums_between(self.weights[buckets], starts, stops) / np.maximum(1, stops - starts)
        return total

    def probability(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.slope * self.margin(texts) + self.shift)


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibration, by Newton steps with a small ridge."""
    positive, n = label.sum(), len(label)
    target = np.where(label == 1, (positive + 1) / (positive + 2), 1 / (n - positive + 2))
    x = np.stack([margin, np.ones(n)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target) + 1e-6 * (w - [1, 0]))
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def fit(rows: list[tuple[int, bool, np.ndarray, np.ndarray]]) -> QualityModel:
    """Fit (label, calibrate, buckets, values) rows by full gradient steps (Adam)."""
    weights = np.zeros(3 << BITS, np.float64)
    label = np.array([r[0] for r in rows], np.float64)
    share = float(np.clip(label.mean() if len(rows) else 0.5, 0.01, 0.99))
    bias = float(np.log(share / (1 - share)))
    for_fit, for_check = [r for r in rows if not r[1]], [r for r in rows if r[1]]
    if len({r[0] for r in for_fit}) < 2:
        return QualityModel(weights.astype(np.float32), bias, 1.0, 0.0)
    bucket = np.concatenate([r[2] for r in for_fit])
    value = np.concatenate([r[3] for r in for_fit])
    row = np.repeat(np.arange(len(for_fit)), [len(r[2]) for r in for_fit])
    used, column = np.unique(bucket, return_inverse=True)
    y = np.array([r[0] for r in for_fit], np.float64)
    importance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, first, second = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    b, b_first, b_second = 0.0, 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = np.bincount(row, weights=value * w[column], minlength=len(y)) + b
        error = (sigmoid(z) - y) * importance
        g = np.bincount(column, weights=value * error[row], minlength=len(used)) + RIDGE * w
        gb = error.sum()
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        b_first, b_second = 0.9 * b_first + 0.1 * gb, 0.99 * b_second + 0.01 * gb * gb
        scale = RATE / (1 + t / STEPS)
        w -= scale * first / (1 - 0.9 ** t) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-6)
        b -= scale * b_first / (1 - 0.9 ** t) / (np.sqrt(b_second / (1 - 0.99 ** t)) + 1e-6)
    weights[used] = w
    model = QualityModel(weights.astype(np.float32), float(b), 1.0, 0.0)
    if len({r[0] for r in for_check}) == 2:
        margin = np.array([b + float(r[3] @ weights[r[2]]) for r in for_check])
        model.slope, model.shift = _platt(margin, np.array([r[0] for r in for_check]))
    return model


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> QualityModel:
    """Model of ``label`` from about ``limit`` labelled rows outside the held-out fold.

    Features are made by tasks; the driver fits what ``limit`` bounds. Without labels of
    both kinds the model answers the share of ones (0.5 without any).
    """
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                made = sparse_features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), part.column("calibrate"), pa.array([m[0].astype("<u4").tobytes() for m in made], pa.binary()),
                     pa.array([m[1].astype("<f4").tobytes() for m in made], pa.binary())], names=["doc_id", "label", "calibrate", "buckets", "values"])

    sample = labelled_sample(docs, labels, label, limit, id_col, text_col).withColumn("calibrate", calibration_fold(F.col("doc_id")))
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(features, f"doc_id {kind}, label int, calibrate boolean, buckets binary, values binary").toArrow().sort_by("doc_id")
    return fit([(y, c, np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(v, "<f4")) for y, c, b, v in
                zip(*(rows.column(n).to_pylist() for n in ("label", "calibrate", "buckets", "values")))])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, n_words, the base counts, base_failed, probability, kept.

    ``n_repeat_words`` counts words inside 5-word windows that occur twice or more in the
    text, the first occurrence included, each word once. A row fails the base with fewer
    than 10 words or more than 20 % repeated words; null and empty texts have no words
    and fail. A row is kept when it passes the base and its probability reaches
    ``keep_from``. Repeated rows are judged alike; other columns are not read; an empty
    table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col, text_col))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                texts = part.column("text").to_pylist()
                counts = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, 5)
                probability = model.value.probability(texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(probability)], names=["doc_id", *names, "probability"])

    rows = texts_of(docs, id_col, text_col)
    out = rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {' long, '.join(names)} long, probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep_from))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Rows are judged where they lie: no join and no shuffle of the texts. A null text has
    no words and goes; rows that repeat are judged alike; an empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col, text_col))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, STEP):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                counts = np.array([text_counts(t) for t in texts], np.int64).reshape(-1, 5)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                yield part.filter(pa.array(~failed & (model.value.probability(texts) >= keep_from)))

    return docs.mapInArrow(judge, docs.schema)
