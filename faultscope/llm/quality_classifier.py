"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every word has an index vector, a few signs at places that its hash names. A word's
vector is the sum of the index vectors of its neighbours over a bounded sample of
training texts; words share 2**15 hashed rows. A text is the mean and the spread of its
words' vectors, how alike neighbouring words are, and its length. A network of two
layers in numpy, trained on the sample, gives the score; its temperature is fitted on a
fifth of the sample that the network doesn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultscope.llm.common import WordBatch, calibration_fold, held_out, labelled_sample, mix, sigmoid, slices, sums_between, texts_of
from faultscope.staging import stage

#: Labelled rows that vectors and network are fitted on, at most about so many.
SAMPLE = 6_000
BITS, DIMS, SIGNS, WINDOW = 15, 64, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 64, 3e-3, 1e-4
#: Score from which the label 1 is predicted.
PREDICT_FROM = 0.3
STEP = 1 << 20


def _rows_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _index_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of every word's index vector."""
    with np.errstate(over="ignore"):
        bits = mix(hashes[:, None] + np.arange(1, SIGNS + 1, dtype=np.uint64))
    return (bits % np.uint64(DIMS)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def context_sums(texts: list[str]) -> np.ndarray:
    """Sums of neighbours' index vectors per hashed row, over the texts."""
    words = WordBatch(texts)
    row, (place, sign) = _rows_of(words.hashes), _index_places(words.hashes)
    total = np.zeros((1 << BITS) * DIMS)
    for gap in range(1, WINDOW + 1):
        near = np.flatnonzero(words.doc[:-gap] == words.doc[gap:]) if len(row) > gap else np.zeros(0, np.int64)
        for a, b in ((near, near + gap), (near + gap, near)):
            total += np.bincount((row[a][:, None] * DIMS + place[b]).ravel(), weights=sign[b].ravel(), minlength=len(total))
    return total.reshape(-1, DIMS)


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Vectors of all hashed rows: damped, centred, of unit length.

    Tasks add up their texts, tasks of the next stage add up slices of the rows; the
    driver gets one table of a fixed size.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS, DIMS))
        for batch in batches:
            for part in slices(batch, "text", STEP):
                total += context_sums(part.column("text").to_pylist())
        used = np.flatnonzero(total.any(axis=1))
        for k in range(0, len(used), 4096):
            own = used[k:k + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own % 16, pa.int64()), pa.array(own), pa.array([v.astype("<f4").tobytes() for v in total[own]], pa.binary())], names=["slice", "row", "vec"])

    def merge(table: pa.Table) -> pa.Table:
        rows, place = np.unique(table["row"].to_numpy(), return_inverse=True)
        total = np.zeros((len(rows), DIMS))
        np.add.at(total, place, np.frombuffer(b"".join(table["vec"].to_pylist()), "<f4").reshape(-1, DIMS))
        return pa.table({"row": rows, "vec": pa.array([v.astype("<f4").tobytes() for v in total], pa.binary())})

    summed = sample.select("text").mapInArrow(local, "slice long, row long, vec binary").groupBy("slice").applyInArrow(merge, "row long, vec binary").toArrow()
    vectors = np.zeros((1 << BITS, DIMS), np.float32)
    if summed.num_rows:
        got = np.frombuffer(b"".join(summed["vec"].to_pylist()), "<f4").reshape(-1, DIMS)
        damped = np.sign(got) * np.log1p(np.abs(got))
        damped = damped - damped.mean(axis=0)
        vectors[summed["row"].to_numpy()] = damped / np.maximum(1e-6, np.linalg.norm(damped, axis=1, keepdims=True))
    return vectors


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """Features of every text, (n, 2 * DIMS + 3); zero but for the constant without words."""
    words = WordBatch(texts)
    v = vectors[_rows_of(words.hashes)]
    a, b = words.first[:-1], words.first[1:]
    n = np.maximum(1, b - a)[:, None]
    mean = sums_between(v, a, b) / n
    spread = np.sqrt(np.maximum(0, sums_between(v * v, a, b) / n - mean * mean))
    _, left = words.pairs()
    edges = np.searchsorted(left, words.first)
    alike = sums_between(np.einsum("ij,ij->i", v[left], v[left + 1]), edges[:-1], edges[1:]) / np.maximum(1, edges[1:] - edges[:-1])
    same = sums_between((words.hashes[left] == words.hashes[left + 1]).astype(np.float32), edges[:-1], edges[1:]) / np.maximum(1, edges[1:] - edges[:-1])
    return np.column_stack([mean, spread, alike, same, np.log1p(b - a) / 10]).astype(np.float32)


@dataclass
class QualityNet:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, texts: list[str]) -> np.ndarray:
        return sigmoid(self.logit(pooled(texts, self.vectors)) / self.temperature)


def _temperature(logit: np.ndarray, label: np.ndarray) -> float:
    """The temperature with the least log loss, by ternary search on a log scale."""
    def loss(log_t: float) -> float:
        z = logit / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, z) - label * z))

    low, high = -3.0, 3.0
    for _ in range(60):
        third = (high - low) / 3
        if loss(low + third) < loss(high - third):
            high -= third
        else:
            low += third
    return float(np.exp((low + high) / 2))


def fit_net(features: np.ndarray, label: np.ndarray, calibrate: np.ndarray, vectors: np.ndarray, seed: int = 7) -> QualityNet:
    width = 2 * DIMS + 3
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN)
    w2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN)
    share = float(np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99))
    b2 = float(np.log(share / (1 - share)))
    x, y = features[~calibrate].astype(np.float64), label[~calibrate].astype(np.float64)
    if len(set(y.tolist())) < 2:
        return QualityNet(vectors, np.zeros(width), np.ones(width), w1, b1, np.zeros(HIDDEN), b2, 1.0)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - centre) / scale
    theta = [w1, b1, w2, np.array([b2])]
    first, second = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            own = order[k:k + BATCH]
            t += 1
            hidden = np.tanh(x[own] @ theta[0] + theta[1])
            error = (sigmoid(hidden @ theta[2] + theta[3][0]) - y[own]) / len(own)
            back = np.outer(error, theta[2]) * (1 - hidden * hidden)
            grads = [x[own].T @ back + DECAY * theta[0], back.sum(axis=0), hidden.T @ error + DECAY * theta[2], np.array([error.sum()])]
            rate = RATE * (1 - epoch / EPOCHS)
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                theta[i] = theta[i] - rate * first[i] / (1 - 0.9 ** t) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
    net = QualityNet(vectors, centre, scale, theta[0], theta[1], theta[2], float(theta[3][0]), 1.0)
    if len(set(label[calibrate].tolist())) == 2:
        net.temperature = _temperature(net.logit(features[calibrate]), label[calibrate])
    return net


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> QualityNet:
    """Network for ``label`` from about ``limit`` labelled rows outside the held-out fold.

    Without labels of both kinds it answers the share of ones (0.5 without any).
    """
    sample = stage(labelled_sample(docs, labels, label, limit, id_col, text_col).withColumn("calibrate", calibration_fold(F.col("doc_id"))), "labelled")
    vectors = word_vectors(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                rows = [f.tobytes() for f in pooled(part.column("text").to_pylist(), shared.value)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("calibrate"), pa.array(rows, pa.binary())], names=["doc_id", "label", "calibrate", "features"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(features, f"doc_id {kind}, label int, calibrate boolean, features binary").toArrow().sort_by([("doc_id", "ascending"), ("features", "ascending")])
    x = np.frombuffer(b"".join(got["features"].to_pylist()), np.float32).reshape(-1, 2 * DIMS + 3)
    return fit_net(x, got["label"].to_numpy(), got["calibrate"].to_numpy().astype(bool), vectors)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", predict_from: float = PREDICT_FROM, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: good quality likelier), predicted.

    Only the text enters a score. Null and empty texts get the network's answer to no
    words. A row with a null doc_id is not held out. Repeated rows score alike; other
    columns are not read; an empty table gives an empty result.
    """
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, id_col, text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(net.value.score(part.column("text").to_pylist()))], names=["doc_id", "score"])

    rows = texts_of(docs, id_col, text_col)
    out = rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= predict_from).cast("int").alias("predicted"))
