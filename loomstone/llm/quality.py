"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: of bytes (1 to 3), and of word gaps (1 to 3), where a word's gap is the class
of the distance to its last use, so that a repeated phrase shows whatever its words are. Each indicator is scaled by the
log-count ratio of its n-gram between the classes, each text's vector has unit length, and a linear model with hinge
loss is fitted by dual coordinate descent. A logistic curve, fitted on margins of rows that the model was not fitted on,
turns a margin into a score.

Fitting takes at most `per_class` labelled rows of each label, those with the smallest hash of the id, and of these, in
a fixed order, as many as have FIT_FEATURES features: a bounded, documented sample. Scoring reads every whole text.

Defined cases: null and empty texts have no n-grams and score by the model's offset; rows with a null label or id are
not fitted on; with one class or none labelled every score is the share of label 1 (1 where nothing is labelled).
Repeated label rows count once. Empty tables give empty results. `score_documents` ignores extra columns;
`keep_good` returns all columns of its input unchanged, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import removed, whole_text, written

BITS = 18
PER_CLASS = 3000
#: Features of all fitted rows together: 512 MB on the driver. Of 6,000 rows of usual length all are far within it.
FIT_FEATURES = 64_000_000
THRESHOLD = 0.7
SEED = 42
_PIECE = 1 << 20
_GAPS = np.array([1, 2, 3, 5, 9, 17, 65])


def _hashed(grams: np.ndarray, salt: int) -> np.ndarray:
    x = (grams.astype(np.uint64) + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


class Featurizer:
    """Distinct hashed n-grams of a text; memory beyond the text is bounded by the number of buckets and a piece."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, dtype=bool)

    def __call__(self, text: bytes) -> np.ndarray:
        found: list[np.ndarray] = []
        for at in range(0, len(text), _PIECE):
            a = np.frombuffer(text[max(0, at - 2) : at + _PIECE], dtype=np.uint8).astype(np.uint32)
            self._add(found, _hashed(a, 1))
            self._add(found, _hashed(a[:-1] << 8 | a[1:], 2))
            self._add(found, _hashed(a[:-2] << 16 | a[1:-1] << 8 | a[2:], 3))
        last: dict[bytes, int] = {}
        gaps = []
        for i, word in enumerate(text.split()):
            gaps.append(i - last.get(word, -(1 << 30)))
            last[word] = i
        if gaps:
            g = np.searchsorted(_GAPS, np.array(gaps), side="right").astype(np.uint32)
            self._add(found, _hashed(g, 4))
            self._add(found, _hashed(g[:-1] << 4 | g[1:], 5))
            self._add(found, _hashed(g[:-2] << 8 | g[1:-1] << 4 | g[2:], 6))
        out = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.seen[out] = False
        return out

    def _add(self, found: list[np.ndarray], idx: np.ndarray) -> None:
        fresh = idx[~self.seen[idx]]
        if len(fresh):
            fresh = np.unique(fresh)
            self.seen[fresh] = True
            found.append(fresh)


@dataclass
class Model:
    weight: np.ndarray  #: model weight times log-count ratio of each bucket
    square: np.ndarray  #: square of the log-count ratio
    bias: float
    slope: float
    offset: float

    def margin(self, idx: np.ndarray) -> float:
        norm = math.sqrt(float(self.square[idx].sum())) if len(idx) else 0.0
        return self.bias + (float(self.weight[idx].sum()) / norm if norm else 0.0)

    def score(self, idx: np.ndarray) -> float:
        z = self.slope * self.margin(idx) + self.offset
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of (share of the n-gram in class 1 / share in class 0), smoothed."""
    p, q = np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)
    for idx, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[idx] += 1
    return np.log(p / ((y > 0).sum() + 2 * alpha)) - np.log(q / ((y < 0).sum() + 2 * alpha))


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss over unit vectors with a bias feature."""
    w, bias, alpha = np.zeros_like(r), 0.0, np.zeros(len(rows))
    values = []
    for idx in rows:
        x = r[idx]
        norm = math.sqrt(float(x @ x))
        values.append(x / norm if norm else x)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, x, label = rows[i], values[i], y[i]
            q = float(x @ x) + 1.0
            grad = label * (float(w[idx] @ x) + bias) - 1.0
            new = min(max(alpha[i] - grad / q, 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * label
                w[idx] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def logistic(margins: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets; the classes weigh as in all labelled rows."""
    pos, neg = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    wt = np.where(y > 0, share / pos, (1 - share) / neg) * len(y)
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([(wt * (p - t) * margins).sum() + 1e-3 * a, (wt * (p - t)).sum()])
        d = wt * p * (1 - p)
        h = np.array([[(d * margins**2).sum() + 1e-3, (d * margins).sum()], [(d * margins).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], labels: np.ndarray, share: float) -> Model:
    """labels: 0 or 1; share: of label 1 among all labelled rows. Every fifth row is kept for the logistic curve."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len({*y}) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        none = np.zeros(1 << BITS)
        return Model(none, none, 0.0, 1.0, math.log(p / (1 - p)))
    aside = np.arange(len(y)) % 5 == 4
    if len({*y[aside]}) < 2 or len({*y[~aside]}) < 2:
        aside = np.zeros(len(y), bool)
    main = np.flatnonzero(~aside)
    r = log_count_ratio([rows[i] for i in main], y[main])
    w, bias = descend([rows[i] for i in main], y[main], r)
    model = Model(w * r, r * r, bias, 1.0, 0.0)
    judged = np.flatnonzero(aside) if aside.any() else main
    margins = np.array([model.margin(rows[i]) for i in judged])
    model.slope, model.offset = logistic(margins, y[judged], share)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column | None, per_class: int, id_col: str, text_col: str):
    """(features, labels, share of label 1) of the fitted rows; the texts become features on the executors."""
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("mark_id"), F.col(label).cast("int").alias("mark"))
    marks = marks.where("mark_id IS NOT NULL AND mark IN (0, 1)")
    if usable is not None:
        marks = marks.where(usable)
    marks = marks.groupBy("mark_id").agg(F.max("mark").alias("mark"))
    counts = {r["mark"]: r["count"] for r in marks.groupBy("mark").count().collect()}
    chosen = [r for y in (0, 1) for r in marks.where(F.col("mark") == y).orderBy(F.xxhash64("mark_id"), "mark_id").limit(per_class).collect()]
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
    if not chosen:
        return [], np.zeros(0), share

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer()
        for batch in batches:
            idx = [of(t).astype(np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in idx], pa.binary())], names=["mark_id", "mark", "idx"])

    ids = spark.createDataFrame([(r["mark_id"], r["mark"]) for r in chosen], "mark_id long, mark int")
    picked = docs.select(F.col(id_col).cast("long").alias("mark_id"), whole_text(text_col).alias("body")).join(F.broadcast(ids), "mark_id")  # at most 2 * per_class ids
    made = written(picked.select("mark_id", "mark", "body").mapInArrow(features, "mark_id long, mark int, idx binary"), "quality-features")
    # At most 2 * per_class sizes reach the driver first; then the features of as many rows, in a fixed order, as FIT_FEATURES allows.
    sizes: dict[int, int] = {}
    for r in made.select("mark_id", F.octet_length("idx").alias("size")).collect():
        sizes[r["mark_id"]] = max(sizes.get(r["mark_id"], 0), r["size"] // 4)
    order = sorted(sizes, key=lambda i: (i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    order = [i for i, total in zip(order, np.cumsum([sizes[i] for i in order]).tolist(), strict=True) if total <= FIT_FEATURES or i == order[0]]
    taken = spark.createDataFrame([(i,) for i in order], "mark_id long")
    rows = made.join(F.broadcast(taken), "mark_id").collect()  # as many ids as above
    removed(made)
    got = {r["mark_id"]: (r["mark"], np.frombuffer(bytes(r["idx"]), np.int32).astype(np.int64)) for r in sorted(rows, key=lambda r: (r["mark_id"], bytes(r["idx"])))}
    return [got[i][1] for i in order], np.array([got[i][0] for i in order]), share


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits the model; `usable` is a condition on mark_id that picks the labelled rows to learn from."""
    return fit(*labelled_sample(docs, labels, label, usable, per_class, id_col, text_col))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer()
        for batch in batches:
            scores = np.array([model.score(of(t)) for t in batch.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("body")).mapInArrow(judge, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't reject, with all their columns; one pass, no shuffle."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Featurizer()
        for batch in batches:
            good = [model.score(of(t.encode() if t is not None else b"")) >= threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
