"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a short vector of statistics (lengths, shares of character kinds, repetition), shares as smoothed
logits and lengths as logarithms, standardised.  Each class has a mean and a covariance, shrunk towards the pooled
covariance and towards its own diagonal.  The difference of the two log densities comes from Mahalanobis distances
through Cholesky factors that are computed once and cached with the model; a logistic curve fitted to the training
rows' differences turns it into a score between 0 and 1.

Labels are learnt from a bounded sample: of the labelled rows outside the held-out fold, those with the smallest
hashes, ``TRAIN_ROWS`` at most.  Scoring covers every row and whole text.  No input of a score is a label, language,
source or id.

Defined cases: a null text is empty; a very long text is measured whole; an empty text has a score like any other; labels that are null or without a
document are not used; with fewer than two labelled rows of either class the score is the smoothed share of class 1;
a repeated ``doc_id`` is scored row by row; an empty table gives an empty result; further columns, whatever their
names, are ignored, and kept by :func:`keep_good`.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, require

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
#: Weight of the pooled covariance, and of the diagonal, in each class's.
POOLED, DIAGONAL = 0.3, 0.05
THRESHOLD = 0.7
HELD_OUT = 2

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LOWER = np.zeros(256, bool)
_LOWER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_HIGH = np.arange(256) >= 128
_COMMON_MARK = np.zeros(256, bool)
_COMMON_MARK[[ord(c) for c in ".,;:'\"-?()"]] = True
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _HIGH | _COMMON_MARK)

NAMES = ("words", "word_length", "upper", "digit", "symbol", "mark", "entropy", "distinct", "top_word", "top_pair", "repeated_lines", "line_words", "short", "long", "marked_words", "capitals")


def _logit(count: float, of: float) -> float:
    """Of a share, smoothed so that short texts stay near the middle."""
    return math.log((count + 0.5) / (max(of - count, 0) + 0.5))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES."""
    data = (text or "").encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    solid = int(counts[~_SPACE].sum())
    words = data.split()
    n = len(words)
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = counts[~_SPACE & (counts > 0)] / max(solid, 1)
    lengths = [len(w) for w in words]
    low = math.log1p(n)
    return [
        low,
        math.log1p(solid / max(n, 1)),
        _logit(counts[_UPPER].sum(), counts[_UPPER | _LOWER].sum()),
        _logit(counts[_DIGIT].sum(), solid),
        _logit(counts[_SYMBOL].sum(), solid),
        _logit(counts[_COMMON_MARK].sum(), solid),
        float(-(p * np.log(p)).sum()),
        _logit(len(seen), n),
        _logit(max(seen.values(), default=0), n),
        _logit(max(pairs.values(), default=0), n),
        _logit(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(len(lines), 1)),
        _logit(sum(x <= 2 for x in lengths), n),
        _logit(sum(x >= 14 for x in lengths), n),
        _logit(sum(1 for w in words if _SYMBOL[w[-1]]), n),
        _logit(sum(1 for w in words if _UPPER[w[0]]), n),
    ]


@dataclass
class Model:
    """Means and inverse Cholesky factors by class, in standardised statistics; the curve of the score."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    log_dets: list[float] = field(default_factory=list)
    slope: float = 0.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        out = np.zeros(len(z))
        for sign, mean, factor, log_det in zip((-1, 1), self.means, self.factors, self.log_dets):
            out -= sign * 0.5 * ((((z - mean) @ factor.T) ** 2).sum(axis=1) + log_det)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        d = self.slope * self.squash(self.difference(x)) + self.shift if self.factors else np.full(len(x), self.shift)
        return 1 / (1 + np.exp(-np.clip(d, -50, 50)))

    @staticmethod
    def squash(d: np.ndarray) -> np.ndarray:
        """Large differences count by their square roots, so far outliers do not steer the curve."""
        return np.sign(d) * np.sqrt(np.abs(d))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model:
    """``x``: rows of statistics, ``y``: 0 or 1."""
    x, y = np.asarray(x, float).reshape(-1, len(NAMES)), np.asarray(y, int)
    model = Model(x.mean(axis=0) if len(x) else np.zeros(len(NAMES)), np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(len(NAMES)))
    sizes = [(y == k).sum() for k in (0, 1)]
    if min(sizes) < 2:
        model.shift = math.log((sizes[1] + 1) / (sizes[0] + 1))
        return model
    z = (x - model.centre) / model.scale
    parts = [z[y == k] for k in (0, 1)]
    covs = [np.cov(part.T) for part in parts]
    both = sum((n - 1) * c for n, c in zip(sizes, covs)) / (sum(sizes) - 2)
    for part, n, cov in zip(parts, sizes, covs):
        share = max(pooled, min(1.0, len(NAMES) / n))
        cov = (1 - share) * cov + share * both
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        model.means.append(part.mean(axis=0))
        model.factors.append(np.linalg.inv(lower))
        model.log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
    d = Model.squash(model.difference(x))
    a, b = 0.1, 0.0
    for _ in range(50):  # Newton steps of a lightly held logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * d).sum() + 0.01 * a, (p - y).sum()])
        h = np.array([[(w * d * d).sum() + 0.01, (w * d).sum()], [(w * d).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def held_out():
    """Whether a row belongs to the fold that no label is learnt from."""
    return F.coalesce(_fold() == F.lit(HELD_OUT), F.lit(False))


def _vectors(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in batch.column(column)], float).reshape(-1, len(NAMES))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality") -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold, chosen by hash.

    Only chosen ids are sent out; only their vectors come back: both are bounded by ``rows``.
    """
    require(docs, ("doc_id", "text"))
    require(labels, ("doc_id", label))
    usable = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).filter(~held_out())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows).dropDuplicates(["doc_id"])
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("y", "text", "doc_id")

    def run(batches):
        claim()
        for batch in batches:
            x = _vectors(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["y", "doc_id", "x"])

    got = found.mapInArrow(run, "y int, doc_id long, x array<double>").orderBy("doc_id", "x").limit(2 * rows).toArrow()
    return fit(np.array(got.column("x").to_pylist(), float), np.array(got.column("y").to_pylist(), int))


def score(docs: DataFrame, model: Model, extra=()) -> DataFrame:
    """``doc_id, score`` and the ``extra`` columns of every row.  No shuffle; the model is a few kilobytes."""

    def run(batches):
        claim()
        for batch in batches:
            s = model.score(_vectors(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), *batch.columns[2:]], ["doc_id", "score", *names])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *extra)
    names = rows.columns[2:]
    ddl = ", ".join(["doc_id long, score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[2:])])
    return rows.mapInArrow(run, ddl)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: ``doc_id, held_out, score, predicted``."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents predicted 1, with all their columns; rows pass through the scorer, so nothing is shuffled."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches):
        claim()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            good = model.score(_vectors(batch, at)) >= threshold
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema).select(*names)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``; labels outside the held-out fold."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
