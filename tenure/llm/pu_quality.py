"""Quality classifier learnt from trusted positives and unlabelled text.

The score is an additive logistic model over binned text statistics. It minimises the
non-negative unbiased risk

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])

with the logistic loss l, trusted positives P, unlabelled documents U and the class
prior pi. The prior is estimated from the scores of a first model that only separates P
from U: above any threshold, U holds at least pi times the share of P, and the smallest
ratio over all thresholds is the estimate.

Bin edges, gradients, risks and the prior are Spark aggregates over all rows. Each task
sends one number per bin, summed by Spark; only the curvature, which steers the steps
and not where they end, comes from a bounded sample on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import col, extended, fold_is_held_out, others
from tenure.session import stage

BINS = 16
#: Rows of the sample that gives the curvature.
CURVATURE_ROWS = 8_000
RIDGE = 1e-3
PRODUCED = ("score", "predicted")
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)
for _group, _members in enumerate(
    [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".,;:?'\"()-", b"!", b"|", b"#$%&*@^~+=<>[]{}\\/_`"], 1
):
    _CLASS[list(_members)] = _group
_CLASS[128:] = 10
NAMES = [
    "other", "upper", "lower", "digit", "space", "line_end", "punctuation", "exclamation", "bar", "symbol", "non_ascii",
    "log_bytes", "distinct_words", "repeated_neighbours", "word_bytes", "distinct_lines", "line_words", "capital_words", "marked_words",
]


def statistics(text: bytes | None) -> list[float]:
    """Statistics of a whole text; an empty one has zeros."""
    text = text or b""
    size = len(text)
    if not size:
        return [0.0] * len(NAMES)
    shares = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=11) / size
    words, lines = text.split(), text.split(b"\n")
    n = len(words) or 1
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    capital = sum(w.isupper() for w in words)
    marked = sum(w[-1] in b"!|#$%&*@^~+=<>\\/_" for w in words)
    return [
        *shares.tolist(), math.log(size), len(set(words)) / n, repeated / n, sum(map(len, words)) / n,
        len(set(lines)) / len(lines), n / len(lines), capital / n, marked / n,
    ]


def measured(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(NAMES))


def _rows(column: pa.Array) -> np.ndarray:
    return measured(column.cast(pa.binary()).to_pylist())


@dataclass
class Model:
    """Bin edges of each statistic, one weight per bin, and the prior that was estimated."""

    edges: list[list[float]]
    weights: np.ndarray
    prior: float = 0.5

    @property
    def offsets(self) -> np.ndarray:
        return 1 + np.concatenate(([0], np.cumsum([len(e) + 1 for e in self.edges])[:-1]))

    @property
    def size(self) -> int:
        return 1 + sum(len(e) + 1 for e in self.edges)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Numbers of the weights that a row adds up; 0 is the intercept."""
        found = [np.searchsorted(e, values[:, j], side="left") + o for j, (e, o) in enumerate(zip(self.edges, self.offsets, strict=True))]
        return np.stack([np.zeros(len(values), np.int64), *found], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1) if len(bins) else np.zeros(0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sums(rows: DataFrame, model: Model) -> dict[str, np.ndarray]:
    """Sums over all rows: counts, losses and gradients of positives (p) and unlabelled (u)."""
    size = model.size

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 2, 3))
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            positive = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            bins = model.bins(values)
            g = model.margin(bins)
            slope = _sigmoid(g)
            for k, (own, weight) in enumerate(((positive, np.ones(len(g))), (positive, slope), (np.ones(len(g), bool), slope))):
                total[:size, k] += np.bincount(bins[own].ravel(), np.repeat(weight[own], bins.shape[1]), minlength=size)
            total[size] += [positive.sum(), _softplus(g[positive]).sum(), _softplus(-g[positive]).sum()]
            total[size + 1] += [len(g), _softplus(g).sum(), 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2, dtype=np.int32)), *(pa.array(total[:, k]) for k in range(3))], names=["j", "a", "b", "c"])

    found = rows.mapInArrow(partial, "j int, a double, b double, c double").groupBy("j").agg(*[F.sum(c).alias(c) for c in "abc"]).collect()
    total = np.zeros((size + 2, 3))
    for r in found:
        total[r["j"]] = r["a"], r["b"], r["c"]
    return {
        "count_p": total[:size, 0], "down_p": total[:size, 1], "down_u": total[:size, 2],
        "n_p": total[size, 0], "loss_down_p": total[size, 1], "loss_up_p": total[size, 2], "n_u": total[size + 1, 0], "loss_down_u": total[size + 1, 1],
    }


def _curvature(model: Model, bins: np.ndarray) -> np.ndarray:
    """Second derivative of E[l(-g)] over the sample."""
    slope = _sigmoid(model.margin(bins))
    dense = np.zeros((len(bins), model.size))
    np.put_along_axis(dense, bins, 1.0, axis=1)
    return (dense * (slope * (1 - slope))[:, None]).T @ dense / max(1, len(bins)) + 2e-3 * np.diag(dense.mean(axis=0))


def _minimise(rows: DataFrame, model: Model, sample: np.ndarray, prior: float, steps: int, step_back: float = 0.5) -> None:
    """Newton steps on the non-negative risk; where the negative part is below zero, step back from it."""
    penalty = RIDGE * np.ones(model.size)
    penalty[0] = 0
    for _ in range(steps):
        s = _sums(rows, model)
        n_p, n_u = max(s["n_p"], 1), max(s["n_u"], 1)
        negative_risk = s["loss_down_u"] / n_u - prior * s["loss_down_p"] / n_p
        negative_slope = s["down_u"] / n_u - prior * s["down_p"] / n_p
        positive_slope = prior * (s["down_p"] - s["count_p"]) / n_p
        curvature = _curvature(model, sample) + np.diag(penalty + 1e-6)
        if negative_risk >= 0:
            slope = positive_slope + negative_slope + penalty * model.weights
            move = np.linalg.solve(curvature, slope)
        else:
            move = -step_back * np.linalg.solve(curvature, negative_slope)
        move *= min(1.0, 4.0 / max(1e-12, np.abs(move).max()))
        model.weights = model.weights - move
        if np.abs(move).max() < 1e-2:
            break


def _prior(rows: DataFrame, model: Model, cells: int = 400) -> float:
    """Smallest ratio of the shares of unlabelled rows and positives above a threshold, with two standard errors."""

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, p = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            positive = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            at = np.minimum((_sigmoid(model.margin(model.bins(values))) * cells).astype(int), cells - 1)
            u += np.bincount(at, minlength=cells)
            p += np.bincount(at[positive], minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), pa.array(u), pa.array(p)], names=["cell", "u", "p"])

    counts = np.zeros((cells, 2))
    for r in rows.mapInArrow(cell, "cell int, u long, p long").groupBy("cell").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect():
        counts[r["cell"]] = r["u"], r["p"]
    n_u, n_p = counts.sum(axis=0)
    if not n_u or not n_p:
        return 0.5
    above_u, above_p = np.cumsum(counts[::-1], axis=0).T / [[n_u], [n_p]]
    high = above_u + 2 * np.sqrt(np.maximum(above_u * (1 - above_u), 1 / n_u) / n_u)
    low = above_p - 2 * np.sqrt(np.maximum(above_p * (1 - above_p), 1 / n_p) / n_p)
    ratios = high[low > 0] / low[low > 0]
    return float(np.clip(ratios.min() if len(ratios) else 0.5, 0.02, 0.98))


def fit(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the model on ``docs`` as unlabelled text and the documents named in ``positives`` (one id column).

    Without positives or documents every score is the prior of one half.
    """
    bodies = docs.select(col(id_col).cast("string").alias("id"), col(text_col).alias("body"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.array(_rows(batch.column(1)).ravel())
            values = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(NAMES), dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["id", "v"])

    named = positives.select(col(positives.columns[0]).cast("string").alias("id")).distinct().withColumn("positive", F.lit(True))
    rows = stage(bodies.mapInArrow(measure, "id string, v array<double>").join(named, "id", "left").select("v", F.coalesce("positive", F.lit(False)).alias("positive"), F.xxhash64("id").alias("h")))
    shares = [k / BINS for k in range(1, BINS)]
    cuts = rows.agg(*[F.percentile_approx(F.element_at("v", j + 1), F.array(*map(F.lit, shares)), 2000).alias(f"c{j}") for j in range(len(NAMES))]).collect()[0]
    edges = [sorted(set(cuts[j] or [])) for j in range(len(NAMES))]
    total = rows.count()
    data = rows.select("v", "positive")
    sampled = rows.where(F.pmod("h", F.lit(1_000_000)) < int(min(1.0, CURVATURE_ROWS / max(total, 1)) * 1_000_000)).select("v").limit(2 * CURVATURE_ROWS)
    first = Model(edges, np.zeros(1 + sum(len(e) + 1 for e in edges)))
    sample = first.bins(np.array([r["v"] for r in sampled.collect()], np.float64).reshape(-1, len(NAMES)))
    if not len(sample) or data.where("positive").isEmpty():
        return first
    _minimise(data, first, sample, prior=0.5, steps=5)
    model = Model(edges, first.weights.copy(), _prior(data, first))
    _minimise(data, model, sample, prior=model.prior, steps=12)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to every row.

    Only the text enters. Null and empty texts are scored alike, equal texts get equal
    scores, an empty table gives an empty table. Columns named like a produced one are
    replaced.
    """
    passed = others(docs, *PRODUCED)
    at = passed.index(next(c for c in passed if c.lower() == text_col.lower()))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _sigmoid(model.margin(model.bins(_rows(batch.column(at)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*passed, *PRODUCED])

    return docs.select(*[col(c) for c in passed]).mapInArrow(apply, extended(docs, passed, "score double, predicted int"))


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the documents outside the held-out fold; positives are ids whose labels all say 1."""
    trusted = labels.where(~fold_is_held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    return fit(docs.where(~fold_is_held_out("doc_id")), trusted)
