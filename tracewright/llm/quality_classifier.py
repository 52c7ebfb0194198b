"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics are taken of every whole text. Counts, sums and sums of products per
class are added up over all labelled documents that may be learned from; shrinkage turns
them into one covariance per class. A score is the logistic of the difference of the two
Gaussian log densities (plus log priors), each from the Mahalanobis distance under a
Cholesky factor that is computed once.

Defined results: null text is empty and gets a score like any other; a very long text is
one text like any other (statistics are linear in it); null ids are scored and never
learned from; rows that repeat an id each count and are scored each; labels other than 0
and 1 are ignored; several labels of one document each count; where a class has no
labelled document, every score is the share of label 1 (0.5 without any label); a score
equal to the threshold is predicted 1; an empty table gives no rows; columns ``score`` and
``predicted`` of the input are replaced by ``score_quality``, all others are left alone.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm._common import held_out, id_text, map_batches, slices, small_enough

_SYMBOLS = bytes(b for b in b"*#$%&@^~<>{}[]\\|=+_/")
_DIGITS, _CAPITALS, _ENDS, _COMMAS = b"0123456789", bytes(range(65, 91)), b".!?", b",;:"
N_STATISTICS = 16


def statistics(text: str) -> list[float]:
    """Transformed statistics: logarithms of sizes, square roots of shares."""
    raw = text.encode("utf-8", "replace")
    n, words = len(raw), text.split()
    w, lines = len(words), text.split("\n")
    share = lambda chars: (n - len(raw.translate(None, chars))) / max(n, 1)
    sizes = np.fromiter(map(len, words), np.float64, w) if w else np.zeros(1)
    return [
        np.log1p(n),
        np.log1p(w),
        np.log1p(sizes.mean()),
        np.log1p(sizes.std()),
        np.log1p(sizes.max()),
        np.sqrt(len(set(words)) / max(w, 1)),
        np.sqrt(sum(map(operator.eq, words, words[1:])) / max(w, 1)),
        np.sqrt(share(_SYMBOLS)),
        np.sqrt(share(_DIGITS)),
        np.sqrt(share(_CAPITALS)),
        np.sqrt(share(_ENDS)),
        np.sqrt(share(_COMMAS)),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        np.sqrt(len(set(lines)) / len(lines)),
        np.sqrt(len(text) / max(n, 1)),
    ]


@dataclass
class Discriminant:
    """Two Gaussians in standardised coordinates."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]  # of the Cholesky factors
    offsets: list[float]  # log prior less half the log determinant
    constant: float | None = None

    #: Standardised statistics beyond this count as this far.
    REACH = 8.0

    @classmethod
    def fit(cls, counts: list[float], sums: list[np.ndarray], products: list[np.ndarray], shrinkage: float) -> Discriminant:
        total = sum(counts)
        d = len(sums[0])
        if min(counts) < 1:
            return cls(np.zeros(d), np.ones(d), [], [], [], counts[1] / total if total else 0.5)
        center = (sums[0] + sums[1]) / total
        spread = np.diag(products[0] + products[1]) / total - center**2
        scale = np.sqrt(np.maximum(spread, 1e-6))
        covs, means = [], []
        for n, s, p in zip(counts, sums, products, strict=True):
            mean = s / n
            covs.append((p / n - np.outer(mean, mean)) / np.outer(scale, scale))
            means.append((mean - center) / scale)
        pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / total
        inverses, offsets = [], []
        for n, cov in zip(counts, covs, strict=True):
            weight = min(1.0, shrinkage + d / (d + n))  # few documents lean on what both classes share
            own = (1 - weight) * cov + weight * pooled
            own = (1 - shrinkage) * own + shrinkage * np.trace(own) / d * np.eye(d) + 1e-4 * np.eye(d)
            factor = np.linalg.cholesky(own)
            inverses.append(np.linalg.inv(factor))
            offsets.append(float(np.log(n / total) - np.log(np.diag(factor)).sum()))
        return cls(center, scale, means, inverses, offsets)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.center) / self.scale, -self.REACH, self.REACH)
        logs = [o - 0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) for m, inv, o in zip(self.means, self.inverses, self.offsets, strict=True)]
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit_discriminant(labelled: DataFrame, shrinkage: float = 0.02) -> Discriminant:
    """From rows (text, label 0/1); only sums leave the executors, a few hundred numbers."""
    d = N_STATISTICS

    def partial(batches):
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            for part in slices(batch, 2000):
                labels = part.column("label").to_numpy(zero_copy_only=False)
                x = np.array([statistics(t) for t in part.column("text").to_pylist()], np.float64).reshape(-1, d)
                for k in (0, 1):
                    own = x[labels == k]
                    n[k] += len(own)
                    s[k] += own.sum(axis=0)
                    p[k] += own.T @ own
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([[n[k], *s[k], *p[k].ravel()] for k in (0, 1)], pa.list_(pa.float64()))], ["label", "sums"])

    parts = labelled.select("text", "label").mapInArrow(partial, "label int, sums array<double>")
    summed = parts.select("label", F.posexplode("sums").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((2, 1 + d + d * d))
    for r in summed:
        out[r["label"], r["at"]] = r["v"]
    return Discriminant.fit([out[k, 0] for k in (0, 1)], [out[k, 1 : 1 + d] for k in (0, 1)], [out[k, 1 + d :].reshape(d, d) for k in (0, 1)], shrinkage)


def train(docs: DataFrame, labels: DataFrame, shrinkage: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Learn from all labelled documents that are not held out; only theirs are read by Python."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("label_id")))
    if small_enough(known, 16):
        known = F.broadcast(known)
    return fit_discriminant(id_text(docs, id_col, text_col).join(known, F.col("doc_id") == F.col("label_id")), shrinkage)


def score_quality(docs: DataFrame, model: Discriminant, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` added, or replaced."""
    rows = docs.drop("score", "predicted")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        score = model.score(np.array([statistics(t) for t in texts], np.float64).reshape(-1, N_STATISTICS))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return map_batches(rows, run, ", ".join([*kinds, "score double", "predicted int"]))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, shrinkage: float = 0.02, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row."""
    model = train(docs, labels, shrinkage, id_col, text_col)
    scored = score_quality(id_text(docs, id_col, text_col), model, threshold)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
