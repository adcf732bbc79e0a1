"""Quality classifier: regularised quadratic discriminant analysis of transformed document statistics.

Class means and covariances come from sums that every task adds up for itself; the driver receives one
small matrix per class. Covariances shrink toward the pooled one and then toward a multiple of the
identity. Workers score with the classes' Cholesky factors, computed once and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm.rules import N_CLASSES, base_counts, class_histogram
from pitscore.llm.shared import ship
from pitscore.llm.text import Prefix, Texts, byte_class, count_by, keep_texts, mix, scan

FEATURES = [
    "words", "word_length", "longest_word", "line_length", "lower", "upper", "digit", "stops", "symbols", "other", "non_ascii",
    "exclaims", "pipes", "duplicate_lines", "repeated_words", "distinct_words", "short_words", "symbol_words",
    "upper_words",
]
#: Shares are smoothed as if every text also held this much typical prose, so that a short text, of which
#: little is known, lies near the middle of both classes.
SMOOTH_CHARS, SMOOTH_WORDS, SMOOTH_LINES = 200.0, 40.0, 5.0
TYPICAL = (0.78, 0.03, 0.0, 0.03, 0.0, 0.0, 0.01, 0.0, 0.0, 0.0, 0.8, 0.35, 0.0, 0.0)
TYPICAL_LENGTH, TYPICAL_LONGEST = 5.0, 18.0
_UPPER, _LOWER = byte_class("[A-Z]"), byte_class("[a-z]")
_MARK = byte_class(r"[#*$%&|<>!]")


def statistics(t: Texts) -> np.ndarray:
    """Transformed statistics of each text: logarithms of sizes, arcsines of the roots of smoothed shares."""
    n = len(t)
    base = base_counts(t)
    hist = class_histogram(t).astype(float)
    size = hist.sum(axis=1) + SMOOTH_CHARS
    start, end, owner = t.words()
    words = base["n_words"] + SMOOTH_WORDS
    length = (end - start).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)

    def running(table):
        return np.concatenate([[0], np.cumsum(table[t.data])])

    def of_words(flag):
        return count_by(owner[flag], n)

    exclaim = running(np.arange(256) == ord("!"))
    pipe = running(np.arange(256) == ord("|"))
    newline = running(np.arange(256) == 10)
    upper, lower, mark = running(_UPPER), running(_LOWER), running(_MARK)
    per_text = lambda r: (r[t.bounds[1:]] - r[t.bounds[:-1]]).astype(float)
    keys = mix(Prefix(t.data).ranges(start, end) + mix(owner.astype(np.uint64) + np.uint64(1)))
    distinct = count_by(owner[np.unique(keys, return_index=True)[1]], n)
    lines = per_text(newline) + 1
    of_size = [hist[:, k] for k in (0, 1, 2, 4, 5, 6)] + [hist[:, 7:N_CLASSES].sum(axis=1), per_text(exclaim), per_text(pipe)]
    of_all_words = [
        base["n_repeat_words"],
        distinct,
        of_words(length <= 3),
        of_words(mark[end] > mark[start]),
        of_words((upper[end] - upper[start] >= 2) & (lower[end] == lower[start])),
    ]
    shares = [(x + SMOOTH_CHARS * p) / size for x, p in zip(of_size, TYPICAL[:9], strict=True)]
    shares.append(base["n_dup_lines"] / (lines + SMOOTH_LINES))
    shares += [(x + SMOOTH_WORDS * p) / words for x, p in zip(of_all_words, TYPICAL[9:], strict=True)]
    sizes = [
        base["n_words"],
        (base["word_chars"] + SMOOTH_WORDS * TYPICAL_LENGTH) / words,
        np.maximum(longest, TYPICAL_LONGEST),
        words / (lines + SMOOTH_LINES),
    ]
    return np.stack(
        [np.log1p(x) for x in sizes] + [np.arcsin(np.sqrt(np.clip(x, 0, 1))) for x in shares], axis=1
    )


@dataclass
class Model:
    """Means, Cholesky factors, log-determinants and log-priors of the two classes."""

    mean: np.ndarray
    factor: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray
    center: np.ndarray
    scale: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of label 1: the difference of the classes' log-densities and priors."""
        z = (x - self.center) / self.scale
        side = []
        for k in (0, 1):
            y = np.linalg.solve(self.factor[k], (z - self.mean[k]).T)
            side.append(self.log_prior[k] - self.log_det[k] / 2 - (y**2).sum(axis=0) / 2)
        return side[1] - side[0]

    def score(self, x: np.ndarray, temperature: float = 1.0) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / temperature, -500, 500)))


def discriminant(n, sums, squares, pooling: float, ridge: float) -> Model:
    """Fits from per-class counts, sums and sums of outer products."""
    d = sums.shape[1]
    total = max(n.sum(), 1)
    center = sums.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diag(squares.sum(axis=0)) / total - center**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        if n[k]:
            m = sums[k] / n[k]
            mean[k] = (m - center) / scale
            cov[k] = (squares[k] / n[k] - np.outer(m, m)) / np.outer(scale, scale)
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    factors, dets = [], []
    for k in (0, 1):
        weight = (1 - pooling) * n[k] / (n[k] + d)
        shrunk = weight * cov[k] + (1 - weight) * pooled
        level = max(np.trace(shrunk) / d, 1e-6)
        factor = np.linalg.cholesky((1 - ridge) * shrunk + ridge * level * np.eye(d))
        factors.append(factor)
        dets.append(2 * np.log(np.diag(factor)).sum())
    prior = np.log((n + 1) / (n.sum() + 2))
    return Model(mean, np.array(factors), np.array(dets), prior, center, scale)


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the statistics of the text."""

    def work(t):
        x = statistics(t)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
        return {"x": lists.cast(pa.list_(pa.float64()))}

    return scan(docs, ["doc_id"], "text", "x array<double>", work)


def usable_labels(labels: DataFrame, label: str = "quality") -> DataFrame:
    """One 0/1 label per document; rows with a null or another value, and documents with both labels, are
    left out."""
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).alias("label")).where(F.col("label").isin(0, 1))
    by_doc = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    return by_doc.where("label = _other").select("doc_id", "label")


def fit(stats: DataFrame, labels: DataFrame, pooling: float = 0.1, ridge: float = 0.02) -> Model:
    """The discriminant of the labelled rows of ``stats``; each task returns its sums only.

    Without labelled rows both classes are equal and every text scores one half; with one class only its
    prior decides.
    """
    ship(stats.sparkSession)
    d = len(FEATURES)

    def run(batches):
        n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten()).reshape(-1, d)
            y = np.asarray(batch.column(1))
            for k in (0, 1):
                own = x[y == k]
                n[k] += len(own)
                s[k] += own.sum(axis=0)
                q[k] += own.T @ own
        for k in (0, 1):
            values = np.concatenate([[n[k]], s[k], q[k].ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(values)), pa.array(np.arange(len(values))), pa.array(values)], ["k", "i", "v"]
            )

    rows = stats.join(labels, "doc_id").select("x", F.col("label").cast("bigint"))
    sums = rows.mapInArrow(run, "k bigint, i bigint, v double").groupBy("k", "i").agg(F.sum("v").alias("v"))
    flat = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():
        flat[r.k, r.i] = r.v
    return discriminant(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d), pooling, ridge)


def score(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` to statistics."""
    ship(stats.sparkSession)
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    kind = dict(stats.dtypes)["doc_id"]
    return stats.select("doc_id", "x").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with all columns, without the texts that score below the threshold. A null text is judged
    as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_texts(docs, "text", lambda t: shared.value.score(statistics(t)) >= threshold)
