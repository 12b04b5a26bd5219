"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of the whole text (counts, shares, repetition) are logged to make them near
normal. Per class the mean and covariance come from one distributed sum of moments over
all training rows; the covariance is shrunk towards the pooled one and its diagonal. The
Cholesky factors are computed once on the driver (a few hundred numbers), sent to the
tasks and reused: a score is the logistic of the Mahalanobis log-density difference plus
the log prior.

Null and empty texts have all statistics 0 and are scored like any other. Labels that are
null are ignored; repeated labels of a document count once per distinct value. With
fewer than two training rows of a class the score is that of the prior. Labels, language,
source and ids never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy
from .textstats import WordHashes, split_words

FEATURES = (
    "words", "word_length", "distinct_share", "repeat_share", "symbol_share", "bang_share",
    "capital_share", "digit_share", "comma_stop_share", "line_words",
)
SHRINK_POOLED, SHRINK_DIAGONAL = 0.3, 0.1
THRESHOLD = 0.3
HELD_OUT_OF = 5

_CAPITAL = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOP = np.frombuffer(b".,;:", np.uint8)


def statistics(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Transformed statistics of one text, in the order of FEATURES."""
    out = np.zeros(len(FEATURES))
    words = split_words(text)
    n = len(words)
    if not n:
        return out
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    h = hashes.of(words)
    distinct = len(np.unique(h))
    lines = sum(1 for x in text.split("\n") if x and not x.isspace())
    chars = sum(map(len, words))
    # shares of short texts are damped: one doubled word in ten says little
    share = lambda codes, of: np.log(0.01 + raw[codes].sum() / of)
    soft_n, soft_chars = n + 20, chars + 100
    out[:] = (
        np.log(n),
        np.log(chars / n),
        np.log(distinct / n) / np.log(n + 1.0),
        np.log(0.01 + np.count_nonzero(h[1:] == h[:-1]) / soft_n),
        share(_SYMBOL, soft_n),
        share(33, soft_n),
        share(_CAPITAL, soft_chars),
        share(_DIGIT, soft_chars),
        share(_STOP, soft_n),
        np.log(n / max(1, lines)),
    )
    return out


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = np.array([statistics(t.as_py(), hashes) for t in batch.column(1)]).reshape(-1, len(FEATURES))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of FEATURES) for every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(_featurise), "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 0 modulo HELD_OUT_OF; never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor, log determinant."""

    log_odds: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    whiten: tuple[np.ndarray, np.ndarray] | None = None
    log_det: tuple[float, float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        odds = np.full(len(x), self.log_odds)
        if self.means is not None:
            for sign, mean, w, det in zip((-1, 1), self.means, self.whiten, self.log_det, strict=True):
                odds += sign * -0.5 * (((x - mean) @ w.T) ** 2).sum(1) - sign * 0.5 * det
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -40, 40)))


def fit(rows: DataFrame, shrink_pooled: float = SHRINK_POOLED, shrink_diagonal: float = SHRINK_DIAGONAL) -> Discriminant:
    """Fit on all of ``rows(x, label)``: one aggregation of first and second moments per class."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = lambda i: F.get("x", F.lit(i))
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(x(i)).alias(f"s{i}") for i in range(d)], *[F.sum(x(i) * x(j)).alias(f"q{i}_{j}") for i, j in pairs])
    by = {r["label"]: r for r in sums.where("label in (0, 1)").collect()}  # two rows
    n = [by[c]["n"] if c in by else 0 for c in (0, 1)]
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < 2:
        return Discriminant(log_odds)
    means, scatter = [], []
    for c in (0, 1):
        mean = np.array([by[c][f"s{i}"] for i in range(d)]) / n[c]
        q = np.zeros((d, d))
        for i, j in pairs:
            q[i, j] = q[j, i] = by[c][f"q{i}_{j}"]
        means.append(mean)
        scatter.append(q - n[c] * np.outer(mean, mean))
    pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
    whiten, dets = [], []
    for c in (0, 1):
        cov = (1 - shrink_pooled) * scatter[c] / n[c] + shrink_pooled * pooled
        cov = (1 - shrink_diagonal) * cov + shrink_diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(factor))
        dets.append(float(2 * np.log(np.diag(factor)).sum()))
    return Discriminant(log_odds, tuple(means), tuple(whiten), tuple(dets))


def _scorer(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``; ``labels(doc_id, quality)`` marks some of them."""
    seen = materialise(features(docs), "quality-features")
    marked = labels.where("quality is not null").select("doc_id", F.col("quality").alias("label")).distinct()
    model = fit(seen.where(~held_out(F.col("doc_id"))).join(marked, "doc_id"))
    out = seen.mapInArrow(tidy(_scorer(model)), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` the classifier does not reject, columns unchanged.

    Rows are decided one by one: those of a repeated doc_id go only where their own text fails.
    """
    seen = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    marked = labels.where("quality is not null").select("doc_id", F.col("quality").alias("label")).distinct()
    train = seen.where(~held_out(F.col("doc_id"))).join(marked.select("doc_id").distinct(), "doc_id", "left_semi")
    model = fit(features(train).join(marked, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            x = np.array([statistics(t.as_py(), hashes) for t in texts]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
