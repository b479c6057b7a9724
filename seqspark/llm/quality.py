"""A quality classifier: regularised quadratic discriminant analysis over document statistics.

One pass over the whole texts turns each document into a short vector of transformed statistics, written once. Class moments are
summed over every labelled training row with partial sums in the tasks, so only one small matrix a class reaches the driver.
Class covariances are shrunk towards the pooled one and towards a multiple of the identity; their Cholesky factors are
computed once, their inverses ride to the tasks, and these score by the difference of the Mahalanobis log-densities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Shares of a class covariance that are replaced by the pooled covariance and then by its mean variance.
POOLED, SPHERE = 0.5, 0.05
#: Log-odds are divided by this before the logistic function, as the statistics aren't independent draws.
TEMPER, THRESHOLD = 4.0, 0.3
NAMES = ("chars", "words", "upper", "digit", "mark", "stop", "shout", "bar", "space", "line", "wide", "word_length", "distinct", "again", "lines_distinct", "top", "entropy", "ends")

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-|"])


def _odds(part: float, whole: float) -> float:
    """Log-odds of a share, kept finite by half a count on either side."""
    return float(np.log((part + 0.5) / (max(whole - part, 0.0) + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole UTF-8 text, in the order of ``NAMES``; finite for an empty one too."""
    n = len(text)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = text.split(b"\n")
    k = len(words)
    count = Counter(words)
    p = c[c > 0] / max(n, 1)
    letters = c[_LETTER].sum()
    again = sum(map(bytes.__eq__, words, words[1:]))
    odd_ends = sum(v for w, v in count.items() if not _LETTER[w[-1]] and w[-1] not in b".,")
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        _odds(c[65:91].sum(), letters),
        _odds(c[48:58].sum(), n),
        _odds(c[_MARKS].sum(), n),
        _odds(c[[44, 46]].sum(), n),
        _odds(c[33], n),
        _odds(c[124], n),
        _odds(c[[9, 10, 13, 32]].sum(), n),
        _odds(c[10], n),
        _odds(c[128:].sum(), n),
        float(np.log1p(sum(map(len, words)) / max(k, 1))),
        _odds(len(count), k),
        _odds(again, k),
        _odds(len(set(lines)), len(lines)),
        _odds(max(count.values(), default=0), k),
        float(-(p * np.log(p)).sum()),
        _odds(odd_ends, k),
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)`` for every row, repeated ones and null ids included, written to the shared folder; a null text counts as empty.

    Other columns are ignored, whatever their names. An empty table gives an empty one. A text of any length is counted in one pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py().encode() if t.is_valid else b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["id", "x"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, x array<double>"), "op1-features")


@dataclass
class Model:
    """Means, Cholesky factors and log-determinants of class 0 and class 1, and the log prior odds of class 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    prior: float

    def __post_init__(self):
        self.whiten = [np.linalg.inv(c) for c in self.factors]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        each = []
        for m, back, ld in zip(self.means, self.whiten, self.log_dets):
            z = back @ (x - m).T
            each.append(-0.5 * (z * z).sum(axis=0) - 0.5 * ld)
        return each[1] - each[0] + self.prior


def moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Label to the count, sums and sums of products over ``rows`` (x, y): added up in each task, then by label and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y = np.array(b.column(0).to_pylist(), float), b.column(1).to_numpy()
            for k in np.unique(y).tolist():
                own = np.column_stack((np.ones((y == k).sum()), x[y == k]))
                total[k] = total.get(k, 0.0) + own.T @ own
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([m.ravel()], pa.list_(pa.float64()))], ["y", "m"])

    part = rows.select("x", F.col("y").cast("int").alias("y")).mapInArrow(run, "y int, m array<double>")
    got = part.select("y", F.posexplode("m").alias("at", "v")).groupBy("y", "at").agg(F.sum("v").alias("v")).collect()  # 2 * (d + 1)^2 rows
    d = len(NAMES) + 1
    out: dict[int, np.ndarray] = {}
    for r in got:
        out.setdefault(r.y, np.zeros(d * d))[r.at] = r.v
    return {k: v.reshape(d, d) for k, v in out.items()}


def fit(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", pooled: float = POOLED, sphere: float = SPHERE) -> Model | None:
    """The model from all ``labels`` rows given; None unless both classes have a row, as with an empty table. An id's label is its largest one; each row of ``features`` with a labelled id counts, repeated ones too."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    got = moments(features.join(lab.hint("merge"), "id").select("x", "y"))
    if set(got) != {0, 1}:
        return None
    n = [got[k][0, 0] for k in (0, 1)]
    means = [got[k][0, 1:] / got[k][0, 0] for k in (0, 1)]
    cov = [got[k][1:, 1:] / got[k][0, 0] - np.outer(m, m) for k, m in zip((0, 1), means)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
    target = np.diag(scale**2)
    factors, dets = [], []
    for c in cov:
        c = (1 - pooled) * c + pooled * both
        c = (1 - sphere) * c + sphere * target + 1e-6 * np.eye(len(scale))
        factors.append(np.linalg.cholesky(c))
        dets.append(2 * float(np.log(np.diag(factors[-1])).sum()))
    return Model(means, factors, dets, float(np.log(n[1] / n[0])))


def score(features: DataFrame, model: Model | None, threshold: float = THRESHOLD, temper: float = TEMPER) -> DataFrame:
    """``(id, score, predicted)`` for every row of ``features``; 0.5 everywhere without a model."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            s = 1 / (1 + np.exp(-np.clip(m.log_odds(x) / temper, -40, 40))) if m and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return features.select("id", "x").mapInArrow(run, f"id {features.schema['id'].dataType.simpleString()}, score double, predicted int")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "utf-8")), F.lit(5)) == 0, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = feature_table(table(spark, sf_dir, "documents"))
    model = fit(feats, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(feats, model).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", "predicted")
