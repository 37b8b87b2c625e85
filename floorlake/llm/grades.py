"""Quality grades by ordinal cumulative-link regression on hashed text.

The grades of labelled rows are ordered: 0 poor, 1 good but toxic, 2 good. One weight per hashed
feature is shared by all grades, and thresholds in ascending order part them: the chance of at least
grade k is the logistic function of (margin - threshold k). Expected grade and tail probability follow from it, and a
document is kept if its chance of being at least ``GOOD`` is no less than ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .features import BUCKETS, Sparse, descend, margins, sigmoid
from .toxicity import fold, labelled_features

GRADES = 3
FIT_ROWS = 2000
GOOD, CUT = 1, 0.5
RIDGE = 2e-4


class GradeModel:
    def __init__(self, thresholds: np.ndarray, weights: np.ndarray):
        self.thresholds, self.weights = thresholds, weights

    def tails(self, texts: pa.Array) -> np.ndarray:
        """Chance of at least grade 1, 2, ... of each text."""
        return sigmoid(np.clip(margins(texts, self.weights)[:, None] - self.thresholds[None, :], -30, 30))


def fit_cumulative_link(rows: Sparse, grade: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """-> ascending thresholds and weights; every grade counts alike. Thresholds are a first one and positive steps."""
    n, m = len(grade), grades - 1
    share = np.bincount(grade, minlength=grades) / max(n, 1)
    cost = 1 / np.maximum(share * (share > 0).sum(), 1e-9)[grade] / n

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        steps = np.exp(np.clip(v[1:m], -20, 20))
        theta = v[0] + np.concatenate([[0], np.cumsum(steps)])
        w = v[m:]
        z = rows.dot(w)
        # Chance of the row's own grade: tail(grade) - tail(grade + 1).
        tail = np.concatenate([np.ones((n, 1)), sigmoid(np.clip(z[:, None] - theta, -30, 30)), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        high, low = tail[at, grade], tail[at, grade + 1]
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high), low * (1 - low)
        dz = -cost * (d_high - d_low) / p
        d_theta = np.zeros(m)
        for k in range(1, grades):
            d_theta[k - 1] = (cost * d_high / p)[grade == k].sum() - (cost * d_low / p)[grade == k - 1].sum()
        tails = np.cumsum(d_theta[::-1])[::-1]
        return float(-(cost * np.log(p)).sum()) + 0.5 * RIDGE * float(w @ w), np.concatenate([[tails[0]], tails[1:] * steps, rows.back(dz) + RIDGE * w])

    v = descend(loss, np.zeros(m + len(rows.kept)))
    return v[0] + np.concatenate([[0], np.cumsum(np.exp(np.clip(v[1:m], -20, 20)))]), v[m:]


def fit_grades(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> GradeModel:
    """Fit on at most ``fit_rows`` labelled rows of each grade from the training folds (crc32 of the id modulo 3 is not 1)."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2))
    given, flat, at = labelled_features(docs, labels, grade, fit_rows, id_col, text_col)
    if len(set(given.tolist())) < 2:  # nothing to learn from: everything is kept
        return GradeModel(np.arange(GRADES - 1) - 4.0, np.zeros(BUCKETS))
    upper = Sparse(flat, at, (given >= GRADES - 1).astype(float), apart=4.0)
    rows = Sparse(flat, at, (given >= GOOD).astype(float), apart=4.0, also=upper.kept)
    thresholds, weights = fit_cumulative_link(rows, given)
    return GradeModel(thresholds, rows.spread(weights))


def quality_grades(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, held_out, expected_grade, tail_probability, kept; one row per row of ``docs``.

    Null and empty texts get the grade of a text without words. Ids may be null or repeated, labels without both values or
    for unknown ids are not used, and other columns are not read.
    """
    model = fit_grades(docs, labels, id_col=id_col, text_col=text_col)

    @F.pandas_udf("array<double>")
    def tails(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = pa.array(part.fillna(""), pa.large_string())
            yield pd.Series([list(row) for lo, hi in slices(texts) for row in model.tails(texts.slice(lo, hi - lo))])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), tails(F.col(text_col)).alias("tails"))
    expected = F.aggregate("tails", F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", "held_out", expected.alias("expected_grade"), F.element_at("tails", GOOD).alias("tail_probability"), (F.element_at("tails", GOOD) >= CUT).alias("kept"))
