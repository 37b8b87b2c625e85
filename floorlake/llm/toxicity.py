"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Voters are lexicons of insults, word beginnings that the labelled rows suggest, patterns, and the
given labels themselves; each votes toxic, clean, or not at all. The label model takes the unseen
class of a document to have made all votes: expectation maximisation finds how often each voter is
right and how often it speaks in either class. Votes that go together beyond what the class
explains are correlated; a voter counts the less the more it is correlated with others. The
classifier is a logistic model over hashed words and word beginnings, trained on the posteriors.

Model fitting is the only bounded step: at most ``FIT_ROWS`` labelled rows of each class from the
training folds. Scores of all rows come from their whole texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed
from .features import BUCKETS, Sparse, bucket, descend, feature_batches, margins, sigmoid, string_hashes
from .units import gather

FIT_ROWS = 3000
#: Bytes of text that are scored at once.
SLICE = 2 << 20
CUT = 0.7
#: Word beginnings taken from the labelled rows as voters.
INDUCED = 192
#: How sure the given labels are, and the weight of the squares of the classifier's weights.
TRUSTED, RIDGE = 0.98, 2e-4
#: Insults that are often used as such; each line is one voter.
LEXICONS = (
    ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "cretin"),
    ("stupid", "dumb", "fool", "fools", "dimwit", "halfwit", "brainless"),
    ("loser", "losers", "failure", "nobody", "reject"),
    ("clown", "clowns", "joke", "buffoon", "jerk"),
    ("scum", "scumbag", "vermin", "filth", "garbage", "trash", "rubbish"),
    ("pathetic", "worthless", "useless", "disgusting", "vile", "revolting"),
    ("hate", "despise", "loathe", "kill", "die"),
    ("dummkopf", "trottel", "arschloch", "abschaum", "versager"),
    ("imbécile", "connard", "crétin", "ordure", "abruti"),
    ("imbécil", "estúpido", "idiota", "basura", "escoria"),
)
#: Kinds of features that voters may take from the labelled rows are words and beginnings; signs and shapes vote in patterns.
_SIGNS = (("!!", "!!!", "?!"), ("***", "###", "%%%", "$$$", "&&&"))


def lexicon_buckets() -> list[np.ndarray]:
    """Buckets of each lexicon's words and of each pattern's signs."""
    words = [bucket(0, *string_hashes(pa.array(line, pa.large_string()))) for line in LEXICONS]
    return words + [bucket(10, *string_hashes(pa.array(line, pa.large_string()))) for line in _SIGNS]


def votes_of(flat: np.ndarray, at: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 none) of all voters on all rows of buckets; ``labels`` is 1, 0 or -1 for none."""
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    voters = []
    for own in lexicon_buckets():
        voters.append((np.bincount(row, np.isin(flat, own), n) > 0).astype(np.int8))
    df, toxic = np.bincount(flat, minlength=BUCKETS), np.bincount(flat, (labels == 1)[row], BUCKETS)
    rate = max(float((labels == 1).mean()), 1e-6)
    support = (toxic + rate) / (df + 1)
    strong = np.flatnonzero((df >= 8) & (support > max(0.9, 1 - (1 - rate) / 4)))
    strong = strong[np.argsort(-toxic[strong], kind="stable")][:INDUCED]
    place = np.full(BUCKETS, -1)
    place[strong] = np.arange(len(strong))
    col = place[flat]
    use = col >= 0
    induced = np.zeros((n, len(strong)), np.int8)
    induced[row[use], col[use]] = 1
    voters += list(induced.T)
    # Without any word that is far commoner in toxic rows a document votes for itself as clean.
    leaning = np.zeros(BUCKETS, bool)
    leaning[(df >= 4) & (support > 0.5 + rate / 2)] = True
    voters.append(np.where(np.bincount(row, leaning[flat], n) > 0, 0, -1).astype(np.int8))
    voters.append(np.where(labels < 0, 0, 2 * labels - 1).astype(np.int8))
    return np.stack(voters, axis=1)


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """-> posterior of the toxic class per row, each voter's accuracy where it speaks, and the voters' correlations given the class."""
    n, m = votes.shape
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    start = votes[:, -1].astype(float)
    q = np.where(start > 0, 0.95, np.where(start < 0, 0.05, prior))
    weight = np.ones(m)
    together = np.eye(m)
    for step in range(rounds):
        prior = float(np.clip(q.mean(), 1e-4, 1 - 1e-4))
        tables = []
        for share in (q, 1 - q):
            total = share.sum() + 2.0
            tables.append(((share @ up + 0.02) / total, (share @ down + 0.02) / total))
        # A voter that says nothing tells nothing: most lexicons are of one language.
        (a1, b1), (a0, b0) = tables
        # The given labels anchor the classes; their accuracy is not learnt.
        for table, up_rate in ((tables[0], TRUSTED), (tables[1], 1 - TRUSTED)):
            table[0][-1], table[1][-1] = up_rate, 1 - up_rate
        say_up, say_down = np.log(a1 / a0), np.log(b1 / b0)
        if step in (8, 16):  # the correlations of what the class leaves unexplained
            rest = votes - (q[:, None] * (a1 - b1) + (1 - q[:, None]) * (a0 - b0))
            scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            together = (rest / scale).T @ (rest / scale) / n
            weight = 1 / (1 + np.maximum(together - np.eye(m), 0).sum(axis=1))
            weight[-1] = 1.0
        score = np.log(prior / (1 - prior)) + up @ (weight * say_up) + down @ (weight * say_down)
        q = sigmoid(np.clip(score, -30, 30))
    right = (q @ up + (1 - q) @ down) / np.maximum(up.sum(axis=0) + down.sum(axis=0), 1)
    return q, right, together


class ToxicityModel:
    """A bias and a weight per bucket, and what the label model found out about the voters."""

    def __init__(self, bias: float, weights: np.ndarray, accuracy: np.ndarray, correlation: np.ndarray):
        self.bias, self.weights, self.accuracy, self.correlation = bias, weights, accuracy, correlation

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(np.clip(self.bias + margins(texts, self.weights), -30, 30))


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 3


def labelled_features(docs: DataFrame, labels: DataFrame, grade: Column, per_class: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``per_class`` rows of each grade from the training folds, chosen by a hash of the id -> grades, and each row's buckets (flat, with offsets).

    The rows come in the order of their ids.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("grade is not null and doc_id is not null").where(fold("doc_id") != 1).dropDuplicates(["doc_id"])
    chosen = None
    for value in (r[0] for r in rows.select("grade").distinct().orderBy("grade").limit(16).collect()):
        some = rows.where(F.col("grade") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = some if chosen is None else chosen.union(some)
    if chosen is None:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.zeros(1, np.int64)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The chosen rows are bounded by ``per_class``, so they may be broadcast.
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text").mapInArrow(feature_batches, "doc_id long, grade int, features array<int>")
    table = found.toArrow().combine_chunks()
    if not table.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.zeros(1, np.int64)
    lists = table.column("features").combine_chunks()
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    at = lists.offsets.to_numpy().astype(np.int64)
    flat, at = gather(lists.values.to_numpy(), at, order)
    return table.column("grade").to_numpy()[order].astype(np.int64), flat, at


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on labelled rows of the training folds (crc32 of the id modulo 3 is not 1)."""
    kind = F.when(F.col(label_col).isin(0, 1), F.col(label_col))
    given, flat, at = labelled_features(docs, labels, kind, fit_rows, id_col, text_col)
    if not (given == 1).any() or not (given == 0).any():  # nothing to learn from: every text gets the same score
        return ToxicityModel(-2.0, np.zeros(BUCKETS), np.zeros(0), np.zeros((0, 0)))
    votes = votes_of(flat, at, given)
    q, accuracy, correlation = label_model(votes, float(given.mean()))
    rows = Sparse(flat, at, q, apart=4.0)
    # Both classes count alike.
    cost = np.where(q > 0.5, 0.5 / max((q > 0.5).sum(), 1), 0.5 / max((q <= 0.5).sum(), 1)) * len(q)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = rows.dot(w[1:]) + w[0]
        r = cost * (sigmoid(z) - q) / rows.n
        value = float((cost * (np.logaddexp(0, z) - q * z)).sum()) / rows.n + 0.5 * RIDGE * float(w[1:] @ w[1:])
        return value, np.concatenate([[r.sum()], rows.back(r) + RIDGE * w[1:]])

    w = descend(loss, np.zeros(len(rows.kept) + 1))
    return ToxicityModel(float(w[0]), rows.spread(w[1:]), accuracy, correlation)


def score_column(model: ToxicityModel):
    """A column function text -> score; null texts count as empty."""

    def scores(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = pa.array(part.fillna(""), pa.large_string())
            yield pd.Series(np.concatenate([model.scores(texts.slice(lo, hi - lo)) for lo, hi in slices(texts, SLICE)]) if len(texts) else np.empty(0))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return trimmed(scores)(parts)

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """-> doc_id, held_out, score, predicted; one row per row of ``docs``.

    ``held_out`` tells that the row's fold is never learnt from (null id: not held out). Null and empty texts get
    the score of a text without features. Without labels of both classes all scores are equal. Other columns,
    whatever their names, are no inputs of a score.
    """
    score = score_column(fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
