"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are taken over the whole text, never over id, language or source: log sizes, word lengths, shares of
character classes and repeated lines. Shares are log-transformed. Class means and covariances come from one aggregation
of sums of products over every labelled training row (two rows reach the driver). Each covariance is shrunk toward the
pooled one and toward its diagonal, whose least size keeps it definite where all texts of a class are equal; its Cholesky factor is cached and a score is the logistic of the difference of the
Mahalanobis log densities plus the log prior odds.

Defined results: null and empty texts have the statistics of an empty text and are scored; a null id counts as the
empty text for the fold; repeated rows are scored each, repeated label rows count each; where either class has fewer than
two labelled rows outside the fold there is nothing to tell texts apart by, and every score is the smoothed share of label
1 among those rows, (n1 + 1) / (n + 2); texts that are all equal score the share of label 1, equal texts within each class
are told apart by their means; an empty documents table gives no rows; other columns, whatever their names, are
not read, and keep_good returns them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, materialize

FEATURES = ("log_words", "word_length", "upper", "symbol", "punctuation", "digit", "line_feed", "short_words", "distinct_words", "repeated_lines", "decorated_words", "long_words")
_LETTER_UPPER, _SYMBOL, _PUNCT, _DIGIT, _FEED, _SPACE = range(1, 7)


def _classes() -> np.ndarray:
    """A character class for each code point below 65536."""
    out = np.zeros(1 << 16, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        if c.isupper():
            out[k] = _LETTER_UPPER
        elif c.isdigit():
            out[k] = _DIGIT
    for chars, kind in (("#$%&*|!@^~=+<>{}[]\\_`/", _SYMBOL), (".,;:?'\"()-", _PUNCT), ("\n", _FEED), (" \t\r", _SPACE)):
        for c in chars:
            out[ord(c)] = kind
    return out


_TABLE: list[np.ndarray] = []


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    if not _TABLE:
        _TABLE.append(_classes())
    text = text or ""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    count = np.bincount(_TABLE[0][np.minimum(code, 0xFFFF)], minlength=7) if len(code) else np.zeros(7, int)
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(code))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if len(x) > 20]
    tail = sum(not w[-1].isalnum() and w[-1] not in ".,;:?'\")" for w in words)
    log = lambda share: float(np.log(share + 0.003))
    return [
        float(np.log1p(len(words))), float(np.log1p(sizes.mean() if len(words) else 0)), log(count[_LETTER_UPPER] / chars), log(count[_SYMBOL] / chars), log(count[_PUNCT] / chars), log(count[_DIGIT] / chars), log(count[_FEED] / chars),
        log(float((sizes <= 3).sum()) / n), log(len(set(words)) / n), log(1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0), log(tail / n), log(float((sizes > 12).sum()) / n),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of the two classes, with the constant of the log density difference.

    always: the score of every text, where the classes could not be told apart.
    """

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    offset: float
    always: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.always is not None:
            return np.full(len(x), self.always)
        z = np.clip((x - self.center) / self.scale, -8, 8)
        away = [((z - m) @ inv.T) ** 2 for m, inv in zip(self.means, self.inverse, strict=True)]
        return 1 / (1 + np.exp(np.clip(0.5 * (away[1].sum(1) - away[0].sum(1)) - self.offset, -700, 700)))


def solve(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float, diagonal: float) -> Discriminant:
    """The discriminant from each class's row count, sums and sums of products."""
    total, d = counts.sum(), sums.shape[1]
    if (counts < 2).any():
        none = np.zeros((2, d))
        return Discriminant(none[0], none[0] + 1, none, np.zeros((2, d, d)), 0.0, float((counts[1] + 1) / (total + 2)))
    center = sums.sum(0) / total
    scale = np.sqrt(np.maximum(np.diag(products.sum(0)) / total - center**2, 1e-6))
    means = (sums / counts[:, None] - center) / scale
    cov = np.stack([(products[k] / counts[k] - np.outer(sums[k], sums[k]) / counts[k] ** 2) / np.outer(scale, scale) for k in (0, 1)])
    pooled = np.tensordot(counts / total, cov, 1)
    factors = []
    for k in (0, 1):
        mixed = (1 - shrink) * cov[k] + shrink * pooled
        mixed = (1 - diagonal) * mixed + diagonal * np.eye(d) * max(np.trace(mixed) / d, 0.01)
        factors.append(np.linalg.cholesky(mixed))
    logs = [np.log(np.diag(f)).sum() for f in factors]
    offset = logs[0] - logs[1] + np.log(counts[1] / counts[0])
    return Discriminant(center, scale, means, np.stack([np.linalg.inv(f) for f in factors]), float(offset))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in texts])


def featurize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, x): x is the array of statistics."""
    return df.select(F.col(f"`{id_col}`").alias("id"), _statistics(F.col(f"`{text_col}`")).alias("x"))


def in_held_out(column, folds: int = 5, fold: int = 0):
    return F.pmod(crc_of_id(column), F.lit(folds)) == fold


def fit(features: DataFrame, labels: DataFrame, label_col: str = "quality", shrink: float = 0.3, diagonal: float = 0.05) -> Discriminant:
    """The discriminant of the labelled rows outside the held-out fold; every one of them counts."""
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    rows = features.where(~in_held_out(F.col("id"))).join(marks, "id")
    d = len(FEATURES)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    found = {r["y"]: r for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect()}
    value = lambda k, name: found[k][name] if k in found else 0
    counts = np.array([value(k, "n") for k in (0, 1)], float)
    s = np.array([[value(k, f"s{i}") for i in range(d)] for k in (0, 1)], float)
    p = np.array([[[value(k, f"p{max(i, j)}_{min(i, j)}") for j in range(d)] for i in range(d)] for k in (0, 1)], float)
    return solve(counts, s, p, shrink, diagonal)


def _scorer(model: Discriminant):
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.zeros(0))

    return score


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Rows (id, held_out, score, predicted) of every row of df; score is the probability of label 1."""
    features = materialize(featurize(df, id_col, text_col), "features")
    if features.isEmpty():
        return features.select(F.col("id").alias(id_col), F.lit(False).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    scored = features.select("id", in_held_out(F.col("id")).alias("held_out"), _scorer(fit(features, labels))("x").alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of df, with all their columns, whose text scores at least the threshold.

    Rows are written once with their statistics, which both the fit and the decision read.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = materialize(df.select(row, F.col("doc_id").alias("id"), _statistics(F.col("text")).alias("x")), "features")
    if rows.isEmpty():
        return df
    return rows.where(_scorer(fit(rows.select("id", "x"), labels))("x") >= threshold).select("row.*")
