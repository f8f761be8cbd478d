"""Document quality by a regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance, shrunk towards the pooled diagonal. The score is the logistic of a
scaled log-density difference; both Mahalanobis distances come from Cholesky factors that are inverted once.

Nulls and empty texts count as a text without words and get the score of those statistics. Rows are scored one
by one, so ties, repeated rows and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.llm.common import held_out, label_sample, labelled_texts, sigmoid, texts

#: Labelled rows used for fitting, at most.
MAX_ROWS = 12_000
THRESHOLD = 0.7
FOLDS, FOLD = 4, 2

# Frequent function words of the four languages.
STOP_WORDS = frozenset("""
the of and to in is that it for was on are as with be at by this from or an he his not but they have
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei um am sind noch wie
le la les de des du et en un une est que qui dans pour par sur pas au avec ce il elle ne se plus
el los las del y que se por con para una su al lo como más pero sus
""".split())

STATISTICS = ("words", "word_length", "long_words", "upper", "digits", "symbols", "marks", "stops", "distinct", "top_word",
              "repeated_lines", "repeated_grams", "line_words", "bars", "odd_words", "entropy", "sentence")


def _share(part: float, whole: float, weight: float = 1.0) -> float:
    """Logit of a share, with ``weight`` units of each kind added so that short texts stay near the middle.

    Marks counted against words may outnumber them ("10.0.0.1" has three stops), so what is left has a floor.
    """
    return float(np.log((part + weight * 0.02) / max(whole - part + weight, weight * 0.02)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of ``STATISTICS``."""
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    chars = len(text)
    lower, upper, digits = int(hist[97:123].sum()), int(hist[65:91].sum()), int(hist[48:58].sum())
    space = int(hist[9:14].sum() + hist[32])
    other = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    plain = int(hist[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    words = text.split()
    n = len(words)
    low = [w.strip(".,;:!?\"'()#$%&*") for w in text.lower().split()]
    counts: dict[str, int] = {}
    for w in low:
        counts[w] = counts.get(w, 0) + 1
    lines = [s for s in text.split("\n") if s.strip()]
    line_chars = sum(map(len, lines))
    h = np.fromiter(map(hash, low), np.int64, n).view(np.uint64)
    grams = n - 4
    again = 0
    if grams > 0:
        with np.errstate(over="ignore"):
            g = h[4:].copy()
            for i in (3, 2, 1, 0):
                g = g * np.uint64(0x9E3779B97F4A7C15) + h[i:i + grams]
        again = grams - len(np.unique(g))
    p = hist[hist > 0] / max(1, hist.sum())
    long = sum(1 for w in words if len(w) > 20)
    odd = sum(1 for w in low if not w.isalpha())
    return [
        np.log1p(n), np.log1p((chars - space) / max(1, n)), _share(long, n, 5), _share(upper, upper + lower, 20),
        _share(digits, chars, 20), _share(other - plain, chars, 20), _share(int(hist[33] + hist[63]), chars, 20),
        _share(sum(map(STOP_WORDS.__contains__, low)), n, 5), np.log((len(counts) + 1) / (n + 1) ** 0.8),
        _share(max(counts.values(), default=0), n, 5), _share(line_chars - sum(map(len, set(lines))), line_chars, 40),
        _share(again, max(grams, 0), 5), np.log1p(n / max(1, len(lines))), _share(int(hist[124] + hist[9]), n, 5),
        _share(odd, n, 5), float(-(p * np.log(p)).sum()), _share(int(hist[46] + hist[63]), n, 5),
    ]


def statistic_rows(batch: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in batch], np.float64).reshape(len(batch), len(STATISTICS))


@dataclass
class Discriminant:
    """Two shrunk Gaussians with cached inverse Cholesky factors, and the calibration of their difference."""

    centre: np.ndarray
    spread: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    logdets: tuple[float, float]
    prior: float
    scale: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.spread
        d = [((z - self.means[k]) @ self.factors[k].T) for k in (0, 1)]
        m = [-0.5 * np.einsum("ij,ij->i", d[k], d[k]) - self.logdets[k] for k in (0, 1)]
        return m[1] - m[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.difference(x) + self.shift)


def _gaussians(x: np.ndarray, y: np.ndarray, shrink: float) -> Discriminant:
    centre, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / spread
    pooled = np.ones(x.shape[1])
    means, factors, logdets = [], [], []
    for k in (0, 1):
        zk = z[y == k]
        mean = zk.mean(0)
        cov = (zk - mean).T @ (zk - mean) / max(1, len(zk))
        chol = np.linalg.cholesky((1 - shrink) * cov + shrink * np.diag(0.5 * pooled + 0.5 * np.diag(cov)) + 1e-4 * np.eye(x.shape[1]))
        means.append(mean)
        factors.append(np.linalg.inv(chol))
        logdets.append(float(np.log(np.diag(chol)).sum()))
    share = (y.mean() * len(y) + 1) / (len(y) + 2)
    return Discriminant(centre, spread, tuple(means), tuple(factors), tuple(logdets), float(np.log(share / (1 - share))))


def _calibrate(model: Discriminant, x: np.ndarray, y: np.ndarray) -> float:
    """Platt scaling of the difference by Newton steps; returns the mean log loss."""
    raw = model.difference(x)
    unit = float(np.abs(raw).mean()) + 1e-9
    d = np.clip(raw / unit, -4, 4)
    a, b = 1.0, 0.0
    t = np.where(y == 1, 1 - 1 / (len(y) + 2), 1 / (len(y) + 2))
    for _ in range(40):
        p = sigmoid(a * d + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - t) * d).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(w * d * d).sum() + 1e-3, (w * d).sum()], [(w * d).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
    a = max(a, 1e-3)
    p = np.clip(sigmoid(a * d + b), 1e-9, 1 - 1e-9)
    model.scale, model.shift = a / unit, b
    return float(-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean())


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    """Choose the shrinkage by log loss on every fourth row, then refit on all rows.

    Without rows of both classes the model gives the share of label 1 (0.5 without any row) to every text.
    """
    if len(y) < 20 or len(set(y.tolist())) < 2:
        d = len(STATISTICS)
        share = (float(y.sum()) + 1) / (len(y) + 2)
        flat = Discriminant(np.zeros(d), np.ones(d), (np.zeros(d),) * 2, (np.eye(d),) * 2, (0.0, 0.0), float(np.log(share / (1 - share))))
        return flat
    test = np.arange(len(y)) % 4 == 3
    best = None
    for shrink in (0.02, 0.05, 0.1, 0.2, 0.4, 0.7):
        model = _gaussians(x[~test], y[~test], shrink)
        loss = _calibrate(model, x[test], y[test])
        if best is None or loss < best[0]:
            best = (loss, shrink, model.scale, model.shift)
    model = _gaussians(x, y, best[1])
    model.scale, model.shift = best[2], best[3]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS,
          folds: int = FOLDS, fold: int = FOLD) -> Discriminant:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold; their statistics are computed in tasks."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistic_rows(texts(b))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    rows = labelled_texts(docs, label_sample(labels, label, folds, fold, max_rows)).mapInArrow(per_batch, "x array<double>, y int").toPandas()
    rows = rows.assign(k=[tuple(v) for v in rows["x"]]).sort_values(["k", "y"], ignore_index=True)  # the same fit in any task order
    x = np.array(rows["k"].tolist(), np.float64).reshape(len(rows), len(STATISTICS))
    order = np.random.default_rng(7).permutation(len(rows))
    return fit(x[order], rows["y"].to_numpy(np.int64)[order])


def score_documents(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """(all columns of ``docs``, score, predicted): one narrow pass over whole texts."""
    @F.pandas_udf("double")
    def score(batch: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batch:
            yield pd.Series(model.score(statistic_rows([t or "" for t in s])), dtype="float64")

    return docs.withColumn("score", score(F.coalesce("text", F.lit("")))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents scored at the threshold or above, with their columns."""
    return score_documents(docs, train(docs, labels)).where("predicted = 1").select(*docs.columns)
