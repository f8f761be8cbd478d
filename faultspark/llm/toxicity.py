"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of rows of one table, picked by hashes of the word, its beginnings and its end, so inflected
and unseen forms share most of it. Filters of one, two and three words slide over the text, each keeps its maximum, and a logistic
layer weighs the maxima. The network is trained in numpy. Its output is then calibrated by language, which is told
from the text by stop words: a scale and a shift for each, drawn towards the common ones where rows are few. A score of
0.5 is each language's threshold.

For scoring, embeddings and filters of a word are multiplied once and remembered, so a text costs a few additions a word.
Long texts are convolved in stretches that overlap by two words, which gives the same maxima.

Nulls and empty texts get the score of a text without words. Rows are scored one by one, so ties, repeated rows and
extra columns change nothing; an empty table gives an empty result. Without labels of both classes every score is the share
of label 1 (0.5 without labels).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultspark.llm.common import held_out, label_sample, labelled_texts, sigmoid

#: Labelled rows used for training, at most.
MAX_ROWS = 6_000
FOLDS, FOLD = 5, 0
BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
EPOCHS, BATCH = 6, 48
CACHE_WORDS, STRETCH = 250_000, 100_000
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‚’…"

# Stop words that tell the languages apart.
LANGUAGES = {
    "en": "the of and to in is that it for was on are with be this by from".split(),
    "de": "der die und den von zu das mit sich auf für ist im nicht ein eine als".split(),
    "fr": "le les des du et une est que qui dans pour par sur pas au avec elle".split(),
    "es": "el los las del y que por con para una su al lo como más pero se".split(),
}
_TONGUE = {w: [k for k, (_, ws) in enumerate(LANGUAGES.items()) if w in ws] for ws in LANGUAGES.values() for w in ws}


def word_rows(word: str) -> list[int]:
    """Table rows of a word: itself, its beginnings of three to six bytes, its last four. Row 0 stays zero."""
    b = word.strip(_MARKS).encode("utf-8", "replace")
    n = len(b)
    if not n:
        return [0] * 6
    c = zlib.crc32(b[:3])
    out = [zlib.crc32(b, 1), c if n > 2 else 0, 0, 0, 0, zlib.crc32(b[-4:], 2) if n > 4 else 0]
    for k in range(3, min(n, 6)):
        c = zlib.crc32(b[k:k + 1], c)
        out[k - 1] = c
    return [h % (BUCKETS - 1) + 1 if h else 0 for h in out]


def tongues(words: list[str]) -> np.ndarray:
    """Stop-word votes of each distinct word, one column a language."""
    out = np.zeros((len(words), len(LANGUAGES)), np.float32)
    for i, w in enumerate(words):
        for k in _TONGUE.get(w.strip(_MARKS), ()):
            out[i, k] = 1.0
    return out


def split_words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words of a column of texts, the code of each word, and where each text's words end."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(coded) else np.zeros(0, np.int64)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), codes, lists.offsets.to_numpy()


@dataclass
class Network:
    table: np.ndarray  # BUCKETS x WIDTH
    filters: list[np.ndarray]  # per width: width x WIDTH x FILTERS
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    weights: np.ndarray
    offset: float = 0.0
    calibration: np.ndarray = field(default_factory=lambda: np.tile([1.0, 0.0], (len(LANGUAGES) + 1, 1)))

    def pooled(self, emb: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima per text and filter, and where they are; ``emb`` has two zero rows behind each text, ``cut`` its start."""
        best, where = [], []
        for w, f in zip(WIDTHS, self.filters):
            padded = np.concatenate([emb, np.zeros((w - 1, emb.shape[1]), emb.dtype)]) if w > 1 else emb
            out = sum(padded[i:i + len(emb)] @ f[i] for i in range(w))
            out[np.concatenate([cut[1:] - 1, cut[1:] - 2])] = 0  # windows that start behind a text
            top = np.maximum.reduceat(out, cut[:-1], axis=0)
            spot = np.empty(top.shape, np.int64)
            for d in range(len(cut) - 1):
                spot[d] = out[cut[d]:cut[d + 1]].argmax(0) + cut[d]
            best.append(top)
            where.append(spot)
        return np.concatenate(best, 1), np.concatenate(where, 1)


def train_network(texts: list[str], y: np.ndarray, seed: int = 11) -> Network:
    """Adam on the logistic loss, positives weighted up; gradients flow through the maxima only."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32),
                  [rng.normal(0, 0.3, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS],
                  np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32))
    net.table[0] = 0
    words, codes, ends = split_words(pa.array(texts, pa.string()))
    rows = np.array([word_rows(w) for w in words] + [[0] * 6], np.int64)
    pad = len(words)
    docs = [np.r_[codes[a:b], pad, pad] for a, b in zip(ends[:-1], ends[1:])]
    weight = np.where(y == 1, np.clip((y == 0).sum() / max(1, (y == 1).sum()), 1, 4), 1.0)
    moment: dict[int, list[np.ndarray]] = {}
    steps = 0

    def adam(key: int, value: np.ndarray, grad: np.ndarray, rate: float, some: np.ndarray | None = None) -> None:
        m, v = moment.setdefault(key, [np.zeros_like(value), np.zeros_like(value)])
        s = slice(None) if some is None else some
        m[s] = 0.9 * m[s] + 0.1 * grad
        v[s] = 0.99 * v[s] + 0.01 * grad * grad
        value[s] -= rate * m[s] / (np.sqrt(v[s]) + 1e-6)

    for epoch in range(EPOCHS):
        rate = 0.02 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            seq = np.concatenate([docs[i] for i in pick])
            cut = np.concatenate([[0], np.cumsum([len(docs[i]) for i in pick])])
            emb = net.table[rows[seq]].sum(1)
            top, spot = net.pooled(emb, cut)
            act = np.maximum(top + net.bias, 0)
            p = sigmoid(act @ net.weights + net.offset)
            g = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            d_act = g[:, None] * net.weights[None, :] * (act > 0)
            steps += 1
            gemb: dict[int, np.ndarray] = {}
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                da, sp = d_act[:, cols], spot[:, cols]
                gf = np.zeros_like(net.filters[k])
                for i in range(w):
                    pos = np.minimum(sp + i, len(emb) - 1)
                    gf[i] = np.einsum("df,dfe->ef", da, emb[pos])
                    np_grad = da[:, :, None] * net.filters[k][i].T[None, :, :]
                    flat = pos.ravel()
                    u, inv = np.unique(flat, return_inverse=True)
                    sums = np.zeros((len(u), WIDTH), np.float32)
                    np.add.at(sums, inv, np_grad.reshape(-1, WIDTH))
                    for a, b in zip(u.tolist(), sums):
                        gemb[a] = gemb[a] + b if a in gemb else b
                adam(k, net.filters[k], gf, rate)
            adam(10, net.bias, d_act.sum(0), rate)
            adam(11, net.weights, act.T @ g + 1e-4 * net.weights, rate)
            net.offset -= rate * float(g.sum())
            if gemb:
                spots = np.fromiter(gemb, np.int64, len(gemb))
                grads = np.stack([gemb[i] for i in gemb])
                ids = rows[seq[spots]]
                u, inv = np.unique(ids.ravel(), return_inverse=True)
                sums = np.zeros((len(u), WIDTH), np.float32)
                np.add.at(sums, inv, np.repeat(grads, ids.shape[1], axis=0))
                keep = u > 0
                adam(12, net.table, sums[keep], rate, u[keep])
    return net


class Scorer:
    """Scores texts; keeps the filtered embedding of each word it has seen."""

    _kept: dict[str, "Scorer"] = {}

    @classmethod
    def kept(cls, key: str, net: Network) -> "Scorer":
        """One per Python worker for the network named ``key``, kept from task to task."""
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(net)
        return cls._kept[key]

    def __init__(self, net: Network):
        self.net = net
        self.forget()

    def forget(self) -> None:
        cols = sum(WIDTHS) * FILTERS
        self.index: dict[str, int] = {}
        self.products = np.zeros((1, cols), np.float32)  # row 0: beyond a text
        self.votes = np.zeros((1, len(LANGUAGES)), np.float32)

    def learn(self, words: list[str]) -> None:
        made = []
        for at in range(0, len(words), 20_000):
            emb = self.net.table[np.array([word_rows(w) for w in words[at:at + 20_000]], np.int64)].sum(1)
            made.append(np.concatenate([emb @ f[i] for f in self.net.filters for i in range(len(f))], 1))
        self.index.update(zip(words, range(len(self.products), len(self.products) + len(words))))
        self.products = np.concatenate([self.products, *made])
        self.votes = np.concatenate([self.votes, tongues(words)])

    def raw(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The network's output and the language (the last number: none) of each text."""
        if len(self.index) > CACHE_WORDS:
            self.forget()
        words, codes, ends = split_words(column)
        self.learn([w for w in words if w not in self.index])
        ids = np.fromiter((self.index[w] for w in words), np.int64, len(words))[codes] if len(words) else codes
        n = len(ends) - 1
        top = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
        votes = np.zeros((n, len(LANGUAGES)), np.float64)
        for doc, lo, hi in self._stretches(ends):
            seq = np.concatenate([np.r_[ids[a:b], ids[b:min(b + 2, ends[d + 1])], 0, 0] for d, a, b in zip(doc, lo, hi)])
            cut = np.cumsum([0] + [b - a + min(2, ends[d + 1] - b) + 2 for d, a, b in zip(doc, lo, hi)])[:-1]
            beyond = np.concatenate([np.arange(b - a + min(2, ends[d + 1] - b) + 2) >= (b - a if b < ends[d + 1] else ends[-1] + 9)
                                     for d, a, b in zip(doc, lo, hi)])  # starts of windows that belong to the next stretch
            col = 0
            for k, w in enumerate(WIDTHS):
                p = self.products[:, col:col + w * FILTERS]
                out = p[seq, :FILTERS]
                for i in range(1, w):
                    out[:len(seq) - i] += p[seq[i:], i * FILTERS:(i + 1) * FILTERS]
                out[seq == 0] = 0
                out[beyond] = -np.inf
                best = np.maximum.reduceat(out, cut, axis=0)
                np.maximum.at(top[:, k * FILTERS:(k + 1) * FILTERS], doc, best)
                col += w * FILTERS
            np.add.at(votes, doc, np.add.reduceat(np.where(beyond[:, None], 0, self.votes[seq]), cut, axis=0))
        act = np.maximum(top + self.net.bias, 0)
        tongue = np.where(votes.max(1, initial=0) > 0, votes.argmax(1) if n else 0, len(LANGUAGES))
        return (act @ self.net.weights + self.net.offset).astype(np.float64), tongue

    @staticmethod
    def _stretches(ends: np.ndarray) -> Iterator[tuple[list[int], list[int], list[int]]]:
        """Groups of stretches (text, from, to) of at most ``STRETCH`` words together."""
        doc: list[int] = []
        lo: list[int] = []
        hi: list[int] = []
        held = 0
        for d in range(len(ends) - 1):
            a = int(ends[d])
            while True:
                b = min(int(ends[d + 1]), a + STRETCH)
                if held + b - a > STRETCH and doc:
                    yield doc, lo, hi
                    doc, lo, hi, held = [], [], [], 0
                doc.append(d)
                lo.append(a)
                hi.append(b)
                held += b - a
                a = b
                if a >= ends[d + 1]:
                    break
        if doc:
            yield doc, lo, hi

    def score(self, column: pa.Array) -> np.ndarray:
        raw, tongue = self.raw(column)
        scale, shift = self.net.calibration[tongue].T
        return sigmoid(scale * raw + shift)


def _platt(x: np.ndarray, y: np.ndarray, prior: tuple[float, float] = (1.0, 0.0), strength: float = 1.0) -> tuple[float, float]:
    a, b = prior
    for _ in range(50):
        p = sigmoid(a * x + b)
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + strength * (a - prior[0]), (p - y).sum() + strength * (b - prior[1])])
        h = np.array([[(w * x * x).sum() + strength, (w * x).sum()], [(w * x).sum(), w.sum() + strength]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return max(a, 1e-2), b


def fit(texts: list[str], y: np.ndarray) -> Network:
    """Train on four fifths of the rows, calibrate by language on the rest."""
    if len(y) < 50 or len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        zero = [np.zeros((w, WIDTH, FILTERS), np.float32) for w in WIDTHS]
        width = len(WIDTHS) * FILTERS
        return Network(np.zeros((BUCKETS, WIDTH), np.float32), zero, np.zeros(width, np.float32), np.zeros(width, np.float32), float(np.log(share / (1 - share))))
    test = np.arange(len(y)) % 5 == 4
    net = train_network([t for t, x in zip(texts, test) if not x], y[~test])
    raw, tongue = Scorer(net).raw(pa.array([t for t, x in zip(texts, test) if x], pa.string()))
    common = _platt(raw, y[test])
    net.calibration[:] = common
    for k in range(len(LANGUAGES)):
        own = tongue == k
        if own.any():
            net.calibration[k] = _platt(raw[own], y[test][own], common, 3.0)
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, folds: int = FOLDS, fold: int = FOLD) -> Network:
    """Fit on at most ``max_rows`` labelled whole texts outside the held-out fold."""
    rows = labelled_texts(docs, label_sample(labels, label, folds, fold, max_rows)).toPandas()
    rows = rows.sort_values(["text", "y"], ignore_index=True)  # the same fit in any task order
    order = np.random.default_rng(5).permutation(len(rows))
    return fit(rows["text"].to_numpy()[order].tolist(), rows["y"].to_numpy(np.int64)[order])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document: one narrow pass over whole texts."""
    net = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # a fixed size: BUCKETS x WIDTH floats
    key = uuid.uuid4().hex

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.kept(key, net.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scorer.score(b.column("text")), pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(per_task, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
