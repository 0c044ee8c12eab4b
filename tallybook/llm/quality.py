"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (shares of character classes, word and line shape, repetition) are cut into at
most 64 histogram bins; shallow trees are fitted to the logistic loss by histograms of gradients, and the
forest is flattened into plain arrays, so that a batch of documents walks all trees at once in numpy.

The fit takes at most MAX_LABELLED labelled rows, chosen by a hash of the document id (a documented
bound); scoring reads every whole text. A null or empty text has statistics of zero and gets a score
like any other. Several labels of one document: the largest counts; a null label is no label. With no
labelled row, or only one class, the score is the share of label 1 (0.5 without labels). Very long texts
are read whole, in windows of words for the word statistics. Ties between splits go to the earlier
statistic and bin. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import text_slices, utf8

MAX_LABELLED = 16_384
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
LEAST_WEIGHT = 1.0   # smallest hessian sum of a leaf
RIDGE = 1.0
KEEP_AT = 0.7

STATISTICS = ["log_chars", "upper", "lower", "digit", "space", "punctuation", "symbol", "other",
              "log_words", "word_length", "distinct_words", "repeated_neighbours", "words_with_letters",
              "words_ending_in_symbol", "distinct_letters", "log_lines", "line_length", "distinct_lines",
              "most_frequent_word", "short_words"]

# character classes by byte: 0 other (bytes of non-ASCII letters), 1 upper, 2 lower, 3 digit, 4 space,
# 5 ordinary punctuation, 6 further symbols
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 5
_CLASS[[c for c in range(33, 127) if _CLASS[c] == 0]] = 6
_SYMBOL = frozenset(c for c in range(256) if _CLASS[c] == 6)


def statistics(text: str | None) -> list[float]:
    """One number per name in STATISTICS, of the whole text."""
    raw = utf8(text or "")
    if not raw:
        return [0.0] * len(STATISTICS)
    freq = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, freq, 7) / len(raw)
    words = raw.split()
    n = max(len(words), 1)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = raw.split(b"\n")
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    ending = sum(c for w, c in counts.items() if w[-1] in _SYMBOL)
    lettered = sum(c for w, c in counts.items() if w[:1].isalpha() or w[0] > 127)
    short = sum(c for w, c in counts.items() if len(w) < 4)
    return [float(np.log1p(len(raw))), *shares[1:7].tolist(), float(shares[0]), float(np.log1p(len(words))),
            sum(map(len, words)) / n, len(counts) / n, repeated / n, lettered / n, ending / n,
            float(np.count_nonzero(freq[97:123])), float(np.log1p(len(lines))),
            float(np.log1p(len(raw) / len(lines))), len(set(lines)) / len(lines),
            max(counts.values(), default=0) / n, short / n]


class Forest:
    """Trees as flat arrays: for each node its statistic, cut, left child (right is next) and value."""

    def __init__(self, feature, cut, left, value, base):
        self.feature, self.cut, self.left, self.value, self.base = feature, cut, left, value, base

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all rows and trees go down one level at a time."""
        rows = np.arange(len(x))
        node = np.zeros((self.feature.shape[0], len(x)), np.int64)
        tree = np.arange(self.feature.shape[0])[:, None]
        for _ in range(DEPTH):
            inner = self.left[tree, node] >= 0
            right = x[rows[None], self.feature[tree, node]] > self.cut[tree, node]
            node = np.where(inner, self.left[tree, node] + right, node)
        return 1.0 / (1.0 + np.exp(-(self.base + self.value[tree, node].sum(0))))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boost TREES trees of DEPTH levels on histograms of at most BINS bins a statistic."""
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(rate / (1 - rate)))
    size = 2 ** (DEPTH + 1) - 1
    feature = np.zeros((TREES, size), np.int64)
    cut = np.zeros((TREES, size))
    left = np.full((TREES, size), -1, np.int64)
    value = np.zeros((TREES, size))
    if len(np.unique(y)) < 2:
        return Forest(feature, cut, left, value, base)
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)])
    raw = np.full(len(y), base)
    for t in range(TREES):
        p = 1.0 / (1.0 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        used = 1
        level = [0]
        for depth in range(DEPTH + 1):
            after = []
            for k in level:
                here = np.flatnonzero(node == k)
                g, h = grad[here].sum(), hess[here].sum()
                value[t, k] = -RATE * g / (h + RIDGE)
                best = (1e-6, -1, -1)
                for f in range(len(cuts)) if depth < DEPTH else ():
                    gs = np.cumsum(np.bincount(binned[f, here], grad[here], BINS))[:-1]
                    hs = np.cumsum(np.bincount(binned[f, here], hess[here], BINS))[:-1]
                    gain = gs**2 / (hs + RIDGE) + (g - gs)**2 / (h - hs + RIDGE) - g**2 / (h + RIDGE)
                    gain[(hs < LEAST_WEIGHT) | (h - hs < LEAST_WEIGHT)] = 0
                    b = int(np.argmax(gain))
                    if gain[b] > best[0]:
                        best = (float(gain[b]), f, b)
                if best[1] < 0:
                    continue
                _, f, b = best
                feature[t, k], cut[t, k], left[t, k] = f, cuts[f][min(b, len(cuts[f]) - 1)], used
                node[here] = used + (binned[f, here] > b)
                value[t, k] = 0.0
                after += [used, used + 1]
                used += 2
            level = after
        raw += value[t, node]
    return Forest(feature, cut, left, value, base)


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch):
            rows = [statistics(t) for t in piece.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(rows, pa.list_(pa.float64()))],
                                             names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          max_rows: int = MAX_LABELLED) -> Forest:
    """Fit on at most `max_rows` labelled documents (those with the smallest id hashes).

    The share to take comes from the number of labels, so only a few more ids than `max_rows` are
    sorted, and only the chosen documents' statistics come to the driver.
    """
    known = (labels.select("doc_id", F.col(label).alias("y")).dropna()
             .groupBy("doc_id").agg(F.max("y").cast("double").alias("y")))
    total = known.count()
    share = min(1.0, 1.2 * max_rows / max(total, 1) + 50 / max(total, 1))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = (known.where(bucket <= int(share * (1 << 30)))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .join(F.broadcast(chosen), "doc_id").select("y", "text")
            .mapInArrow(_stats_batches, "y double, x array<double>"))
    got = rows.toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    y = np.array(got.column("y").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order in which rows arrive
    return fit(x[order], y[order])


def _score_batches(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in text_slices(batch):
            x = np.array([statistics(t) for t in piece.column(piece.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(forest.score(x))],
                                             names=[*piece.schema.names[:-1], "score"])


def score(docs: DataFrame, forest: Forest, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns named in `keep`, then `score` (probability of label 1), for every row."""
    keep = ["doc_id"] if keep is None else keep
    rows = docs.select(*[F.col(k) for k in keep], F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(partial(_score_batches, forest=forest), ", ".join([*fields, "score double"]))
