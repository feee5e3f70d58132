"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled rows (``TRAIN_ROWS``,
the least by a hash of their ids), flattened into arrays and walked in numpy, all trees
and rows of a batch side by side. Statistics cover whole texts.

Defined results: null and empty texts have the statistics of the empty text and get a
score like any other; without labelled rows, or with one label only, every score is the
(smoothed) share of label 1; null labels are left out; rows that repeat are scored
alike; extra columns are kept by ``score`` and ignored by ``train``. An id and a label
that repeat count once in training, by the least statistics of their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import small_batches
from .common import arrow_map, claim, trim
from .shingles import _SPACE, _words

#: Labelled rows that a model is fitted on at most.
TRAIN_ROWS = 16_384
TREES, DEPTH, RATE, BINS, LEAST_LEAF, L2 = 60, 4, 0.2, 64, 8, 1.0

FEATURES = [
    "log_bytes", "letters", "upper_of_letters", "digits", "spaces", "newlines", "sentence_marks", "other_marks",
    "pipes", "non_ascii", "entropy", "log_words", "word_bytes", "word_bytes_sd", "distinct_words", "top_word",
    "words_ending_in_symbol", "words_all_upper", "line_bytes", "distinct_lines", "lines_with_mark",
]

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".,;:'\"-"]] = True
_OTHER = ~(_LETTER | _DIGIT | _SPACE | _SENTENCE)


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for one text."""
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(data, minlength=256)
    letters, share = int(count[_LETTER].sum()), count[count > 0] / n
    words, _ = _words(data, np.zeros(1, np.int64))
    w = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_share = len(set(lines)) / len(lines) if lines else 0.0
    size, sd, distinct, top, symbol, upper = 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    if w:
        space = _SPACE[data]
        begins = np.flatnonzero(~space & np.append(True, space[:-1]))
        ends = np.flatnonzero(~space & np.append(space[1:], True))
        long = ends - begins + 1
        size, sd = float(long.mean()), float(long.std())
        repeats = np.unique(words, return_counts=True)[1]
        distinct, top = len(repeats) / w, repeats.max() / w
        symbol = float(_OTHER[data[ends]].mean())
        capitals = np.cumsum(np.append(0, _UPPER[data]))
        lower = np.cumsum(np.append(0, _LETTER[data] & ~_UPPER[data]))
        upper = float(((capitals[ends + 1] > capitals[begins]) & (lower[ends + 1] == lower[begins])).mean())
    marked = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines) if lines else 0.0
    return [
        np.log1p(n), letters / n, count[_UPPER].sum() / max(letters, 1), count[_DIGIT].sum() / n, count[_SPACE].sum() / n, count[10] / n, count[_SENTENCE].sum() / n,
        count[_OTHER].sum() / n, count[124] / n, count[128:].sum() / n, -(share * np.log2(share)).sum(), np.log1p(w), size, sd, distinct, top,
        symbol, upper, n / max(len(lines), 1), line_share, marked,
    ]


@dataclass
class Trees:
    """Complete trees of one depth as arrays ``(trees, nodes)``: node k has the children
    2k + 1 and 2k + 2. ``leaf`` has the values of the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``."""
        raw = np.full(len(x), self.base)
        trees, nodes = self.feature.shape
        if trees:
            tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
            at = np.zeros((len(x), trees), np.int64)
            for _ in range(int(np.log2(nodes + 1))):
                at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
            raw += self.leaf[tree, at - nodes].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the logistic loss; splits by histograms of ``BINS`` quantiles."""
    y = y.astype(np.float64)
    nodes = 2**DEPTH - 1
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Trees(np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), base)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    raw, feature, threshold, leaf = np.full(len(y), base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        at, f, t = np.zeros(len(y), np.int64), np.zeros(nodes, int), np.full(nodes, np.inf)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            best = np.full(width, 1e-6)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                cell, size = (at - first) * BINS + binned[j], width * BINS
                g, h, n = (np.cumsum(np.bincount(cell, w, size).reshape(width, BINS), axis=1) for w in (grad, hess, None))
                gain = g**2 / (h + L2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + L2) - g[:, -1:] ** 2 / (h[:, -1:] + L2)
                gain[(n < LEAST_LEAF) | (n[:, -1:] - n < LEAST_LEAF)] = 0
                gain[:, len(c) :] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                f[first + better], t[first + better] = j, c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > t[at])
        g, h = np.bincount(at - nodes, grad, nodes + 1), np.bincount(at - nodes, hess, nodes + 1)
        value = RATE * g / (h + L2)
        raw += value[at - nodes]
        feature.append(f)
        threshold.append(t)
        leaf.append(value)
    return Trees(np.array(feature), np.array(threshold), np.array(leaf), base)


def _measured(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the column ``statistics`` in front; one of this name gives way."""
    df = df.drop(*({"statistics"} - {text}))
    at = df.columns.index(text)
    schema = T.StructType([T.StructField("statistics", T.ArrayType(T.DoubleType())), *df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", lambda: None)
        for batch in small_batches(batches):
            values = [statistics(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), *batch.columns], names=["statistics", *batch.schema.names])

    return arrow_map(df, run, schema)


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """A model from ``documents(doc_id, text)`` and ``labels(doc_id, label)``."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where("label is not null and id is not null").distinct()
    # bounded by ``rows``, so it may be broadcast
    sample = F.broadcast(known.orderBy(F.xxhash64("id"), "id", "label").limit(rows))
    chosen = documents.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("id"))
    measured = _measured(chosen.select("doc_id", "label", "text"), "text")
    found = measured.groupBy("doc_id", "label").agg(F.min("statistics").alias("statistics")).toPandas().sort_values(["doc_id", "label"])
    x = np.array(found["statistics"].tolist(), dtype=np.float64).reshape(len(found), len(FEATURES))
    return fit(x, found["label"].to_numpy(np.float64))


def score(df: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``text`` replaced by ``score`` (double, 0 to 1), other columns as they are, but one
    named ``score``, which gives way."""
    df = df.drop(*({"score"} - {text}))
    at = df.columns.index(text)
    fields = list(df.schema.fields)
    fields[at] = T.StructField("score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", lambda: None)
        for batch in small_batches(batches):
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))
            arrays, names = list(batch.columns), list(batch.schema.names)
            arrays[at], names[at] = pa.array(model.score(x)), "score"
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        trim()

    return arrow_map(df, run, T.StructType(fields))
