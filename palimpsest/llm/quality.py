"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Trees are grown on the driver from at most :data:`SAMPLE_ROWS` labelled rows (chosen by a hash
of their id); only their statistics, never texts, come to the driver. Trees are flattened into
arrays of feature, threshold and child, and a whole block of documents walks each tree level
by level in numpy.

Null text is read as empty and scored like any text. An id with several labels trains on
their mean; equal texts with unlike labels are rows of their own. Without labelled rows, or with one class only, the score is the share of label 1
(0.5 without any). Every row is returned, repeated rows too; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_texts, text_of
from palimpsest.llm.lang_id import held_out

SAMPLE_ROWS = 30_000
BINS = 64
_SENTENCE = re.compile(r"[.!?]+")
_CLASSES = np.zeros((256, 9))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b, 0] = _b < 128 and _c.isalpha()
    _CLASSES[_b, 1] = _b < 128 and _c.isupper()
    _CLASSES[_b, 2] = _b < 128 and _c.isdigit()
    _CLASSES[_b, 3] = _c in " \t"
    _CLASSES[_b, 4] = _c in "\n\r"
    _CLASSES[_b, 5] = _c in ".,;:!?'\"-"
    _CLASSES[_b, 6] = 32 < _b < 127 and not _c.isalnum() and _c not in ".,;:!?'\"-"
    _CLASSES[_b, 7] = _b >= 128
    _CLASSES[_b, 8] = _b < 32 and _c not in "\t\n\r"
NAMES = ["log_bytes", "letters", "upper", "digits", "blanks", "breaks", "marks", "symbols", "high", "control", "entropy", "log_words", "word_mean", "word_sd", "word_max", "distinct", "top_word", "one_char", "capital", "symbol_words", "log_lines", "line_mean", "distinct_lines", "short_lines", "sentence_words", "no_mark_lines", "packed", "bigram_distinct", "long_words"]


def statistics(text: str) -> np.ndarray:
    """The features of one text; whole text, linear time."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(1, len(raw))
    share = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    k = max(1, len(lines))
    odd = sum(c for w, c in seen.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'")
    return np.array(
        [
            np.log1p(len(raw)),
            *(counts @ _CLASSES / n),
            -(share * np.log2(share)).sum(),
            np.log1p(len(words)),
            sizes.mean(),
            sizes.std(),
            np.log1p(sizes.max()),
            len(seen) / m,
            max(seen.values(), default=0) / m,
            (sizes == 1).sum() / m,
            sum(c for w, c in seen.items() if w[0].isupper()) / m,
            odd / m,
            np.log1p(len(lines)),
            np.log1p(len(text) / k),
            len(set(lines)) / k,
            sum(len(x) < 30 for x in lines) / k,
            m / max(1, len(_SENTENCE.findall(text))),
            sum(x[-1] not in ".!?" for x in lines) / k,
            len(zlib.compress(raw, 1)) / (n + 16),
            len(set(zip(words, words[1:], strict=False))) / m,
            (sizes > 12).sum() / m,
        ]
    )


@dataclass
class Forest:
    """Flattened trees: row t of each array is a complete binary tree of ``depth`` levels."""

    base: float = 0.0
    depth: int = 4
    rate: float = 0.1
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 15), dtype=np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 15)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 16)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, least: float = 20.0, ridge: float = 1.0) -> Forest:
    """Boost logistic loss on histograms of ``BINS`` quantile bins."""
    if not len(y):
        return Forest()
    mean = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    inner, leaves = 2**depth - 1, 2**depth
    forest = Forest(float(np.log(mean / (1 - mean))), depth, rate)
    if y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    n, width = x.shape
    shift = np.arange(width) * BINS
    margin = np.full(n, forest.base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, at = np.zeros(inner, dtype=np.int32), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cell = (((at - first)[:, None] * width * BINS) + shift + binned).ravel()
            sums = [np.bincount(cell, np.repeat(v, width), nodes * width * BINS).reshape(nodes, width, BINS) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(left_h < least * 0.05) | (right_h < least * 0.05)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for node in range(nodes):
                f, b = divmod(int(best[node]), BINS)
                if gain[node, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + node], threshold[first + node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        at -= inner
        value = -np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge) * rate
        margin += value[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    forest.feature, forest.threshold, forest.leaf = np.array(features), np.array(thresholds), np.array(values)
    return forest


def _features(texts: list[str]) -> np.ndarray:
    return np.stack([statistics(t) for t in texts]) if texts else np.zeros((0, len(NAMES)))


def fit(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on ``labels`` (``key``, ``label`` 0 or 1) joined to ``docs``; nulls in either are left out."""
    named = labels.select(F.col(key).alias("_k"), F.col(label).cast("double").alias("_y")).filter("_k is not null and _y is not null").groupBy("_k").agg(F.avg("_y").alias("_y"))
    total = named.count()
    if total > sample_rows:
        named = named.filter(F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < int(sample_rows / total * (1 << 30)))
    # At most about sample_rows rows of 16 bytes: small enough to send to every executor.
    rows = docs.select(F.col(key).alias("_k"), text_of(text).alias("_x")).join(F.broadcast(named), "_k")

    def make():
        return lambda texts: {"x": list(_features(texts))}

    found = map_texts(rows, {"_k": F.col("_k"), "_y": F.col("_y")}, F.col("_x"), make, "x array<double>").orderBy("_k").limit(2 * sample_rows).toPandas()
    if not len(found):
        return Forest()
    return grow(np.stack(found["x"].to_numpy()), found["_y"].to_numpy())


def score(docs: DataFrame, forest: Forest, keep: dict[str, Column], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep`` plus ``score`` (probability of label 1) and ``predicted``; a map without a shuffle."""

    def make():
        def work(texts: list[str]) -> dict:
            s = forest.score(_features(texts))
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    return map_texts(docs, keep, text_of(text), make, "score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns: learn from the labels that aren't held out, score all."""
    forest = fit(docs, labels.filter(~held_out(5, 0)), "quality")
    return score(docs, forest, {"doc_id": F.col("doc_id"), "held_out": held_out(5, 0)}, threshold=0.3)
