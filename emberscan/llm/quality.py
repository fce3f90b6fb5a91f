"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics (``FEATURES``) are taken over whole texts, by vectorised passes
over the bytes of a batch.  Trees are grown in numpy on the driver from at most
``SAMPLE_ROWS`` labelled documents: features are cut into ``BINS`` quantile bins
and every node's split comes from histograms of gradients.  Each tree is a
complete binary tree of ``DEPTH`` levels in flat arrays (feature, threshold, leaf
value), so a batch walks all trees with one gather per level.

Defined results: a null text counts as empty, and the empty text has all
statistics 0 and is scored like any other; without labelled rows, or with one
class only, the score is the smoothed share of label 1; several labels of one
document count by their mean (1 from one half on), rows with a null label or id
not at all; documents with the same id are scored each by its own text, and of
them one, by a hash of the text, is learned from; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import sampled, small_batches

#: Bound of what a fit sees.
SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE, LEAST, RIDGE = 64, 4, 80, 0.15, 20, 1.0

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "punct": b".,;:?'\"()-",
    "bang": b"!",
    "symbol": b"#$%&*@^~<>{}[]\\/_=+`",
    "pipe": b"|",
    "blank": b" \t",
    "newline": b"\n",
    "wide": range(194, 245),
}
FEATURES = (
    "log_bytes", "log_words", "mean_word", "std_word", "longest_word", "unique_words", "top_word",
    "repeated_next", "unique_pairs", "unique_triples", "one_byte_words", "long_words", "mean_line",
    "unique_lines", "short_lines", "entropy", *_CLASSES,
)
_OF = np.full(256, len(_CLASSES), np.uint8)
for _k, _v in enumerate(_CLASSES.values()):
    _OF[list(_v)] = _k


def _shares(hashes: np.ndarray) -> tuple[float, float]:
    """(share of distinct values, share of the most frequent)."""
    if not len(hashes):
        return 0.0, 0.0
    _, c = np.unique(hashes, return_counts=True)
    return len(c) / len(hashes), c.max() / len(hashes)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, features) of a block of texts."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    col = {f: i for i, f in enumerate(FEATURES)}
    if not len(data):
        return out
    s, e = tv.spans(~tv.SPACE[data], offsets)
    h = tv.spans_hash(tv.LOWER[data], s, e)
    at = np.searchsorted(s, offsets)
    size = (e - s).astype(float)
    pair = tv.mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    triple = tv.mix(pair[:-1] * np.uint64(5) + h[2:]) if len(h) > 2 else h[:0]
    line_s, line_e = tv.spans(data != 10, offsets)
    line_h = tv.spans_hash(data, line_s, line_e)
    line_at = np.searchsorted(line_s, offsets)
    kind = _OF[data]
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if a == b:
            continue
        row = out[i]
        bytes_ = np.bincount(data[a:b], minlength=256)
        share = bytes_[bytes_ > 0] / (b - a)
        row[col["entropy"]] = -(share * np.log2(share)).sum()
        row[col["upper"] : col["upper"] + len(_CLASSES)] = np.bincount(kind[a:b], minlength=len(_CLASSES) + 1)[:-1] / (b - a)
        row[col["log_bytes"]] = np.log1p(b - a)
        p, q = int(at[i]), int(at[i + 1])
        m = q - p
        row[col["log_words"]] = np.log1p(m)
        if m:
            w = size[p:q]
            row[col["mean_word"]], row[col["std_word"]] = w.mean(), w.std()
            row[col["longest_word"]] = np.log1p(w.max())
            row[col["one_byte_words"]], row[col["long_words"]] = (w == 1).mean(), (w > 15).mean()
            row[col["unique_words"]], row[col["top_word"]] = _shares(h[p:q])
            if m > 1:
                row[col["repeated_next"]] = (h[p : q - 1] == h[p + 1 : q]).mean()
                row[col["unique_pairs"]] = _shares(pair[p : q - 1])[0]
            if m > 2:
                row[col["unique_triples"]] = _shares(triple[p : q - 2])[0]
        p, q = int(line_at[i]), int(line_at[i + 1])
        if q > p:
            w = line_e[p:q] - line_s[p:q]
            row[col["mean_line"]] = np.log1p(w.mean())
            row[col["unique_lines"]] = _shares(line_h[p:q])[0]
            row[col["short_lines"]] = (w < 30).mean()
    return out


class Forest:
    """Flat complete trees: feature and threshold per inner node, value per leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        trees = len(self.feature)
        if trees and len(x):
            rows, each = np.arange(len(x))[:, None], np.arange(trees)[None, :]
            node = np.zeros((len(x), trees), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[each, node]] > self.threshold[each, node])
            z = z + self.value[each, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 or y.min() == y.max():
        return Forest(base, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)))
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(f)])
    least = min(LEAST, max(1, n // 20))
    z = np.full(n, base)
    features_, thresholds, values = [], [], []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        feat, thr = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-7)
            choice = np.full((width, 2), -1)
            for j in range(f):
                if not len(cuts[j]):
                    continue
                at = local * BINS + binned[j]
                g, w, c = (np.bincount(at, weights=v, minlength=width * BINS).reshape(width, BINS) for v in (grad, hess, np.ones(n)))
                gl, wl, cl = (np.cumsum(v, axis=1)[:, : len(cuts[j])] for v in (g, w, c))
                gt, wt, ct = (v.sum(axis=1, keepdims=True) for v in (g, w, c))
                gain = gl**2 / (wl + RIDGE) + (gt - gl) ** 2 / (wt - wl + RIDGE) - gt**2 / (wt + RIDGE)
                gain[(cl < least) | (ct - cl < least)] = -1
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                choice[better] = np.stack([np.full(width, j), k], axis=1)[better]
            for q in range(width):
                if choice[q, 0] >= 0:
                    feat[first + q] = choice[q, 0]
                    thr[first + q] = cuts[choice[q, 0]][choice[q, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feat[node]] > thr[node])
        leaf = node - inner
        g, w = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (grad, hess))
        value = -RATE * g / (w + RIDGE)
        z = z + value[leaf]
        features_.append(feat)
        thresholds.append(thr)
        values.append(value)
    return Forest(base, np.array(features_), np.array(thresholds), np.array(values))


def _feature_rows(batches):
    for batch in tv.batches(batches, 1000):
        data, offsets = tv.buffers(batch.column(1))
        for i, j, d, o in tv.blocks(data, offsets):
            x = features(d, o)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(i, j - i) for k in (0, 2, 3)), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "h", "x"]
            )


def labelled(labels: DataFrame, column: str, learn: Column) -> DataFrame:
    """(doc_id, label) of at most ``SAMPLE_ROWS`` documents that ``learn`` lets in."""
    rows = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    rows = rows.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    return sampled(rows, F.col("doc_id"), SAMPLE_ROWS)


def train(docs: DataFrame, labels: DataFrame, column: str, learn: Column) -> Forest:
    """``learn``: condition on doc_id for label rows that may be seen."""
    small_batches(docs.sparkSession)
    # the broadcast side has SAMPLE_ROWS rows of an id and a label at most
    chosen = labelled(labels, column, learn).select(F.col("doc_id").cast("long").alias("doc_id"), "label")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id")
    found = rows.select("doc_id", "text", "label", "h").mapInArrow(_feature_rows, "doc_id long, label int, h long, x binary")
    # rows of one id come down to one, in the tasks first
    got = found.groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), "h").alias("r")).select("r.label", "r.x").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack([np.frombuffer(b) for b in got["x"].to_pylist()])
    y = got["label"].to_numpy()
    order = np.lexsort(np.column_stack([x, y]).T[::-1])
    return fit(x[order], y[order].astype(float))


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in tv.batches(batches, 1000):
            data, offsets = tv.buffers(batch.column(1))
            parts = [forest.score(features(d, o)) for _, _, d, o in tv.blocks(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
