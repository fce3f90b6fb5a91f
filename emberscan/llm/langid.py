"""Language identification from averaged hashed subword embeddings.

A text's letters (ASCII and Latin-1 lower-cased, all else a blank) give byte
n-grams of 2, 3 and 4, hashed to ``BUCKETS`` rows of an embedding table.  Their
average goes through a linear softmax.  Table and softmax are trained together
by stochastic gradient descent in numpy, on a sample of labelled documents, the
same number of each language: ``SAMPLE_DOCS`` in all or ``LEAST_DOCS`` of each, whichever
is more, so that no language goes unlearned; of these a fifth
is held back to fit a temperature (never sharpening) and the rejection threshold: the score below
which fewer than ``LOSS`` of the rightly labelled fall, never more than one half.

As average and softmax are linear, prediction gathers one table row for each n-gram,
without a loop over words: of the language logits where these are fewer than the
embedding's ``WIDTH``, else of the embedding, which the softmax then takes as an average.

Defined results: a null text or one without a letter (Unicode's L classes; number
signs are none) is ``und`` with score 0 and
rejected; such rows are not learned from; with no labelled document at all every text is; ties go to the
language first in order; repeated rows are judged alike; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import small_batches

BUCKETS, WIDTH, ORDERS = 1 << 15, 16, (2, 3, 4)
#: Bounds of what a fit sees: documents in all, or of each language if that is more.
SAMPLE_DOCS, LEAST_DOCS = 2400, 20
EPOCHS, LOSS, UNKNOWN = 6, 0.001, "und"
_LETTER = regex.compile(r"\p{L}")
_CLASS = np.full(256, 32, np.uint8)
_CLASS[128:] = np.arange(128, 256)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def letters(data: np.ndarray) -> np.ndarray:
    low = _CLASS[data]
    wide = np.zeros(len(data), bool)
    if len(data) > 1:
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return np.where(wide, low + 0x20, low).astype(np.uint8)


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte (the last few wrap to blanks)."""
    padded = np.concatenate([letters(data), np.full(order, 32, np.uint8)]).astype(np.uint32)
    n = len(data)
    code = np.zeros(n, np.uint32)
    for k in range(order):
        code = code << np.uint32(8) | padded[k : k + n]
    code = (code ^ np.uint32(order * 0x01000193)) * np.uint32(0x9E3779B1)
    return code >> np.uint32(32 - 15)


def _spread(offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the positions whose n-gram lies in the text, at least one each."""
    return offsets[:-1], np.maximum(offsets[1:] - order + 1, offsets[:-1])


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of one text."""
    data = np.frombuffer(text, np.uint8)
    parts = [grams(data, n)[: max(len(data) - n + 1, 0)] for n in ORDERS]
    return np.unique(np.concatenate(parts), return_counts=True)


class Model:
    """languages, embedding (buckets x width), softmax (width x languages), bias, temperature, threshold.

    ``table`` is the narrower of embedding and their product, ``out`` what is left to apply to an average of its rows.
    """

    def __init__(self, languages, emb, out, bias, temperature=1.0, threshold=0.0):
        self.languages, self.bias = list(languages), bias
        self.table, self.out = (emb @ out, None) if len(self.languages) <= emb.shape[1] else (emb, out)
        self.table = self.table.astype(np.float32)
        self.temperature, self.threshold = temperature, threshold

    def of_average(self, rows: np.ndarray) -> np.ndarray:
        return (rows if self.out is None else rows @ self.out) + self.bias

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offsets) - 1, self.table.shape[1]))
        count = np.zeros(len(offsets) - 1)
        piece = max(1 << 14, (1 << 22) // self.table.shape[1])
        for n in ORDERS:
            begin, end = _spread(offsets, n)
            code = grams(data, n)
            inside = np.zeros(len(data) + 1, np.int8)
            np.add.at(inside, begin, 1)
            np.add.at(inside, end, -1)
            good = np.cumsum(inside[:-1]) > 0
            code = np.where(good, code, BUCKETS).astype(np.int64)
            for at in range(0, len(code), piece):
                got = self._padded()[code[at : at + piece]]
                lo, hi = np.maximum(offsets[:-1], at), np.minimum(offsets[1:], at + piece)
                some = np.flatnonzero(hi > lo)
                total[some] += np.add.reduceat(got, lo[some] - at, axis=0)
            count += end - begin
        return self.of_average(total / np.maximum(count, 1)[:, None])

    def _padded(self) -> np.ndarray:
        if not hasattr(self, "_pad"):
            self._pad = np.concatenate([self.table, np.zeros((1, self.table.shape[1]), np.float32)])
        return self._pad

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max())
    return z / z.sum()


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 5) -> Model:
    """Train on (buckets, counts) of texts; the order given does not matter much, the seed fixes it."""
    languages = sorted(set(labels))
    at = {x: k for k, x in enumerate(languages)}
    y = np.array([at[x] for x in labels])
    rng = np.random.default_rng(seed)
    n, c = len(y), len(languages)
    held = np.arange(n) % 5 == 4
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, c)), np.zeros(c)
    out += rng.normal(0, 0.1, out.shape)
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        for i in rng.permutation(np.flatnonzero(~held)):
            idx, cnt = bags[i]
            share = cnt / cnt.sum()
            hidden = share @ emb[idx]
            grad = _softmax(hidden @ out + bias)
            grad[y[i]] -= 1
            back = out @ grad
            out -= rate * np.outer(hidden, grad)
            bias -= 0.1 * rate * grad
            emb[idx] -= rate * np.outer(share / (share @ share), back)
    model = Model(languages, emb, out, bias)
    check = np.flatnonzero(held) if held.any() else np.arange(n)
    if c > 1:
        logits = model.of_average(np.array([(cnt / cnt.sum()) @ model.table[idx] for idx, cnt in (bags[i] for i in check)]))
        best = min(np.geomspace(1, 20, 61), key=lambda t: _nll(logits, y[check], t))
        model.temperature = float(best)
        p = model.probabilities(logits)
        right = p.argmax(axis=1) == y[check]
        if right.any():
            model.threshold = float(min(0.5, np.quantile(p.max(axis=1)[right], LOSS)))
    return model


def _nll(logits: np.ndarray, y: np.ndarray, t: float) -> float:
    z = logits / t
    z = z - z.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())


def has_letter(text) -> bool:
    """The one test of what can be judged, for learning and for prediction."""
    return text.is_valid and _LETTER.search(text.as_py()) is not None


def _bags(batches):
    for batch in tv.batches(batches):
        batch = batch.filter(pa.array([has_letter(t) for t in batch.column(1)], pa.bool_()))
        idx, cnt = [], []
        for text in batch.column(1):
            i, c = bag(text.as_py().encode())
            idx.append(i.astype(np.uint16).tobytes())
            cnt.append(np.minimum(c, 65535).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary())], ["lang", "idx", "cnt"])


def sample(docs: DataFrame, learn: Column) -> DataFrame | None:
    """(lang, text): of each language the same number of different rows, the smallest by a hash; None without any.

    A share by hash cuts the rows first, so that the ranking sees little more than
    what it keeps, however many rows a language has or one row is repeated.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), "text").alias("h")
    )
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("n")).collect()  # a row for each language
    if not counts:
        return None
    each = max(SAMPLE_DOCS // len(counts), LEAST_DOCS)
    share = [(r["lang"], min(1_000_000, int(1_500_000 * each / max(r["n"], 1)) + 1)) for r in counts]
    shares = docs.sparkSession.createDataFrame(sorted(share), "lang string, share long")
    some = rows.join(F.broadcast(shares), "lang").filter(F.pmod("h", F.lit(1_000_000)) < F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_000)), "h")
    return some.dropDuplicates(["lang", "h"]).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= each).select("lang", "text")


def train(docs: DataFrame, learn: Column) -> Model | None:
    """Fit on the rows where ``learn`` holds; None if none of these has a language and a letter."""
    small_batches(docs.sparkSession)
    chosen = sample(docs, learn)
    if chosen is None:
        return None
    got = chosen.mapInArrow(_bags, "lang string, idx binary, cnt binary").toArrow().sort_by([("lang", "ascending"), ("idx", "ascending")])
    if not got.num_rows:
        return None
    bags = [
        (np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(c, np.uint16).astype(float))
        for i, c in zip(got["idx"].to_pylist(), got["cnt"].to_pylist())
    ]
    keep = [k for k, (i, _) in enumerate(bags) if len(i)]
    if not keep:
        return None
    return fit([bags[k] for k in keep], [got["lang"][k].as_py() for k in keep])


def predict(docs: DataFrame, model: Model | None, extra: list[str]) -> DataFrame:
    """``extra`` columns of ``docs`` with lang_pred, score and accepted for each row."""
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in extra], F.col("text").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes[:-1]) + ", lang_pred string, score double, accepted boolean"

    def run(batches):
        for batch in tv.batches(batches, 1000):
            texts = batch.column(batch.num_columns - 1)
            data, offsets = tv.buffers(texts)
            n = batch.num_rows
            known = np.array([model is not None and has_letter(t) for t in texts], bool)
            pred, score = np.full(n, -1), np.zeros(n)
            if model is not None:
                for i, j, d, o in tv.blocks(data, offsets, 1 << 20):
                    p = model.probabilities(model.logits(d, o))
                    pred[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
            score = np.where(known, np.clip(score, 0, 1), 0.0)
            names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(pred, known)]
            ok = known & (score >= (model.threshold if model is not None else 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(ok)],
                [*batch.schema.names[:-1], "lang_pred", "score", "accepted"],
            )

    return kept.mapInArrow(run, schema)


def accepted_only(docs: DataFrame, learn: Column) -> DataFrame:
    """``docs`` without the rows whose language is rejected."""
    model = train(docs, learn)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    judged = predict(rows, model, ["row"]).filter("accepted")
    return judged.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
