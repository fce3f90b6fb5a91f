"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text.

Folding: homoglyphs of other scripts (capitals before they are lower-cased) and
digits and signs used as letters to letters, lower case, accents off, invisible
characters away, all else to blanks.  ``!`` and ``|`` are letters only between
letters or digits.  A 1 can be an i or an l: a text with one inside a word is read both
ways.  The lexicon holds words and, marked by ``*``, word beginnings of
four or five letters.  Their weights are log odds learned from at most
``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` labelled documents, shrunk for rare entries.
Exception phrases are entries too: what lies inside one does not count.  Beside
the given ones, in any language, pairs of neighbouring words with an entry in them are
learned as exceptions if at least ``LEAST_PHRASE`` clean documents of the sample hold them and no
toxic one does.

A document's different hits give the total weight, the total by the square root
of its length, their number and the largest weight; a logistic curve over these,
fitted in numpy, makes the score.  For this fit a document is measured by a lexicon
learned from the two thirds of the sample that it is not in.

Defined results: a null or empty text has no hits and gets the score of no hits;
without labelled rows of both classes the score is the smoothed share of label 1,
at most 0.49 if there is none; several labels of a document count by their mean;
rows with a null id or label are not learned from; of rows with one id one, by a
hash of the text, is learned from; repeated rows are scored alike; an empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import checkpoint, drop_checkpoint, sampled, small_batches

#: Bounds of what a fit sees, and of the lexicon.
SAMPLE_TOXIC, SAMPLE_CLEAN, CANDIDATES, ENTRIES = 4000, 8000, 30_000, 4000
STEMS, LEAST_DOCS, LEAST_PHRASE, LEAST_WEIGHT = (4, 5), 3, 5, 1.5

# What stands for a letter.
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ð": "d",
}
CAPITALS = {"Н": "h", "Η": "h", "Ζ": "z", "Μ": "m", "Ν": "n", "Υ": "y", "Β": "b", "Ρ": "p", "Χ": "x", "У": "y", "В": "b", "Р": "p", "С": "c", "Х": "x"}
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "stupid simple", "pond scum", "sore loser rule", "idiot proof")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_SIGN = re.compile(r"(?<=[^\W_])[!|]+(?=[^\W_])")
_ONE = re.compile(r"(?:(?<=[^\W\d_])1|1(?=[^\W\d_]))")


class _Fold(dict):
    """Code point -> folded text, worked out when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in _INVISIBLE or unicodedata.combining(c):
            got = ""
        elif c in DIGITS and c not in "!|":
            got = DIGITS[c]
        elif c in CAPITALS:
            got = CAPITALS[c]
        else:
            c = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            c = "".join(HOMOGLYPHS.get(x, x) for x in c)
            got = "".join(x if x.isalnum() else " " for x in c) or " "
        self[code] = got
        return got


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words, one blank between them and one at each end."""
    text = _SIGN.sub(lambda m: "".join(DIGITS[c] for c in m.group()), text or "")
    return " " + " ".join(text.translate(_FOLD).split()) + " "


def readings(text: str | None) -> list[str]:
    """The folded text, and the one with each 1 beside a letter read as l, if that differs."""
    text = text or ""
    return [fold(text), fold(_ONE.sub("l", text))] if _ONE.search(text) else [fold(text)]


def terms(folded: str) -> set[str]:
    words = set(folded.split())
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions=EXCEPTIONS):
        self.weights, self.exceptions = weights, [fold(x) for x in exceptions]

    def automaton(self):
        auto = ahocorasick.Automaton()
        for term, w in self.weights.items():
            key = " " + term[:-1] if term.endswith("*") else f" {term} "
            old = auto.get(key, None)
            if old is None or abs(w) > abs(old[1]):
                auto.add_word(key, (len(key), w))
        for x in self.exceptions:
            auto.add_word(x, (len(x), None))
        auto.make_automaton()
        return auto if len(auto) else None


def placed_hits(auto, folded: str) -> dict[int, float]:
    """Blank before each word found outside exception phrases -> weight of its heaviest entry (whole or beginning)."""
    if auto is None:
        return {}
    found: dict[int, float] = {}
    begins: list[int] = []
    ends: list[int] = []
    for end, (size, w) in auto.iter(folded):
        begin = end - size + 1
        if w is None:  # spans come by their ends; what a later one covers goes into it
            while begins and begins[-1] >= begin:
                begins.pop()
                ends.pop()
            if begins and begin < ends[-1]:
                begin = begins.pop()
                ends.pop()
            begins.append(begin)
            ends.append(end)
        elif w > found.get(begin, -math.inf):
            found[begin] = w
    if not begins:
        return found

    def free(k: int) -> bool:
        i = bisect.bisect_right(begins, k) - 1
        return i >= 0 and k < ends[i]

    return {k: w for k, w in found.items() if not free(k)}


def hits(auto, folded: str) -> list[float]:
    """Weights of the different words found; of a word's entries (whole and beginnings) the heaviest."""
    found = placed_hits(auto, folded)
    return list({folded[k : folded.find(" ", k + 1)]: w for k, w in sorted(found.items())}.values())


def measures(auto, text: str | None) -> list[float]:
    ways = readings(text)
    found: dict[str, float] = {}
    for folded in ways:
        for k, w in placed_hits(auto, folded).items():
            # both ways fold a place to the same length, so it names the word
            word = ways[0][k : ways[0].find(" ", k + 1)]
            found[word] = max(w, found.get(word, -math.inf))
    w = list(found.values())
    total = sum(w)
    return [math.log1p(total), total / math.sqrt(ways[0].count(" ")), math.log1p(len(w)), max(w, default=0.0)]


class Model:
    def __init__(self, lexicon: Lexicon, coef: np.ndarray, bias: float):
        self.lexicon, self.coef, self.bias = lexicon, coef, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coef + self.bias, -35, 35)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w)), g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


FOLDS = 3
_COUNTS = "term string, fold int, n long"


def pairs_with(folded: str, auto) -> set[str]:
    """Pairs of neighbouring words that hold an entry."""
    out = set()
    for k in placed_hits(auto, folded):
        end = folded.find(" ", k + 1)
        before = folded.rfind(" ", 0, k) if k else -1
        after = folded.find(" ", end + 1)
        if before >= 0:
            out.add(folded[before + 1 : end])
        if after >= 0:
            out.add(folded[k + 1 : after])
    return out


def _counts(found_in):
    """Arrow batches (text, fold) -> documents per (term, fold), ``found_in`` giving a document's terms."""

    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for t, k in zip(batch.column(0), batch.column(1).to_pylist()):
                count.update((x, k) for x in found_in(t.as_py()))
        keys = list(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([count[k] for k in keys], pa.int64())],
            ["term", "fold", "n"],
        )

    return run


def _by_fold(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)).alias(f"f{k}") for k in range(FOLDS)]
    )


def learn_lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> Lexicon:
    """Entries from documents per term among ``n_toxic`` and ``n_clean`` documents."""
    weights = {}
    for term, k in toxic.items():
        if k < LEAST_DOCS:
            continue
        w = math.log((k + 0.5) / (n_toxic + 1)) - math.log((clean.get(term, 0) + 0.5) / (n_clean + 1)) - 1 / math.sqrt(k)
        if w >= LEAST_WEIGHT:
            weights[term] = w
    top = sorted(weights, key=lambda t: (-weights[t] * toxic[t], t))[:ENTRIES]
    return Lexicon({t: round(weights[t], 6) for t in sorted(top)})


def train(docs: DataFrame, labels: DataFrame, learn: Column, column: str = "toxic") -> Model:
    small_batches(docs.sparkSession)
    rows = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    rows = rows.groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    parts = [sampled(rows.filter(F.col("label") == k), F.col("doc_id"), n) for k, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = parts[0].unionByName(parts[1]).withColumn("fold", F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(FOLDS)).cast("int"))
    # the broadcast side is bounded by the two sample sizes, and so are the rows that are left
    seen = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id")
    seen = seen.groupBy("doc_id").agg(F.min_by(F.struct("text", "label", "fold"), "h").alias("r")).select("r.*")
    seen = checkpoint(seen)
    try:
        return _fit(seen)
    finally:
        drop_checkpoint(seen)


def _fit(seen: DataFrame) -> Model:
    """The model of a bounded sample (text, label, fold)."""
    sc = seen.sparkSession.sparkContext
    size = np.zeros((2, FOLDS), int)
    for r in seen.groupBy("label", "fold").count().collect():
        size[r["label"], r["fold"]] = r["count"]
    n_clean, n_toxic = (int(x) for x in size.sum(axis=1))
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        share = share if n_toxic else min(share, 0.49)
        return Model(Lexicon({}), np.zeros(4), math.log(share / (1 - share)))

    def documents(label: int, found_in) -> DataFrame:
        return _by_fold(seen.filter(F.col("label") == label).select("text", "fold").mapInArrow(_counts(found_in), _COUNTS))

    found = documents(1, lambda t: terms(fold(t))).filter(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()
    only = sc.broadcast({r["term"] for r in found})
    other = documents(0, lambda t: terms(fold(t)) & only.value).collect()

    def left(rows, k: int | None) -> dict[str, int]:
        return {r["term"]: r["n"] - (r[f"f{k}"] if k is not None else 0) for r in rows}

    def entries(k: int | None) -> Lexicon:
        gone = size[:, k] if k is not None else np.zeros(2, int)
        return learn_lexicon(left(found, k), left(other, k), n_toxic - int(gone[1]), n_clean - int(gone[0]))

    whole = sc.broadcast(entries(None))

    def phrases(t: str | None) -> set[str]:
        if not hasattr(whole.value, "auto"):
            whole.value.auto = whole.value.automaton()
        return pairs_with(fold(t), whole.value.auto)

    clean = documents(0, phrases).filter(F.col("n") >= LEAST_PHRASE).orderBy(F.desc("n"), "term").limit(ENTRIES).collect()
    named = sc.broadcast({r["term"] for r in clean})
    toxic = documents(1, lambda t: phrases(t) & named.value).collect()

    def without(k: int | None) -> Lexicon:
        bad = {t for t, n in left(toxic, k).items() if n}
        learned = sorted(t for t, n in left(clean, k).items() if n >= LEAST_PHRASE and t not in bad)
        return Lexicon(entries(k).weights, (*EXCEPTIONS, *learned))

    folds = sc.broadcast([without(k) for k in range(FOLDS)])

    def measure(batches):
        auto = [x.automaton() for x in folds.value]
        for batch in batches:
            x = np.array([measures(auto[k], t.as_py()) for t, k in zip(batch.column(0), batch.column(2).to_pylist())]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(x[:, k]) for k in range(4)]], ["label", "a", "b", "c", "d"])

    got = seen.select("text", "label", "fold").mapInArrow(measure, "label int, a double, b double, c double, d double").toPandas()
    x, y = got[["a", "b", "c", "d"]].to_numpy(), got["label"].to_numpy(float)
    order = np.lexsort(np.column_stack([x, y]).T)
    coef, bias = fit_curve(x[order], y[order])
    return Model(without(None), coef, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        auto = model.lexicon.automaton()
        for batch in tv.batches(batches):
            x = np.array([measures(auto, t.as_py()) for t in batch.column(1)]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
