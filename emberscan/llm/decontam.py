"""Benchmark decontamination by template windows.

Words are runs of letters, marks and digits of any script, cut at punctuation,
symbols and spaces in Unicode's sense; in scripts that are written without spaces
(Chinese, Japanese, Thai, Lao, Burmese, Khmer, Tibetan) each character is a word.
Each becomes a typed
placeholder by itself, whatever stands around it: numbers ("12", "1,000", "5km")
``<num>``, a capitalised word ``<name>``, a unit right after a number ``<unit>``;
all else is its lower-cased self.  Windows of ``WINDOW`` words are hashed in three
streams: as templates; lower-cased with numbers open, so that a change of case does
not hide a copy; and, where they hold a number, lower-cased with numbers as they
are, which loses no verbatim copy however many slots it has.  Windows of the first
two need ``DENSE`` words that are not open (all, below ``LITERALS`` words): a row of
mere numbers or names would match every other.  Items with fewer words are one
window of their length.

Windows of documents first pass a broadcast bitmap of bounded size made from the
benchmark's windows, then meet these in a hash join (broadcast only if counted to
be few).  Of the matched windows on one diagonal of a document and an item, those
count whose slots hold the item's own values, and those that fill the item's slots
consistently: one value of the item maps to one value of the document and back, the
one that stands in its place more often than any other (in a draw, none).  A document is contaminated by an item if consistent windows cover at
least half of the item's words, or ``ENOUGH`` of them, among these ``LITERALS``
words that are the same in both (or as many as the item has outside its slots).

Result: (doc_id, text_hash, item_id, covered, n_words, kind), kind being
``exact`` if windows whose slots hold the item's own values cover all that is
covered, else ``reparameterised``.

Defined results: null or empty texts and items match nothing, nor do items with
a null item_id or fewer than ``SHORTEST`` words; repeated rows give repeated findings once; rows
with a null doc_id are judged too; empty tables give no rows.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import hash_filter, in_filter, small_batches, text_hash

WINDOW, ENOUGH, SHORTEST, LITERALS, DENSE = 8, 13, 3, 5, 2
STREAMS = (0, 1, 2)  # templates, numbers open, as they are
#: Benchmark windows up to this number are broadcast for the join (a few hundred bytes each at most: at most WINDOW slots).
BROADCAST_WINDOWS = 200_000

UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec secs second seconds min mins minute minutes h hr hrs "
    "hour hours day days week weeks month months year years percent usd eur gbp dollar dollars euro euros pound "
    "pounds cent cents meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches "
    "foot feet gram grams kilogram kilograms liter liters litre litres kmh mph hz khz mhz ghz w kw mw v kv j kj pa"
).split()

_INSIDE = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _INSIDE[_a:_b] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_SALT = (np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6B2F3D4E17), np.uint64(0x2545F4914F6CDD1D))


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes (ASCII and Latin-1 letters) and where a capital began."""
    low = tv.LOWER[data]
    upper = low != data
    if len(data) > 1:
        wide = np.zeros(len(data), bool)
        wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low = np.where(wide, data + 0x20, low).astype(np.uint8)
        upper[:-1] |= wide[1:]
    return low, upper


_UNIT_HASH: np.ndarray | None = None


def unit_hashes() -> np.ndarray:
    global _UNIT_HASH
    if _UNIT_HASH is None:
        data, off = tv.buffers(pa.array(UNITS))
        _UNIT_HASH = np.sort(tv.spans_hash(data, off[:-1], off[1:]))
    return _UNIT_HASH


#: Where each character is a word: first and last code points.
_NO_SPACES = (
    (0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3040, 0x30FF),
    (0x3105, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
)
_CLASS: np.ndarray | None = None


def classes() -> np.ndarray:
    """By code point below 0x10000: 0 between words, 1 inside a word, 2 a word by itself."""
    global _CLASS
    if _CLASS is None:
        kinds = [unicodedata.category(chr(c)) for c in range(0x10000)]
        out = np.array([k[0] not in "PSZ" and k not in ("Cc", "Cf") for k in kinds], np.int8)
        for a, b in _NO_SPACES:
            out[a : b + 1] *= 2
        _CLASS = out
    return _CLASS


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block of UTF-8 texts."""
    inside = _INSIDE[data]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return tv.spans(inside, offsets)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
    rest = [(data[np.minimum(lead + k, len(data) - 1)] & 0x3F).astype(np.int64) for k in (1, 2, 3)]
    first = data[lead].astype(np.int64)
    point = np.where(size == 2, (first & 0x1F) << 6 | rest[0], (first & 0x0F) << 12 | rest[0] << 6 | rest[1])
    kind = classes()[point & 0xFFFF]
    wide = (first & 7) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
    kind = np.where(size == 4, np.where((wide >= 0x20000) & (wide < 0x40000), 2, 1), kind)
    for k in range(4):
        at = lead[(kind == 0) & (size > k)] + k
        inside[at[at < len(data)]] = False
    alone = kind == 2
    cuts = np.concatenate([offsets, lead[alone], np.minimum(lead[alone] + size[alone], len(data))])
    return tv.spans(inside, cuts)


class Templates:
    """Words of a block of texts: byte spans, template codes, literal codes, kinds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        s, e = word_spans(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
        low, upper = folded(data)
        digits = _DIGIT[data]
        num = digits[s] if len(s) else np.zeros(0, bool)
        if len(s) > 1:  # "1,000" and "3.14" are one number
            gap = np.minimum(e[:-1], max(len(data) - 1, 0))
            sep = (s[1:] - e[:-1] == 1) & ((data[gap] == 44) | (data[gap] == 46))
            doc = np.searchsorted(offsets, s, "right")
            joined = np.zeros(len(s), bool)
            joined[1:] = num[1:] & num[:-1] & sep & (doc[1:] == doc[:-1])
            keep = ~joined
            last = np.flatnonzero(np.append(keep[1:], True))
            s, e, num = s[keep], e[last], num[keep]
        n_up = np.concatenate([[0], np.cumsum(upper)])
        ups = n_up[e] - n_up[s]
        self.start, self.end, self.data = s, e, data
        self.at = np.searchsorted(s, offsets)
        literal = tv.spans_hash(low, s, e)
        name = (upper[s] if len(s) else np.zeros(0, bool)) & (ups == 1) & (e - s > 1) & ~num
        known = unit_hashes()
        where = np.minimum(np.searchsorted(known, literal), len(known) - 1)
        unit = np.zeros(len(s), bool)
        if len(s) > 1:
            unit[1:] = (known[where[1:]] == literal[1:]) & num[:-1]
            unit[self.at[:-1][self.at[:-1] < len(s)]] = False  # the first word of a text follows no number
        name &= ~unit
        self.kind = np.where(num, 1, np.where(name, 2, np.where(unit, 3, 0))).astype(np.int8)
        self.template = np.where(num, _NUM, np.where(name, _NAME, np.where(unit, _UNIT, literal)))
        self.literal = np.where(num, _NUM, literal)
        self.exact = literal
        self.value = tv.mix(tv.spans_hash(data, s, e) + self.kind.astype(np.uint64)).astype(np.int64)
        n = len(s) + 1
        self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, _BACK))

    def windows(self, width: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every admissible window of ``width`` words inside one text."""
        code = (self.template, self.literal, self.exact)[stream]
        n = len(code)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tv.mix(code) * self.up[:n])])
        first = np.arange(n - width + 1)
        h = tv.mix((total[width:] - total[:-width]) * self.down[: n - width + 1] ^ (_SALT[stream] + np.uint64(width)))
        open_ = np.concatenate([[0], np.cumsum((self.kind > 0) if stream == 0 else (self.kind == 1))])
        n_open = open_[width:] - open_[:-width]
        if stream == 2:  # without a number the window is in stream 1 already
            fit = n_open > 0
        else:
            fit = width - n_open >= (DENSE if width >= LITERALS else width)
        text = np.searchsorted(self.at, first, "right")
        ok = (text == np.searchsorted(self.at, first + width - 1, "right")) & fit
        return first[ok], h[ok]

    def slots(self, first: int, width: int, stream: int) -> list[dict]:
        """Offset in the window and hashed value of each open word."""
        out: list[dict] = []
        if stream == 2:
            return out
        for k in range(first, first + width):
            kind = int(self.kind[k])
            if kind == 1 or (kind and stream == 0):
                out.append({"at": k - first, "value": int(self.value[k])})
        return out


_FOUND = "key1 long, key2 long, h long, pos int, slots array<struct<at:int,value:bigint>>"
_SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.int64())]))


def _window_rows(widths, wanted):
    """Arrow batches (key1, key2, text) -> windows; ``wanted``: hash -> mask of those to keep."""

    def run(batches):
        for batch in tv.batches(batches):
            data, offsets = tv.buffers(batch.column(2))
            k1, k2 = batch.column(0), batch.column(1)
            for i, j, d, o in tv.blocks(data, offsets, 1 << 21):
                t = Templates(d, o)
                owner, hashes, pos, slots = [], [], [], []
                for width in widths:
                    for stream in STREAMS:
                        first, h = t.windows(width, stream)
                        hit = np.flatnonzero(wanted(h)) if wanted else np.arange(len(h))
                        if not len(hit):
                            continue
                        first, h = first[hit], h[hit]
                        text = np.searchsorted(t.at, first, "right") - 1
                        # empty texts share a word offset: the last of them owns the word
                        owner.append(text + i)
                        hashes.append(h.astype(np.int64))
                        pos.append((first - t.at[text]).astype(np.int32))
                        slots += [t.slots(int(f), width, stream) for f in first]
                if owner:
                    at = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays(
                        [k1.take(at), k2.take(at), pa.array(np.concatenate(hashes)), pa.array(np.concatenate(pos)), pa.array(slots, _SLOTS)],
                        ["key1", "key2", "h", "pos", "slots"],
                    )

    return run


def _count_words(texts):
    import pandas as pd

    data, offsets = tv.buffers(pa.array(texts, pa.large_string(), from_pandas=True))
    return pd.Series(np.diff(Templates(data, offsets).at).astype("int64"))


def _count_plain(texts):
    import pandas as pd

    data, offsets = tv.buffers(pa.array(texts, pa.large_string(), from_pandas=True))
    t = Templates(data, offsets)
    plain = np.concatenate([[0], np.cumsum(t.kind == 0)])
    return pd.Series(np.diff(plain[t.at]).astype("int64"))


def _usual(windows, of: str, to: str) -> dict[int, int]:
    """The value ``to`` that stands most often for each value ``of``; none in a draw."""
    places: dict[int, dict[int, set[int]]] = {}
    for w in windows:
        for p in w["pairs"]:
            places.setdefault(p[of], {}).setdefault(p[to], set()).add(w["ipos"] + p["at"])
    out: dict[int, int] = {}
    for x, others in places.items():
        most = max(map(len, others.values()))
        top = [y for y, at in others.items() if len(at) == most]
        if len(top) == 1:
            out[x] = top[0]
    return out


def _judge(windows) -> dict:
    """Item words that the windows of one diagonal cover, those the same in both texts, those of windows with the item's own values."""
    value, back = _usual(windows, "item", "doc"), _usual(windows, "doc", "item")
    words: set[int] = set()
    alike: set[int] = set()
    own: set[int] = set()
    for w in windows:
        changed = {w["ipos"] + p["at"] for p in w["pairs"] if p["item"] != p["doc"]}
        if changed and any(value.get(p["item"]) != p["doc"] or back.get(p["doc"]) != p["item"] for p in w["pairs"]):
            continue
        span = range(w["ipos"], w["ipos"] + w["width"])
        words.update(span)
        alike.update(x for x in span if x not in changed)
        if not changed:
            own.update(span)
    return {"words": sorted(words), "alike": sorted(alike), "own": sorted(own)}


def _judge_all(lines):
    import pandas as pd

    return pd.DataFrame([_judge(w) for w in lines], columns=["words", "alike", "own"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, covered, n_words, kind)."""
    spark = docs.sparkSession
    small_batches(spark)
    count, count_plain = F.pandas_udf(_count_words, "long"), F.pandas_udf(_count_plain, "long")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null").distinct()
    items = items.select("item_id", text_hash(F.col("text")).alias("item_hash"), "text").withColumns({"n_words": count("text"), "n_plain": count_plain("text")})
    items = items.filter(F.col("n_words") >= SHORTEST)
    short = [r[0] for r in items.filter(F.col("n_words") < WINDOW).select("n_words").distinct().collect()]
    parts = []
    for width in [*sorted(short), WINDOW]:
        fit = items.filter(F.col("n_words") >= WINDOW if width == WINDOW else F.col("n_words") == width)
        rows = fit.select("item_id", "item_hash", "text").mapInArrow(_window_rows([width], None), _FOUND)
        parts.append(rows.withColumn("width", F.lit(width)))
    windows = parts[0]
    for p in parts[1:]:
        windows = windows.unionByName(p)
    windows = windows.join(
        items.select(F.col("item_id").alias("key1"), F.col("item_hash").alias("key2"), "n_words", "n_plain"), ["key1", "key2"]
    ).select("h", F.col("key1").alias("item_id"), F.col("key2").alias("item_hash"), F.col("pos").alias("ipos"), F.col("slots").alias("islots"), "width", "n_words", "n_plain")
    n_windows = windows.count()
    bits = spark.sparkContext.broadcast(hash_filter(windows.select("h"), n_windows))
    few = n_windows <= BROADCAST_WINDOWS

    def wanted(h):
        return in_filter(bits.value, h)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), "text").filter("text is not null")
    found = texts.mapInArrow(_window_rows([*sorted(short), WINDOW], wanted), _FOUND).select(
        F.col("key1").alias("doc_id"), F.col("key2").alias("text_hash"), "h", "pos", "slots"
    )
    both = found.join(F.broadcast(windows) if few else windows, "h")
    pairs = F.zip_with("islots", "slots", lambda a, b: F.struct(a["at"].alias("at"), a["value"].alias("item"), b["value"].alias("doc")))
    keys = ["doc_id", "text_hash", "item_id", "item_hash", "n_words", "n_plain"]
    lines = both.groupBy(*keys, (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(
        F.collect_set(F.struct("ipos", "width", pairs.alias("pairs"))).alias("windows")
    )
    judge = F.pandas_udf(_judge_all, "words array<int>, alike array<int>, own array<int>")
    lines = lines.withColumn("judged", judge("windows"))
    size = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(f"judged.{c}"))))
    whole = lines.groupBy(*keys).agg(*[size(c).alias(n) for c, n in (("words", "covered"), ("alike", "n_alike"), ("own", "n_own"))])
    whole = whole.filter(f"covered >= {ENOUGH} or 2 * covered >= n_words").filter(f"n_alike >= least({LITERALS}, n_plain)")
    return whole.select(
        "doc_id", "text_hash", "item_id", F.col("covered").cast("long").alias("covered"), "n_words",
        F.when(F.col("n_own") == F.col("covered"), "exact").otherwise("reparameterised").alias("kind"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that any item contaminates."""
    gone = contaminated(docs, benchmark).select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.col("doc_id").isNull().alias("none"), text_hash(F.col("text")).alias("hash"),
    )
    return rows.join(gone, ["id", "none", "hash"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
