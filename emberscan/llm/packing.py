"""Best-fit packing of token pieces into sequences, with certified bin counts.

Every document is tokenised, closed with an end id and cut into pieces of at
most ``capacity`` tokens.  Pieces are dealt to buckets by hash; each bucket runs
best-fit decreasing, and lower bounds from dual feasible functions tell whether
its number of bins is certainly the least possible.  Buckets that are not
certified give up their bins with gaps; these pieces are dealt anew, to as many
fewer buckets as there are fewer pieces, and packed again, until all buckets are
certified, only one is left, or the last round settles what it has.

Only ids and lengths move between rounds; a bucket's size does not grow with the
input, so neither does a task.  ``certificate`` tells how many sequences a packing
has, how many any packing needs at least, and so what is left uncertified.

Words are cut out and looked up here only for a tokenizer file whose normaliser
and pre-tokeniser are those this module knows (``KNOWN``); any other file encodes
whole texts by itself.

Defined results: a null or empty text is the end id alone (one piece of length
1); repeated documents are packed once for each row; an empty table gives no
rows.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small_batches

CAPACITY = 4096
END_ID = 1
#: Pieces that one bucket holds on average: enough for best-fit decreasing to
#: fill nearly every bin, and a small task.
BUCKET_PIECES = 4000
MAX_ROUNDS = 4
#: A bin has a gap if more than capacity // GAP_SHARE tokens of it are free.
GAP_SHARE = 256

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Characters whose letter, number and space classes, lower case and normal form
# are the same in every library: for texts of these alone, words can be cut out
# here and looked up; any other text goes through the tokenizer as a whole.
_ODD = re.compile("[^\\t\\n\\r -~¡-±´-¸º»¿-įı-ɏ]|<\\|")
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
# The file's parts that this cutting stands for.
KNOWN = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed", "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None, "padding": None,
}
#: Words remembered by each Python worker.
CACHE_WORDS = 400_000

_loaded: dict[str, "WordTokens"] = {}


def _as_bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class WordTokens(dict):
    """word -> its ids as little-endian bytes, filled on demand."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = [t["content"] for t in file.get("added_tokens", [])]
        # added tokens must be such as _ODD sends to the whole text
        self.known = all(file.get(k) == v for k, v in KNOWN.items()) and all(t.startswith("<|") for t in added) and file["model"]["type"] == "BPE"
        # printable stand-ins of the 256 bytes: printable Latin-1 stands for itself,
        # the others follow from U+0100 on in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.stand = {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.stand)
        got = _as_bytes([t.id for t in self.model.tokenize(shown)])
        self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        if not self.known or _ODD.search(text):
            return _as_bytes(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, _WORD.findall(text.lower())))



def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    small_batches(docs.sparkSession)
    end = _as_bytes([end_id])

    def run(batches):
        if tokenizer not in _loaded:
            _loaded[tokenizer] = WordTokens(tokenizer)
        tok = _loaded[tokenizer]
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins) by best fit, longest first.

    The rooms that some open bin has are bits of one integer, so the tightest
    room that fits is its lowest set bit at or above the length.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: dict[int, list[int]] = {}
    mask, count = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        above = mask >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            stack = rooms[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            room, b, count = capacity, count, count + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            if not mask >> left & 1:
                mask |= 1 << left
                rooms[left] = []
            rooms[left].append(b)
    return bins, offsets, count


def lower_bound(lengths: np.ndarray, capacity: int, ks: int = 24) -> int:
    """Bins that any packing of these lengths needs."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity, ks)


def bound_of_counts(count: np.ndarray, capacity: int, ks: int = 24) -> int:
    """Bins that any packing of count[n] pieces of each length n needs: the best of two families of dual feasible functions.

    The first rounds lengths above capacity - t up to the capacity and drops those
    below t; the second, for k, keeps lengths x with (k+1)x a multiple of the
    capacity and otherwise rounds (k+1)x/capacity down to k-ths.
    """
    count = count.astype(np.int64)
    if not count.any():
        return 0
    n_upto, s_upto = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    t = np.arange(0, capacity // 2 + 1)
    big = n_upto[capacity] - n_upto[capacity - t]
    mid = s_upto[capacity - t] - np.where(t > 0, s_upto[np.maximum(t - 1, 0)], 0)
    best = int(np.max(big + -(-mid // capacity)))
    x = np.arange(capacity + 1)
    for k in range(1, ks + 1):
        y = (k + 1) * x
        exact = y % capacity == 0
        value = np.where(exact, x * k, (y // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


_PACKED = "uid long, length long, bin long, offset long, settled boolean"


def _pack_bucket(capacity: int, last: bool, rnd: int):
    def run(key, t):
        bucket = int(key[0].as_py())
        uid = t.column("uid").to_numpy()
        length = t.column("length").to_numpy()
        order = np.lexsort((uid, length))
        uid, length = uid[order], length[order]
        bins, offsets, count = best_fit_decreasing(length, capacity)
        fill = np.bincount(bins, weights=length, minlength=count)
        sure = last or count == lower_bound(length, capacity)
        settled = np.ones(count, bool) if sure else fill >= capacity - capacity // GAP_SHARE
        return pa.table(
            {
                "uid": uid, "length": length, "bin": (np.int64(rnd) << 58) | (np.int64(bucket) << 24) | bins,
                "offset": offsets, "settled": settled[bins],
            }
        )

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """(uid, length) -> (uid, bin, offset); bins hold at most ``capacity``."""
    done = pieces.filter(F.col("length") == capacity).select(
        "uid", (-1 - F.col("uid")).alias("bin"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < capacity).select("uid", "length")
    n = rest.count()
    for rnd in range(1, MAX_ROUNDS + 1):
        if not n:
            break
        buckets = -(-n // bucket_pieces)
        last = rnd == MAX_ROUNDS or buckets == 1
        dealt = rest.withColumn("bucket", F.pmod(F.xxhash64(F.lit(rnd), "uid"), F.lit(buckets)))
        packed = checkpoint(dealt.groupBy("bucket").applyInArrow(_pack_bucket(capacity, last, rnd), _PACKED))
        done = done.unionByName(packed.filter("settled").select("uid", "bin", "offset"))
        rest = packed.filter(~F.col("settled")).select("uid", "length")
        n = 0 if last else rest.count()
    return done


def packed_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    pieces = token_pieces(docs, tokenizer, capacity, end_id)
    pieces = checkpoint(pieces.withColumn("uid", F.monotonically_increasing_id()))
    placed = pack(pieces, capacity)
    return pieces.join(placed, "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )


def certificate(pieces: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Sequences of a packing (length, sequence_id), the least that any needs, and the gap between.

    The bound comes from the counts of all lengths, ``capacity`` numbers at most.
    """
    rows = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    used = pieces.select("sequence_id").distinct().count()
    count = np.zeros(capacity + 1, np.int64)
    for r in rows:
        count[r["length"]] = r["n"]
    bound = bound_of_counts(count, capacity)
    return {"sequences": used, "bound": bound, "gap": used - bound}
