"""Line deduplication across documents: sorted hashes in, keep bitmaps out.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased.  Keys of at least ``MIN_KEY`` code points found in two or more
documents lose all their lines but those in the smallest doc_id holding them.

Keys become two 64-bit hashes.  (hash, doc_id, position) rows are range
partitioned on the whole of that order, so a line that a third of all documents
hold is spread over many partitions, and are written to the shared folder.  One
pass reports each partition's first and last key (a row per partition, all that
the driver sees); from these follows who owns a key that began in an earlier
partition.  The second pass streams each partition and marks what comes after
the first document of a key.  Dropped positions meet again by document.

Result: (doc_id, text_hash, n_lines, n_dropped, keep) for documents that lose
lines, ``keep`` being the zlib-compressed bits of kept lines; others keep all.

Defined results: a null or empty text is one empty line; rows with a null
doc_id keep all their lines and make no other line a copy; rows with the same
doc_id are one document; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions, small_batches, text_hash

MIN_KEY = 10
_EDGE = " \t\n\x0b\x0c\r"
_KEYS = "h1 long, h2 long, doc_id long, text_hash long, pos int, n_lines int"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_EDGE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _line_rows(docs: DataFrame, min_key: int) -> DataFrame:
    lines = F.split(F.col("text"), "\n", -1)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .filter("doc_id is not null")
        .select("doc_id", text_hash(F.col("text")).alias("text_hash"), lines.alias("lines"))
        .select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "text_hash", "n_lines", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_key)
    )
    return rows.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(97), "key").alias("h2"), "doc_id", "text_hash", "pos", "n_lines"
    )


def _ends(batches):
    """One row per partition: first key, last key, first document of the last run."""
    first = last = None
    for b in batches:
        if not b.num_rows:
            continue
        h1, h2, d = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        at = int(new[-1]) if len(new) else 0
        if first is None:
            first = (int(h1[0]), int(h2[0]))
        if at or last is None or (int(h1[0]), int(h2[0])) != last[:2]:
            last = (int(h1[at]), int(h2[at]), int(d[at]))
    if first is not None:
        yield pa.RecordBatch.from_pylist(
            [{"pid": TaskContext.get().partitionId(), "f1": first[0], "f2": first[1], "l1": last[0], "l2": last[1], "owner": last[2]}]
        )


def _copies(carried: dict):
    def run(batches):
        own = carried.get(TaskContext.get().partitionId())
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            h1, h2, d = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            begins = np.ones(n, bool)
            begins[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            owner = d[start]
            if own is not None and (int(h1[0]), int(h2[0])) == own[:2]:
                owner = np.where(start == 0, own[2], owner)
            own = (int(h1[-1]), int(h2[-1]), int(owner[-1]))
            at = np.flatnonzero(owner != d)
            if len(at):
                yield b.take(pa.array(at)).select(["doc_id", "text_hash", "pos", "n_lines"])

    return run


def _bitmaps(batches):
    for b in batches:
        keep = []
        for n, dropped in zip(b.column(2).to_pylist(), b.column(3)):
            bits = np.ones(n, bool)
            bits[dropped.values.to_numpy()] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array([len(x.values) for x in b.column(3)], pa.int64()), pa.array(keep, pa.binary())],
            ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"],
        )


def line_bitmaps(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """Keep bitmaps of the documents that lose lines."""
    spark = docs.sparkSession
    small_batches(spark)
    order = ["h1", "h2", "doc_id", "text_hash", "pos"]
    rows = checkpoint(_line_rows(docs, min_key))
    rows = checkpoint(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))
    ends = rows.mapInArrow(_ends, "pid long, f1 long, f2 long, l1 long, l2 long, owner long").collect()
    carried, own = {}, None
    for e in sorted(ends):
        if own is not None and own[:2] == (e.f1, e.f2):
            carried[e.pid] = own
            if (e.l1, e.l2) == own[:2]:
                continue
        own = (e.l1, e.l2, e.owner)
    dropped = rows.mapInArrow(_copies(carried), "doc_id long, text_hash long, pos int, n_lines int")
    return (
        dropped.groupBy("doc_id", "text_hash")
        .agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
        .mapInArrow(_bitmaps, "doc_id long, text_hash long, n_lines int, n_dropped long, keep binary")
    )


def kept_text(text: str | None, keep: bytes | None) -> str | None:
    if keep is None or text is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, bits) if bit)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row struct of ``docs``, n_dropped, keep): every row beside its bitmap, null if it keeps all."""
    left = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("_id"),
        text_hash(F.coalesce("text", F.lit(""))).alias("_hash"),
    )
    right = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_dropped", "keep")
    return left.join(right.hint("shuffle_hash"), ["_id", "_hash"], "left").select("row", "n_dropped", "keep")


def dedup_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with the kept lines as ``text`` (and ``n_chars``, where it has that column)."""
    cut = F.pandas_udf(_kept_series, "string")
    joined = with_bitmaps(docs, line_bitmaps(docs, min_key))
    text = F.when(F.col("keep").isNull(), F.col("row.text")).otherwise(cut(F.when(F.col("keep").isNotNull(), F.col("row.text")), "keep"))
    joined = joined.select("row", "keep", text.alias("text"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("keep").isNull(), F.col("row.n_chars")).otherwise(F.char_length("text").cast(dict(docs.dtypes)[c])).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return joined.select(*cols)


def _kept_series(text, keep):
    import pandas as pd

    return pd.Series([kept_text(t, k) for t, k in zip(text, keep)], dtype=object)
