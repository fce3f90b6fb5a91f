"""Shared helpers: table reads, checkpoints, row keys, labels, components."""

from __future__ import annotations

import gc
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most in this session, unless it has a smaller bound.

    Texts differ widely in length, and a batch is held several times over, in the
    JVM and in Python; bounded by rows alone it would grow with the texts.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Driver and tasks are one process, so a folder of this machine is shared."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local session; on a cluster it
    would lie on one node's disk, so there this raises ValueError.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_checkpoint(df: DataFrame) -> None:
    """Delete the files of a frame made by ``checkpoint``; it cannot be read any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        delete_path(df.sparkSession, file.get())


def free_shuffles(spark: SparkSession) -> None:
    """Hint that shuffle files which nothing refers to any more can go.

    Spark deletes them when the driver collects garbage, which a lightly loaded
    driver may not do for long.  Checkpoints do not wait for this: they are
    deleted by ``drop_checkpoint``.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def sampled(df: DataFrame, key: Column, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` rows, the smallest by a hash of ``key``.

    A hash threshold a little above the share wanted cuts the input first, so
    that the ordering never sees more than about 1.3 x ``rows`` rows.
    """
    n = df.count()
    h = F.xxhash64(F.lit(seed), key)
    if n > 2 * rows:
        share = 1.3 * rows / n
        df = df.filter(F.pmod(h, F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1))
    return df.orderBy(F.pmod(h, F.lit(1_000_003)), h, key).limit(rows)


#: Bits of a bitmap filter for each entry, and its least and largest size (1 and 32 MiB).
BITS_PER_ENTRY, LEAST_BITS, MOST_BITS = 16, 1 << 23, 1 << 28


def filter_bits(n: int) -> int:
    """Bits of a filter of n entries, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ENTRY * n).bit_length()))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    h = h.astype(np.uint64)
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


#: Words of a filter that go to the driver as one value.
SLICE = 1 << 8


def hash_filter(hashes: DataFrame, n: int = 0) -> np.ndarray:
    """Bitmap over a frame of one column of 64-bit hashes, about ``n`` of them.

    Built and packed on the executors; the driver gets the bytes of its used slices,
    ``MOST_BITS`` / 8 at most, as Arrow and never a row for each word.  It only
    spares work: a full one lets all pass.
    """
    bits = filter_bits(n)

    def run(batches):
        row = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _slots(b.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = row.view(np.int64)
        used = np.flatnonzero(words)
        for i in range(0, len(used), 1 << 16):
            at = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["word", "bits"])

    def packed(batches):
        rows = np.zeros((bits // 64 // SLICE, SLICE), np.int64)
        for b in batches:
            np.bitwise_or.at(rows.reshape(-1), b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
        used = np.flatnonzero(rows.any(axis=1))
        for i in range(0, len(used), 1 << 10):
            at = used[i : i + (1 << 10)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([x.tobytes() for x in rows[at]], pa.binary())], ["slice", "data"])

    words = hashes.mapInArrow(run, "word long, bits long").repartition(F.expr(f"word div {SLICE}"))
    got = words.mapInArrow(packed, "slice long, data binary").toArrow()
    out = np.zeros((bits // 64 // SLICE, SLICE), np.int64)
    for b in got.to_batches():
        for k, x in zip(b.column(0).to_pylist(), b.column(1)):
            out[k] = np.frombuffer(x.as_buffer(), np.int64)
    return out.reshape(-1).view(np.uint8)


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _slots(h, 8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


#: Edges of a component search that one map task reads.
EDGES_PER_PARTITION = 100_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) long links -> (id, component), component = smallest id reached.

    Alternating large-star / small-star over a checkpointed edge table; only
    counts and checksums come to the driver.  Ids without links are absent.
    """
    def shape(e: DataFrame) -> DataFrame:
        return e.filter("src <> dst").select(
            F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
        ).distinct()

    def settled(e: DataFrame) -> tuple[DataFrame, tuple]:
        """The checkpointed edges, and their count and checksum."""
        e = checkpoint(e)
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))).first()
        return e, (mark[0], mark[1])

    def narrowed(e: DataFrame, mark: tuple) -> DataFrame:
        """The edges in partitions that suit their number."""
        parts = 1 + mark[0] // EDGES_PER_PARTITION
        return e.coalesce(parts) if parts < partitions(e.sparkSession) else e

    def both_ways(e: DataFrame) -> DataFrame:
        return e.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))

    # the files of a round go as soon as the next one has written its own
    kept, seen = settled(shape(edges))
    cur = narrowed(kept, seen)
    while seen[0]:
        # larger neighbours go to the smallest one; a hub's rows can be split, as this is a join
        both = both_ways(cur)
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        # smaller neighbours, and the node itself, go to the smallest one
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.when(F.col("dst") == F.col("m"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.col("m").alias("dst"))
        nxt, now = settled(shape(small))
        del both, low, large, least, small, cur
        drop_checkpoint(kept)
        kept, cur = nxt, narrowed(nxt, now)
        free_shuffles(edges.sparkSession)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return cur.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(roots)
