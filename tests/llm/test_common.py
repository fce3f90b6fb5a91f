import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscan.llm import common as C


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    linked = {x for e in edges if e[0] != e[1] for x in e}
    return {x: find(x) for x in linked}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(200)],
    [(0, i) for i in range(1, 300)] + [(5000, i) for i in range(300, 500)],
    [(random.Random(i).randrange(300), random.Random(-i - 1).randrange(300)) for i in range(200)],
    [(7, 7), (-3, 9), (9, -3), (9, 2**62)],
    [],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    got = {r.id: r.component for r in C.connected_components(df).collect()}
    assert got == brute(edges)


def test_filter_has_no_false_negatives(spark):
    ids = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = C.hash_filter(ids)
    h = np.array([r.h for r in ids.collect()])
    assert C.in_filter(bits, h).all()
    other = np.array([r.h for r in spark.range(10**6, 10**6 + 20000).select(F.xxhash64("id").alias("h")).collect()])
    assert C.in_filter(bits, other).mean() < 0.01
    assert not C.in_filter(C.hash_filter(ids.limit(0)), h).any()


def test_filter_comes_to_the_driver_packed(spark, monkeypatch):
    """No frame with a row for each word of the filter reaches the driver."""
    brought, kind = [], type(spark.range(0))
    for name in ("toPandas", "toArrow", "collect"):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), **b: brought.append(len(got := f(self, *a, **b))) or got)
    n = 200_000
    ids = spark.range(n).select(F.xxhash64("id").alias("h")).repartition(5)
    for said in (n, 6 * n):
        brought.clear()
        bits = C.hash_filter(ids, said)
        assert 0 < sum(brought) <= len(bits) // 2048
        want = np.zeros(8 * len(bits), bool)
        want[C._slots(np.array([r.h for r in ids.collect()]), 8 * len(bits))] = True
        assert 8 * len(bits) == C.filter_bits(said)
        assert np.array_equal(bits, np.packbits(want, bitorder="little"))


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(10_000).withColumnRenamed("id", "doc_id")
    one = sorted(r.doc_id for r in C.sampled(df.repartition(3), F.col("doc_id"), 100).collect())
    two = sorted(r.doc_id for r in C.sampled(df.repartition(7), F.col("doc_id"), 100).collect())
    assert one == two and len(one) == 100
    assert C.sampled(df.limit(0), F.col("doc_id"), 5).count() == 0


def test_crc_of_ids(spark):
    import zlib

    got = spark.createDataFrame([(17,), (-3,), (None,)], "doc_id long").select(C.crc_of_id(F.col("doc_id"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(b"17"), zlib.crc32(b"-3"), 0]


def test_small_batches_keep_a_smaller_bound(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        for now, want in (("1000", "1000"), (str(64 << 20), str(C.BATCH_BYTES)), ("64m", str(C.BATCH_BYTES))):
            spark.conf.set(key, now)
            C.small_batches(spark)
            assert spark.conf.get(key).rstrip("b") == want
    finally:
        spark.conf.set(key, old)
