import random

import numpy as np
import pyarrow as pa
from helpers import awkward, docs, words
from pyspark.sql import functions as F

from emberscan.llm import quality as Q
from emberscan.llm import textvec as tv


def measured(texts):
    return Q.features(*tv.buffers(pa.array(texts)))


def test_features_against_plain_python():
    texts = ["Hello hello world!\nAgain\nAgain", "", None, "a b a b", "#|# 12\n\n\nx", "éÉ ß"]
    x = measured(texts)
    col = {f: i for i, f in enumerate(Q.FEATURES)}
    assert x.shape == (6, len(Q.FEATURES)) and (x[1] == 0).all() and (x[2] == 0).all()
    w = texts[0].lower().split()
    assert np.isclose(x[0, col["unique_words"]], len(set(w)) / len(w)) and np.isclose(x[0, col["top_word"]], 2 / 5)
    assert np.isclose(x[0, col["repeated_next"]], 2 / 4) and np.isclose(x[0, col["unique_lines"]], 2 / 3)
    assert np.isclose(x[3, col["unique_pairs"]], 2 / 3) and np.isclose(x[3, col["one_byte_words"]], 1)
    assert np.isclose(x[4, col["pipe"]], 1 / 10) and np.isclose(x[4, col["digit"]], 2 / 10) and np.isclose(x[4, col["newline"]], 3 / 10)
    whole = measured([texts[0]])
    assert np.allclose(whole[0], x[0])


def test_trees_match_a_plain_walk_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = Q.fit(x[:2000], y[:2000])
    p = forest.score(x[2000:])
    assert ((p >= 0.5) == y[2000:]).mean() > 0.97 and p.min() >= 0 and p.max() <= 1
    for row in x[2000:2010]:
        z = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            k = 0
            for _ in range(Q.DEPTH):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            z += v[k - (2**Q.DEPTH - 1)]
        assert np.isclose(1 / (1 + np.exp(-z)), forest.score(row[None])[0])


def test_degenerate_labels():
    none = Q.fit(np.zeros((0, 3)), np.zeros(0))
    assert none.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert Q.fit(np.zeros((4, 3)), np.ones(4)).score(np.zeros((1, 3)))[0] > 0.5
    assert Q.fit(np.zeros((6, 3)), np.array([0, 1, 0, 1, 1, 1.0])).score(np.zeros((1, 3))).shape == (1,)


def test_end_to_end(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        good = i % 2 == 0
        t = " ".join(words(rng, 80)) if good else " ".join([rng.choice(["spam", "buy"])] * 60)
        rows.append((i, t, "en"))
    df = docs(spark, rows).repartition(4)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 0), (4, None, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    forest = Q.train(df, labels, "quality", F.col("doc_id") % 3 != 1)
    got = Q.score(df.unionByName(awkward(spark)).selectExpr("*", "1 as score", "2 as label"), forest)
    out = got.collect()
    assert len(out) == 307 and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.doc_id is not None and r.doc_id % 3 == 1 and r.doc_id > 5]
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held)
    assert Q.score(df.limit(0), forest).count() == 0
    flat = Q.score(df, Q.train(df, labels.limit(0), "quality", F.lit(True))).collect()
    assert {r.score for r in flat} == {0.5}


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE_ROWS", 50)
    labels = spark.range(1000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    got = Q.labelled(labels, "quality", F.lit(True))
    assert 40 <= got.count() <= 50
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in Q.labelled(labels.repartition(7), "quality", F.lit(True)).collect())


def test_first_split_against_every_split():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 4)), (rng.random(300) < 0.4).astype(float)
    y[x[:, 2] > 0.3] = 1
    forest = Q.fit(x, y)
    p = 1 / (1 + np.exp(-forest.base))
    grad, hess = p - y, np.full(300, p * (1 - p))
    part = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + Q.RIDGE)
    best = (-1.0, 0, 0.0)
    least = min(Q.LEAST, 300 // 20)
    for j in range(4):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, Q.BINS + 1)[1:-1])):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= least:
                best = max(best, (part(left) + part(~left) - part(np.ones(300, bool)), j, cut))
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == best[1:]


def test_leaves_hold_newton_steps():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(400, 3)), (rng.random(400) < 0.5).astype(float)
    forest = Q.fit(x, y)
    one = Q.Forest(forest.base, forest.feature[:1], forest.threshold[:1], forest.value[:1])
    p = 1 / (1 + np.exp(-forest.base))
    z = np.log(one.score(x) / (1 - one.score(x))) - forest.base
    for v in np.unique(np.round(z, 9)):
        at = np.isclose(z, v, atol=1e-8)
        # rows with this step lie in leaves of that value; with one leaf each the step is Newton's
        assert min(abs(v - w) for w in forest.value[0]) < 1e-8
    leaf = np.zeros(400, int)
    for _ in range(Q.DEPTH):
        leaf = 2 * leaf + 1 + (x[np.arange(400), forest.feature[0][leaf]] > forest.threshold[0][leaf])
    leaf -= 2**Q.DEPTH - 1
    for k in np.unique(leaf):
        g, w = (p - y[leaf == k]).sum(), (leaf == k).sum() * p * (1 - p)
        assert np.isclose(forest.value[0][k], -Q.RATE * g / (w + Q.RIDGE))


def test_rows_of_one_id_are_learned_from_once(spark):
    rows = [(i, f"text number {i} of a few words", "en") for i in range(50)] + [(7, f"other {k}", "en") for k in range(500)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    seen = []
    old = Q.fit
    try:
        Q.fit = lambda x, y: seen.append(len(y)) or old(x, y)
        Q.train(docs(spark, rows).repartition(3), labels, "quality", F.lit(True))
    finally:
        Q.fit = old
    assert seen == [50]
