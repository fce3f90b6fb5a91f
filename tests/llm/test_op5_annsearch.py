import numpy as np
from pyspark.sql import functions as F

from emberscan.llm import annsearch as A

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, v string"


def table(spark, x, ids=None, odd=()):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(a) for a in v], 1, 1, "v") for i, v in zip(ids, x)]
    return spark.createDataFrame([*rows, *[(i, v, 1, 1, "v") for i, v in odd]], SCHEMA)


def exact(x, ids, q, k=5):
    x = np.float32(x).astype(float)
    s = (x @ x[q]) / np.sqrt((x * x).sum(1) * (x[q] @ x[q]))
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]]
    return [(int(ids[i]), float(s[i])) for i in order[:k]]


def answers(df, step=50):
    got = {}
    for r in A.nearest_neighbours(df, F.col("vec_id") % step == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def recall(x, got, step=50):
    ids = np.arange(len(x))
    hit = total = 0
    for q in range(0, len(x), step):
        want = exact(x, ids, q)
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        scores = [s for _, _, s in got[q]]
        assert scores == sorted(scores, reverse=True)
        hit += len({i for i, _ in want} & {i for _, i, _ in got[q]})
        total += 5
    return hit / total


def test_recall_on_tight_and_loose_groups(spark):
    rng = np.random.default_rng(1)
    loose = rng.normal(size=(2500, 32)) + rng.normal(size=(10, 32))[rng.integers(0, 10, 2500)]
    tight = rng.normal(size=(3, 32))[rng.integers(0, 3, 1500)] + 0.05 * rng.normal(size=(1500, 32))
    x = rng.permutation(np.vstack([loose, tight]))
    assert recall(x, answers(table(spark, x).repartition(4))) >= 0.9


def test_small_tables_are_exact_with_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 7))
    x[100:130] = x[50]
    got = answers(table(spark, x).repartition(3))
    for q in range(0, 300, 50):
        want = exact(x, np.arange(300), q)
        assert [i for _, i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for _, _, s in got[q]], [s for _, s in want], atol=1e-12)
    assert [i for _, i, _ in got[50]] == [100, 101, 102, 103, 104]


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 3))
    odd = [(50, None), (100, [0.0, 0.0, 0.0]), (150, [1.0, None, 2.0]), (200, [float("nan"), 1.0, 1.0]), (250, [float("inf"), 1.0, 1.0]), (300, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (350, [])]
    got = answers(table(spark, x, odd=odd))
    assert set(got) == {0} and len(got[0]) == 3
    assert answers(table(spark, x[:1])) == {}
    assert answers(table(spark, x).limit(0)) == {}
    assert answers(table(spark, x[:0], odd=odd[:2])) == {}


def test_repeated_ids_count_once(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20, 5))
    ids = [0] * 3 + [7] * 10 + [8, 9, 10, 11, 12, 13, 14]
    x[:3], x[3:13] = x[0], x[0] + 0.01
    got = answers(table(spark, x, ids))
    assert set(got) == {0} and len({i for _, i, _ in got[0]}) == 5 and got[0][0][1] == 7


def test_hot_cell_is_cut(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_BYTES", 64 * 64)
    monkeypatch.setattr(A, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(5)
    x = np.ones((1500, 16)) + 0.1 * rng.normal(size=(1500, 16))
    assert recall(x, answers(table(spark, x).repartition(3), 50)) >= 0.9


def test_distances_stay_near_the_truth():
    rng = np.random.default_rng(6)
    x = A.unit(rng.normal(size=(2000, 24)))
    index = A.Quantiser(x, 20)
    cell, codes, error = index.encode(x)
    c = int(np.bincount(cell).argmax())
    at = np.flatnonzero(cell == c)
    near = index.approximate(x[:50], c, codes[at])
    assert (np.abs(near - x[:50] @ x[at].T) <= error[at] + 1e-9).all()


def test_the_method_runs_on_small_tables_too(spark, monkeypatch):
    seen = []
    build = A.build_index
    monkeypatch.setattr(A, "build_index", lambda *a: seen.append(build(*a)) or seen[-1])
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 16)) + 3 * rng.normal(size=(8, 16))[rng.integers(0, 8, 200)]
    assert recall(x, answers(table(spark, x).repartition(3))) >= 0.9
    report = seen[0].report()
    assert report["cells"] >= 8 and report["probed"] < report["cells"]


def test_a_second_level_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 12))[rng.integers(0, 6, 3000)] + 0.5 * rng.normal(size=(3000, 12))
    index = A.Quantiser(x[:600], 400)
    assert len(index.first) == 30 and index.n_lists >= 400
    u = A.unit(x)
    cell, codes, error = index.encode(u)
    c = int(np.bincount(cell).argmax())
    at = np.flatnonzero(cell == c)
    assert (np.abs(index.approximate(u[:50], c, codes[at]) - u[:50] @ u[at].T) <= error[at] + 1e-9).all()
    assert np.allclose(index.cell_scores(u[:3])[:, c], u[:3] @ index.centroid(c))
    monkeypatch.setattr(A, "SAMPLE_ROWS", 300)
    monkeypatch.setattr(A, "ROWS_PER_CENTROID", 10)
    assert recall(x, answers(table(spark, x).repartition(3))) >= 0.9


def test_queries_with_too_few_in_their_cells_look_further(spark, monkeypatch):
    monkeypatch.setattr(A.Quantiser, "probe", lambda self, q: (np.arange(len(q)), self.cell_scores(q).argmax(axis=1)))
    x = np.eye(30) + 0.01
    got = answers(table(spark, x).repartition(2), 10)
    assert {q: len(v) for q, v in got.items()} == {0: 5, 10: 5, 20: 5}


def test_a_vector_that_many_rows_share(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 8))
    x[200:700] = x[0]
    got = answers(table(spark, x).repartition(4))
    assert [i for _, i, _ in got[0]] == [200, 201, 202, 203, 204] and [i for _, i, _ in got[250]] == [0, 200, 201, 202, 203]
    base = A.distinct_vectors(A.usable(table(spark, x), "vec_id", "embedding"), 5, np.dtype("<f4")).collect()
    assert len(base) == 400 and max(len(r.ids) for r in base) == 6
