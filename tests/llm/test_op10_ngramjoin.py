import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from helpers import awkward, docs, words

from emberscan.llm import ngramjoin as N

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets = [(d, shingles(t, n)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            if 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def run(df, n, percent):
    got = N.link_components(df, n, percent).select("doc_id", "n_shingles", "component_id")
    return sorted((tuple(r) for r in got.collect()), key=str)


def family(rng, base, rate):
    return [w if rng.random() > rate else f"x{rng.randrange(9999)}" for w in base]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for size in (3, 5, 8, 12, 20, 40, 90, 200):
        for _ in range(4):
            base = words(rng, size)
            for rate in (0, 0, 0.005, 0.01, 0.02, 0.04, 0.08):
                rows.append(family(rng, base, rate))
            rows.append(base[:-1])
            rows.append(base + words(rng, max(1, size // 12)))
    passage = words(rng, 60)
    rows += [words(rng, 100) + passage + words(rng, rng.randrange(100)) for _ in range(40)]
    rng.shuffle(rows)
    return [(i + 1, " ".join(r), "en") for i, r in enumerate(rows)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_against_brute_force(spark, n, percent):
    rows = corpus(n)
    assert run(docs(spark, rows).repartition(4), n, percent) == brute([(d, t) for d, t, _ in rows], n, percent)


def test_small_tiles_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 3000)
    monkeypatch.setattr(N, "SMALL", 100)
    rng = random.Random(9)
    base = words(rng, 150)
    rows = [(i, " ".join(family(rng, base, 0.006)), "en") for i in range(1, 160)]
    assert run(docs(spark, rows).repartition(4), 3, 90) == brute([(d, t) for d, t, _ in rows], 3, 90)


def test_awkward(spark):
    df = awkward(spark, ["one two three four five", "ONE two  three\nfour five", "two", "two", "one two"])
    rows = [(r.doc_id, r.text) for r in df.collect()] + [(4, "two")]
    df = df.unionByName(docs(spark, [(4, "two", "en")])).selectExpr("*", "1 as id", "2 as key", "3 as n_shingles")
    assert run(df, 3, 90) == brute(rows, 3, 90)
    assert run(df.limit(0), 3, 90) == []


def test_keep_one(spark):
    df = awkward(spark, ["one two three four five", "another text of its own words", "another text of its own words"])
    extra = df.selectExpr("*", "1 as component_id", "2 as low")
    got = N.keep_one(extra, 3, 90)
    assert got.columns == extra.columns
    ids = sorted((r.doc_id for r in got.collect()), key=str)
    assert ids == sorted([1, 2, 3, 4, 5, 101, None], key=str)
    assert N.keep_one(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 80), st.integers(0, 80), st.sampled_from([80, 90]), st.integers(0, 2**31), st.booleans())
def test_linked_sets_share_a_key(common, a, b, percent, seed, some_frequent):
    rng = np.random.default_rng(seed)
    all_ = np.unique(rng.integers(0, 2**63, common + a + b, dtype=np.uint64))
    x, y = np.sort(np.concatenate([all_[:common], all_[common : common + a]])), np.sort(np.concatenate([all_[:common], all_[common + a :]]))
    if 100 * common < percent * len(np.union1d(x, y)) or np.array_equal(x, y):
        return
    frequent = np.sort(rng.choice(all_, len(all_) // 2, replace=False)) if some_frequent else np.zeros(0, np.uint64)
    keys = []
    for s in (x, y):
        band = N.band_of(len(s), percent)
        keys.append(set(np.concatenate([N.part_keys(s, c, percent, frequent) for c in (band, band + 1)]).tolist()))
    assert keys[0] & keys[1]


def test_bit_counts_bound_the_overlap():
    rng = np.random.default_rng(3)
    sets = sorted((np.unique(rng.integers(0, 4000, k, dtype=np.uint64) << np.uint64(20)) for k in (1, 5, 16, 17, 50, 60, 500, 900, 3000)), key=len)
    sets.append(np.unique(np.concatenate([sets[-1], sets[0] + np.uint64(1)])))
    maps = N.Bitmaps([N.bitmap(s) for s in sets], np.array([len(s) for s in sets]))
    for i, x in enumerate(sets):
        most = maps.most(i, np.arange(i))
        for j in range(i):
            assert len(np.intersect1d(x, sets[j])) <= most[j]
            bits = min(N.bitmap_bits(len(x)), N.bitmap_bits(len(sets[j])))
            a, b = N.bitmap(x, bits), N.bitmap(sets[j], bits)
            both = int(np.bitwise_count(a & b).sum())
            assert most[j] == min(len(x) - int(np.bitwise_count(a).sum()) + both, len(sets[j]) - int(np.bitwise_count(b).sum()) + both)


def test_clashing_columns(spark):
    df = awkward(spark, ["one two three four five"]).selectExpr("*", "1 as _low", "2 as row", "3 as text_hash", "4 as component", "5 as `a.b`", "6 as stays")
    got = N.keep_one(df, 3, 90)
    assert got.columns == df.columns and got.count() == 6


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "some other words altogether here"), (2, "alpha beta gamma delta"), (2, "yet more of them now"), (1, "alpha beta gamma delta")]
    got = N.keep_one(docs(spark, [(d, t, "en") for d, t in rows]), 3, 90)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted({rows[0], rows[1], rows[3]})


def test_large_groups_of_copies_of_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 2000)
    monkeypatch.setattr(N, "SMALL", 64)
    rng = random.Random(11)
    rows = []
    for g in range(3):
        base = words(rng, 120)
        for k in range(90):  # a drift: far members link to each other only, not to the middle
            at = rng.randrange(118)
            base = [*base[:at], f"d{g}-{k}", *base[at + 1 :]]
            rows.append((g * 1000 + k, " ".join(base[: 120 - k % 5]), "en"))
    rng.shuffle(rows)
    assert run(docs(spark, rows).repartition(4), 3, 90) == brute([(d, t) for d, t, _ in rows], 3, 90)


def test_filters_are_freed_and_no_shingle_list_is_merged_in_the_driver(spark, monkeypatch):
    sent, sc, kind = [], spark.sparkContext, type(spark.range(0))
    monkeypatch.setattr(sc, "broadcast", lambda value, f=sc.broadcast: sent.append(f(value)) or sent[-1])

    def refused(self):
        raise AssertionError("rows are brought to the driver as objects")

    monkeypatch.setattr(kind, "toPandas", refused)
    rows = corpus(5)
    got = run(docs(spark, rows).repartition(4), 3, 90)
    assert got == brute([(d, t) for d, t, _ in rows], 3, 90)
    assert len(sent) == 3 and not any(b._jbroadcast.isValid() for b in sent)
