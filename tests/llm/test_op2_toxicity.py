import random

import numpy as np
from helpers import awkward, docs, words
from pyspark.sql import functions as F

from emberscan.llm import toxicity as T

BAD = ["moron", "scumbag", "worthless"]


def test_folding():
    assert T.fold("M0R0N") == " moron " and T.fold("mоrоn") == " moron " and T.fold("mo​ron!") == " moron "
    assert T.fold("Dégoûtant, ＳＣＵＭ") == " degoutant scum " and T.fold(None) == "  " and T.fold("$cum b@g") == " scum bag "


def brute(lexicon, folded):
    """Heaviest entry of each word outside exception phrases, once per word."""
    ws, out, free = folded.split(), {}, set()
    for x in lexicon.exceptions:
        p = x.split()
        for i in range(len(ws) - len(p) + 1):
            if ws[i : i + len(p)] == p:
                free.update(range(i, i + len(p)))
    for i, w in enumerate(ws):
        fit = [v for t, v in lexicon.weights.items() if t == w or (t.endswith("*") and w.startswith(t[:-1]))]
        if fit and i not in free:
            out[w] = max(fit)
    return sorted(out.values())


def test_automaton_against_brute_force():
    rng = random.Random(1)
    lexicon = T.Lexicon({"moron": 3.0, "moro*": 2.0, "trash": 2.5, "can": 1.0, "clow*": 4.0, "a": 0.5})
    auto = lexicon.automaton()
    vocabulary = ["moron", "morons", "trash", "can", "clown", "fish", "a", "ok", "xmoron", "cannot"]
    for _ in range(300):
        folded = T.fold(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12))))
        assert sorted(T.hits(auto, folded)) == brute(lexicon, folded)
    assert T.hits(T.Lexicon({}, ()).automaton(), " moron ") == []


def corpus(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = words(rng, 60, 400)
        bad = i % 6 == 0
        if bad:
            for _ in range(2):
                x = rng.choice(BAD)
                w.insert(rng.randrange(60), x if rng.random() < 0.7 else x.replace("o", "0").upper())
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, 1, None), (0, 1, 1)]
    return docs(spark, rows).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    df, labels = corpus(spark)
    model = T.train(df, labels, F.col("doc_id") % 5 != 0)
    got = T.score(df.unionByName(awkward(spark, ["you are a MOR0N, a worthless scumbag"])).selectExpr("*", "1 as score", "2 as fold", "3 as label"), model).collect()
    assert len(got) == 608 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id % 5 == 0 and r.doc_id > 5 and r.doc_id != 100]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 6 == 0) for r in held]) > 0.97
    assert T.score(df.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    df, labels = corpus(spark)
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        got = T.score(awkward(spark), T.train(df, some, F.lit(True))).collect()
        assert all(r.score < 0.5 for r in got)
    only = T.score(awkward(spark), T.train(df, labels.filter("toxic = 1"), F.lit(True))).collect()
    assert all(r.score > 0.5 for r in only)


def test_letters_in_disguise():
    assert T.fold("1D!0T") == " idiot " and T.fold("ΗΖΜ Н8") == " hzm hb " and T.fold("idiot!") == " idiot " and T.fold("! | a!") == " a "
    assert T.readings("c1own") == [" ciown ", " clown "] and T.readings("in 1 day, 10 days") == [T.fold("in 1 day, 10 days")]
    auto = T.Lexicon({"clown": 3.0, "idiot": 2.0}).automaton()
    one = T.measures(auto, "a C1OWN and an 1D1OT")
    assert one == T.measures(auto, "a clown and an idiot") and one[0] > 0


def test_a_very_long_text_of_exceptions_is_read_in_passing():
    import time

    auto = T.Lexicon({"trash": 2.5, "idiot": 2.0}).automaton()
    start = time.perf_counter()
    got = T.measures(auto, "trash can idiot proof idiot " * 350_000)
    assert time.perf_counter() - start < 60 and got[2] == np.log1p(1)  # 10 MB


def test_overlapping_exceptions():
    lexicon = T.Lexicon({"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}, ("a b", "b c", "a b c", "d d"))
    auto = lexicon.automaton()
    rng = random.Random(5)
    for _ in range(300):
        folded = T.fold(" ".join(rng.choice("abcd") for _ in range(rng.randrange(15))))
        assert sorted(T.hits(auto, folded)) == brute(lexicon, folded)


def test_exceptions_are_learned_in_any_language(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        w = words(rng, 40, 300)
        if i % 4 == 0:
            w.insert(rng.randrange(40), "ordure")
        elif i % 12 == 1:
            at = rng.randrange(40)
            w[at:at] = ["bac", "ordure"]
        rows.append((i, " ".join(w), "fr"))
        labels.append((i, 1, int(i % 4 == 0)))
    df, labels = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.train(df, labels, F.lit(True))
    assert " bac ordure " in model.lexicon.exceptions
    got = {r.doc_id: r.score for r in T.score(docs(spark, [(1, "le bac ordure est plein", "fr"), (2, "quelle ordure", "fr")]), model).collect()}
    assert got[1] < 0.5 < got[2]


def test_rows_of_one_id_count_once(spark):
    df, labels = corpus(spark)
    many = df.unionByName(docs(spark, [(6, f"other text {k}", "en") for k in range(300)]))
    model = T.train(many, labels, F.col("doc_id") % 5 != 0)
    assert 0 <= T.score(df, model).agg(F.max("score")).first()[0] <= 1
