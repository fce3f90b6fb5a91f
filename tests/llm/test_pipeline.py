import corpus_pipeline as P
import pytest
from helpers import docs
from test_op10_ngramjoin import brute as near_brute
from test_op8_linededup import brute as line_brute

from emberscan.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_brute_force(spark, steps):
    names = [n for n, _ in P.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "pack"]
    assert all(s.columns == steps[0].columns for s in steps[:5])
    known = rows(steps[1])
    assert len(known) >= 0.97 * steps[0].count()
    import hashlib

    want = {(d, sha) for d, _, _, sha in line_brute(known)}
    assert {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows(steps[2])} == want
    keep = {d for d, _, c in near_brute(rows(steps[2]), P.NEAR_SHINGLE, P.NEAR_PERCENT) if c == d}
    assert {d for d, _ in rows(steps[3])} == keep
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for d, t in rows(steps[3]) if not any(i in (t or "") for i in items)}
    assert {d for d, _ in rows(steps[4])} == clean
    assert {r.doc_id for r in steps[5].select("doc_id").distinct().collect()} == {d for d, _ in rows(steps[4])}


def test_run_gives_the_last_stage(spark, steps):
    got = P.run(spark, SF)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, steps[5].select(*cols).collect()))


def test_empty_and_odd_input(spark):
    df = docs(spark, [(1, None, "en"), (2, "", None), (None, "12", "en")])
    for some in (df, df.limit(0)):
        for _, stage in P.STAGES:
            stage(spark, some, SF).collect()


def test_every_operator_is_registered():
    q = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in q if n.startswith("op")) == list(range(1, 11)) and "pipeline" in q
    assert set(registry.oracle_sql()) <= set(q)


def test_clashing_columns_in_every_stage(spark):
    names = ["_low", "_gone_id", "row", "text_hash", "id", "none", "hash", "keep", "score", "h", "grp", "item_id"]
    df = docs(spark, [(1, "the first text of all of them is here", "en"), (2, "the second one\nis another", "en"), (None, None, None)])
    extra = df.selectExpr("*", *[f"{k} as `{n}`" for k, n in enumerate(names)])
    for _, stage in P.STAGES[:4]:
        got = stage(spark, extra, SF)
        assert got.columns == extra.columns
        assert got.collect() is not None
    assert P.STAGES[4][1](spark, extra, SF).count() == 3
