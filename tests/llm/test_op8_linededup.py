import hashlib
import random

from helpers import awkward, docs

from emberscan.llm import linededup as L
from emberscan.llm.q_linededup import _digests

EDGE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """rows: (doc_id, text) -> list of (doc_id, n_lines, n_dropped, sha)."""
    owner, holders = {}, {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(EDGE).translate(LOWER)
            if d is not None and len(k) >= 10:
                owner[k] = min(d, owner.get(k, d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or owner.get(x.strip(EDGE).translate(LOWER), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def run(df):
    got = L.with_bitmaps(df, L.line_bitmaps(df)).mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return [tuple(r) for r in got.collect()]


def order(rows):
    return sorted(rows, key=str)


def test_random_documents(spark):
    rng = random.Random(4)
    pool = [f"a line number {i} of the pool" for i in range(25)] + ["short", "", "  Padded LINE here \t", "padded line here", "ÄÖÜ is no ascii x", "äöü is no ascii x"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9))), "en") for i in range(80)]
    rows += [(7, "a second text of document seven\n" + pool[0], "en"), (7, rows[7][1], "en")]
    df = docs(spark, rows).repartition(5)
    assert order(run(df)) == order(brute([(d, t) for d, t, _ in rows]))


def test_hot_line_spans_partitions(spark):
    rows = [(i, f"the line that all documents hold\nbut this line is only in {i}", "en") for i in range(3000)]
    df = docs(spark, rows).repartition(6)
    assert order(run(df)) == order(brute([(d, t) for d, t, _ in rows]))


def test_one_key_only(spark):
    rows = [(i, "exactly the same line", "en") for i in range(500)]
    got = run(docs(spark, rows).repartition(4))
    assert sum(r[2] for r in got) == 499


def test_awkward_and_clashing_columns(spark):
    df = awkward(spark, ["one two three four five\nand more words", "and more words\n"])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert order(run(df)) == order(brute(rows))
    extra = df.selectExpr("*", "1 as keep", "2 as pos", "3 as text_hash", "'x' as row")
    out = L.dedup_lines(extra)
    assert out.columns == extra.columns and out.count() == len(rows)
    assert {r.doc_id: r.text for r in out.collect()}[101] == ""
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_stage_updates_text_and_length(spark):
    df = docs(spark, [(1, "shared line of text\nmine", "en"), (2, "yours\nShared line of text ", "en")])
    got = {r.doc_id: (r.text, r.n_chars) for r in L.dedup_lines(df).collect()}
    assert got == {1: ("shared line of text\nmine", 24), 2: ("yours", 5)}
