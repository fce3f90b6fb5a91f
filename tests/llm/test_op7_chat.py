import hashlib
import random

import duckdb
import pytest

from emberscan.llm import q_chat
from emberscan.llm.chat import BUDGET, CLOSE, HISTORY, OPEN, format_windows, read_back

SCHEMA = "conv_id long, turn long, role string, text string, window int, cost string"


def conversations(spark):
    rng = random.Random(3)
    texts = ["", None, "\\", "<", "\\b\\l", "</turn>", "<turn user>", "a > b", "line\nline", "é中😀", "\\\\<\\l"]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 40)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", "to>ol\\g", None])
            text = rng.choice(texts) if rng.random() < 0.3 else "".join(rng.choice("abc <\\>\n") for _ in range(rng.randrange(2500)))
            rows.append((c, t, role, text, 1, "x"))
    rows += [(50, 0, "assistant", "x" * 60_000, 1, "x"), (50, 1, "assistant", "y", 1, "x"), (51, None, "user", "n", 1, "x")]
    rows += [(52, 1, "assistant", "tie", 1, "x"), (52, 1, "assistant", "tie", 1, "x"), (None, 1, "user", "no id", 1, "x")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def brute(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        learned = "".join(t for _, role, t in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned))
    return out


def test_round_trip(spark):
    rows, df = conversations(spark)
    windows = format_windows(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(windows).collect()}
    assert got == brute(rows)
    assert read_back(format_windows(df.limit(0))).count() == 0


def test_windows(spark):
    _, df = conversations(spark)
    ws = format_windows(df).collect()
    assert max(r.window for r in ws) > 2
    system = {r.conv_id for r in df.filter("turn = 0 and role = 'system'").collect()}
    for r in ws:
        pieces = r.formatted.split(CLOSE)
        assert pieces[-1] == "" and all(p.startswith(OPEN) for p in pieces[:-1])
        assert r.cost <= BUDGET or len(pieces) - 1 - r.n_repeated == 1
        if r.conv_id in system:
            assert pieces[0].startswith(OPEN + "system>")
        for span in r.loss:
            assert r.formatted[: span.begin].endswith("<turn assistant>") and r.formatted[span.end :].startswith(CLOSE)
        spans = [(s.begin, s.end) for s in r.loss]
        assert spans == sorted(spans)


def test_repeated_history_exists(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "w" * 600, 1, "x") for t in range(100)]
    ws = format_windows(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_repeated == 2 for r in ws if r.window) and all(r.cost <= BUDGET for r in ws)
    assert sum(len(r.loss) for r in ws) == 50


def test_no_window_exceeds_the_budget_but_for_one_turn(spark):
    rng = random.Random(8)
    rows = []
    for c in range(120):
        system = rng.choice([0, 50, 3000, 6000, 7100, 7300, 14_000, 20_000])
        large = rng.choice([20, 900, 4000, 9000, 16_000, 30_000])
        if system:
            rows.append((c, 0, "system", "s" * system, 1, "x"))
        rows += [(c, t, rng.choice(["user", "assistant"]), "w" * rng.randrange(large), 1, "x") for t in range(1, rng.randrange(2, 30))]
    rows += [(200, 0, "system", "s" * 14_000, 1, "x")] + [(200, t, "user", "w" * 900, 1, "x") for t in range(1, 20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ws = format_windows(df).collect()
    cost = lambda p: -(-(len(p) + len(CLOSE)) // 4)
    whole = {c: next((cost(f"{OPEN}system>{r[3]}") for r in rows if r[0] == c and r[2] == "system"), 0) for c in range(201)}
    for r in ws:
        pieces = r.formatted.split(CLOSE)[:-1]
        assert r.cost <= BUDGET or len(pieces) == 1
        if 0 < 2 * whole[r.conv_id] <= BUDGET - HISTORY and not pieces[0].startswith(OPEN + "system>"):
            assert sum(map(cost, pieces[r.n_repeated :])) + whole[r.conv_id] > BUDGET  # no room for it
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(format_windows(df)).collect()}
    assert got == brute(rows)
    assert any(not r.formatted.startswith(OPEN + "system>") and whole[r.conv_id] for r in ws) and max(r.cost for r in ws) > BUDGET


@pytest.mark.parametrize("budget, history", [(40, 10), (8, 8), (300, 0)])
def test_other_budgets(spark, budget, history):
    rows, df = conversations(spark)
    ws = format_windows(df, budget, history)
    assert all(r.cost <= budget or len(r.formatted.split(CLOSE)) == 2 for r in ws.collect())
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(ws).collect()} == brute(rows)


def test_sql_on_awkward_rows(spark, tmp_path):
    rows, df = conversations(spark)
    rows += [(300 + k, t, "system" if t == 0 else "user", "s" * (n if t == 0 else m), 1, "x") for k, (n, m) in enumerate([(14_000, 900), (7000, 14_000), (6000, 12_000), (100, 17_000)]) for t in range(9)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = q_chat.op7_chat_format(spark, str(tmp_path)).select(*cols)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, con.execute(q_chat.SQL).fetchall()))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('/root/testdata/sf{sf}/conversations.parquet')")
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = q_chat.op7_chat_format(spark, f"/root/testdata/sf{sf}").select(*cols)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(q_chat.SQL).df()[cols].itertuples(index=False, name=None))


def test_no_python_in_the_plan(spark):
    plan = q_chat.op7_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
