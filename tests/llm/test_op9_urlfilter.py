import random

import duckdb

from emberscan.llm import q_urlfilter, urlfilter
from emberscan.llm.urlfilter import Index, index_files, judge_urls, split_url

RULES = q_urlfilter.RULES


def brute(url, rules, default="allow"):
    host, path = split_url(url)
    fits = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])))
    return host, path, best[0] + best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "http://com/en/", "http://x.com?/en/",
    "http://m.example.net/de/81", "http://m.example.net/de/9", "ftp://a.org#/es/", "http://a.org/es/1", "http://notexample.com/en/7", "http://é.com/en/1", "http://a://b.com/en/x",
    "http://a.com:80/en/1", "http://example.com/en/7", "http://example.com/en/7",
]


def test_against_brute_force(spark):
    rng = random.Random(2)
    urls = URLS + [f"http://{rng.choice(['', 'm.', 'a.b.'])}{rng.choice(['example', 'x'])}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randrange(99)}" for _ in range(300)]
    rows = [(i, u, "clash", "clash") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, RULES).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}
    assert judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in judge_urls(df.limit(3), [], default="block").collect()} == {"block"}


def index(folder, rules, shard_bytes=1 << 20):
    paths = []
    for k, content in enumerate(index_files(rules, shard_bytes)):
        paths.append(str(folder / f"i{shard_bytes}-{k}"))
        (folder / f"i{shard_bytes}-{k}").write_bytes(content)
    return Index(paths)


def test_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: 7)
    got = index(tmp_path, RULES)
    for u in URLS:
        host, path, rule, verdict = brute(u, RULES)
        assert got.judge([(host, path)]) == [(rule, verdict if rule else None)]


def test_same_rule_twice_blocks(tmp_path):
    got = index(tmp_path, [("a.com", "/x", "block"), ("A.com", "/x", "allow")])
    assert got.judge([("a.com", "/xy")]) == [("a.com/x", "block")]


def test_any_number_of_files_gives_the_same(tmp_path):
    rules = [(f"h{i % 50}.com", f"/p{i}", "block" if i % 3 else "allow") for i in range(500)]
    parts = [(f"m.h{i % 60}.com", f"/p{i % 700}x") for i in range(1000)]
    one, many = index(tmp_path, rules), index(tmp_path, rules, 300)
    assert len(many.shards) > 10
    assert one.judge(parts) == many.judge(parts) == [b[2:] if b[2] else (None, None) for b in (brute(f"x://{h}{p}", rules) for h, p in parts)]


def test_host_and_path_are_kept_apart(spark, tmp_path):
    rules = [("exa", "mple.com", "block"), ("other.org", "", "block"), ("b.com", "/a", "allow")]
    urls = ["http://example.com/", "http://other.org", "http://b.com/abc", "http://x/b.com/a", "http://" + "a." * 3000 + "b.com/" + "a" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)} and got[0][2] is None


def test_the_same_rules_are_shared_once(spark):
    before = len(spark.sparkContext.listFiles)
    df = spark.createDataFrame([(1, "http://q.com/a")], "page_id long, url string")
    for _ in range(3):
        assert judge_urls(df, [("q.com", "/a", "block")]).first().verdict == "block"
    assert len(spark.sparkContext.listFiles) <= before + 1


def test_sql(spark):
    con = duckdb.connect()
    con.execute("create view pages as select * from read_parquet('/root/testdata/sf0.001/pages.parquet')")
    got = q_urlfilter.op9_url_filter(spark, "/root/testdata/sf0.001")
    want = con.execute(q_urlfilter.SQL).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()))) == sorted(map(str, want))
