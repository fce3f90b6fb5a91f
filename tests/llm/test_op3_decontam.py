import random

from helpers import awkward, docs, words

from emberscan.llm import decontam as D


def bench(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def found(df, items):
    return {(r.doc_id, r.item_id): r.kind for r in D.contaminated(df, items).collect()}


ITEM = "Anna has 12 apples and gives 3 kg of pears to Bertram before Anna walks 1,500 m to the old market with 2.5 euros left"


def test_copies_changes_and_reparameterised(spark):
    rng = random.Random(1)
    pad = lambda: " ".join(words(rng, 50))
    other = ITEM.replace("Anna", "Clara").replace("Bertram", "Dora").replace("12", "77").replace("3 kg", "9 lb").replace("1,500", "8")
    mixed = ITEM.replace("Anna walks", "Emil walks")
    rows = [
        (1, f"{pad()} {ITEM} {pad()}"), (2, f"{pad()}\n{other}\n{pad()}"), (3, f"{pad()} {ITEM.upper()} {pad()}"), (4, f"{pad()} {ITEM.lower()}"),
        (5, pad()), (6, "Anna has 12 apples and gives 3 kg of"), (7, " ".join(ITEM.split()[::-1])), (8, mixed), (9, ITEM.replace("old market", "new and big market")),
    ]
    got = found(docs(spark, [(i, t, "en") for i, t in rows]), bench(spark, [ITEM, " ".join(words(rng, 30))]))
    assert got[(1, 0)] == "exact" and got[(2, 0)] == "reparameterised" and {3, 4, 9} <= {d for d, _ in got}
    assert not {5, 6, 7} & {d for d, _ in got}


def test_inconsistent_slots_are_no_copy(spark):
    item = "When Anna meets Bob the day is good and when Anna leaves Bob the day is bad"
    same = item.replace("Anna", "Carl").replace("Bob", "Dina")
    torn = "When Carl meets Bob the day is good and when Dina leaves Emma the day is bad"
    got = found(docs(spark, [(1, same, "en"), (2, torn, "en")]), bench(spark, [item]))
    assert got == {(1, 0): "reparameterised"}


def test_brute_force_on_planted_passages(spark):
    rng = random.Random(2)
    items = [" ".join(words(rng, rng.randrange(3, 60))) for _ in range(30)]
    rows, want = [], set()
    for i in range(200):
        parts = words(rng, rng.randrange(200))
        for k in rng.sample(range(30), rng.randrange(3)):
            at = rng.randrange(len(parts) + 1)
            parts.insert(at, items[k])
            want.add((i, k))
        rows.append((i, " ".join(parts), "en"))
    text = {i: f" {t} " for i, t, _ in rows}
    want = {(i, k) for i in text for k in range(30) if f" {items[k]} " in text[i]}
    got = set(found(docs(spark, rows).repartition(4), bench(spark, items)))
    assert want <= got and got - want == set()


def test_short_items_and_awkward_rows(spark):
    items = bench(spark, [None, "", "two words", "one two three", "word word word word"])
    df = awkward(spark, ["zero one two three four", "one two", "1 2 3"])
    got = found(df.selectExpr("*", "1 as h", "2 as item_id", "3 as kind"), items)
    assert set(got) == {(4, 3), (100, 3), (5, 4)}
    assert found(df.limit(0), items) == {} and found(df, items.limit(0)) == {}
    kept = D.drop_contaminated(df.selectExpr("*", "1 as item_id"), items)
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 2, 3, None, 101, 102], key=str) and kept.columns == [*df.columns, "item_id"]


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    assert found(docs(spark, [(1, ITEM, "en")]), bench(spark, [ITEM, ITEM])) == {(1, 0): "exact", (1, 1): "exact"}


def test_short_number_dense_and_slot_dense_items(spark):
    rng = random.Random(3)
    pad = lambda: " ".join(words(rng, 30))
    items = ["What is 12 plus 7?", "12 15 18 21 24 27 30 33 36 39 42 45 48 51 54", "Tom has 3 apples, Ann has 5 pears. Total?", "Paris: 12 January"]
    rows = [
        *[(k, f"{pad()} {t} {pad()}") for k, t in enumerate(items)],
        (10, f"{pad()} What is 31 plus 4? {pad()}"), (12, f"{pad()} Eva has 8 apples, Udo has 9 pears. Total? {pad()}"),
        (20, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20"), (21, "London: 14 March"), (22, "Tom has 3 apples"), (23, "Ulm is 12"),
    ]
    got = found(docs(spark, [(i, t, "en") for i, t in rows]), bench(spark, items))
    assert got == {**{(k, k): "exact" for k in range(4)}, (10, 0): "reparameterised", (12, 2): "reparameterised"}


def test_one_torn_slot_leaves_the_rest_of_a_copy(spark):
    rng = random.Random(4)
    w = words(rng, 40, 26)
    w = ["".join(chr(97 + int(c)) for c in x[1:]) + "x" for x in w]
    w[2] = w[37] = "Anna"
    w[20] = "Anna"
    item, torn = " ".join(w), " ".join([*w[:37], "Emil", *w[38:]])
    two = [*w[:20], "oak", *w[21:]]  # Anna twice: once each, a draw
    other = " ".join([*two[:2], "Clara", *two[3:37], "Emil", *two[38:]])
    most = " ".join([*w[:2], "Clara", *w[3:20], "Clara", *w[21:37], "Emil", *w[38:]])
    d = docs(spark, [(1, torn, "en"), (2, other, "en"), (3, most, "en")])
    got = {(r.doc_id, r.item_id): (r.covered, r.kind) for r in D.contaminated(d, bench(spark, [item, " ".join(two)])).collect()}
    assert got[(1, 0)] == (37, "exact") and got[(2, 1)] == (34, "exact") and got[(3, 0)] == (37, "reparameterised")


def test_scripts_without_spaces_and_unicode_punctuation(spark):
    items = ["小明有三个苹果，他又买了五个，现在一共有多少个？", "ขวดนี้มีน้ำกี่ลิตรครับ", "the old man said hello to the young sailor", "りんごが12個あります"]
    rows = [
        (0, "今天天气很好。小明有三个苹果，他又买了五个，现在一共有多少个？我们去公园。"), (1, "สวัสดีขวดนี้มีน้ำกี่ลิตรครับขอบคุณ"),
        (2, "and so “the old man said hello”—to the young sailor… again"), (3, "箱にりんごが12個あります。"), (4, "今天天气很好，我们去公园散步，然后回家吃饭。"), (5, "😀 𠀀𠀁 é"),
    ]
    got = found(docs(spark, [(i, t, "xx") for i, t in rows]), bench(spark, items))
    assert got == {(k, k): "exact" for k in range(4)}
    data, offsets = D.tv.buffers(D.pa.array(["a—b “c” l’été 你好ab 12個", "𠀀𠀁x", ""]))
    s, e = D.word_spans(data, offsets)
    assert [data[i:j].tobytes().decode() for i, j in zip(s, e)] == ["a", "b", "c", "l", "été", "你", "好", "ab", "12", "個", "𠀀", "𠀁", "x"]


def test_two_values_of_the_item_are_not_one_of_the_document(spark):
    item = "a box with 12 red balls next to a box with 15 red balls stands on the table"
    both = item.replace("12", "7").replace("15", "7")
    fair = item.replace("12", "7").replace("15", "9")
    got = found(docs(spark, [(1, both, "en"), (2, fair, "en"), (3, item, "en")]), bench(spark, [item]))
    assert got.get((2, 0)) == "reparameterised" and got.get((3, 0)) == "exact" and (1, 0) not in got


def test_one_changed_number_of_a_long_copy(spark):
    rng = random.Random(12)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(34)]
    w = [*plain[:10], "12", *plain[10:30], "12", *plain[30:]]
    torn = [*w[:31], "13", *w[32:]]
    assert found(docs(spark, [(1, " ".join(torn), "en")]), bench(spark, [" ".join(w)])) == {(1, 0): "exact"}


def brute_templates(doc, item):
    """Item words under windows that equal the document's as templates, slots consistent both ways over one diagonal; words given as (kind, value)."""
    code = lambda w: [v if k == "w" else k for k, v in w]
    size = min(D.WINDOW, len(item))
    best = 0
    for shift in range(-len(item), len(doc)):
        at = [i for i in range(len(item) - size + 1) if 0 <= i + shift <= len(doc) - size and code(item[i : i + size]) == code(doc[i + shift : i + shift + size])]
        cover = {x for i in at for x in range(i, i + size)}
        pairs = {(item[x], doc[x + shift]) for x in cover if item[x][0] != "w"}
        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            best = max(best, len(cover))
    return best


def test_brute_force_over_templates(spark):
    rng = random.Random(13)
    word = lambda: ("w", "".join(rng.choice("abcde") for _ in range(5)))
    slot = lambda: rng.choice([("num", str(rng.randrange(100, 999))), ("name", "".join(["Z", *(rng.choice("xyz") for _ in range(4))]))])
    items = [[slot() if rng.random() < 0.2 else word() for _ in range(rng.randrange(10, 30))] for _ in range(15)]
    rows, want = [], {}
    for i in range(120):
        k = rng.randrange(15)
        change = {x: ((x[0], str(rng.randrange(1000, 99999))) if x[0] == "num" else ("name", "Q" + x[1][1:] + rng.choice("xyz"))) for x in items[k] if x[0] != "w"}
        if len(set(change.values())) < len(change):
            continue
        cut = items[k][: rng.randrange(5, len(items[k]) + 1)]
        part = [change.get(x, x) for x in cut] if i % 2 else cut
        doc = [word() for _ in range(10)] + part + [word() for _ in range(10)]
        rows.append((i, " ".join(v for _, v in doc), "en"))
        for n, item in enumerate(items):
            covered = brute_templates(doc, item)
            if covered >= D.ENOUGH or 2 * covered >= len(item):
                want[(i, n)] = covered
    text = [" ".join(v for _, v in x) for x in items]
    got = {(r.doc_id, r.item_id): r.covered for r in D.contaminated(docs(spark, rows).repartition(3), bench(spark, text)).collect()}
    assert got == want and len(want) > 40
