import random
import re

import numpy as np
import pyarrow as pa

from emberscan.llm import textvec as tv

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_words_of_many_texts_and_pieces(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abC é\n\t\x0b中 ") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, "x" * 300]
    want = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] for t in texts]
    col = pa.array(texts)
    results = []
    for piece in (1 << 20, 64):
        monkeypatch.setattr(tv, "PIECE", piece)
        tv._powers.clear()
        h, at = tv.words(*tv.buffers(col))
        assert [int(b - a) for a, b in zip(at, at[1:])] == [len(w) for w in want]
        results.append(h)
    assert (results[0] == results[1]).all()
    flat = [w for ws in want for w in ws]
    seen = {}
    for w, x in zip(flat, results[0]):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_blocks():
    col = pa.array(["aa", None, "b c", ""]).slice(1, 3)
    data, off = tv.buffers(col)
    assert data.tobytes() == b"b c" and off.tolist() == [0, 0, 3, 3]
    parts = list(tv.blocks(data, off, 1))
    assert [(i, j) for i, j, _, _ in parts][-1][1] == 3 and sum(len(d) for _, _, d, _ in parts) == 3
    assert tv.spans(np.zeros(0, bool), np.zeros(1, np.int64))[0].size == 0
