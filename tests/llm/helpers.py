"""Small document tables with every awkward case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], schema)


def awkward(spark, texts=()):
    """Null text and id, empty and blank texts, repeated rows, a long text; then ``texts``."""
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "  \n\t ", None), (4, "one two three four five", "en"),
        (4, "one two three four five", "en"), (None, "a text without an id, long enough", "en"), (5, "word " * 40_000, "en"),
        *[(100 + i, t, "en") for i, t in enumerate(texts)],
    ]
    return docs(spark, rows)


def words(rng: random.Random, n: int, vocabulary: int = 5000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
