"""Small inputs that the tests share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with extra columns whose names an operator may use for its own.
CLASHING = SCHEMA + ", score double, size long, key long, n_links long, e array<double>, dim int, start int, end int, target double, _rep long, _ranges string, component long, features string"
TEXTS = "/root/testdata/sf0.001/documents.parquet"


def frame(spark, rows, clashing=False):
    """rows: (doc_id, text, source)."""
    full = [(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows]
    if clashing:
        full = [(*r, 0.5, 3, 4, 5, [1.0], 1, 2, 3, 0.1, 7, "x", 8, "y") for r in full]
    return spark.createDataFrame(full, CLASHING if clashing else SCHEMA)


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [(1, None, "a"), (2, "", None), (3, "   \n\t ", "a"), (4, "one two", "b"), (5, "one two", "b"), (5, "one two", "b"), (None, "null id here", "c"), (None, None, None), (6, long, "a"), (7, long, None), (8, "é ☃ 😀 \x00 tail", "b")]


def random_words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
