import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.tokens import PrefixCounter, prefix_counts, token_counts

from .data import TEXTS, frame, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "the", " ", "  ", "\n", " \n", "'", "'re", "'s", "é", "ß", "1", "23", "!", "!!", " don't", "<|endoftext|>", "<|endo", "\t", "\x85", "\xa0", "²", "½", "\x1c", "ing", "tion", "日", "本", "☃", "😀", "_", "XX", "aaaa", 'token = "04dbe']


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_prefix_is_what_the_library_counts(library):
    rng, counter = random.Random(1), PrefixCounter(PATH)
    for _ in range(500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert list(counter.every_prefix(text)) == want
        limit = rng.randint(0, 20)
        n, fit = counter.count(text, limit)
        assert n == want[-1]
        if n > limit:
            assert fit == max(i for i, c in enumerate(want) if c <= limit)


def test_whole_table(spark, library):
    docs = spark.read.parquet(TEXTS)
    got = {r.doc_id: r for r in token_counts(docs, PATH, 1024).collect()}
    for r in docs.collect():
        text = r.text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        g = got[r.doc_id]
        assert (g.n_bytes, g.n_tokens, g.over_limit) == (len(text.encode()), n, n > 1024)


def test_odd_rows(spark, library):
    rows = odd_rows()
    got = token_counts(frame(spark, rows, clashing=True), PATH, 10).collect()
    want = sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == want
    assert token_counts(frame(spark, []), PATH).count() == 0
    counts = prefix_counts(frame(spark, rows[:5]), PATH).collect()
    assert [len(r.counts) for r in counts] == [len(t or "") + 1 for _, t, _ in rows[:5]]
