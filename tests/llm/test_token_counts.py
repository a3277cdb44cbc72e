import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tecflow.llm import token_counts as tc


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tc.VOCABULARY))


def texts(n):
    rng = random.Random(1)
    bits = ["the", " and", "'s", "'re", "'", " ", "  ", "\n", "\t", "12", " 7", "é", "ß", "日本", "😀", "!!", "...", "tion", "ing", "X", "<|endoftext|>", "<|endof", " ", "á", "\r\n", "Don't", "l'eau"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library(library):
    c = tc.counter(public_tokenizers.path(tc.VOCABULARY))
    for t in texts(3000):
        assert c.count(t) == len(library.encode(t, add_special_tokens=False).ids), t


def test_every_prefix_equals_the_library(library):
    c = tc.counter(public_tokenizers.path(tc.VOCABULARY))
    for t in texts(300):
        want = [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
        assert c.at_prefixes(t).tolist() == want, t


def test_long_texts_are_cut_where_words_end(library, monkeypatch):
    monkeypatch.setattr(tc, "PIECE", 40)
    c = tc.counter(public_tokenizers.path(tc.VOCABULARY))
    t = "Ça va  bien. " * 30 + " " * 100 + "x" * 300
    assert c.count(t) == len(library.encode(t).ids)


def test_operator_and_budgets(spark, library):
    rows = [(1, "Hello there, world"), (2, None), (3, ""), (None, "a b"), (1, "Hello there, world")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = tc.token_counts(docs).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "").ids)) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    stored = tc.prefix_counts(docs.where("doc_id = 1").limit(1))
    from pyspark.sql import functions as F

    r = stored.select(tc.tokens_of_prefix(F.col("counts"), F.lit(11)).alias("n"), tc.fitting_prefix(F.col("counts"), 2).alias("k")).first()
    assert r.n == len(library.encode("Hello there").ids) and r.k == len("Hello there")
    assert tc.token_counts(docs.limit(0)).count() == 0
