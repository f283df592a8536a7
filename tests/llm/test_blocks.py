from __future__ import annotations

import random

import pytest

from doclathe.llm import repeats
from doclathe.llm.common import rolling
from doclathe.llm.phrase_dedup import hashed_words, phrase_dedup
from doclathe.llm.suffix_dedup import byte_tokens, suffix_dedup

from test_repeats import brute, some_texts


@pytest.fixture
def one_partition(spark):
    """All groups of a side meet in one call of the kernel."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def least_of(options, tokens_of, k):
    """The option of the least hash: it is the anchor of nearly every window that has it."""
    return min(options, key=lambda t: int(rolling(tokens_of(t.encode()), k)[0]))


def test_phrase_in_many_texts_cuts_nothing_unique(docs_of, one_partition):
    common = least_of([f"aa{i} bb{i} cc{i}" for i in range(400)], lambda t: hashed_words(t.split()), 3)
    rows = [(i, " ".join([*(f"l{i}x{j}" for j in range(8)), common, *(f"r{i}x{j}" for j in range(8))])) for i in range(repeats.HOT + 400)]
    out = phrase_dedup(docs_of(rows), 9, 3).where("n_removed > 0").count()
    assert out == 0


@pytest.mark.parametrize("hot", [1, 3, 10])
def test_hot_phrases_equal_brute_force(docs_of, one_partition, hot):
    rows = some_texts(5, 60)
    out = sorted(map(tuple, phrase_dedup(docs_of(rows), 9, 3, hot=hot).select("doc_id", "n_removed").collect()))
    words = [(t or "").encode().split() for _, t in rows]
    assert out == sorted((i, int(m.sum())) for (i, _), m in zip(rows, brute(words, 9)))


def test_head_in_many_texts_cuts_nothing_unique(docs_of, one_partition):
    rng = random.Random(0)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
    common = least_of([text(8) for _ in range(400)], byte_tokens, 8)
    rows = [(i, text(40) + common + text(40)) for i in range(repeats.HOT + 400)]
    assert suffix_dedup(docs_of(rows), 24, 8).where("n_removed > 0").count() == 0


@pytest.mark.parametrize("hot", [1, 3, 10])
def test_hot_heads_equal_brute_force(docs_of, one_partition, hot):
    rows = some_texts(6, 60)
    out = sorted(map(tuple, suffix_dedup(docs_of(rows), 24, 8, 3, hot=hot).select("doc_id", "n_removed").collect()))
    data = [(t or "").encode() for _, t in rows]
    assert out == sorted((i, int(m.sum())) for (i, _), m in zip(rows, brute(data, 24)))
