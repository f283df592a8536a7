from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, k1 long, k2 long, _row long, copies long, keeper string, label string, _own_text double, _kept_id long, _score double, _x long, item_id string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with columns whose names clash with those that operators use inside."""

    def make(pairs):
        return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, 4, 5, "k", None, 42.0, 7, 42.0, 8, "i") for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated and very long texts, repeated and null ids."""
    long = " ".join(f"w{i % 977}é" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "One line\nof text"), (4, "One line\nof text"), (5, long), (6, long + " end"), (None, "One line\nof text"), (None, None), (7, "a" * 5000), (8, "\x00 \x1c odd signs 😀")]
