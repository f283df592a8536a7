from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from doclathe.llm import repeats
from doclathe.llm.common import mixed, rolling, sliding_min
from doclathe.llm.phrase_dedup import phrase_dedup
from doclathe.llm.repeats import distinct_texts
from doclathe.llm.suffix_dedup import SuffixIndex, suffix_dedup, suffixes


def brute(seqs, length):
    """For each sequence: which tokens are in a window that starts more than once anywhere."""
    n = Counter(tuple(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        m = np.zeros(len(s), bool)
        for i in range(len(s) - length + 1):
            if n[tuple(s[i : i + length])] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


def some_texts(seed, n=40):
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "Dd", "é", "漢", "x1"]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]
    shared = [" ".join(rng.choices(words, k=25)) for _ in range(4)]
    out = []
    for i, t in enumerate(base):
        if rng.random() < 0.5:
            p = rng.choice(shared)
            t = t + rng.choice([" ", "\n", "  "]) + p[rng.randint(0, 5) :] + " " + rng.choice(base)
        out.append((i, t))
    return out + [(n, base[0]), (n + 1, base[1]), (n + 1, base[1]), (n + 2, "ab" * 200), (n + 3, "z " * 90), (n + 4, None), (n + 5, "")]


@pytest.mark.parametrize(("seed", "hot"), [(1, 2048), (2, 3)])
def test_suffix_dedup_equals_brute_force(docs_of, seed, hot):
    rows = some_texts(seed)
    out = sorted(map(tuple, suffix_dedup(docs_of(rows), 24, 8, 3, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()))
    data = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), b, m in zip(rows, data, brute(data, 24)):
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        want.append((i, len(b), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest(), bytearray(kept)))
    assert out == sorted(want)
    assert sum(x[2] for x in want) > 500


@pytest.mark.parametrize(("seed", "shard"), [(3, 20_000), (4, 1)])
def test_phrase_dedup_equals_brute_force(docs_of, seed, shard):
    rows = some_texts(seed)
    out = sorted(map(tuple, phrase_dedup(docs_of(rows), 9, 3, shard=shard).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()))
    words = [(t or "").encode().split() for _, t in rows]
    want = []
    for (i, _), w, m in zip(rows, words, brute(words, 9)):
        kept = b" ".join(x for x, gone in zip(w, m) if not gone)
        want.append((i, len(w), int(m.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
    assert out == sorted(want)
    assert sum(x[2] for x in want) > 100


def test_batches_meet_all_earlier_ones(spark, docs_of, tmp_path):
    """Batches added one at a time, with the index saved and opened in between, equal one run over all rows."""
    rows = some_texts(7)
    docs = [docs_of(rows[i::3]) for i in range(3)]
    index = SuffixIndex(spark, 24, 8)
    for i, d in enumerate(docs):
        index.add(d)
        index.save(str(tmp_path / "index"))
        index = SuffixIndex.open(spark, str(tmp_path / "index"))
        assert [n for n, _ in index.family.levels] == [[1], [2], [2, 1]][i]
        sofar = docs[0] if i == 0 else sofar.unionByName(d)  # noqa: F821
        got = sorted(map(tuple, index.result(sofar).select("doc_id", "n_removed", "kept_sha256").collect()))
        want = sorted(map(tuple, suffix_dedup(sofar, 24, 8).select("doc_id", "n_removed", "kept_sha256").collect()))
        assert got == want
    for _, level in index.family.levels:
        heads = [bytes(r[0]) for r in level.select("prefix").collect()]
        assert len(heads) == len(set(heads)) > 0
    index.dropped()


def test_levels_meet_without_a_shuffle(docs_of):
    index = SuffixIndex(docs_of([]).sparkSession, 24, 8)
    for d in (docs_of(some_texts(8)), docs_of(some_texts(9))):
        new = index.family._array(suffixes(distinct_texts(d), 24, 8))
        index.family.levels.append((1, new))
    (_, a), (_, b) = index.family.levels
    plan = a.join(b.hint("merge"), "prefix", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_odd_texts(docs_of, odd_texts):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in suffix_dedup(docs_of(odd_texts)).select("doc_id", "n_bytes", "n_removed").collect()), key=key)
    size = {i: len((t or "").encode()) for i, t in odd_texts}
    assert [r[:2] for r in got if r[0]] == sorted((i, size[i]) for i, _ in odd_texts if i)
    gone = {r[0]: r[2] for r in got}
    assert gone[1] == gone[2] == gone[4] == gone[8] == 0
    assert gone[5] == size[5] and gone[7] == 5000 and gone[6] >= size[5]
    words = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in phrase_dedup(docs_of(odd_texts)).collect()}
    assert words[5] == (30_000, 30_000) and words[3] == words[1] == (0, 0) and words[4] == (4, 0)
    empty = docs_of(odd_texts).limit(0)
    assert suffix_dedup(empty).count() == phrase_dedup(empty).count() == 0


def test_rolling_hashes_depend_on_content_alone():
    rng = np.random.default_rng(0)
    x = mixed(rng.integers(0, 3, 500).astype(np.uint64))
    for k in (1, 2, 7, 35, 400):
        h = rolling(x, k)
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(x[i : i + k].tobytes(), h[i]) == h[i]
        assert len(set(h.tolist())) == len(seen)
    assert len(rolling(x, 501)) == 0
    for w in (1, 5, 8):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_long_sequences_are_cut_into_parts(monkeypatch):
    monkeypatch.setattr(repeats, "POSITION", 6)
    monkeypatch.setattr(repeats, "LOW", np.uint64(63))
    x = np.tile(mixed(np.arange(100, dtype=np.uint64)), 4)
    head, place, first, last = repeats.anchors(x, 12, 4)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert covered.tolist() == list(range(len(x) - 11))
    h = rolling(x, 4)
    assert all(h[p] == t and a >= p - 8 and b <= p for t, p, a, b in zip(head, place, first, last) for a, b in [(a, b)] if b <= p)
