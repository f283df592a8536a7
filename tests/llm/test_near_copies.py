from __future__ import annotations

import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from doclathe.llm import links
from doclathe.llm.embedding_dedup import embedding_dedup
from doclathe.llm.links import components, local_roots
from doclathe.llm.simhash import fingerprint, fingerprint_links, masks, one_of_each, simhash_dedup


def slow_fingerprint(text):
    w = [x for x in text.encode().lower().split()]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(spark):
    rng = random.Random(0)
    for n in (0, 1, 3, 4, 5, 300):
        t = " ".join(rng.choices(["Ab", "c", "É", "dd,"], k=n))
        assert fingerprint(t.encode()) == slow_fingerprint(t)
    assert fingerprint("É".encode()) != fingerprint("é".encode())  # only A-Z are lower-cased
    jvm = spark.sql("select xxhash64('a b c d') as h").first()["h"]
    assert fingerprint(b"A b  c\nd") == jvm % (1 << 64)


def test_masks_cover_all_pairs_within_the_radius():
    rng = random.Random(1)
    for r in (1, 4):
        family = [m % (1 << 64) for m in masks(r)]
        assert len(family) == 2 ** (r + 1) - 1
        for _ in range(3000):
            d = sum(1 << b for b in rng.sample(range(64), r))
            assert any(not d & m for m in family)


@pytest.mark.parametrize("block", [2048, 4])
def test_links_equal_brute_force(spark, monkeypatch, block):
    rng = random.Random(2)
    x = [rng.getrandbits(64) for _ in range(60)]
    for c in list(x[:20]):
        for _ in range(rng.randint(1, 9)):
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
            x.append(c)
    x = sorted(set(x))
    monkeypatch.setattr(links.block_pairs, "__defaults__", (block,))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in x], "fp long")
    got = {r["id"]: r["component"] for r in components(fingerprint_links(df)).collect()}
    a, b = zip(*[(i, j) for i in range(len(x)) for j in range(i) if (x[i] ^ x[j]).bit_count() <= 4])
    root = local_roots(np.array(a), np.array(b), len(x))
    groups: dict[int, set] = {}
    for i, v in enumerate(x):
        groups.setdefault(int(root[i]), set()).add(signed(v))
    want = {v: min(g) for g in groups.values() if len(g) > 1 for v in g}
    assert got == want


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert got == dict.fromkeys(range(n), 0) | {1000: 1000, 1001: 1000}
    assert components(df.limit(0)).count() == 0


def test_simhash_of_odd_texts(docs_of, odd_texts):
    out = simhash_dedup(docs_of(odd_texts)).collect()
    assert len(out) == len(odd_texts)
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out}
    assert by[1] == by[2] == by[3] == ("0" * 16, 1)
    assert by[4][1] == 4 and by[5][1] == by[6][1] == 5
    assert simhash_dedup(docs_of(odd_texts).limit(0)).count() == 0
    kept = one_of_each(docs_of(odd_texts))
    assert kept.columns == docs_of([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 7, 8]


def vectors(seed=0, n=300, d=32):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, d))
    rows = []
    for i in range(n):
        v = base[rng.integers(60)] + rng.normal(0, 0.12, d)
        rows.append((i, [float(np.float32(a)) for a in v], int(rng.integers(2)), "extra"))
    return rows + [(n, None, 1, ""), (n + 1, [], 1, ""), (n + 2, [0.0] * d, 1, ""), (n + 3, [1.0] * (d - 1) + [None], 1, ""), (n + 4, [float("nan")] * d, 1, ""), (n + 5, rows[0][1], None, ""), (None, rows[1][1], rows[1][2], ""), (7, rows[7][1], rows[7][2], ""), (n + 6, [1.0, 2.0], 1, ""), (n + 7, [2.0, 4.0], 1, "")]


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    from doclathe.llm import embedding_dedup as m

    monkeypatch.setattr(m, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, _row string")
    out = embedding_dedup(df).collect()
    good = [i for i, r in enumerate(rows) if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    a, b = [], []
    for i in good:
        for j in good:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    a.append(i)
                    b.append(j)
    n = np.bincount(np.array(a + b), minlength=len(rows))
    root = local_roots(np.array(a), np.array(b), len(rows))
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], 1 << 60), r[0])
    want = [(r[0], int(n[i]), least.get(root[i])) for i, r in enumerate(rows)]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in out]
    # At most a tenth of the links may be missed, and none may be added.
    assert sum(x[1] for x in got) >= 0.9 * n.sum() and len(a) > 100
    assert sorted(got, key=key) == sorted(want, key=key)
    assert embedding_dedup(df.limit(0)).count() == 0
    assert embedding_dedup(df.where(F.col("vec_id") == 300)).first()["kept"]


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_recall_on_real_tables(spark):
    """Every pair found by brute force is retrieved through the tables, and no other."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.toPandas()
    x = np.stack(rows["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = np.zeros(len(rows), int)
    for label in rows["label"].unique():
        at = np.flatnonzero(rows["label"] == label)
        n[at] = (x[at] @ x[at].T >= 0.98).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup(df).collect()}
    found = np.array([got[i] for i in rows["vec_id"]])
    assert (found <= n).all() and found.sum() >= 0.99 * n.sum()


def test_plans_follow_the_number_of_vectors():
    from doclathe.llm.embedding_dedup import Plan

    widths = [Plan.of(n, 64, 0.98).width for n in (1, 1000, 5600, 10**6, 10**9)]
    assert widths == sorted(widths) and widths[0] == 8 and widths[-1] == 24
    for n in (1, 5600, 10**9):
        p = Plan.of(n, 64, 0.98)
        same = (1 - np.arccos(0.98) / np.pi) ** p.width
        assert (1 - same) ** p.tables <= 1e-4 and p.rotations * p.each >= p.tables
    assert Plan.of(100, 3, 0.98).bits == 3
