from __future__ import annotations

import hashlib
import importlib
import os
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from doclathe.llm.bpe import ByteBpe, bpe_encode, chunks, piece_starts, pieces, scan, stitch

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    BPE = ByteBpe.of(f.read(), public_tokenizers.PATTERN)
SF = "/root/testdata/sf0.001"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab  \n\té1!'s漢😀’", max_size=300), st.sampled_from([(4, 2), (8, 4), (20, 30)]))
def test_stitched_chunks_encode_like_the_whole_text(text, sizes):
    scans = [(at, *scan(BPE, at, p, len(text), *sizes)) for at, p in chunks(text, *sizes)]
    ids = [i for p in pieces(text, stitch(scans)) for i in BPE.encode(p)]
    assert ids == BPE.encode(text)
    assert BPE.decode(ids) == text.encode()


def test_piece_starts_equal_stitch(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(40):
        text = "".join(rng.choices(["ab", " ", "\n", "1", "x" * 30], [9, 9, 2, 3, i % 3], k=rng.randint(1, 150)))
        scans = [(at, *scan(BPE, at, p, len(text), 20, 8)) for at, p in chunks(text, 20, 8)]
        rows += [(i, at, h, t) for at, h, t in scans]
        want[i] = stitch(scans)
    got = piece_starts(spark.createDataFrame(rows, "_row long, at long, head array<long>, tail array<long>")).collect()
    assert {i: sorted({r["begin"] for r in got if r["_row"] == i and (r["no"] == 0 or r["begin"])}) for i in want} == want
    assert min(map(len, want.values())) == 1 and max(map(len, want.values())) > 5


def test_long_pre_tokens_at_production_sizes(docs_of):
    rows = [(1, "word " * 9000 + "y" * 70_000 + " word" * 9000), (2, "z" * 100_000), (3, "ab cd\n" * 15_000)]
    out = bpe_encode(docs_of(rows), PATH, public_tokenizers.PATTERN, with_ids=False).collect()
    want = {i: hashlib.sha256(",".join(map(str, BPE.own.encode_ordinary(t))).encode()).hexdigest() for i, t in rows}
    assert {r["doc_id"]: r["ids_sha256"] for r in out} == want


def test_rows(docs_of, odd_texts):
    rng = random.Random(0)
    # Pre-tokens of more than an overlap, of several chunks, and between texts that are in step.
    runs = ["x" * 1700 + " and then some words " * 60, "some words " * 90 + "é" * 130 + " more of them" * 90 + " " * 700 + "end", "1" * 2500]
    rows = [*odd_texts, (30, "<|endoftext|> is text"), (31, "".join(rng.choices("ab  \né1!", k=3000))), *((40 + i, t) for i, t in enumerate(runs))]
    out = bpe_encode(docs_of(rows), PATH, public_tokenizers.PATTERN, chunk=500, overlap=50).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out]
    want = []
    for i, t in rows:
        ids = BPE.own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(len(r["ids"]) == r["n_tokens"] for r in out)
    assert bpe_encode(docs_of([]), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_pipeline_equals_its_operators(spark):
    """Each stage against what its operator says about the stage's own input."""
    import corpus_pipeline as p
    from doclathe.llm.common import stored
    from doclathe.llm.decontaminate import decontamination
    from doclathe.llm.line_dedup import line_dedup
    from doclathe.llm.simhash import simhash_dedup
    from doclathe.llm.toxicity import fitted, scorer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    model = fitted(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = ids(docs.where(scorer(docs, model) < 0.5))
    a = stored(p.drop_toxic(spark, docs, SF), "a")
    assert ids(a) == want and a.columns == docs.columns
    b = stored(p.dedup_lines(spark, a, SF), "b")
    assert b.columns == docs.columns
    assert sorted((r["doc_id"], r["kept_text"]) for r in line_dedup(a).collect()) == sorted((r["doc_id"], r["text"]) for r in b.collect())
    c = stored(p.drop_near_copies(spark, b, SF), "c")
    assert ids(c) == ids(simhash_dedup(b).where("doc_id = component_id"))
    leaks = {r["doc_id"] for r in decontamination(c, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    d = stored(p.drop_contaminated(spark, c, SF), "d")
    assert ids(d) == sorted(set(ids(c)) - leaks) and d.columns == docs.columns
    e = {r["doc_id"]: r for r in p.encode(spark, d, SF).collect()}
    assert {i: r["decoded_sha256"] for i, r in e.items()} == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in d.collect()}
    assert sorted(e) == ids(p.run(spark, SF))


def test_pipeline_stages():
    p = importlib.import_module("corpus_pipeline")
    assert [k for k, _ in p.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages_take_odd_rows(spark, docs_of, odd_texts):
    import corpus_pipeline as p

    for rows in (odd_texts, []):
        docs = docs_of(rows)
        for name, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == docs_of([]).columns, name
        assert p.encode(spark, docs, SF).count() == docs.count()
