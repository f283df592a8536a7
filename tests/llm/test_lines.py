from __future__ import annotations

import random

import numpy as np
import pytest

from doclathe.llm.line_dedup import CuckooFilter, LineIndex, line_dedup
from doclathe.llm.queries import OP10_SQL

LONG = "this line is long enough to count as a key, é"


def brute(rows, least=40, docs=5):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held: dict = {}
    for r, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                held.setdefault(k, {})[r] = i
    out = []
    for i, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            h = held.get(key(x), {})
            top = max((v for v in h.values() if v is not None), default=None)
            if len(h) < docs or i == top:
                kept.append(x)
        out.append((i, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), "\n".join(kept)))
    return out


def some_rows():
    rng = random.Random(0)
    lines = [f"{LONG} {i}" for i in range(6)] + ["short", "", LONG.upper(), "  " + LONG + "\t", "x" * 39, "x" * 40, "é" * 39, "é" * 40]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)))) for i in range(40)]
    return rows + [(None, LONG), (None, None), (3, LONG), (39, LONG), (50, "")]


@pytest.mark.parametrize(("carried", "sieve"), [(200_000, 1 << 20), (0, 1 << 20), (0, 0)])
def test_line_dedup_equals_brute_force(docs_of, carried, sieve):
    rows = some_rows()
    out = line_dedup(docs_of(rows), broadcast_rows=carried, sieve_bytes=sieve, also=("keeper", "_row"))
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()]
    key = lambda t: tuple((x is None, x if x is not None else 0) for x in t)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert sum(x[2] for x in got) > 20
    assert {(r["in_keeper"], r["in__row"]) for r in out.collect()} == {("k", 4)}


def test_odd_texts_and_empty_tables(docs_of, odd_texts):
    out = line_dedup(docs_of(odd_texts)).collect()
    assert len(out) == len(odd_texts) and all(r["n_dropped"] == 0 for r in out)
    assert line_dedup(docs_of([])).count() == 0


def filter_cells(index):
    """What each shard's filter holds, wherever in its two buckets it is."""
    out = {}
    for r in index.filters.collect():
        f = CuckooFilter.load(r["data"])
        out[r["shard"]] = f.n, sorted((v, min(i // 4, i // 4 ^ f._jump(v, m)), m) for m, cells in f.parts for i, v in enumerate(cells) if v)
    return {k: v for k, v in out.items() if v[0]}


def test_index_is_reversible(docs_of, spark):
    """Deletion undoes insertion in postings, counts, filters and output; insertion equals a new index."""
    docs = docs_of(some_rows()[:40])
    new = docs_of([(100 + i, LONG + f" {i % 3}\nnew line that becomes frequent by this insertion") for i in range(9)])
    both = docs.unionByName(new)
    rows = lambda df: sorted(map(tuple, df.collect()))
    index = LineIndex.over(docs, shard_keys=2)
    assert index.shards > 1
    grown = index.insert(new)
    assert rows(grown.counts) != rows(index.counts) and filter_cells(grown) != filter_cells(index)
    whole = LineIndex.over(both, shard_keys=2)
    assert rows(grown.counts) == rows(whole.counts) and rows(grown.postings) == rows(whole.postings)
    assert rows(line_dedup(both, grown)) == rows(line_dedup(both))
    keys = [(r["h1"], r["h2"]) for r in grown.frequent().collect()]
    h1, h2 = (np.array([k[j] for k in keys]) for j in (0, 1))
    assert grown.sieve().contains(h1, h2).all() and not index.sieve().contains(h1, h2).all()
    back = grown.delete(new.select("doc_id"))
    assert rows(back.counts) == rows(index.counts) and rows(back.postings) == rows(index.postings)
    assert filter_cells(back) == filter_cells(index)
    assert rows(line_dedup(docs, back)) == rows(line_dedup(docs))
    none = back.delete(docs.select("doc_id"))
    assert none.counts.count() == none.postings.count() == 0 and filter_cells(none) == {}


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    own = rng.integers(-(1 << 62), 1 << 62, 3000)
    other = rng.integers(-(1 << 62), 1 << 62, 20_000)
    for capacity in (len(own), 10):  # the second has to grow
        f = CuckooFilter(capacity)
        for h in own.tolist():
            f.add(h)
        f = CuckooFilter.load(f.dump())
        assert f.contains(own).all() and f.n == len(own)
        assert f.contains(other).mean() < 0.005
        for h in own[:1500].tolist():
            assert f.remove(h)
        assert f.contains(own[1500:]).all() and f.contains(own[:1500]).mean() < 0.02
        assert not CuckooFilter(4).remove(12345)
    full = CuckooFilter(1)
    for _ in range(20):
        full.add(7)  # more than two buckets hold
    assert full.contains(np.array([7])).all() and full.remove(7) and full.contains(np.array([7])).all()


def test_sql_is_the_same(docs_of):
    import duckdb

    rows = [(i, t) for i, t in some_rows()[:40]]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({OP10_SQL})").fetchall())
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup(docs_of(rows)).collect())
    assert got == want
