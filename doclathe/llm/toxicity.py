"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words (lower case, without outer punctuation) and their first four and five characters,
hashed to 2^20 buckets. Up to POSITIVE toxic and NEGATIVE other labelled rows (the first by a hash of their id: a
documented bound, weighted back to the labels' shares) give the FEATURES buckets that tell the classes apart best, and a
factorization machine of rank RANK is fitted to them: bias, weights, and an interaction for every pair. Then all buckets
that at least three of these rows have get factors, fitted to what is left, so that pairs tell whose terms do not.

Defined cases: null and empty texts get the score of a text without terms; ids with several labels are toxic if one
says so; null labels and ids teach nothing, and of rows with equal ids one does; labels of one class only, or none, give
every text that class's share; rows with equal ids are scored one by one; other columns, of both tables, are ignored.
"""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Held, Memo, held_out, tuned

BUCKETS, FEATURES, RANK = 1 << 20, 2048, 8
POSITIVE, NEGATIVE = 4_000, 6_000
EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»„“”‘’…–—¡¿"


def bucket(kind: str, s: str) -> int:
    return zlib.crc32(f"{kind}{s}".encode("utf-8", "replace")) % BUCKETS


def term_buckets(token: str) -> tuple[int, ...]:
    w = token.strip(EDGES)
    if not w:
        return ()
    return (bucket("w", w), *(bucket(str(n), w[:n]) for n in (4, 5) if len(w) >= n))


class FactorizationMachine:
    def __init__(self, buckets: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.buckets, self.bias, self.w, self.v = buckets, bias, w, v
        self.square = (v * v).sum(1)

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, features: int = FEATURES, rank: int = RANK, epochs: int = 12, rate: float = 0.05, seed: int = 0) -> FactorizationMachine:
        prior = float((weight * y).sum() / weight.sum()) if len(y) and weight.sum() else 0.0
        if not len(y) or y.min() == y.max():
            return cls(np.empty(0, np.int64), prior, np.empty(0), np.empty((0, rank)))
        rng = np.random.default_rng(seed)
        telling = np.sort(cls._telling(rows, y, features))
        n = len(telling)
        m = cls(telling, float(np.log(prior / (1 - prior))), np.zeros(n, np.float32), rng.normal(0, 0.02, (n, rank)).astype(np.float32))
        m._descend(rows, y, weight, np.ones(n, bool), rng, epochs, rate)
        # Terms that tell nothing alone may tell in pairs: they get factors, fitted to what is left, and no weights.
        kept = np.union1d(telling, cls._frequent(rows))
        n, old = len(kept), np.searchsorted(kept, telling)
        w, v = np.zeros(n, np.float32), rng.normal(0, 0.002, (n, rank)).astype(np.float32)
        w[old], v[old] = m.w, m.v
        m = cls(kept, m.bias, w, v)
        m._descend(rows, y, weight, np.isin(kept, telling), rng, -(-epochs // 3), rate, slow=1e-2)
        return cls(kept, m.bias, m.w.astype(float), m.v.astype(float))

    def _descend(self, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, weighted: np.ndarray, rng: np.random.Generator, epochs: int, rate: float, slow: float = 1e-4) -> None:
        """AdaGrad over ``epochs``; buckets that aren't ``weighted`` keep their weight of 0. Factors' steps start from ``slow``."""
        n, w, v = len(self.buckets), self.w, self.v
        index = [(at := self.place[r])[at >= 0] for r in rows]
        here, nth = np.zeros(n, bool), np.zeros(n, np.int32)
        gw, gv, gb = np.full(n, 1e-4, np.float32), np.full(v.shape, slow, np.float32), 1e-4
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(order), 128):
                own = order[s : s + 128]
                # Only the terms of these rows take part and are updated.
                here[:] = False
                for r in own:
                    here[index[r]] = True
                of = np.flatnonzero(here)
                nth[of] = np.arange(len(of))
                x = np.zeros((len(own), len(of)), np.float32)
                for i, r in enumerate(own):
                    x[i, nth[index[r]]] = 1
                wo, vo = w[of], v[of]
                xv = x @ vo
                z = self.bias + x @ wo + 0.5 * ((xv * xv).sum(1) - x @ (vo * vo).sum(1))
                e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own] / len(own)).astype(np.float32)
                ex = x.T @ e
                dw = (ex + 1e-5 * wo) * weighted[of]
                dv = x.T @ (e[:, None] * xv) - ex[:, None] * vo + 1e-4 * vo
                gw[of] += dw * dw
                gv[of] += dv * dv
                gb += float(e.sum()) ** 2
                w[of] = wo - rate * dw / np.sqrt(gw[of])
                v[of] = vo - rate * dv / np.sqrt(gv[of])
                self.bias -= rate * float(e.sum()) / gb**0.5

    @staticmethod
    def _frequent(rows: list[np.ndarray]) -> np.ndarray:
        """Buckets that at least three rows have."""
        n = np.zeros(BUCKETS, np.int32)
        for r in rows:
            n[r] += 1
        return np.flatnonzero(n >= 3)

    @staticmethod
    def _telling(rows: list[np.ndarray], y: np.ndarray, features: int) -> np.ndarray:
        """Buckets by the chi-squared of their presence against the label; at least three rows must have them."""
        n, pos = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for r, of in zip(rows, y):
            n[r] += 1
            pos[r] += of
        names = np.flatnonzero(n >= 3)
        n, pos = n[names], pos[names]
        share = y.mean()
        chi = (pos - n * share) ** 2 / (n * share * (1 - share))
        order = np.lexsort((names, -chi))[:features]
        return names[order[chi[order] > 0]]

    @cached_property
    def place(self) -> np.ndarray:
        """Where each bucket stands among those kept; -1: not kept."""
        out = np.full(BUCKETS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def logit(self, index: np.ndarray) -> float:
        s = self.v[index].sum(0)
        return self.bias + self.w[index].sum() + 0.5 * (s @ s - self.square[index].sum())

    def score(self, index: np.ndarray) -> float:
        if not len(self.w):
            return self.bias
        return float(1 / (1 + np.exp(-np.clip(self.logit(index), -500, 500))))


def fitted(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> FactorizationMachine:
    """Learns from labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    spark = docs.sparkSession
    tuned(spark)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out("doc_id", 0))
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: list[tuple[int, int]] = []
    for y, most in ((1, positive), (0, negative)):
        chosen += [(r["doc_id"], y) for r in own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not chosen:
        return FactorizationMachine.fit([], np.empty(0), np.empty(0))
    sample = F.broadcast(spark.createDataFrame(chosen, "doc_id long, toxic int"))
    buckets = _bucket_udf()
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(sample, "doc_id").select("doc_id", "toxic", buckets("text").alias("b"))
    found = found.groupBy("doc_id", "toxic").agg(F.min("b").alias("b")).collect()  # one row for each id: the bound holds
    found.sort(key=lambda r: (r["toxic"], r["doc_id"], r["b"]))
    y = np.array([r["toxic"] for r in found], float)
    rows = [np.frombuffer(r["b"], np.uint32) for r in found]
    n = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    share = {k: total.get(k, 0) / max(1, sum(total.values())) for k in (0, 1)}
    weight = np.array([share[int(k)] * len(y) / n[int(k)] for k in y])
    return FactorizationMachine.fit(rows, y, weight)


def _bucket_udf():
    @F.pandas_udf("binary")
    def buckets(texts: pd.Series) -> pd.Series:
        memo = Memo(term_buckets)
        return pd.Series([np.array(sorted({b for t in set((x or "").lower().split()) for b in memo[t]}), np.uint32).tobytes() for x in texts])

    return buckets


def scorer(docs: DataFrame, model: FactorizationMachine, text: str = "text") -> Column:
    """A column: the score of a text, from 0 to 1."""
    tuned(docs.sparkSession)
    held = Held(docs.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = held.value
        memo = _memo_for(held.id, lambda t: tuple(p for b in term_buckets(t) if (p := int(m.place[b])) >= 0))
        out = []
        for x in texts:
            index = sorted({i for t in set((x or "").lower().split()) for i in memo[t]})
            out.append(m.score(np.array(index, np.int64)))
        return pd.Series(out, dtype=float)

    return score(F.col(text))


_memos: dict[int, Memo] = {}


def _memo_for(key, f) -> Memo:
    """A worker keeps what it has looked up from one batch to the next."""
    if key not in _memos:
        _memos.clear()
        _memos[key] = Memo(f)
    return _memos[key]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    tuned(docs.sparkSession)
    model = fitted(docs, labels)
    out = docs.select(F.col("doc_id"), held_out("doc_id", 0).alias("held_out"), scorer(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
