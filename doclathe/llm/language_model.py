"""Log-bilinear language model with noise-contrastive estimation, for scoring texts.

Tokens are words (A-Z lower-cased, ASCII white space between) and one end. Counts of all words are taken over every
training text. Frequent words are classes of their own, as many as ``own_words`` has for the corpus; all others fall into
ENDINGS classes by their last two bytes. The class w after the classes u1 and, before it, u2 has the score
(r_u1 C1 + r_u2 C2) q_w + b_w. Every partition of the training texts fits a copy of the model to all of its tokens, by
AdaGrad on the loss of noise-contrastive estimation with NOISE classes sampled for each step; the copies' mean, weighted by
their tokens, is the model. Batched matrix products give the normaliser of every pair of classes, so that all token
log-probabilities are normalised. Within a class a word has the share of its smoothed count, with room for one unseen
word. Words beyond the HOT most frequent, which travel with the tasks, meet their counts in a shuffle.

Defined cases: null and empty texts are the end token alone; a null id is a training row; without training rows every
class is equally likely and base_score is log10(1) for each token; rows with equal ids are scored one by one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Held, dropped, held_out, stored, texts_of, tuned

ENDINGS, HOT = 256, 200_000
RANK, NOISE, BATCH, RATE = 24, 64, 2048, 0.1
#: A partition with fewer steps than this goes over its (first KEPT) tokens again.
STEPS, KEPT = 600, 1_000_000
#: Copies of the model that one task averages.
FAN_IN = 32
#: The end token's hash; no word has it, as words are never empty.
END_HASH = xxhash.xxh64_intdigest(b"") - (1 << 64)


def own_words(tokens: int) -> int:
    """Words with a class of their own: 1023 up to 2^28 training tokens, twice as many for each 16-fold, 4095 at most (the
    table of normalisers has their square)."""
    return (1 << min(12, max(10, int(np.log2(max(tokens, 1)) // 4) + 4))) - 1


def word_hash(w: bytes) -> int:
    h = xxhash.xxh64_intdigest(w)
    return h - (1 << 64) if h >> 63 else h


def ending(w: bytes) -> int:
    """Class, among the endings, of a word that isn't one of its own: from its last two bytes, without closing
    punctuation."""
    return xxhash.xxh32_intdigest(w.rstrip(b".,;:!?)\"'")[-2:]) % ENDINGS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.exp(-x)
    out += 1
    return np.reciprocal(out, out=out)


class LogBilinear:
    """Scores (r_u1 C1 + r_u2 C2) q_w + b_w of class w after u1 and u2. A context has one class more: no word yet."""

    NAMES = ("r", "c1", "c2", "q", "b")

    def __init__(self, counts: np.ndarray, rank: int = RANK, seed: int = 0):
        """``counts`` of the classes give the noise and the first b."""
        rng, n = np.random.default_rng(seed), len(counts)
        self.noise = (counts + 0.5) / (counts + 0.5).sum()
        self.r = rng.normal(0, 0.3, (n + 1, rank)).astype(np.float32)
        self.c1, self.c2 = np.eye(rank, dtype=np.float32), 0.5 * np.eye(rank, dtype=np.float32)
        self.q = rng.normal(0, 0.1, (n, rank)).astype(np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self._upto = np.cumsum(self.noise)
        self._shift = np.log(self.noise).astype(np.float32)
        self._seen = {k: np.full(getattr(self, k).shape, 1e-6, np.float32) for k in self.NAMES}

    def step(self, u1: np.ndarray, u2: np.ndarray, w: np.ndarray, rng: np.random.Generator, noise: int = NOISE, rate: float = RATE) -> None:
        """One step of AdaGrad: each class w is to be told from ``noise`` classes sampled for all of them."""
        k = np.minimum(np.searchsorted(self._upto, rng.random(noise)), len(self.noise) - 1)
        shift = self._shift + np.float32(np.log(noise))
        x1, x2 = self.r[u1], self.r[u2]
        v = x1 @ self.c1 + x2 @ self.c2
        qw, qk = self.q[w], self.q[k]
        true = (_sigmoid((v * qw).sum(1) + self.b[w] - shift[w]) - 1) / len(w)
        false = _sigmoid(v @ qk.T + (self.b[k] - shift[k])) / len(w)
        dv = true[:, None] * qw + false @ qk
        both = np.concatenate((w, k))
        self._move("r", np.concatenate((u1, u2)), np.concatenate((dv @ self.c1.T, dv @ self.c2.T)), rate)
        self._move("q", both, np.concatenate((true[:, None] * v, false.T @ v)), rate)
        self._move("b", both, np.concatenate((true, false.sum(0))), rate)
        for name, x in (("c1", x1), ("c2", x2)):
            self._move(name, np.arange(len(self.c1)), x.T @ dv, rate * 0.1)

    def _move(self, name: str, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
        rows = rows.astype(np.uint16)  # sorted by radix; there are fewer than 2^16 classes
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        g, rows = np.add.reduceat(g[order], first), rows[first]
        seen = self._seen[name]
        seen[rows] += g * g
        getattr(self, name)[rows] -= rate * g / np.sqrt(seen[rows])

    def dump(self) -> bytes:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES]).astype(np.float32).tobytes()

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for k in self.NAMES:
            x = getattr(self, k)
            setattr(self, k, flat[at : (at := at + x.size)].reshape(x.shape).astype(np.float32))
        return self

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """What a class adds to the context as the last one, and as the one before."""
        return self.r @ self.c1, self.r @ self.c2

    def normalisers(self, u2: int) -> np.ndarray:
        """Natural log of the sum over all classes, after u2 and each u1."""
        a1, a2 = self.contexts()
        s = (a1 + a2[u2]) @ self.q.T + self.b
        top = s.max(1, keepdims=True)
        return (top + np.log(np.exp(s - top).sum(1, keepdims=True)))[:, 0]


class Lexicon:
    """Frequent words, by hash: their counts and classes."""

    def __init__(self, h: np.ndarray, n: np.ndarray, endings: np.ndarray, words: int):
        order = np.lexsort((h, -n))
        h, n, cls = h[order], n[order], endings[order].astype(np.int64) + words
        own = np.flatnonzero(h != END_HASH)[:words]
        cls[own] = np.arange(len(own))
        by = np.argsort(h)
        self.words, self.end, self.start = words, words + ENDINGS, words + ENDINGS + 1
        self.h, self.n, self.cls = h[by], n[by], cls[by]
        self.cls[self.h == END_HASH] = self.end
        self.n_end = int(n[h == END_HASH].sum())

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, class, count) of words; count -1: not among the frequent words."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        known = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        cls, n = np.empty(len(h), np.int64), np.full(len(h), -1)
        cls[known], n[known] = self.cls[at[known]], self.n[at[known]]
        rare = np.flatnonzero(~known)
        cls[rare] = np.fromiter((ending(words[i]) for i in rare.tolist()), np.int64, len(rare)) + self.words
        return h, cls, n


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def sequences(texts: list[bytes], lexicon: Lexicon) -> dict[str, np.ndarray]:
    """The tokens of some texts, one after the other: w, u1, u2 (classes: own, before, and before that), at (each text's
    first token), and for its words h, n, and words' places among the tokens."""
    per = [_words(t) for t in texts]
    sizes = np.fromiter(map(len, per), np.int64, len(per))
    h, cls, n = lexicon.find([w for p in per for w in p])
    ends = np.cumsum(sizes)
    w = np.insert(cls, ends, lexicon.end)
    at = np.cumsum(sizes + 1) - (sizes + 1)
    u1 = np.concatenate(([0], w[:-1]))
    u1[at] = lexicon.start
    u2 = np.concatenate(([0], u1[:-1]))
    u2[at] = lexicon.start
    return {"w": w, "u1": u1, "u2": u2, "at": at, "h": h, "n": n, "sizes": sizes, "place": np.arange(len(cls)) + np.repeat(np.arange(len(per)), sizes)}


def word_counts(train: DataFrame) -> DataFrame:
    """h, ending, n for every word of the training texts, and for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        ends = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([word_hash(w) for w in c], pa.int64()), pa.array([ending(w) for w in c], pa.int32()), pa.array(c.values(), pa.int64())], ["h", "ending", "n"])

        for b in batches:
            for t in texts_of(b):
                c.update(_words(t))
            ends += b.num_rows
            if len(c) > 300_000:
                yield out()
                c.clear()
        if c:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END_HASH], pa.int64()), pa.array([ENDINGS], pa.int32()), pa.array([ends], pa.int64())], ["h", "ending", "n"])

    return train.mapInArrow(run, "h long, ending int, n long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def hot_words(counts: DataFrame, words: int, most: int = HOT) -> Lexicon:
    """All words above the lowest count at which there are at most ``most``, by a histogram of counts."""
    level = F.floor(16 * F.log2("n")).cast("int")
    bins = sorted(((r["l"], r["k"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, n = 1 << 30, 0
    for b, k in bins:
        if n + k > most:
            break
        least, n = b, n + k
    rows = counts.where((level >= least) | (F.col("h") == END_HASH)).select("h", "n", "ending").toPandas()
    return Lexicon(rows["h"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["ending"].to_numpy(np.int64), words)


def class_counts(counts: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and words of each class."""
    n, v = np.zeros(lexicon.start), np.zeros(lexicon.start)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[lexicon.words + r["ending"]], v[lexicon.words + r["ending"]] = r["n"], r["v"]
    own = lexicon.cls < lexicon.words
    n[lexicon.cls[own]], v[lexicon.cls[own]] = lexicon.n[own], 1
    if own.any():  # at most 4095 rows
        alone = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(x),) for x in lexicon.h[own]], "h long")), "h", "left_semi")
        for r in alone.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            n[lexicon.words + r["ending"]] -= r["n"]
            v[lexicon.words + r["ending"]] -= r["v"]
    return n, v


def fitted(train: DataFrame, held: Held, n_cls: np.ndarray) -> LogBilinear:
    """The mean of the models that the partitions of ``train`` fit to all of their tokens."""
    model = LogBilinear(n_cls)
    if not n_cls.sum():
        model.r[:] = 0  # every class is equally likely
        model.b[:] = 0
        return model
    lost = Held(train.sparkSession, n_cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, rng, steps, tokens, kept = LogBilinear(lost.value), np.random.default_rng(part), 0, 0, []

        def over(x: np.ndarray) -> int:
            x = x[:, rng.permutation(x.shape[1])]
            for i in range(0, x.shape[1], BATCH):
                own.step(*x[:, i : i + BATCH], rng)
            return -(-x.shape[1] // BATCH)

        for b in batches:
            s = sequences(texts_of(b), held.value)
            x = np.stack((s["u1"], s["u2"], s["w"]))
            steps += over(x)
            if tokens < KEPT:
                kept.append(x.astype(np.int16))
            tokens += x.shape[1]
        if not tokens:
            return
        again = np.concatenate(kept, 1).astype(np.int64)
        while steps < STEPS:
            steps += over(again)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([own.dump()], pa.binary())], ["part", "tokens", "model"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        out = sum(np.frombuffer(m, np.float32) * np.float64(t) for m, t in zip(rows["model"], rows["tokens"])) / rows["tokens"].sum()
        return pd.DataFrame({"part": [int(rows["part"].min())], "tokens": [int(rows["tokens"].sum())], "model": [out.astype(np.float32).tobytes()]})

    shape = "part long, tokens long, model binary"
    copies = stored(train.mapInArrow(run, shape), "models")
    n = copies.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    while n > 1:
        n = -(-n // FAN_IN)
        fewer = stored(copies.withColumn("g", F.pmod("part", F.lit(n))).groupBy("g").applyInPandas(lambda rows: mean(rows).assign(part=rows["g"].iloc[0]), shape), "models")
        dropped(copies)
        copies = fewer
    return model.load(np.frombuffer(bytes(copies.first()["model"]), np.float32))


def normaliser_table(spark, model: LogBilinear) -> np.ndarray:
    """log of the normaliser by u2 and u1, in tasks of their own: of a fixed size, whatever the corpus."""
    held, n = Held(spark, model), len(model.r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for u in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([held.value.normalisers(u).astype(np.float32).tobytes()], pa.binary())], ["u", "z"])

    out = np.zeros((n, n), np.float32)
    for r in spark.range(0, n, 1, min(n, 64)).mapInArrow(run, "u long, z binary").toLocalIterator():
        out[r["u"]] = np.frombuffer(bytes(r["z"]), np.float32)
    return out


def lm_scores(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row."""
    spark = docs.sparkSession
    tuned(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    train = base.where(~held_out("doc_id", 1)).select("text")
    counts = stored(word_counts(train), "words")
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    lexicon = hot_words(counts, own_words(n_all), hot)
    held = Held(spark, lexicon)
    n_cls, v_cls = class_counts(counts, lexicon)
    model = fitted(train, held, n_cls)
    within = -np.log10(n_cls + 0.5 * (v_cls + 1))
    within[: lexicon.words] = within[lexicon.end] = 0
    a1, a2 = model.contexts()
    parts = Held(spark, (a1, a2, model.q, model.b, normaliser_table(spark, model), within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        a1, a2, q, bias, z, within = parts.value
        of_end = np.log10(lex.n_end + 0.5)
        for b in batches:
            s = sequences(texts_of(b), lex)
            w, u1, u2, n = s["w"], s["u1"], s["u2"], s["n"]
            logp = np.empty(len(w))
            for i in range(0, len(w), 1 << 15):
                c, x, y = (t[i : i + (1 << 15)] for t in (w, u1, u2))
                logp[i : i + (1 << 15)] = np.einsum("ij,ij->i", a1[x] + a2[y], q[c]) + bias[c] - z[y, x]
            logs = np.where(n >= 0, np.log10(np.maximum(n, 0) + 0.5), 0.0)
            base, known = np.zeros(len(w)), np.zeros(len(w))
            base[s["place"]], known[s["place"]] = logs, n > 0
            # A word with a class of its own is all of its class; the others have a share of theirs.
            score = logp / np.log(10) + within[w] + np.where(w >= lex.words, base, 0.0)
            total = lambda x: np.add.reduceat(x, s["at"])  # noqa: B023, E731
            rare = np.flatnonzero(n < 0)
            to = np.concatenate(([0], np.cumsum(s["sizes"])))
            offsets = np.searchsorted(rare, to).astype(np.int32)
            cols = [pa.array(s["sizes"] + 1), pa.array(total(known).astype(np.int64) + (lex.n_end > 0)), pa.array(total(base) + of_end), pa.array(total(score)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(s["h"][rare]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_tokens", "n_hot", "log_counts", "model", "rare"])

    dense = base.mapInArrow(run, "doc_id long, n_tokens long, n_hot long, log_counts double, model double, rare array<long>")
    dense = stored(dense.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rare = dense.select("_row", F.explode("rare").alias("h")).groupBy("_row", "h").agg(F.count(F.lit(1)).alias("k"))
    rare = rare.join(counts.select("h", "n"), "h", "left").groupBy("_row")
    rare = rare.agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_logs"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("n_rare"))
    out = dense.drop("rare").join(rare, "_row", "left")
    logs = F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out("doc_id", 1).alias("held_out"),
        "n_tokens",
        (F.col("n_hot") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * float(np.log10(n_all + 0.5 * (v_all + 1)))).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
