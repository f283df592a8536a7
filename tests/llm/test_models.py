from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclathe.llm.decontaminate import EDGES, SLOT_HASHES, decontamination, template
from doclathe.llm.language_model import LogBilinear, lm_scores
from doclathe.llm.quality import resample, top_k
from doclathe.llm.toxicity import FactorizationMachine, toxicity

SF = "/root/testdata/sf0.01"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_factorization_machine_learns_a_pair():
    """Toxic only where insult and group meet: no additive weights can tell."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (600, 2))
    rows = [np.array(sorted({2 * k + int(v) for k, v in enumerate(r)} | {int(z) for z in rng.integers(10, 60, 3)}), np.int64) for r in x]
    y = (x[:, 0] == x[:, 1]).astype(float)
    chi = FactorizationMachine._telling
    FactorizationMachine._telling = staticmethod(lambda rows, y, features: np.arange(60))
    try:
        m = FactorizationMachine.fit(rows[:400], y[:400], np.ones(400), epochs=60)
    finally:
        FactorizationMachine._telling = staticmethod(chi)
    right = [(m.score(r) >= 0.5) == bool(t) for r, t in zip(rows[400:], y[400:])]
    assert np.mean(right) > 0.9


def toxic_docs(n=600):
    rng = random.Random(0)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("an", "el", "or", "ist", "ung")]
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = rng.choices(words, k=rng.randint(3, 40))
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["Nastyword,", "nastyling", "awfulness."]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity(docs_of, spark, odd_texts):
    docs, labels = toxic_docs()
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    lab = lab.withColumn("text", F.lit("x")).withColumn("b", F.lit(1)).withColumn("score", F.lit(2.0))  # names that clash
    out = toxicity(docs_of(docs + odd_texts), lab).collect()
    assert len(out) == len(docs) + len(odd_texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out[: len(docs)] if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    none = toxicity(docs_of(odd_texts), lab.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity(docs_of([]), lab).count() == 0


@has_tables
def test_quality_drops_junk(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = resample(docs, labels)
    kept = {r["doc_id"] for r in out.collect()}
    own = labels.collect()
    share = sum(r["quality"] for r in own) / len(own)
    assert len(kept) == round(share * docs.count())
    assert np.mean([r["doc_id"] in kept for r in own if r["quality"]]) > 0.95
    assert np.mean([r["doc_id"] in kept for r in own if not r["quality"]]) < 0.3


def test_resampling_of_odd_texts(docs_of, spark, odd_texts):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, None), (4, None, 1)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).withColumn("target", F.lit(True))
    assert resample(docs_of(odd_texts), labels, k=6).count() == 6
    assert resample(docs_of(odd_texts), labels, k=100).count() == len(odd_texts)
    assert resample(docs_of(odd_texts), labels.limit(0)).count() == 0
    assert resample(docs_of([]), labels, k=3).count() == 0


@pytest.mark.parametrize("k", [0, 1, 7, 250, 500, 900])
def test_top_k(spark, k):
    rng = random.Random(k)
    rows = [(i, rng.choice([rng.gauss(0, 1e4), 1.25, -3.5, 0.0])) for i in range(500)]
    got = sorted((r["gumbel_key"] for r in top_k(spark.createDataFrame(rows, "doc_id long, gumbel_key double"), k).collect()), reverse=True)
    assert got == pytest.approx(sorted((x for _, x in rows), reverse=True)[:k], abs=1e-5)


ITEM = "A train leaves Rome at 9 and covers 120 km before noon while Maria rides 120 km on her bike and rests for 3 hours near the river"


def brute_leaks(docs, items, coverage=0.5, consistent=0.8):
    """Windows as lists of tokens, every item against every text."""
    h = lambda words: template(words).tolist()
    out = []
    for i, text in docs:
        words = (text or "").split()
        for item_id, item in items:
            own = (item or "").split()
            if len(own) < 5 or len(words) < min(8, len(own)):
                continue
            n, a, b = min(8, len(own)), h(own), h(words)
            wins = [tuple(a[q : q + n]) for q in range(len(a) - n + 1)]
            hits = [(p, q) for p in range(len(b) - n + 1) for q, w in enumerate(wins) if tuple(b[p : p + n]) == w]
            share = len({wins[q] for _, q in hits}) / len(set(wins))
            if share < coverage:
                continue
            lines = Counter(s for s, _ in {(p - q, q) for p, q in hits})
            shift = min(lines, key=lambda s: (-lines[s], s))
            at = {q + k for p, q in hits if p - q == shift for k in range(n)}
            slot = [q for q in at if a[q] in SLOT_HASHES]
            pairs = Counter((a[q], own[q].strip(EDGES), words[q + shift].strip(EDGES)) for q in slot)
            agree = sum(max(v for (k, o, _), v in pairs.items() if (k, o) == g) for g in {(k, o) for k, o, _ in pairs})
            if not slot or agree / len(slot) >= consistent:
                out.append((i, item_id, share, len(slot), agree / len(slot) if slot else 1.0))
    return out


def leaks_of(spark, docs_of, texts, items, **options):
    bench = spark.createDataFrame([(i, t, "doc", 1, 2.0) for i, t in items], "item_id long, text string, doc_id string, h long, q double")
    got = decontamination(docs_of(texts), bench, **options).collect()
    return [(r["doc_id"], r["item_id"], r["coverage"], r["n_slots"], r["consistency"]) for r in got]


def test_templates(spark, docs_of):
    broken = ITEM.replace("120", "250", 1).replace(" 9 ", " 120 ").replace("3", "250")
    half = ITEM.split()
    texts = [
        (1, ITEM),
        (2, "Before it. " + ITEM + " and more text follows"),
        (3, ITEM.replace("120", "250").replace("Maria", "Anna").replace(" 9 ", " 7 ").replace("km", "miles")),
        (4, broken),
        (5, "words that have nothing to do with it " * 5),
        (6, "And then. One two three four five six."),
        (7, " ".join(half[: len(half) // 3])),
    ]
    items = [(1, ITEM), (2, "too short"), (3, None), (4, "one two three four five six")]
    got = leaks_of(spark, docs_of, texts, items, consistent=0.95)
    assert sorted((d, i) for d, i, *_ in got) == [(1, 1), (2, 1), (3, 1), (6, 4)]


@pytest.mark.parametrize("carried", [1_000_000, 0])
def test_decontamination_equals_brute_force(docs_of, spark, odd_texts, carried):
    rng = random.Random(3)
    words = ["red", "Anna", "7", "km", "sees", "Rome", "12", "and", "the", "blue."]
    items = [(1, ITEM), (1, ITEM), (2, "short"), (None, None), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (None, "the red and the blue")]
    items += [(10 + i, " ".join(rng.choices(words, k=rng.randint(5, 14)))) for i in range(6)]
    texts = [t for t in odd_texts if t[0] not in (5, 6)] + [(20, "Intro. " + ITEM), (20, "Intro. " + ITEM), (21, ITEM.replace("120", "77")), (22, "9 8 7 6 5 4 3 2 1 0 1 2 3 4 5")]
    texts += [(30 + i, " ".join(rng.choices(words, k=30)) + " " + (rng.choice(items)[1] or "")) for i in range(20)]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    got = sorted(leaks_of(spark, docs_of, texts, items, broadcast_windows=carried), key=key)
    assert got == sorted(brute_leaks(texts, items), key=key) and len(got) > 15
    assert leaks_of(spark, docs_of, texts, []) == leaks_of(spark, docs_of, [], items) == []


def lm_docs(n=300):
    rng = random.Random(0)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    out = []
    for i in range(n):
        w = []
        for j in range(rng.randint(1, 30)):
            w.append(rng.choice(a if j % 2 else b))
        out.append((i, " ".join(w) + (f" only{i}" if i % 3 == 0 else "")))
    return out


def test_language_model(docs_of, odd_texts):
    rows = lm_docs() + odd_texts
    out = lm_scores(docs_of(rows)).collect()
    train: Counter = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update((t or "").encode().lower().split())
            train[""] += 1
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), ""]
        want.append((i, len(w), sum(train[x] > 0 for x in w), sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"]) for r in out]
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[3])
    for x, y in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], rel=1e-9)
    assert {r["train_tokens"] for r in out} == {n}
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] > 8]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)
    assert lm_scores(docs_of([])).count() == 0


def test_rare_words_meet_their_counts_in_a_shuffle(docs_of):
    docs = docs_of(lm_docs(80))
    key = lambda df: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6)) for r in df.collect())
    assert key(lm_scores(docs, hot=20)) == key(lm_scores(docs))


def log_softmax(m, u1, u2):
    s = (m.r[u1] @ m.c1 + m.r[u2] @ m.c2).astype(float) @ m.q.T.astype(float) + m.b
    return s - s.max() - np.log(np.exp(s - s.max()).sum())


def test_both_positions_are_learnt_from_sampled_noise():
    """The next class follows from the last two together, by position; noise is sampled."""
    rng = np.random.default_rng(0)
    u1, u2 = rng.integers(0, 6, (2, 30_000))
    w = np.where(rng.random(30_000) < 0.9, 6 + u1 % 2 + 2 * (u2 % 3), rng.integers(0, 12, 30_000))
    m = LogBilinear(np.bincount(w, minlength=12).astype(float))
    for _ in range(6):
        for i in range(0, 30_000, 500):
            m.step(u1[i : i + 500], u2[i : i + 500], w[i : i + 500], rng)
    p = np.array([log_softmax(m, a, b)[c] for a, b, c in zip(u1[:2000], u2[:2000], w[:2000])])
    assert p.mean() > np.log(m.noise)[w].mean() + 0.9
    z = m.normalisers(3)
    for u in range(12):
        s = (m.r[u] @ m.c1 + m.r[3] @ m.c2) @ m.q.T + m.b
        assert np.exp(s - z[u]).sum() == pytest.approx(1, rel=1e-4)
    flat = np.frombuffer(m.dump(), np.float32)
    assert LogBilinear(np.ones(12)).load(flat).dump() == m.dump()


def test_scores_equal_brute_force(docs_of, odd_texts, monkeypatch):
    """Token by token: the class's probability, times the word's share of its class."""
    from doclathe.llm import language_model as lm

    seen = {}
    real = lm.fitted
    monkeypatch.setattr(lm, "own_words", lambda n: 40)
    monkeypatch.setattr(lm, "fitted", lambda train, held, n: seen.setdefault("model", seen.setdefault("lexicon", held.value) and real(train, held, n)))
    rows = [r for r in lm_docs(120) + odd_texts if r[0] not in (5, 6)]
    out = lm_scores(docs_of(rows), hot=60).collect()
    train: Counter = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            train.update((t or "").encode().lower().split())
    lex, m = seen["lexicon"], seen["model"]
    cls = lambda w: int(lex.find([w])[1][0])
    n_cls, v_cls = Counter(), Counter()
    for w, n in train.items():
        n_cls[cls(w)] += n
        v_cls[cls(w)] += 1
    want = []
    for i, t in rows:
        words = (t or "").encode().lower().split()
        total, u1, u2 = 0.0, lex.start, lex.start
        for w in [*words, None]:
            c = lex.end if w is None else cls(w)
            total += log_softmax(m, u1, u2)[c] / math.log(10)
            if w is not None and c >= 40:
                total += math.log10((train[w] + 0.5) / (n_cls[c] + 0.5 * (v_cls[c] + 1)))
            u1, u2 = c, u1
        want.append(((i is None, i or 0), len(words) + 1, total))
    got = [((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], r["score"]) for r in out]
    for x, y in zip(sorted(got), sorted(want), strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-4, abs=1e-3)


@has_tables
def test_model_beats_word_counts_on_held_out_texts(spark):
    r = lm_scores(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r["s"] - r["b"]) / r["n"] > 0.35  # 0.375 decimal digits a token when this was written


def test_models_of_many_partitions_are_averaged(spark, docs_of):
    from doclathe.llm import language_model as lm

    docs = docs_of(lm_docs(200)).repartition(40).select("text")
    counts = lm.word_counts(docs)
    lexicon = lm.hot_words(counts, 40)
    n, v = lm.class_counts(counts, lexicon)
    assert n.sum() == counts.agg(F.sum("n")).first()[0] and v.sum() == counts.count()
    m = lm.fitted(docs, lm.Held(spark, lexicon), n)
    assert np.isfinite(np.frombuffer(m.dump(), np.float32)).all()
    assert [lm.own_words(x) for x in (0, 10**6, 1 << 27, 1 << 28, 1 << 32, 1 << 60)] == [1023, 1023, 1023, 2047, 4095, 4095]


def test_held_out_by_text_of_the_id(spark):
    from doclathe.llm.common import held_out

    df = spark.range(50).select("id", held_out("id", 1).alias("h"))
    assert {r["id"] for r in df.where("h").collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1}
    assert not df.select(held_out(F.lit(None).cast("long"), 0).alias("h")).first()["h"]
