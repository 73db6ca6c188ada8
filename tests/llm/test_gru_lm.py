import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lodgely.llm import gru_lm as G


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check(rows, table, head=None):
    docs = [(r.doc_id, r.text or "") for r in table.select("doc_id", "text").collect()]
    counts = Counter()
    for i, t in docs:
        if not held(i):
            counts.update([*t.encode().lower().split(), G.END])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        own = [*t.encode().lower().split(), G.END]
        want.append((str(i), held(i), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows if n)


def test_query(docs, odd, none, monkeypatch):
    rows = G.op9_gru_lm(docs).collect()
    check(rows, docs)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    monkeypatch.setattr(G, "HEAD", 40)
    check(G.op9_gru_lm(docs).collect(), docs)
    check(G.op9_gru_lm(odd).collect(), odd)
    assert G.op9_gru_lm(none).count() == 0


def test_scores_by_the_network(docs, monkeypatch):
    """The query's score, word by word: class, word in its class or share of the tail's counts, rare words too."""
    kept = {}
    vocabulary, train = G.vocabulary, G.train
    monkeypatch.setattr(G, "HEAD", 1500)
    monkeypatch.setattr(G, "vocabulary", lambda counts: kept.setdefault("v", vocabulary(counts)))
    monkeypatch.setattr(G, "train", lambda *a: kept.update(net=train(*a)) or kept["net"])
    table = docs.filter("doc_id < 60")
    rows = {r.doc_id: r.score for r in G.op9_gru_lm(table).collect()}
    v, net, counts, per = kept["v"], kept["net"], Counter(), G.MODEL // G.CLASSES
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), G.END] for r in table.collect()}
    for i, words in texts.items():
        if not held(i):
            counts.update(words)
    order = {w: k for w, k in v.codes.items() if k < G.MODEL}
    assert len(counts) > 1500 and sorted((counts[w] for w in v.codes), reverse=True) == sorted(counts.values(), reverse=True)[: len(v.codes)]
    tail_tokens, tail_words = Counter(), Counter()
    for w, c in counts.items():
        if w not in order:
            tail_tokens[G.tail_class(w)] += c
            tail_words[G.tail_class(w)] += 1
    for i, words in texts.items():
        h, total, before = np.zeros((1, G.HIDDEN)), 0.0, 0
        for word in words:
            h = G._gates(net.x[[before]], h, net.u)[0]
            p = np.exp(h @ net.c + net.d)[0].astype(float)
            if (w := order.get(word)) is None:
                t = G.tail_class(word)
                k = G.CLASSES + t
                total += math.log10((counts[word] + 1) / (tail_tokens[t] + tail_words[t] + 1))
                before = G.MODEL + t
            else:
                k, before = w // per, w
                q = np.exp(net.w[k * per : (k + 1) * per] @ h[0] + net.v[k * per : (k + 1) * per])
                total += math.log10(q[w % per] / q.sum())
            total += math.log10(p[k] / p.sum())
        assert rows[i] == pytest.approx(total, rel=1e-4)


def test_more_tied_words_than_the_vocabulary_takes(spark, monkeypatch):
    words = spark.range(3000).selectExpr("cast(concat('w', id) as binary) as word", "cast(3 as long) as c")
    more = spark.createDataFrame([(b"top", 90), (b"next", 3 * 90), (G.END, 50), (b"none", 0)], "word binary, c long")
    for most in (1, 2, 3, 700, 3001, 3002, 3003, 9000):
        parts = [r for p in G.commonest(words.unionByName(more).filter("c <> 50"), most) for r in p.collect()]
        assert len(parts) == len({bytes(r.word) for r in parts}) == min(most, 3002) and sum(r.c for r in parts) == sum(sorted([3] * 3000 + [90, 270], reverse=True)[:most])
    assert sorted(bytes(r.word) for p in G.commonest(words, 700) for r in p.collect()) == sorted(bytes(r.word) for p in G.commonest(words.repartition(7), 700) for r in p.collect())
    tied = spark.range(100_100).selectExpr("cast(concat('w', id) as binary) as word", "cast(3 as long) as c")
    v = G.vocabulary(tied)
    assert len(v.codes) == G.HEAD + 1 and v.distinct == 100_100 and (v.tail_words.sum(), v.tail_tokens.sum()) == (100_100 - G.MODEL + 1, 3 * (100_100 - G.MODEL + 1))


def test_codes(monkeypatch):
    texts = ["a b  A\tc", None, "", " zz yy zz ", "b\x1cb é É", "a"]
    codes, tail = {G.END: 0, b"a": 1, b"b": 2, b"c": 3}, np.array([-1, -1, -1, 5])
    monkeypatch.setattr(G, "MODEL", 3)
    vocab = G.Vocabulary(codes, np.ones(4), tail, 9, 4, np.zeros(G.TAILS), np.zeros(G.TAILS))
    for text, (code, ids, rare) in zip(texts, G.coded(vocab, pa.array(texts, pa.string())), strict=True):
        own = (text or "").encode().lower().split()
        want = [codes.get(w, -1) for w in own] + [0]
        assert code.tolist() == want and rare.to_pylist() == [w for w in own if w not in codes]
        assert ids.tolist() == [k if 0 <= k < 3 else 3 + (5 if k == 3 else G.tail_class(w)) for w, k in zip([*own, G.END], want)]


def test_nothing_to_learn_from(odd):
    rows = G.op9_gru_lm(odd.filter("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")).collect()
    assert all(r.train_tokens == 0 and r.score == r.base_score for r in rows)


@pytest.fixture()
def net():
    rng = np.random.default_rng(0)
    shapes = [(G.MODEL + G.TAILS, 3 * G.HIDDEN), (G.HIDDEN, 3 * G.HIDDEN), (G.HIDDEN, G.CLASSES + G.TAILS), (G.CLASSES + G.TAILS,), (G.MODEL, G.HIDDEN), (G.MODEL,)]
    return G.Network(*(rng.normal(size=s) * 0.3 for s in shapes))


def test_slopes(net):
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, G.MODEL + G.TAILS, n) for n in (5, 3, 9)]
    target, came, fresh = G.grid(ids, 2)
    trainer = G.Trainer(net, 0.1)
    start = np.zeros((target.shape[1], G.HIDDEN))
    slopes, _, _ = trainer.slopes(target, came, fresh, start)
    for p, s in zip(trainer.net.parts(), slopes.parts()):
        at = np.unravel_index(np.abs(s).argmax(), s.shape)
        ends = []
        for move in (1e-2, -2e-2):
            p[at] += move
            ends.append(trainer.slopes(target, came, fresh, start)[2])
        p[at] += 1e-2
        assert s[at] == pytest.approx(-(ends[0] - ends[1]) / 2e-2, rel=2e-3)


def test_states_run_through_windows_and_lanes(net):
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, G.MODEL + G.TAILS, n) for n in (1, 700, 30, 5)]
    per, want = G.MODEL // G.CLASSES, []
    for own in ids:
        h, total, before = np.zeros((1, G.HIDDEN)), 0.0, 0
        for w in own.tolist():
            h = G._gates(net.x[[before]], h, net.u)[0]
            p = np.exp(h @ net.c + net.d)[0]
            k = w // per if w < G.MODEL else w - G.MODEL + G.CLASSES
            total += math.log10(p[k] / p.sum())
            if w < G.MODEL:
                q = np.exp(net.w[k * per : (k + 1) * per] @ h[0] + net.v[k * per : (k + 1) * per])
                total += math.log10(q[w % per] / q.sum())
            before = w
        want.append(total)
    for lanes in (1, 2, 256):
        assert G.likelihoods(net, ids, lanes) == pytest.approx(want, rel=1e-4)


def test_words_sum_to_one(net):
    """Over all words of the network and all tail classes, one step's probabilities sum to one."""
    h = np.random.default_rng(3).normal(size=(1, G.HIDDEN)).repeat(G.MODEL + G.TAILS, axis=0)
    got, _ = G.output(net, h, np.arange(G.MODEL + G.TAILS))
    assert np.exp(got).sum() == pytest.approx(1.0, rel=1e-5)
