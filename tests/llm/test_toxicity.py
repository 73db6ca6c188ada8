import itertools
import zlib

import numpy as np
from lodgely.llm import toxicity as X


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    lengths, moves = np.array([0, 3, 7, 1]), rng.normal(size=(2, 2))
    score = rng.normal(size=11) * 2
    p, expected, total = X.Chains(lengths).marginals(score, moves)
    want, counts, log, at = np.zeros(11), np.zeros((2, 2)), 0.0, 0
    for n in lengths.tolist():
        z, q, e = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            path = list(zip((0, *y), y))
            w = np.exp(sum(moves[a, b] for a, b in path) + sum(score[at + k] for k in range(n) if y[k]))
            z, q = z + w, q + w * np.array(y, float)
            for a, b in path:
                e[a, b] += w
        want[at : at + n], counts, log, at = q / z, counts + e / z, log + np.log(z), at + n
    assert np.allclose(p, want) and np.allclose(expected, counts) and np.isclose(total, log)


def test_long_documents_are_one_chain():
    rng = np.random.default_rng(2)
    score, moves = rng.normal(size=700) * 3, np.array([[1.0, -2.0], [-1.0, 1.0]])
    p, _, _ = X.Chains(np.array([700])).marginals(score, moves)
    t, forward = np.exp(moves), [np.array([1.0, 0.0])]
    for s in score:
        a = forward[-1] @ t * np.array([1, np.exp(s)])
        forward.append(a / a.sum())
    back, want = np.ones(2), np.zeros(700)
    for k in range(699, -1, -1):
        m = forward[k + 1] * back
        want[k] = m[1] / m.sum()
        back = t @ (back * np.array([1, np.exp(score[k])]))
        back /= back.sum()
    assert np.allclose(p, want)


def test_query(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = X.op7_toxicity(table, labels).collect()
    assert len(rows) == table.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(t == p for t, p in held) >= 0.93 * len(held) and not any(p > t for t, p in held)


def test_held_out_labels_do_not_matter(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    score = lambda l: sorted((r.doc_id, r.score) for r in X.op7_toxicity(table, l).collect())
    assert score(labels) == score(flipped)


def test_spans_and_odd_rows(spark, odd, none):
    texts = [f"the cat number{i} sat on a mat {'you scum liar' if i % 3 == 0 else 'good day'} and left {i}" for i in range(90)]
    model = X.fit(texts, [int(i % 3 == 0) for i in range(90)])
    (score, spans), (low, nothing) = X.tag(model, ["Été — You, SCUM liar!", "hello there"])
    assert score > 0.5 and ["Été — You, SCUM liar!"[a:b] for a, b, _ in spans] in (["SCUM liar"], ["You, SCUM liar"]) and low < 0.5 and nothing == []
    got = X.score(odd, model).collect()
    assert len(got) == 14 and {r["key"] for r in got} == {"x"} and len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert X.score(none, model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in X.op7_toxicity(odd, empty).collect()} == {0}


def test_long_texts_cost_no_others_their_place(spark):
    rows = [(i, f"the cat number{i} sat on a mat {'you scum liar' if i % 3 == 0 else 'good day'} and left {i}") for i in range(200)]
    long = [(i, "far too long " * 5000) for i in range(200, 260)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(260)], "doc_id long, toxic int")
    docs = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    want, got = X.learn(docs(rows), labels, most_bytes=60_000), X.learn(docs(rows + long), labels, most_bytes=60_000)
    assert want.vocabulary and got.vocabulary == want.vocabulary and got.prior == want.prior
    texts = ["you scum liar", "good day"]
    assert [s for s, _ in X.tag(got, texts)] == [s for s, _ in X.tag(want, texts)]
    one = X.learn(docs([(i, t * 40 if i % 3 else t) for i, t in rows]), labels, most_bytes=60_000)
    assert 0 < one.prior < 1


def test_the_samples_make_up_does_not_shift_scores(spark):
    texts = [f"the cat number{i} sat on a mat {'you scum liar' if i % 3 == 0 else 'good day'} and left {i}" for i in range(90)]
    toxic = [int(i % 3 == 0) for i in range(90)]
    few = [k for k in range(90) if toxic[k] or k < 30]
    plain, told = X.fit([texts[k] for k in few], [toxic[k] for k in few]), X.fit([texts[k] for k in few], [toxic[k] for k in few], share=1 / 3)
    (a,), (b,) = ([s for s, _ in X.tag(m, [""])] for m in (plain, told))
    assert b < a and b < 0.5
    assert [s for s, _ in X.tag(X.fit(texts[:1], [1], share=0.1), ["", "you scum liar"])] == [0.1, 0.1]
    rows = [(i, t * 40 if i % 3 else t) for i, t in enumerate(texts)]
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = X.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, most_bytes=20_000)
    assert [s < 0.5 for s, _ in X.tag(model, [""])] == [True]


def test_spans_of_a_long_text(spark):
    import re
    import time

    texts = [f"le chat été {i} sur la table {'you scum liar' if i % 3 == 0 else 'good day'} parti {i}" for i in range(90)]
    model = X.fit(texts, [int(i % 3 == 0) for i in range(90)])
    short = "été 🙂 " + "le chat été sur la table good day parti you scum liar parti \n " * 20
    (_, spans), (_, none) = X.tag(model, [short, "le chat good day"])
    inside = [short[a:b] for a, b, _ in spans]
    assert len(inside) == 20 and all("scum" in x and re.fullmatch(r"\S.*\S", x) for x in inside) and none == []
    unit = "le chat été sur la table good day parti you scum liar le chat été sur la table good day parti "
    long, began = unit * 52_000, time.perf_counter()
    (_, spans), = X.tag(model, [long])
    assert len(long.encode()) > 5_000_000 and len(spans) == 52_000 and time.perf_counter() - began < 60
    assert {long[a:b] for a, b, _ in spans[::997]} == {long[spans[0][0] : spans[0][1]]}
    began = time.perf_counter()
    raw = long.encode()
    hot = np.arange(0, 52_000 * 19, 19)
    got = X._spans(raw, raw.translate(X._BLANK), hot, np.ones(52_000 * 21))
    assert len(got) == 52_000 and time.perf_counter() - began < 10
