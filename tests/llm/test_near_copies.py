import random

import corpus_pipeline as C
import numpy as np
from lodgely.llm import simhash as S
from pyspark.sql import functions as F


def likeness(a, b):
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split())]
    return len(grams[0] & grams[1]) / len(grams[0] | grams[1])


def edited(rng, text, count):
    words = text.split()
    for k in rng.sample(range(len(words)), count):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_of_likeness_080_to_095_go(spark):
    rng = random.Random(1)
    rows, gone, stay = [], set(), set()
    for k in range(60):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 400)))
        copy = next(t for t in iter(lambda: edited(rng, text, rng.randint(1, 9)), None) if 0.8 <= likeness(text, t) <= 0.95)
        far = next(t for t in iter(lambda: edited(rng, text, rng.randint(2, 40)), None) if 0.6 <= likeness(text, t) < 0.78 and likeness(copy, t) < 0.78)
        rows += [(3 * k, text), (3 * k + 1, copy), (3 * k + 2, far)]
        gone.add(3 * k + 1)
        stay |= {3 * k, 3 * k + 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in C.drop_near_copies(spark, docs, "").collect()} == stay
    assert len({r.component_id for r in S.linked_prints(docs).collect()} & gone) > 30


def test_components_by_brute_force(spark):
    rng = random.Random(2)
    line = " ".join(f"c{k}" for k in range(30))
    centre = " ".join(f"v{rng.randrange(5000)}" for _ in range(150))
    texts = [edited(rng, centre, rng.randint(1, 8)) for _ in range(150)] + [f"{line} " + " ".join(f"u{rng.randrange(5000)}" for _ in range(20)) for _ in range(60)]
    for n in (3, 5, 7):
        chain = [" ".join(f"x{n}y{k}" for k in range(100))]
        while len(chain) < 12:
            chain.append(edited(rng, chain[-1], n % 3 + 1))
        texts += chain
    rng.shuffle(texts)
    label, sets = list(range(len(texts))), [set(S.shingle_set(t).tolist()) for t in texts]
    near = [[j for j in range(len(texts)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8] for i in range(len(texts))]
    while (new := [min(label[j] for j in near[i]) for i in range(len(texts))]) != label:
        label = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()} == dict(enumerate(label))
    base = S.with_bands(docs)
    node = {r.doc_id: r.node for r in base.collect()}
    for small, rounds in ((3, 2),):
        roots = {r.node: r.root for r in S.near_links(base, small=small, rounds=rounds, few=0).collect()}
        least = {}
        for i, n in sorted(node.items()):
            least.setdefault(roots.get(n, n), i)
        assert [least[roots.get(node[i], node[i])] for i in range(len(texts))] == label


def test_one_id_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "A a"), (1, "B b"), (2, "B b"), (2, None), (None, "B b"), (1, "A a")], "doc_id long, text string")
    kept = C.drop_near_copies(spark, docs, "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", "A a"), ("1", "B b"), ("2", "None"), ("None", "B b")]


def test_share_of_pairs_that_meet():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 100, np.uint64)
        x, y = (np.unique(np.concatenate([both[:80], part])) for part in (both[80:90], both[90:]))
        met += bool(np.any(S.band_keys(x) == S.band_keys(y)))
    assert met == 300


def test_fingerprints_link_without_bands(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(120):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(100, 400)))
        low, high = ((0.8, 0.85), (0.88, 0.92), (0.94, 0.98))[k % 3]
        copy = next(t for t in iter(lambda: edited(rng, text, rng.randint(1, 9)), None) if low <= likeness(text, t) <= high)
        far = next(t for t in iter(lambda: edited(rng, text, rng.randint(2, 40)), None) if 0.6 <= likeness(text, t) < 0.78 and likeness(copy, t) < 0.78)
        rows += [(3 * k, text), (3 * k + 1, copy), (3 * k + 2, far)]
        want[k] = low
    base = S.with_bands(spark.createDataFrame(rows, "doc_id long, text string"))
    node = {r.doc_id: r.node for r in base.collect()}
    roots = {r.node: r.root for r in S.near_links(base.withColumn("keys", F.array().cast("array<long>"))).collect()}
    root = {i: roots.get(n, n) for i, n in node.items()}
    share = {low: np.mean([root[3 * k] == root[3 * k + 1] for k in want if want[k] == low]) for low in (0.8, 0.88, 0.94)}
    assert share[0.8] >= 0.1 and share[0.88] >= 0.5 and share[0.94] >= 0.8, share
    assert all(root[3 * k + 2] not in (root[3 * k], root[3 * k + 1]) for k in want) and len({root[3 * k] for k in want}) == 120


def test_prints_follow_the_fingerprint_rule():
    text = " ".join(f"w{k}" for k in range(80))
    prints = S.set_prints(S.shingle_set(text))
    assert len(set(prints.tolist())) == S.PRINTS and int(prints[0]) == S.fingerprint(text, 5) and not len(S.set_prints(S.shingle_set("")))
