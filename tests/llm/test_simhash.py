import random

import numpy as np
import xxhash
from lodgely.llm import simhash as S
from lodgely.llm.components import components


def plain(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(fps):
    """Smallest index that each reaches by steps of at most two bits."""
    fps, label = np.array(fps, np.uint64), list(range(len(fps)))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    changed = True
    while changed:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(fps))]
        changed, label = new != label, new
    return label


def test_fingerprints(odd):
    assert all(S.fingerprint(r.text) == plain(r.text) for r in odd.collect())


def test_two_bits_share_a_key():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << k
        keys = [set(S.segment_keys(np.array([x], np.uint64))[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_golay_balls():
    patterns, count = S.golay_keys()
    assert sorted(set(count.tolist())) == [1, 6] and int((count == 6).sum()) == 1771


def test_links_on_both_paths(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ (1 << a) ^ (1 << b) for a in range(0, 30) for b in range(a, 30)} | {rng.getrandbits(64) for _ in range(200)}
    base = [rng.getrandbits(64) for _ in range(40)]
    fps |= set(base) | {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    label = reach(fps)
    for most in (4, 64, 10**6):
        got = {r.node: r.root for r in components(S.links(df, most)).collect()}
        groups = {}
        for x, l in zip(fps, label):
            groups.setdefault(l, set()).add(int(np.uint64(x).view(np.int64)))
        for members in groups.values():
            assert {got.get(m, m) for m in members} == {min(members)}


def test_query(docs, odd, none):
    for table in (docs, odd):
        rows = table.select("doc_id", "text").collect()
        label = reach([plain(r.text) for r in rows])
        least = {}
        for r, l in zip(rows, label):
            least[l] = min(x for x in (least.get(l), r.doc_id) if x is not None) if (least.get(l), r.doc_id) != (None, None) else None
        want = sorted((str(r.doc_id), f"{plain(r.text):016x}", str(least[l])) for r, l in zip(rows, label))
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in S.op3_simhash(table).collect()) == want
    assert S.op3_simhash(none).count() == 0


def test_long_chain(spark):
    edges = spark.range(500).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0
