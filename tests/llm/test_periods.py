import hashlib
import random
import zlib

import numpy as np
from lodgely.llm import periods as P


def brute(words):
    """All runs, by comparing every word with the one q on, for every q."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, length, q) for (a, length), q in out.items()), key=lambda r: (r[0], r[2]))


def cut(text):
    return [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]


def plain(doc_id, text):
    """The query's row of one document, word by word."""
    words = cut(text)
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    start, length, q = best or (None, None, None)
    return (doc_id, len(runs), start, length, q, None if best is None else 1000 * length // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def rows(df):
    return sorted((tuple(r)[:8] for r in P.op11_periods(df).collect()), key=str)


def test_runs_by_brute_force():
    rng, found = random.Random(5), 0
    for _ in range(300):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(0, 60))]
            base = [rng.randint(0, rng.choice([1, 2, 5, 50])) for _ in range(rng.randint(1, 70))]
            words += (base * 6)[: int(len(base) * rng.uniform(1, 5.5))]
        want = brute(words)
        assert P.find_runs(np.array(words, np.int64)) == want
        found += len(want)
    assert found > 200


def test_periods_at_the_edges_of_scales():
    for q in (*range(1, 60), 100, 133, 134):
        unit = list(range(1000, 1000 + q))
        for length in (max(24, 3 * q), max(24, 3 * q) - 1, 4 * q + 3):
            words = [1, 2, 3, *(unit * 40)[:length], 4, 5]
            assert P.find_runs(np.array(words)) == brute(words)


def test_runs_with_small_periods_inside():
    words = ([0] * 30 + [1]) * 4 + [2] + ([0, 0, 1] * 12 + [5]) * 3
    assert P.find_runs(np.array(words)) == brute(words) and len(brute(words)) > 5


def test_minimizers_cover_every_window():
    x = P._mixed(np.arange(500) % 37)
    for width in (1, 2, 7, 64):
        at = set(P.minimizers(x, width).tolist())
        assert at == {i for k in range(len(x) - width + 1) for i in range(k, k + width) if x[i] == x[k : k + width].min()}


def test_query(spark, odd, none):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(table) == sorted((plain(r.doc_id, r.text) for r in table.collect()), key=str)
    cyclic = [r for r in rows(table) if r[2] is not None]
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in cyclic)
    assert rows(odd) == sorted((plain(r.doc_id, r.text) for r in odd.collect()), key=str)
    assert P.op11_periods(none).count() == 0


def test_operator_keeps_columns_and_whole_texts(spark):
    unit = " ".join(f"w{i}" for i in range(1000))
    long = " ".join([unit] * 700)
    docs = spark.createDataFrame([(1, long, "x", [7]), (2, None, "y", [8]), (2, None, "y", [8])], "doc_id long, text string, collapsed string, runs array<int>")
    got = sorted(P.with_runs(docs.withColumn("note", docs["collapsed"])).collect(), key=lambda r: r.doc_id)
    assert [(r.note, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [("x", 700_000, [(0, 700_000, 1000)], unit), ("y", 0, [], ""), ("y", 0, [], "")]
