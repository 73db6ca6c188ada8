import hashlib

import pytest
from lodgely.llm import syncmers as S
from pyspark.sql import functions as F


def test_edits(docs, odd, none):
    for table in (docs, odd.filter("doc_id is not null")):
        rows = sorted({(r.doc_id, r.text or "") for r in table.collect()}, key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest()))
        want = {}
        for k, (i, t) in enumerate(rows):
            q = len(t) // 4
            want[i, len(t)] = hashlib.sha256((t[: len(t) - q] + rows[(k + 1) % len(rows)][1][:q]).encode()).hexdigest()
        got = S.op6_syncmers(table).collect()
        assert len(got) == table.count()
        assert {(r.doc_id, r.n_chars): r.edited_sha256 for r in got} == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert S.op6_syncmers(odd).count() == 14 and S.op6_syncmers(none).count() == 0


def test_anchors_by_brute_force(spark, odd):
    rows = odd.filter("doc_id is not null").select("doc_id", "text", S.anchors().alias("a"), F.expr("transform(filter(split(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w))").alias("h")).collect()
    pairs = spark.createDataFrame([(i, k, h, g) for i, r in enumerate(rows) for k, (h, g) in enumerate(zip(r.h, r.h[1:]))], "i int, k int, h long, g long").select("i", "k", F.xxhash64("h", "g").alias("b")).collect()
    grams = {(p.i, p.k): p.b for p in pairs}
    for i, r in enumerate(rows):
        n = len(r.h)
        if n == 0:
            assert r.a == []
        elif n < 5:
            assert [x.position for x in r.a] == [0]
        else:
            b = [grams[i, k] for k in range(n - 1)]
            assert [x.position for x in r.a] == [k for k in range(n - 4) if min(b[k], b[k + 3]) <= min(b[k + 1 : k + 3])]


def test_likeness(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], []), (list(range(100)), list(range(50, 150)))], "a array<long>, b array<long>")
    assert [r.x for r in df.select(S.likeness("a", "b").alias("x")).collect()] == pytest.approx([0.5, 1.0, 0.0, 50 / 150])


def test_likeness_is_that_of_the_fingerprint_columns(docs, odd):
    """near_edited and near_next by the returned fingerprints alone; these by the anchors of texts that Python edits."""
    for table in (docs, odd.filter("doc_id is not null")):
        rows = sorted({(r.doc_id, r.text or "") for r in table.collect()}, key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest()))
        edits = [(i, t, t[: len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][: len(t) // 4], rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]
        prints = {}
        for r in table.sparkSession.createDataFrame(sorted({(t,) for e in edits for t in e[1:]}), "text string").select("text", S.anchors().alias("a")).collect():
            prints[r.text] = "".join(f"{h % 2**64:016x}" for h in sorted({x.hash for x in r.a}))
        want = {(i, len(t)): (prints[t], prints[e], prints[n]) for i, t, e, n in edits}
        cut = lambda p: {p[k : k + 16] for k in range(0, len(p), 16)}
        alike = lambda a, b: len(cut(a) & cut(b)) / len(cut(a) | cut(b)) if a or b else 1.0
        for r in S.op6_syncmers(table).collect():
            own, edited, following = want[r.doc_id, r.n_chars]
            assert (r.fingerprint, r.edited_fingerprint) == (own, edited)
            assert r.near_edited == pytest.approx(alike(own, edited)) and r.near_next == pytest.approx(alike(own, following)) and 0 <= r.near_placed <= 1


def test_matches(spark):
    words = [f"w{i}" for i in range(60)]
    a = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    b = spark.createDataFrame([(2, " ".join(["x", "y", "z"] + words[10:50]))], "doc_id long, text string")
    best = S.matches(a, b).orderBy(F.desc("anchors")).first()
    assert best.shift == -7 and best["first"] >= 10 and best["last"] <= 49 and best.anchors >= 10


def test_equal_texts_are_alike(docs):
    got = S.op6_syncmers(docs).join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.count_distinct("fingerprint").alias("n"))
    assert got.filter("n > 1").count() == 0


def test_a_short_shared_passage_of_long_texts_counts(spark):
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([f"{n}{i}" for i in range(3000)] + passage + [f"{n}{i}" for i in range(3000, 6000)]) for n in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{x.hash for x in r.a} for r in docs.orderBy("doc_id").select(S.anchors().alias("a")).collect()]
    both = len(sets[0] & sets[1])
    assert both > 5
    for r in S.op6_syncmers(docs).collect():
        assert r.near_next == pytest.approx(both / len(sets[0] | sets[1])) and 0.5 < r.near_placed < 0.65
        assert len(r.fingerprint) == 16 * len(sets[r.doc_id])


def test_matches_find_a_repeated_passage_at_each_place(spark):
    words = [f"w{i}" for i in range(40)]
    a = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    b = spark.createDataFrame([(2, " ".join(words + ["x", "y", "z"] + words))], "doc_id long, text string")
    assert {r.shift: r.anchors for r in S.matches(a, b).collect() if r.anchors > 5}.keys() == {0, 43}
