import math
import random

import duckdb
import numpy as np
from lodgely.llm import bond as B
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def plain(rows):
    """The query row by row: (anchor, positive, rank, negative, positive score, negative score)."""
    good = [[i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]] for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, y, v) in enumerate(good):
        if i % 50:
            continue
        others = [(sum(a * b for a, b in zip(v, w)), j, z) for m, (j, z, w) in enumerate(good) if m != k and len(w) == len(v)]
        others.sort(key=lambda s: (-s[0], s[1]))
        for p, j, z in [s for s in others if s[2] == y][:5]:
            fits = [s for s in others if s[2] != y and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(i, j, n, m, p, s) for n, (s, m, _) in enumerate(fits, 1)]
    return sorted(out)


def query(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(tuple(r)[:6] for r in B.op12_bond(df).collect())


def test_random_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(size=16) * 0.4], int(i % 6 % 3)) for i in rng.permutation(700)]
    got = query(spark, rows)
    assert got == plain(rows) and len(got) > 50


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (50, [1.0, 0.5], 2), (50, [0.5, 1.0], 2), (None, [9.0, 9.0], 2), (3, None, 2), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 1), (8, [1.0, 1.0], None),
        (9, [1.0, 1.0, 1.0], 1), (7, [0.7, 0.7], 1), (14, [0.7, 0.7], 1), (15, [0.7, 0.7], 3), (16, [0.7, 0.7], 3), (17, [0.6, 0.2], 3), (17, [0.6, 0.2], 3), (18, [-1.0, 0.0], 2), (100, [], 4), (101, [], 4), (102, [], 5), (150, [0.0, 0.0], 3),
    ]
    assert query(spark, rows) == plain(rows)
    assert B.op12_bond(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_and_a_label_with_most_rows(spark):
    rng = random.Random(4)
    rows = [(i, [1.0, 0.25, 0.0, -0.5], 1) for i in range(300)] + [(300 + i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)], 1 if i % 3 else 2) for i in range(400)]
    assert query(spark, rows) == plain(rows)


def test_scan_with_several_blocks_and_large_numbers(spark, monkeypatch):
    rng = np.random.default_rng(8)
    for scale in (3, 5000, 1 << 20, 1 << 30):
        x, labels, ids = rng.integers(-scale, scale, (200, 6)), rng.integers(0, 3, 200), rng.permutation(200)
        blocks = [B.Block(ids[k : k + 60], labels[k : k + 60], x[k : k + 60]) for k in range(0, 200, 60)]
        for row in range(0, 200, 20):
            scores = [sum(a * b for a, b in zip(x[row].tolist(), y)) for y in x.tolist()]
            order = sorted(range(200), key=lambda r: (-scores[r], ids[r]))
            want = [(ids[r], scores[r]) for r in order if labels[r] == 1][:6]
            assert list(zip(*(c.tolist() for c in B.nearest_alike(blocks, x[row], 1, 6)))) == want
            top = max(scores)
            windows = [(top // 2, top * 95 // 100), (0, top // 3), (5, 4)]
            for (lo, hi), (i, s) in zip(windows, B.in_windows(blocks, x[row], 1, windows, 3)):
                assert list(zip(i.tolist(), s.tolist())) == [(ids[r], scores[r]) for r in order if labels[r] != 1 and lo <= scores[r] <= hi][:3]


def test_bounds_drop_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64)) * 2
    x[:, 0] += np.where(np.arange(4000) % 10 == 0, 300, 0)
    block, seen = B.Block(np.arange(4000), np.zeros(4000, int), x.astype(np.int64)), []

    def goal(least, largest):
        seen.append(len(least))
        return largest >= B._kth(least, 5)

    anchor = np.zeros(64, np.int64)
    anchor[0], anchor[5] = 300, 2
    at, _ = B.vertical_scan(block, anchor, np.arange(4000), goal)
    assert seen[0] == 4000 and seen[1] <= 400 and len(at) < 50


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{sf}/embeddings.parquet'")
    got = con.execute(B.ORACLE_SQL)
    names = [c[0] for c in got.description]
    df = B.op12_bond(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert sorted(got.fetchall()) == sorted(tuple(r) for r in df.select(names).collect()) and set(names) == set(df.columns)


def test_one_row_of_each_rank(spark):
    df = B.hard_negatives(spark.range(40).select("id", (F.col("id") % 4).alias("label"), F.array(F.col("id"), F.lit(3).cast("long")).alias("vector")), F.col("id") < 5, 2, 2, 10, 100)
    rows = df.collect()
    assert rows and len({(r.anchor_id, r.positive_id, r["rank"]) for r in rows}) == len(rows) and {r.positive_rank for r in rows} == {1, 2}
