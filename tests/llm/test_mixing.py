import math
from collections import defaultdict

import pytest
from lodgely.llm import mixing as M
from pyspark.sql import functions as F


def targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, full, left = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        out |= {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if out[s] >= most * sizes[s]]
        if not over:
            return out
        for s in over:
            out[s] = most * sizes[s]
            full.add(s)
            left -= out[s]
        if len(full) == len(names):
            return out


def test_query(docs):
    rows = M.op5_mixing(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    size, taken, target, own = defaultdict(int), defaultdict(int), {}, {}
    for r in rows:
        assert r.size == len(text[r.doc_id].encode().split()) and 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source], own[r.source] = r.target, r.source_size
    want = targets(dict(size))
    for s in size:
        assert own[s] == size[s] and target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.02 * want[s] + 20
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in M.op5_mixing(docs).collect())


def test_odd_rows(odd, none):
    rows = M.with_copies(odd).collect()
    assert len(rows) == 14 and {r.copies for r in rows if r.size == 0} == {1}
    assert {r.source_size for r in rows if r.source is None} == {8} and {r["key"] for r in rows} == {"x"}
    assert M.op5_mixing(none).count() == 0


def test_rates_solve_the_dual(spark):
    cells = [("a", s, n) for s, n in ((1, 40), (7, 9), (300, 2))] + [("b", 5, 10), ("c", 4, 3)]
    sizes = spark.createDataFrame(cells, "source string, size long, n long")
    goal = {"a": 500.0, "b": 100.0, "c": 0.0}
    total = {s: sum(z * n for x, z, n in cells if x == s) for s in goal}
    count = {s: sum(n for x, _, n in cells if x == s) for s in goal}
    sources = spark.createDataFrame([(s, total[s], count[s], goal[s]) for s in goal], "source string, source_size long, docs long, target double")
    tilt = {r.source: r.tilt for r in M.balance(sizes, sources).collect()}
    assert tilt["b"] == math.inf and tilt["c"] == -math.inf
    mean = total["a"] / count["a"]
    assert sum(n * z * min(2.0, math.exp(tilt["a"] * z / mean)) for x, z, n in cells if x == "a") == pytest.approx(500.0, rel=1e-6)


def test_rows_without_ids_fall_into_many_blocks(spark):
    docs = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "'s' as source", "concat('a b c ', id) as text").unionByName(spark.createDataFrame([(1, "t", "x " * 100_000)], "doc_id long, source string, text string"))
    got = M.with_copies(docs)
    per = got.filter("source = 's'").groupBy(F.pmod(F.xxhash64("doc_id", "text"), F.lit(256)).alias("block")).agg(F.count("*").alias("n"))
    assert got.count() == 20_001 and per.count() == 256 and per.agg(F.max("n")).first()[0] < 200
    first, again = ({r.text: r.copies for r in M.with_copies(docs.repartition(n)).filter("source = 's'").collect()} for n in (3, 11))
    assert first == again
