"""Every registered query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from lodgely.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, sf, db, name):
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cur = db.execute(Q.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in cur.fetchall()]
    assert ordered(df.select(columns).collect()) == ordered(want)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_near_dup_equals_brute_force(spark, sf):
    from lodgely.operators import silver

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    classes = {r["key"]: set(r.words) for r in silver.word_classes(docs, "text", "doc_id").filter("key = class").collect() if r.words}
    want = {(a, b) for a in classes for b in classes if a < b and len(classes[a] & classes[b]) / len(classes[a] | classes[b]) >= 0.8}
    assert {(r.a, r.b) for r in silver.near_dup(docs, "text", "doc_id").collect()} == want


def test_near_dup_of_sets_of_all_sizes(spark):
    """Edited copies of sets from one word to 90, with common and rare words, against all pairs."""
    import random

    from lodgely.operators import silver

    rng, rows = random.Random(8), []
    for n in (1, 2, 3, 4, 5, 7, 9, 10, 11, 19, 20, 29, 31, 45, 90):
        for _ in range(6):
            words = [f"c{rng.randrange(12)}" if rng.random() < 0.3 else f"r{rng.randrange(3000)}" for _ in range(n)]
            for _ in range(5):
                own = [w if rng.random() > rng.choice([0, 0.05, 0.1, 0.15]) else f"e{rng.randrange(40)}" for w in words]
                rng.shuffle(own)
                rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame([*rows, (len(rows), None), (len(rows) + 1, " . ")], "doc_id long, text string")
    sets = {}
    for i, text in rows:
        sets.setdefault(frozenset(text.split()), i)
    likeness = lambda x, y: len(x & y) / len(x | y)
    for t in (0.8, 0.6):
        want = {(sets[x], sets[y]): likeness(x, y) for x in sets for y in sets if sets[x] < sets[y] and likeness(x, y) >= t}
        assert {(r.a, r.b): r.similarity for r in silver.near_dup(docs, "text", "doc_id", t).collect()} == want and len(want) > 100
    links = {r["key"]: r.links for r in silver.near_classes(docs, "text", "doc_id", 0.6).collect()}
    assert len(links) == len(docs.collect()) and all(links[i] == sum(i in p for p in want) for i in sets.values())


def test_near_dup_puts_words_in_order_without_a_shuffle(spark):
    from lodgely.operators import silver

    rows = [(i, [f"w{i}", f"p{i // 2}", "the", "of"]) for i in range(100)]
    df = spark.createDataFrame(rows, "key long, words array<string>")
    rare = silver.rare_words(df, 0.5)
    assert "Exchange" not in rare._jdf.queryExecution().executedPlan().toString()
    got = {r["key"]: r for r in rare.collect()}
    assert all(len(got[i].hashes) in (1, 2) and got[i].hashes[0] == got[i ^ 1].hashes[0] for i in range(100))
