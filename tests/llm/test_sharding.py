import zlib
from collections import Counter, defaultdict

from lodgely.llm import sharding as S
from pyspark.sql import functions as F


def check(rows, shards):
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(docs, odd, none):
    rows = S.op2_sharding(docs).collect()
    assert len(rows) == docs.count()
    check(rows, 24)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.grown_shard is None for r in rows)
    rows = S.op2_sharding(odd).collect()
    assert len(rows) == 14 and {r.size for r in rows if r.doc_id in (3, 4)} == {8}
    check(rows, 24)
    assert S.op2_sharding(none).count() == 0


def test_groups_stay_together(spark):
    rows = spark.range(2400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 20)).otherwise(-F.col("id")).cast("string").cast("binary").alias("key"))
    got = S.shard(rows, 8).collect()
    check(got, 8)
    parts = defaultdict(set)
    for r in got:
        parts[bytes(r.key)].add(r.shard)
    linked = [p for k, p in parts.items() if not k.startswith(b"-")]
    assert sum(len(p) > 1 for p in linked) <= 0.15 * len(linked)


def test_hot_group_is_spread_over_few(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "hot").otherwise(F.col("id").cast("string")).cast("binary").alias("key"))
    got = S.shard(rows, 10).collect()
    check(got, 10)
    hot = Counter(r.shard for r in got if bytes(r.key) == b"hot")
    assert sum(hot.values()) == 1000 and sum(n for _, n in hot.most_common(5)) >= 700


def cut(where, links):
    return sum(w for a, b, w in links if where[a] != where[b])


def test_edges_pull_neighbours_together(spark):
    """Rings of 50 documents with different texts, and weak links between them: the rings stay whole but for some at the cuts."""
    import random

    rng = random.Random(3)
    links = [(f"{g}:{i}", f"{g}:{(i + d) % 50}", 1.0) for g in range(16) for i in range(50) for d in (1, 2, 3)]
    links += [(f"{rng.randrange(16)}:{rng.randrange(50)}", f"{rng.randrange(16)}:{rng.randrange(50)}", 0.2) for _ in range(100)]
    names = [f"{g}:{i}" for g in range(16) for i in range(50)]
    rows = spark.createDataFrame(list(enumerate(names)), "doc_id long, name string").select("doc_id", F.col("name").cast("binary").alias("key"))
    edges = spark.createDataFrame(links, "a string, b string, weight double").select(F.col("a").cast("binary").alias("a"), F.col("b").cast("binary").alias("b"), "weight")
    got = S.shard(rows, 4, edges=edges)
    check(got.collect(), 4)
    where = {bytes(r.key).decode(): r.shard for r in got.collect()}
    plain = {bytes(r.key).decode(): r.shard for r in S.shard(rows, 4).collect()}
    summed = [(a, b, w) for a, b, w in links if a != b]
    told = S.cut_edges(got.select("key", "shard"), edges).first()
    assert abs(told.cut - cut(where, summed)) < 1e-6 and abs(told.total - sum(w for _, _, w in summed)) < 1e-6
    assert cut(where, summed) < 0.75 * cut(plain, summed)


def test_cut_of_copies_against_the_least_possible(spark):
    """Groups of equal texts that fit in shards: no assignment cuts less than none; a random one cuts three quarters."""
    rows = spark.range(800).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, F.floor(F.col("id") / 10)).otherwise(-F.col("id")).cast("string").cast("binary").alias("key"))
    got = S.shard(rows, 4)
    after = S.cut_edges(got.select("key", "shard")).first()
    before = S.cut_edges(rows.select("key", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).alias("shard"))).first()
    where = {r.doc_id: r.shard for r in got.collect()}
    assert after.total == 40 * 45 and after.cut == sum(where[i] != where[j] for i in range(400) for j in range(i) if i // 10 == j // 10)
    assert before.cut > 0.7 * before.total and after.cut < 0.15 * after.total


def test_rows_without_ids_start_in_all_shards(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.md5(F.col("id").cast("string")).cast("binary").alias("key"))
    starts = rows.groupBy(F.pmod(S.row_hash(1), F.lit(8)).alias("start")).count().collect()
    assert len(starts) == 8 and max(r["count"] for r in starts) < 3000
    got = S.shard(rows, 8)
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [2500] * 8 and got.select("shard", "slot").distinct().count() == 20_000
