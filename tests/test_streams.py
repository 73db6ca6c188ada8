import random
import time
from collections import Counter
from datetime import datetime, timedelta

from lodgely.streaming import streams as S
from pyspark.sql import functions as F

DAY = datetime(2026, 1, 1)
PRICES = "key string, run_no long, at timestamp, price_vnd long"


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")


def alerts(spark, path, forget=timedelta(days=365)):
    source = spark.read.parquet(f"{path}/in")
    stream = S.price_alerts(S.files(spark, f"{path}/in", source.schema, 1), "1 day", forget)
    query = S.run_once(stream, f"{path}/out", f"{path}/state")
    return sorted(tuple(r) for r in spark.read.schema(S.ALERT).parquet(f"{path}/out").collect()), query


def plain(rows):
    """Changes of the last known price of each key, in order of time and run."""
    out, last = [], {}
    for key, run_no, at, price in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[2], r[1], -r[3])):
        if key in last and run_no <= last[key][0]:
            continue
        if key in last and last[key][1] != price:
            out.append((key, run_no, last[key][1], price))
        last[key] = (run_no, price)
    return sorted(out)


def test_alerts_of_rows_out_of_order(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{k}", run, DAY + timedelta(hours=run * 5 + k % 3), rng.choice([None, 100, 100, 200])) for k in range(12) for run in range(8)]
    rows += rows[::7]
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(hours=rng.uniform(0, 20)))
    for i in range(0, len(mixed), 40):
        put(spark, tmp_path, i, mixed[i : i + 40], PRICES)
    early, _ = alerts(spark, tmp_path)
    S.closing_row(spark.read.parquet(f"{tmp_path}/in")).write.mode("append").parquet(f"{tmp_path}/in")
    got, _ = alerts(spark, tmp_path)
    assert got == plain(rows) and len(got) > 10 and set(early) <= set(got) and len(early) < len(got)


def test_state_shrinks_when_listings_are_forgotten(spark, tmp_path):
    held = lambda q: max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:])
    put(spark, tmp_path, 0, [(f"k{k}", 1, DAY, 100) for k in range(30)], PRICES)
    put(spark, tmp_path, 1, [("k0", 2, DAY + timedelta(days=5), 150)], PRICES)
    got, query = alerts(spark, tmp_path, timedelta(days=10))
    many = held(query)
    put(spark, tmp_path, 2, [("k1", 9, DAY + timedelta(days=60), 300)], PRICES)
    put(spark, tmp_path, 3, [("k1", 10, DAY + timedelta(days=63), 310)], PRICES)
    put(spark, tmp_path, 4, [("x", 1, DAY + timedelta(days=66), None)], PRICES)
    got, query = alerts(spark, tmp_path, timedelta(days=10))
    assert got == [("k0", 2, 100, 150), ("k1", 10, 300, 310)] and held(query) < many / 5


def test_health_counts_every_request(spark, tmp_path):
    schema, rng = "source string, crawl_status string, finished_at timestamp, elapsed_ms double", random.Random(5)
    rows = [(rng.choice("ab"), rng.choice(["success", "timeout"]), DAY + timedelta(minutes=rng.uniform(0, 300)), float(k)) for k in range(400)]
    rows.sort(key=lambda r: r[2])
    late = [("a", "success", DAY + timedelta(minutes=3), 5.0), ("a", "success", DAY + timedelta(minutes=299), 7.0)]
    for batch in (rows[:200], rows[200:], late):
        put(spark, tmp_path, 0, batch, schema)
        source = spark.read.parquet(f"{tmp_path}/in")
        S.health_tables(S.files(spark, f"{tmp_path}/in", source.schema), f"{tmp_path}/t", f"{tmp_path}/state")
    key = lambda r: (r[2].replace(minute=r[2].minute // 10 * 10, second=0, microsecond=0), r[0], r[1])
    want = Counter(map(key, rows + late))
    whole = S.health_windows(spark, f"{tmp_path}/t", closing=True).collect()
    assert {(r.start, r.source, r.crawl_status): r.requests for r in whole} == want and sum(r.late for r in whole) == 1
    assert [tuple(r)[:4] for r in S.late_requests(spark, f"{tmp_path}/t").collect()] == [late[0]]
    newest = max(r[2] for r in rows + late)
    closed = {k: n for k, n in want.items() if k[0] + timedelta(minutes=10) <= newest - timedelta(minutes=10)}
    assert {(r.start, r.source, r.crawl_status): r.requests for r in S.health_windows(spark, f"{tmp_path}/t").collect()} == closed
    mean = {k: sum(r[3] for r in rows + late if key(r) == k) / n for k, n in want.items()}
    assert all(abs(r.mean_ms - mean[r.start, r.source, r.crawl_status]) < 1e-6 for r in whole)
    parts = spark.read.parquet(f"{tmp_path}/t/parts/batch=1")
    parts.withColumn("requests", F.col("requests")).write.mode("overwrite").parquet(f"{tmp_path}/again")
    spark.read.parquet(f"{tmp_path}/again").write.mode("overwrite").parquet(f"{tmp_path}/t/parts/batch=1")
    assert S.health_windows(spark, f"{tmp_path}/t", closing=True).agg(F.sum("requests")).first()[0] == 402


def forgetful(rows, forget):
    out, last = [], {}
    for key, run_no, at, price in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[2], r[1], -r[3])):
        if key in last and at - last[key][2] >= forget:
            del last[key]
        if key in last and run_no <= last[key][0]:
            continue
        if key in last and last[key][1] != price:
            out.append((key, run_no, last[key][1], price))
        last[key] = (run_no, price, at)
    return sorted(out)


def test_alert_tables_batch_by_batch(spark, tmp_path):
    """As price_alerts(), in batches that come out of order, with listings that are forgotten and a batch that is done again; and many listings in short time."""
    rng = random.Random(12)
    rows = [(f"k{k}", run, DAY + timedelta(hours=run * 5 + k % 3 + (400 if run > 5 and k % 4 == 0 else 0)), rng.choice([None, 100, 100, 200])) for k in range(12) for run in range(9)]
    rows += rows[::7]
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(hours=rng.uniform(0, 20)))
    took = lambda: S.alert_tables(S.files(spark, f"{tmp_path}/in", PRICES, 1), f"{tmp_path}/t", f"{tmp_path}/state", "1 day", timedelta(days=10))
    told = lambda: sorted(tuple(r) for r in S.told_alerts(spark, f"{tmp_path}/t").collect())
    for i in range(0, len(mixed), 50):
        put(spark, tmp_path, i, mixed[i : i + 50], PRICES)
        took()
    early = told()
    late = ("k0", 99, DAY, 777)
    put(spark, tmp_path, 0, [late], PRICES)
    S.closing_row(spark.read.parquet(f"{tmp_path}/in")).write.mode("append").parquet(f"{tmp_path}/in")
    took()
    want = forgetful(rows, timedelta(days=10))
    assert told() == want and len(want) > 10 and set(early) < set(want) and want != plain(rows)
    many = spark.range(20_000).selectExpr("cast(id as string) as key", "explode(array(1L, 2L)) as run_no").selectExpr("key", "run_no", "timestamp_seconds(1767225600 + run_no * 60) as at", "run_no * 100 as price_vnd")
    many.write.parquet(f"{tmp_path}/many")
    S.closing_row(spark.read.parquet(f"{tmp_path}/many")).write.mode("append").parquet(f"{tmp_path}/many")
    began = time.monotonic()
    S.alert_tables(S.files(spark, f"{tmp_path}/many", PRICES), f"{tmp_path}/m", f"{tmp_path}/mstate")
    assert S.told_alerts(spark, f"{tmp_path}/m").count() == 20_000 and time.monotonic() - began < 30
