import math
import random
from datetime import date, timedelta

from lodgely.operators import density as D
from lodgely.operators import gold, history
from lodgely.operators import sketches as K
from pyspark.sql import functions as F


def ranks_of(values, x):
    return sum(v < x for v in values) / len(values), sum(v <= x for v in values) / len(values)


def test_sketched_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), date(2026, 1, 1) + timedelta(days=min(int(rng.expovariate(0.02)), 400)), int(rng.lognormvariate(15, 0.5))) for _ in range(12_000)]
    df = spark.createDataFrame(rows, "district string, day date, price_vnd long")
    table = K.quantile_table(df.unionByName(df.limit(5).withColumn("price_vnd", F.lit(None).cast("long"))), ["district", "day"])
    of = lambda d: [r[2] for r in rows if r[0] == d]
    for r in K.merged(table, ["district"]).select("district", "n", *[K.quantile(q).alias(str(q)) for q in (0.05, 0.25, 0.5, 0.75, 0.95)]).collect():
        assert r.n == len(of(r.district))
        for q in (0.05, 0.25, 0.5, 0.75, 0.95):
            low, high = ranks_of(of(r.district), r[str(q)])
            assert low - 0.012 <= q <= high + 0.012
    got = K.rolling_quantiles(table, 30, (0.25, 0.5)).collect()
    assert len(got) == len({(r[0], r[1]) for r in rows})
    for r in rng.sample(got, 80):
        recent = [v for d, day, v in rows if d == r.district and r.day - timedelta(days=29) <= day <= r.day]
        assert r.n == len(recent)
        for q, x in zip((0.25, 0.5), r.recent):
            low, high = ranks_of(recent, x)
            assert low - 0.012 <= q <= high + 0.012 + 1 / len(recent)
    for days in (1, 2, 7, 31):
        short = K.rolling_quantiles(table, days).collect()
        assert all(r.n == sum(1 for d, day, _ in rows if d == r.district and r.day - timedelta(days=days - 1) <= day <= r.day) for r in rng.sample(short, 20))
    exact = {(r.district, r.day, r.price_vnd): r.price_percentile for r in gold.with_percentile(df).collect()}
    assert all(abs(r.price_percentile - exact[r.district, r.day, r.price_vnd]) < 0.015 for r in K.with_sketched_percentile(df).collect())
    a, b = ({tuple(r)[:3] for r in out.filter("is_outlier").select("district", "day", "price_vnd").collect()} for out in (gold.with_outlier(df), K.with_sketched_outlier(df)))
    assert len(a ^ b) <= 0.2 * len(a) and len(a) > 50


def test_z_scores(spark):
    rows = [("a", 100 + k % 5) for k in range(60)] + [("a", 1000), (None, 7), (None, None), ("b", 5)]
    got = gold.with_outlier(spark.createDataFrame(rows, "district string, price_vnd long"), "z").filter("is_outlier").collect()
    assert [(r.district, r.price_vnd) for r in got] == [("a", 1000)]


def test_clusters_keep_rows_that_have_no_numbers(spark):
    rows = [(i, 1.0 + i % 7 * 0.01, 10.0) for i in range(70)] + [(i, 9.0, 500.0 + i % 5) for i in range(70, 140)] + [(200, None, 10.0), (201, 9.0, None), (202, float("nan"), 10.0)]
    got = {r.i: r.cluster for r in gold.clusters(spark.createDataFrame(rows, "i int, a double, b double"), ["a", "b"], k=2).collect()}
    assert set(got) == {r[0] for r in rows} and [got[i] for i in (200, 201, 202)] == [None] * 3
    assert {len({got[i] for i in part}) for part in (range(70), range(70, 140))} == {1} and got[0] != got[100]


def test_distinct_sketches(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("run"), F.when(F.col("id") % 3 == 0, F.col("id") % 20_000).otherwise(F.col("id") % 20_000 + 5_000 * (F.col("id") % 3)).alias("listing"))
    exact = {r.run: {x.listing for x in df.filter(f"run = {r.run}").select("listing").collect()} for r in df.select("run").distinct().collect()}
    table = K.distinct_table(df, ["run"], "listing")
    whole = K.distinct_over(table, []).first()
    assert whole.rows == 60_000 and abs(whole.distinct - len(set().union(*exact.values()))) < 0.02 * whole.distinct
    for r in K.distinct_changes(table, "run").collect():
        now, before = exact[r.run], exact.get(r.run - 1)
        assert abs(r["values"] - len(now)) <= 0.03 * len(now)
        if before is None:
            assert r.kept is None
        else:
            for got, want in ((r.kept, now & before), (r.gained, now - before), (r.lost, before - now)):
                assert abs(got - len(want)) <= 0.03 * len(now | before)


def test_density_clusters_by_brute_force(spark):
    rng = random.Random(9)
    spots = [(rng.choice([1.0, 1.45, 3.0]) + rng.gauss(0, 0.12), rng.choice([-2.0, 0.5]) + rng.gauss(0, 0.12), rng.randint(1, 9)) for _ in range(500)] + [(rng.uniform(-5, 5), rng.uniform(-5, 5), 1) for _ in range(100)]
    df = spark.createDataFrame(spots + [(None, 1.0, 1)], "lat double, lon double, price_vnd long")
    cells = {}
    for lat, lon, _ in spots:
        c = (math.floor(lat / 0.1), math.floor(lon / 0.1))
        cells[c] = cells.get(c, 0) + 1
    around = lambda c: [(c[0] + y, c[1] + x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    near = {c: sum(cells.get(a, 0) for a in around(c)) for c in cells}
    dense = {c for c in cells if near[c] >= 15}
    name = {c: f"{c[0]}:{c[1]}" for c in dense}
    for _ in dense:
        name = {c: min(name[a] for a in around(c) if a in dense) for c in dense}
    got = D.density_clusters(df, 0.1, 15, F.col("price_vnd") <= 3)
    assert {(r.cell_y, r.cell_x): (r.listings, r.near, r.cluster) for r in got.collect()} == {c: (cells[c], near[c], name[c]) for c in dense} and len(set(name.values())) > 2
    areas = D.hotspot_areas(got, 0.1).collect()
    assert {r.cluster: r.cells for r in areas} == {n: sum(v == n for v in name.values()) for n in name.values()}
    assert all(r.south < r.north and r.west < r.east and 0 <= r.marked_share <= 1 for r in areas)


def test_nearest_by_brute_force(spark):
    rng = random.Random(11)

    def km(a, b):
        x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(x)))

    spots = [(k, 10 + rng.gauss(0, 0.05), 106 + rng.gauss(0, 0.05)) for k in range(200)] + [(200 + k, rng.uniform(-80, 80), rng.uniform(-180, 180)) for k in range(6)] + [(300, 10.0, 106.0), (301, 10.0, 106.0)]
    points = [(0, 10.0, 106.0), (1, 10.3, 106.2), (2, -60.0, -179.9), (3, 89.0, 10.0)]
    df = spark.createDataFrame(spots + [(400, None, 1.0)], "listing_id long, lat double, lon double")
    p = spark.createDataFrame(points + [(9, None, 1.0)], "point_id int, point_lat double, point_lon double")
    for k, some in ((5, spots), (300, spots[:40])):
        own = df.join(spark.createDataFrame([(s[0],) for s in some], "listing_id long"), "listing_id", "left_semi")
        got = {i: [r.listing_id for r in sorted(D.nearest(own, p, k).collect(), key=lambda r: r["rank"]) if r.point_id == i] for i in range(4)}
        assert got == {i: [s[0] for s in sorted(some, key=lambda s: (round(km((lat, lon), s[1:]), 9), s[0]))[:k]] for i, lat, lon in points}
    assert D.nearest(df.limit(0), p, 3).count() == 0
    priced = df.withColumns({"price_vnd": F.col("listing_id"), "area_m2": F.col("listing_id").cast("double")})
    assert {r.listing_id for r in D.best_matches(priced, p.filter("point_id = 0"), 400, 150, 100.0).collect()} == set(range(100, 151))


def test_history_run_by_run_equals_one_pass(spark):
    rng, rows = random.Random(4), []
    for key in (*range(25), None):
        for run in range(1, 9):
            if rng.random() < 0.7:
                rows.append((key, run, rng.choice([None, 100, 200]), rng.choice(["x", "y"]) if rng.random() < 0.3 else "x"))
    df = spark.createDataFrame(rows, "key int, run_no int, price long, title string")
    want = []
    for key in (*range(25), None):
        own = {r[1]: r[2:] for r in rows if r[0] == key}
        for run in range(1, 9):
            if run in own:
                if run - 1 in own and own[run - 1] == own[run]:
                    want[-1][4] = run
                    want[-1][5] += 1
                else:
                    want.append([key, *own[run], run, run, 1])
    key = lambda r: [(x is None, str(x)) for x in r]
    told = lambda h: sorted(([r["key"], r.price, r.title, r.first_run, r.last_run, r.seen] for r in h.collect()), key=key)
    values = ["price", "title"]
    assert told(history.intervals(df, ["key"], "run_no", values)) == sorted(want, key=key)
    so_far = history.intervals(df.filter("run_no = 1"), ["key"], "run_no", values)
    for run in range(2, 9):
        new = df.filter(f"run_no = {run}").drop("run_no")
        so_far = spark.createDataFrame(history.extend(so_far, new, ["key"], run, values).collect(), so_far.schema)
    assert told(so_far) == sorted(want, key=key)
    assert told(history.extend(so_far, new, ["key"], 8, values)) == sorted(want, key=key)
    assert {(r["key"], r.price) for r in history.as_of(so_far, 5).collect()} == {(r[0], r[2]) for r in rows if r[1] == 5}
    twice = df.unionByName(df.withColumn("price", F.lit(7).cast("long")))
    assert history.once(twice, ["key"], "run_no", values, ["price"]).count() == len(rows)


def test_counts_give_exact_quantiles(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), date(2026, 1, 1) + timedelta(days=min(int(rng.expovariate(0.02)), 400)), int(rng.lognormvariate(15, 0.5))) for _ in range(9_000)]
    table = K.count_table(spark.createDataFrame([*rows, ("a", date(2026, 1, 1), None)], "district string, day date, price_vnd long"), ["district", "day"])
    ranks = (0.0, 0.25, 0.5, 0.75, 1.0)
    want = lambda own: [sorted(own)[max(math.ceil(q * len(own)), 1) - 1] for q in ranks]
    of = lambda d: [r[2] for r in rows if r[0] == d]
    assert {r.district: (r.n, r.quantiles) for r in K.exact_quantiles(table, ["district"], ranks).collect()} == {d: (len(of(d)), want(of(d))) for d in ("a", "b", None)}
    got = K.exact_rolling(table, 30, ranks).collect()
    assert len(got) == len({(r[0], r[1]) for r in rows})
    for r in rng.sample(got, 80):
        recent = [v for d, day, v in rows if d == r.district and r.day - timedelta(days=29) <= day <= r.day]
        assert (r.n, r.recent) == (len(recent), want(recent))


def test_run_changes_are_exact(spark):
    """More listings than a sketch of 2^16 entries holds, a row met twice, and no run 4."""
    spans = {1: range(100_000), 2: range(30_000, 130_000), 3: range(50_001, 150_000), 5: range(60_000, 150_000)}
    df = spark.range(150_000).selectExpr("id as listing_id", "explode(array(1, 2, 3, 5)) as run_no").filter(" or ".join(f"(run_no = {run} and listing_id >= {x.start} and listing_id < {x.stop})" for run, x in spans.items()))
    sets = {run: set(x) for run, x in spans.items()}
    got = {r.run_no: tuple(r)[1:] for r in history.run_changes(df.unionByName(df.limit(10))).collect()}
    want = {run: (len(own), *((len(own & sets[run - 1]), len(own - sets[run - 1]), len(sets[run - 1] - own)) if run - 1 in sets else (None,) * 3)) for run, own in sets.items()}
    assert got == want


def test_clusters_read_their_input_once_and_weigh_equal_rows(spark):
    """Copies weigh as much as rows, and the input is made once, whatever the number of iterations."""
    made = spark.sparkContext.accumulator(0)
    spots = [(1.0, 1.0, 50), (1.2, 1.1, 40), (9.0, 7.0, 30), (9.1, 7.3, 30), (5.0, 30.0, 20)]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a, b, n in spots for _ in range(n))]

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "i int, a double, b double")
    got = gold.clusters(df.mapInArrow(count, df.schema), ["a", "b"], k=3).collect()
    assert made.value == len(rows) == len(got)
    by = {}
    for r in got:
        by.setdefault(r.cluster, set()).add((r.a, r.b))
    assert sorted(map(sorted, by.values())) == [[(1.0, 1.0), (1.2, 1.1)], [(5.0, 30.0)], [(9.0, 7.0), (9.1, 7.3)]]
