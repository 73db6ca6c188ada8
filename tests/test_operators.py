"""Small tables through the operators."""

import json
import math
import random

from pyspark.sql import functions as F

from lodgely import schemas
from lodgely.operators import bronze, extract, gold, runs, silver
from lodgely.sources import lake

PAGE = """<html><body><nav><a href="/login">x</a></nav><main>
<div class="adItem_WRAPPER x"><a href="/thue/1.htm#a"><h3>Phòng số một</h3></a><span class="price">3 triệu</span><p>Quận Tân Bình, TP.HCM</p><img data-src="a.jpg"></div>
<div class="AdItem_wrapper"><a href="/thue/1.htm">again</a><h3>Phòng số một</h3></div>
<div class="AdItem_wrapper"><a href="/dashboard"><h3>Menu item</h3></a></div>
<div class="AdItem_wrapper"><a href="#">no link</a></div>
<div class="AdItem_wrapper"><a href="/thue/2.htm">b</a><h4>ab</h4>25 m²</div>
<div class="AdItem_wrapper"><a href="/thue/3.htm"><div class="AdItem_wrapper"><a href="/thue/4.htm">in</a></div></a><i class="title">Tin ưu tiên 2 Nhà nhỏ</i></div>
</main></body></html>"""


def test_cards(spark):
    pages = spark.createDataFrame([("https://s.vn/list", PAGE, 1, "r"), ("https://s.vn/none", None, 2, "r"), ("https://s.vn/bad", "<div <<", 3, "r")], "url string, html string, page_number int, run_id string")
    got = extract.cards(pages).orderBy("card_position").collect()
    assert [(r.detail_url, r.title_raw, r.price_raw, r.card_position) for r in got] == [("https://s.vn/thue/1.htm", "Phòng số một", "3 triệu", 1), ("https://s.vn/thue/3.htm", "Nhà nhỏ", None, 6)]
    assert got[0].location_raw == "Quận Tân Bình, TP.HCM" and got[0].thumbnail_url_raw == "https://s.vn/a.jpg" and got[0].listing_id == "1"
    assert [r.card_position for r in extract.cards(pages, limit=1).collect()] == [1]


def test_extraction_counters(spark):
    pages = spark.createDataFrame([("https://s.vn/list", PAGE, 1, "r"), ("https://s.vn/none", None, 2, "r"), ("https://s.vn/bare", "<p>x</p>", None, None)], "url string, html string, page_number int, run_id string")
    found = extract.candidates(pages)
    counts = lambda limit: {r.page_url: (r.seen, r.extracted, r.repeated, r.kept) for r in runs.extraction_stats(found, limit).collect()}
    assert counts(50) == {"https://s.vn/list": (6, 3, 1, 2), "https://s.vn/none": (0, 0, 0, 0), "https://s.vn/bare": (0, 0, 0, 0)}
    assert counts(1)["https://s.vn/list"] == (6, 1, 0, 1)


def test_card_fallbacks(spark):
    by_id = '<main><article data-testid="ad-item"><a href="/x/1.htm"><h3>Phòng một</h3></a></article><div data-testid="AD-ITEM"><a href="/x/2.htm"><h3>Phòng hai</h3></a></div></main>'
    by_link = '<main><ul><li><a href="/thue-phong/3.htm">Phòng ba</a><h3>Phòng ba</h3></li><span><a href="/thue-phong/4.htm"><h3>Phòng bốn</h3></a></span></ul><a href="/mua/5.htm">no</a></main>'
    pages = spark.createDataFrame([("https://s.vn/a", by_id, 1, "r"), ("https://s.vn/b", by_link, 2, "r")], "url string, html string, page_number int, run_id string")
    assert sorted((r.page_number, r.listing_id, r.title_raw, r.card_position) for r in extract.cards(pages).collect()) == [(1, "1", "Phòng một", 1), (1, "2", "Phòng hai", 2), (2, "3", "Phòng ba", 1), (2, "4", "Phòng bốn", 2)]


def test_a_lost_attempt_changes_no_run(spark, tmp_path):
    path = str(tmp_path / "lake")
    keyed = lambda rows, schema: spark.createDataFrame(rows, schema).withColumns({"source": F.lit("s"), "ingest_date": F.lit("2026-01-01").cast("date"), "run_id": F.lit("r")})
    read = lambda: ([r.v for r in lake.read_run(spark, path, "listings", "v string").collect()], [r.u for r in lake.read_run(spark, path, "metadata", "u string").collect()], [r.n for r in lake.read_run(spark, path, "manifest", "n int").collect()])
    none = keyed([], "n int")
    lake.commit_run(keyed([("x",)], "v string"), keyed([("p",)], "u string"), keyed([(1,)], "n int"), path, "a")
    lake.commit_run(keyed([("y",)], "v string"), keyed([("q",)], "u string"), none, path, "b")
    assert read() == (["x"], ["p"], [1])
    lake.commit_run(keyed([("y",)], "v string"), keyed([("q",)], "u string"), keyed([(2,)], "n int"), path, "b")
    assert read() == (["y"], ["q"], [2])


def test_details(spark):
    html = '<h1>Tiêu đề</h1><div class="AdDecription_price">2,5 tr</div><div class="amenity-item">Bếp</div><div class="amenity-item">Bếp</div><img src="//cdn.x/1.png"><img src="data:x"><img src="/y.png"><div class="date"> </div>'
    pages = spark.createDataFrame([("q1", "https://s.vn/9.htm", html), ("q2", "https://s.vn/8.htm", "")], "request_url string, url string, html string")
    a, b = extract.details(pages).orderBy("request_url").collect()
    assert (a.title_raw, a.price_raw, a.amenities_raw, a.image_urls_raw, a.posted_at_raw, a.listing_id) == ("Tiêu đề", "2,5 tr", ["Bếp"], ["https://cdn.x/1.png"], None, "9")
    assert (b.listing_id, b.title_raw, b.image_urls_raw) == ("8", None, [])


def test_sql_table_function(spark):
    extract.register(spark)
    assert spark.sql("select position from extract_cards('<div class=\"AdItem_wrapper\"><a href=\"/a/1.htm\">x</a></div>', 'http://s/')").collect()[0][0] == 1


def test_merge_keeps_cards_and_details(spark):
    card = dict.fromkeys([f.split()[0] for f in schemas.CARD.split(", ")]) | {"detail_url": "u1", "title_raw": "card", "thumbnail_url_raw": "t", "run_id": "r", "crawled_at": "c"}
    detail = dict.fromkeys([f.split()[0] for f in schemas.DETAIL.split(", ")]) | {"request_url": "u2", "detail_url": "u2", "title_raw": "detail"}
    cards = spark.createDataFrame([card], schemas.CARD + ", run_id string, crawled_at string")
    details = spark.createDataFrame([detail], schemas.DETAIL + ", request_url string")
    left = bronze.merge(cards, details).collect()
    assert [(r.listing_id, r.source, r.title_raw, r.image_urls_raw, r.amenities_raw) for r in left] == [("", "unknown", "card", ["t"], [])]
    assert sorted(r.url for r in bronze.merge(cards, details, "full").collect()) == ["u1", "u2"]


def test_groups_and_survivors(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "key long")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(9, 10)], "a long, b long")
    groups = silver.dup_groups(pairs, nodes)
    assert {r["key"]: r["group"] for r in groups.collect()} == {**{i: 0 for i in range(8)}, 8: 8, 9: 9, 10: 9, 11: 11}
    rows = nodes.select(F.col("key").alias("listing_key"), (-F.col("key")).alias("age"))
    assert sorted(r.listing_key for r in silver.survivors(rows, groups, ["age"]).collect()) == [7, 8, 10, 11]


def test_latest_twice_is_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, r int, v string")
    once = silver.latest(df, ["k"], ["r", "v"])
    assert sorted(once.collect()) == sorted(silver.latest(once, ["k"], ["r", "v"]).collect())


def test_diff_and_gone(spark):
    a, b = (spark.createDataFrame(x, "k int, p int") for x in ([(1, 1), (2, 2), (3, None)], [(2, 5), (3, None), (4, 4)]))
    assert {r.k: r.change for r in runs.diff(a, b, ["k"], ["p"]).collect()} == {1: "removed", 2: "changed", 3: "same", 4: "added"}
    assert [r.k for r in runs.gone(a, b, ["k"]).collect()] == [1]


def test_commit_replaces_its_own_run(spark, tmp_path):
    rows = spark.createDataFrame([("s", "r1", "x"), ("s", "r2", "y")], "source string, run_id string, v string").withColumn("ingest_date", F.lit("2026-01-01").cast("date"))
    lake.commit(rows, str(tmp_path / "t"))
    lake.commit(rows.filter("run_id = 'r1'").withColumn("v", F.lit("z")), str(tmp_path / "t"))
    assert {(r.run_id, r.v) for r in lake.read(spark, str(tmp_path / "t"), "v string").collect()} == {("r1", "z"), ("r2", "y")}


def test_json_files_and_snapshots(spark, tmp_path):
    folder = tmp_path / "bronze/site/2026-01-02/run_20260102_030405"
    folder.mkdir(parents=True)
    (folder / "listings.json").write_text(json.dumps([{"listing_id": "1", "url": "u", "image_urls_raw": ["a"]}, {"listing_id": "2"}], indent=2))
    (folder / "manifest.json").write_text(json.dumps({"run_id": "r", "pages_success": 3}, indent=2))
    got = lake.read_bronze_json(spark, str(tmp_path / "bronze")).orderBy("listing_id").collect()
    assert [(r.listing_id, r.folder_source, r.ingest_date, r.run_id) for r in got] == [(x, "site", "2026-01-02", "run_20260102_030405") for x in "12"]
    assert lake.read_manifest_json(spark, str(tmp_path / "bronze")).first().pages_success == 3
    raw = tmp_path / "raw/site/listing/2026-01-02/r1"
    raw.mkdir(parents=True)
    (raw / "p1.html").write_text(PAGE)
    assert lake.reparse(spark, str(tmp_path / "raw"), "r1", F.lit("https://s.vn/list")).count() == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "x string, y int")
    for fmt in ("csv", "parquet", "json"):
        lake.export(df, str(tmp_path / fmt), fmt)
    assert lake.read_flat(spark, str(tmp_path / "csv"), "x string, y int", "csv").collect() == df.collect()


def test_serving_and_features_on_empty(spark):
    empty = spark.createDataFrame([], "source string, listing_key string, url string, title string, area_m2 double, posted_at timestamp, ward string, district string, city string, price_vnd long, is_negotiable boolean, price_basis string, crawled_ts timestamp, amenities_raw array<string>")
    assert {k: v.count() for k, v in gold.serving_tables(empty).items()} == dict.fromkeys(("listings", "locations", "prices", "amenities"), 0)
    assert silver.quality(empty).first()["rows"] == 0


def test_search_takes_zero_as_a_bound(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (2, 5, 9.0)], "listing_id int, price_vnd long, area_m2 double")
    assert [r.listing_id for r in gold.search(df, max_price=0).collect()] == [1]
    assert [r.listing_id for r in gold.search(df, min_price=0, min_area=0.0).collect()] == [1, 2]


def test_nearby_anywhere(spark):
    rng = random.Random(4)
    spots = [(i, rng.choice((0.0, 59.9, 80.0, 89.8, -89.6)) + rng.uniform(-0.3, 0.1), (rng.choice((179.9, 0.0)) + rng.uniform(-0.4, 0.4) + 180) % 360 - 180) for i in range(300)]

    def km(a, b):
        x, y, u, v = map(math.radians, (a[1], b[1], a[2], b[2]))
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin((v - u) / 2) ** 2)))

    rows = spark.createDataFrame(spots, "id int, lat double, lon double")
    points = rows.select(F.col("id").alias("point_id"), F.col("lat").alias("point_lat"), F.col("lon").alias("point_lon"))
    assert {(r["id"], r.point_id) for r in gold.nearby(rows, points, 15.0).collect()} == {(a[0], b[0]) for a in spots for b in spots if km(a, b) <= 15.0}


def test_plain_pages_are_read_as_by_the_parser(monkeypatch):
    """Pages of plain tags are read without the full parser, with its result; all others by it."""
    import random

    from lodgely.operators.nodes import Nodes

    told = lambda n: (n.tag, n.attrs, n.parent, n.own, n.end, n.low)
    pieces = ["<div>", '<div class="AdTitle x">', "</div>", '<a href="/x.htm" Class="price">', "</a>", "<br>", '<li\n a="1" A="2" >', "</li>", "</ul>", " đẹp ", "&amp;", "<", "<!-- c -->", "<script>if (a<b) '<p>'</script>", "<title>x <b>y</title>", "<p/>", "<input disabled>", "</li >", '<p a="x"b="y">', "<div a=1>"]
    rng = random.Random(3)
    pages = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    quick = [told(Nodes(p)) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(Nodes, "_plain", lambda self, html: False)
        assert quick == [told(Nodes(p)) for p in pages]
    monkeypatch.setattr(Nodes, "feed", lambda self, html: 1 / 0)
    page = Nodes('<div data-testid="list-ads"><a href="/1.htm#x"><h3 class="AdItem_title">Phòng 1</h3><br></a></div>')
    assert page.with_tag("h3", 1) == [3] and page.having("class", "aditem", 2) == [3] and page.text(1) == "Phòng 1" and page.with_tag("a", 3) == []
