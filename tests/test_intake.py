import json

from lodgely.operators import extract
from lodgely.sources import intake, lake
from pyspark.sql import functions as F

GOOD = {"listing_id": "1", "source": "s", "url": "https://a.vn/1.htm", "title_raw": "t", "image_urls_raw": ["a"], "amenities_raw": []}


def put(top, run, text, name="listings.json"):
    folder = top / "site" / "2026-01-02" / run
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_every_record_is_taken_in_or_kept_apart_once(spark, tmp_path):
    odd = [GOOD, {**GOOD, "title_raw": ["x"]}, {"source": "s"}, {**GOOD, "url": "nowhere"}, 5, {**GOOD, "image_urls_raw": [1]}, {**GOOD, "price_raw": 5, "url": None}, {**GOOD, "extra": 1}, {**GOOD, "title_raw": None, "source": " "}, None]
    put(tmp_path / "in", "r1", json.dumps(odd, indent=2))
    put(tmp_path / "in", "r2", json.dumps([GOOD, GOOD], indent=2)[:-40])
    put(tmp_path / "in", "r3", json.dumps(GOOD))
    put(tmp_path / "in", "r4", "[]")
    put(tmp_path / "in", "r5", "")
    put(tmp_path / "in", "r6", json.dumps([GOOD]).encode()[:-2] + b"\xff\xfe\"}]")
    good, bad = intake.checked(spark, str(tmp_path / "in"))
    assert sorted((r.run_id, r.position, r.listing_id, r.title_raw, tuple(r.image_urls_raw), tuple(r.amenities_raw), r.folder_source, r.price_raw) for r in good.collect()) == [("r1", k, "1", "t", ("a",), (), "site", None) for k in (0, 7)]
    want = {1: ["wrong_type:title_raw"], 2: ["missing_field:url"], 3: ["bad_url:url"], 4: ["not_an_object"], 5: ["wrong_type:image_urls_raw"], 6: ["missing_field:url", "wrong_type:price_raw"], 8: ["missing_field:source"], 9: ["not_an_object"]}
    got = bad.collect()
    assert {r.position: r.codes for r in got if r.run_id == "r1"} == want and json.loads(next(r.record for r in got if r.position == 1)) == odd[1]
    assert sorted((r.run_id, r.position, r.codes) for r in got if r.run_id != "r1") == [("r2", None, ["unreadable_file"]), ("r3", None, ["not_an_array"]), ("r6", None, ["unreadable_file"])]
    for _ in range(2):
        intake.take_in(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert lake.read(spark, str(tmp_path / "out/accepted"), "listing_id string").count() == 2
    kept = lake.read(spark, str(tmp_path / "out/quarantine"), "codes array<string>, position int")
    assert kept.count() == 11 and kept.filter("source = 'site' and run_id = 'r1'").count() == 8


def test_other_schemas(spark, tmp_path):
    put(tmp_path, "r1", json.dumps([{"run_id": "r", "source": "s", "pages_success": 3, "errors": []}, {"run_id": "r", "source": "s", "pages_success": "3"}]), "manifest.json")
    good, bad = intake.checked(spark, str(tmp_path), "run_id string, source string, pages_success int, errors array<string>, elapsed_ms double", ("run_id",), (), "*/*/*/manifest.json")
    assert [(r.run_id, r.pages_success) for r in good.select("run_id", "pages_success").collect()] == [("r", 3)] and [r.codes for r in bad.collect()] == [["wrong_type:pages_success"]]


def test_lines_of_csv_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\nz,b\n3,c\n4\n")
    good, bad = intake.checked_flat(spark, str(tmp_path), "x int, y string")
    assert sorted((r.x, r.y) for r in good.collect()) == [(1, "a"), (3, "c")] and sorted(r.record for r in bad.collect()) == ["4", "z,b"]


def test_meta_tags_and_json_ld(spark):
    meta = '<meta name="a" content="1"><meta content="" name="A"><meta name="b"><meta property="c" content="x"><meta name="" content="y">'
    blocks = ["5", '"x"', '[1,{"a":2},[{"z":1}]]', '{"b":1}', '{"b"', "null"]
    html = meta + "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string")
    assert {r.page_id: r.m for r in pages.select("page_id", extract.meta_tags(F.col("html")).alias("m")).collect()} == {1: {"a": "", "c": "x"}, 2: None, 3: {}}
    assert sorted((r.page_id, r.position, r.j) for r in extract.json_ld(pages).select("page_id", "position", F.to_json("block").alias("j")).collect()) == [(1, 2, '{"a":2}'), (1, 3, '{"b":1}')]


def test_request_log_and_silver_files(spark, tmp_path):
    put(tmp_path / "in", "r1", json.dumps([{"run_id": "r1", "request_url": "u", "http_status": 200, "elapsed_ms": 1.5}], indent=2), "metadata.json")
    got = lake.read_request_log_json(spark, str(tmp_path / "in")).first()
    assert (got.run_id, got.http_status, got.elapsed_ms, got.crawl_status) == ("r1", 200, 1.5, None)
    rows = spark.createDataFrame([("k1", "Hà Nội", 1), ("k2", None, 2), ("k3", "Huế", 3)], "listing_key string, city string, price_vnd long")
    lake.write_silver(rows, str(tmp_path / "silver"))
    lake.write_silver(rows.filter("city = 'Huế'").withColumn("price_vnd", F.lit(9).cast("long")), str(tmp_path / "silver"))
    back = spark.read.parquet(str(tmp_path / "silver"))
    assert sorted((r.listing_key, r.city, r.price_vnd) for r in back.collect()) == [("k1", "Hà Nội", 1), ("k2", None, 2), ("k3", "Huế", 9)]
