import pytest
from lodgely.operators import gold
from lodgely.sources import lake
from lodgely.streaming import streams
from pyspark.sql import functions as F

URL, HOW = "jdbc:derby:memory:serving;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
TYPES = "source VARCHAR(40), listing_key VARCHAR(80)"


def read(spark, name):
    return sorted(tuple(r) for r in spark.read.jdbc(URL, name, properties=HOW).collect())


def test_serving_tables_go_round(spark):
    silver = spark.createDataFrame(
        [("s", "k1", "https://a/1", "Phòng", 20.0, None, "P1", "Q1", "HN", 3_000_000, False, "per_month", None, ["wifi", "wifi", "bed"]), ("s", "k2", None, None, None, None, None, None, None, None, True, None, None, None)],
        "source string, listing_key string, url string, title string, area_m2 double, posted_at timestamp, ward string, district string, city string, price_vnd long, is_negotiable boolean, price_basis string, crawled_ts timestamp, amenities_raw array<string>",
    )
    for name, table in gold.serving_tables(silver).items():
        for _ in range(2):
            lake.publish_staged(table, URL, name, HOW, ("source", "listing_key"), TYPES)
        assert read(spark, name) == sorted(tuple(r) for r in table.collect())
    lake.publish_jdbc(gold.serving_tables(silver)["locations"], URL, "plain_locations", HOW)
    assert len(read(spark, "plain_locations")) == 2


def test_rows_are_swapped_by_key_or_not_at_all(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "source string, listing_key string, v int")
    key = ("source", "listing_key")
    lake.publish_staged(rows(("s", "a", 1), ("s", "b", 1)), URL, "swapped", HOW, key, TYPES)
    lake.publish_staged(rows(("s", "b", 2), ("s", "c", 2)), URL, "swapped", HOW, key, TYPES)
    assert read(spark, "swapped") == [("s", "a", 1), ("s", "b", 2), ("s", "c", 2)]
    bad = rows(*[("s", f"x{k}", k) for k in range(50)]).repartition(5).withColumn("v", F.when(F.col("v") == 40, F.raise_error(F.lit("lost on the way"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost on the way"):
        lake.publish_staged(bad, URL, "swapped", HOW, key, TYPES)
    assert read(spark, "swapped") == [("s", "a", 1), ("s", "b", 2), ("s", "c", 2)]
    with pytest.raises(Exception):
        lake.publish_staged(rows(("s", "a", 9)).withColumn("more", F.lit(1)), URL, "swapped", HOW, key, TYPES)
    assert read(spark, "swapped") == [("s", "a", 1), ("s", "b", 2), ("s", "c", 2)]
    lake.publish_staged(rows(("s", "z", 3)), URL, "swapped", HOW, (), TYPES)
    assert read(spark, "swapped") == [("s", "z", 3)]


def test_new_snapshots_are_parsed_once(spark, tmp_path):
    card = lambda n: f'<div class="AdItem_wrapper"><a href="https://s.vn/thue/{n}.htm"><h3 class="AdItem_title">Phòng {n}</h3></a></div>'

    def put(run, page, *ids, kind="listing"):
        folder = tmp_path / "raw/site" / kind / "2026-01-02" / run
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{page}.html").write_text(f'<div data-testid="list-ads">{"".join(map(card, ids))}</div>')

    def parse(parser="v1"):
        out = f"{tmp_path}/{parser}"
        streams.parse_snapshots(streams.snapshots(spark, f"{tmp_path}/raw"), out, f"{tmp_path}/state-{parser}", F.lit("https://s.vn/list"), parser)
        cards = lake.read_run(spark, out, "listings", "listing_id string, page_run string, card_position int").collect()
        log = lake.read_run(spark, out, "metadata", "path string, page_run string").collect()
        return sorted((r.page_run, r.listing_id, r.card_position) for r in cards), sorted((r.page_run, r.path.rpartition("/")[2], r.run_id) for r in log)

    put("r1", "p1", 1, 2)
    put("r1", "p2", 3)
    put("r1", "d", 9, kind="detail")
    assert parse() == ([("r1", "1", 1), ("r1", "2", 2), ("r1", "3", 1)], [("r1", "p1.html", "v1_0"), ("r1", "p2.html", "v1_0")])
    put("r2", "p1", 1)
    put("r2", "p2")
    cards, log = parse()
    assert cards == [("r1", "1", 1), ("r1", "2", 2), ("r1", "3", 1), ("r2", "1", 1)] and [x for x in log if x[0] == "r2"] == [("r2", "p1.html", "v1_1"), ("r2", "p2.html", "v1_1")]
    (tmp_path / "state-v1/commits/1").unlink()
    for f in (tmp_path / "state-v1/commits").glob(".1.crc"):
        f.unlink()
    assert parse() == (cards, log)
    again, _ = parse("v2")
    assert again == cards
