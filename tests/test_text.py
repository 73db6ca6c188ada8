"""Worked examples of the text rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodgely.functions import log as L
from lodgely.functions import text as T


def values(spark, rule, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def test_price(spark):
    cases = {
        "4tr5": 4500000, "4.5 triệu/tháng": 4500000, "4,5 tr": 4500000, "4 triệu rưỡi": 4500000, "4.500.000đ/tháng": 4500000, "900.000 đ/tháng": 900000, "3TR": 3000000, "3,2 triệu/tháng": 3200000,
        "3,200,000 đ": 3200000, "500 nghìn": 500000, "1,2 tỷ": 1200000000, "8 triệu/tháng": 8000000, "Thỏa thuận": None, "giá thoả thuận": None, "200 nghìn/m²": None, "6 K": None, "": None, None: None,
    }
    assert values(spark, T.price_vnd, list(cases)) == list(cases.values())
    assert values(spark, T.is_negotiable, ["Thỏa thuận", "GIÁ THOẢ THUẬN", "3tr", None]) == [True, True, False, False]
    assert values(spark, T.price_per_m2_quoted, ["200 nghìn/m²", "3tr"]) == [200000, None]
    assert values(spark, T.price_basis, ["200 nghìn/m2", "3tr", "x"]) == ["per_m2", "per_month", None]


def test_deposit(spark):
    cases = {"2 triệu": 2000000, "1tr5": 1500000, "Cọc 500 nghìn": 500000, "1.000.000 đ": 1000000, "Thỏa thuận": None, "không": None, "": None, None: None}
    assert values(spark, T.deposit_vnd, list(cases)) == list(cases.values())


def test_clean(spark):
    cases = {" a\u00a0 b\n": "a b", "x\u200by": "x y", "\ufeffPhòng\t\u0007trọ": "Phòng trọ", " \u00a0\u200b\u0000 ": None, "": None, None: None, "Đã sạch": "Đã sạch"}
    assert values(spark, T.clean, list(cases)) == list(cases.values())


def test_raw_patterns(spark):
    assert values(spark, T.extract_price, ["Giá 3,5 triệu/tháng nhé", "4tr5", "6 K", "thỏa thuận"]) == ["3,5 triệu/tháng", None, None, "thỏa thuận"]
    assert values(spark, T.extract_area, ["rộng 25 m² đẹp", "25m2", "m2"]) == ["25 m²", "25m2", None]


def test_area(spark):
    assert values(spark, T.area_m2, ["25 m2", "25m²", "30 m²", "22,5 m²", "x", None]) == [25.0, 25.0, 30.0, 22.5, None, None]


def test_address(spark):
    got = values(spark, T.address, ["Q.Bình Thạnh, TP.HCM", "Phường 5, Quận Gò Vấp, TP. Hồ Chí Minh", "Quận 7 Nguyễn Văn 3 tin", "Huyện Nhà Bè, Hồ Chí Minh", None])
    assert [g and (g.ward, g.district, g.city) for g in got][:2] == [(None, "Bình Thạnh", "Hồ Chí Minh"), ("5", "Gò Vấp", "Hồ Chí Minh")]
    assert got[3].district == "Nhà Bè" and got[3].city == "Hồ Chí Minh" and got[4] is None


def test_titles_and_places(spark):
    assert values(spark, T.clean_title, ["Tin ưu tiên 6 Phòng đẹp", "ab", "  MỚI: Phòng   trọ ", None]) == ["Phòng đẹp", None, "Phòng trọ", None]
    assert values(spark, T.clean_location, ["Hot · Quận 7 · 2 giờ trước", "Quận 1 25 m²", "Quận Tân Bình - 3,5 triệu", "x"]) == ["Quận 7", "Quận 1", "Quận Tân Bình", None]


def test_posted_at(spark):
    now = dt.datetime(2026, 8, 20, 12)
    cases = {
        "Hôm nay": now, "vừa xong": now, "Hôm qua": now - dt.timedelta(days=1), "2 giờ trước": now - dt.timedelta(hours=2), "5 phút trước": now - dt.timedelta(minutes=5), "3 ngày trước": now - dt.timedelta(days=3),
        "1 tháng trước": now - dt.timedelta(days=30), "12/08/2026": dt.datetime(2026, 8, 12), "2026-08-12": dt.datetime(2026, 8, 12), "31/02/2026": None, "2 năm trước": None, "": None, None: None,
    }
    assert values(spark, lambda c: T.posted_at(c, F.lit(now)), list(cases)) == list(cases.values())


def test_urls(spark):
    assert values(spark, T.listing_id, ["https://a.b/c/133556911.htm", "https://a.b/c"]) == ["133556911", None]
    page = lambda n: lambda c: T.build_page_url(c, F.lit(n))
    assert values(spark, page(1), ["http://a/b"]) == ["http://a/b"] and values(spark, page(2), ["http://a/b", "http://a/b?page=7&x=1"]) == ["http://a/b?page=2", "http://a/b?page=2&x=1"]
    assert values(spark, T.extract_page_number, ["http://a/b?x=1&page=3", "http://a/b", None]) == [3, 1, 1]
    assert values(spark, T.canonical_url, ["HTTPS://Ex.COM/a/?b=2&utm_source=x&a=1#f"]) == ["https://ex.com/a?a=1&b=2"]
    to = lambda c: T.absolute_url(F.lit("https://a.b/c/d?x=1"), c)
    assert values(spark, to, ["/e#f", "//h/i", "g", "?y=2", "http://z/"]) == ["https://a.b/e", "https://h/i", "https://a.b/c/g", "https://a.b/c/d?y=2", "http://z/"]


def test_tags_and_phones(spark):
    assert values(spark, T.amenity_tags, ["Có GÁC LỬNG, ban công", None]) == [["loft", "balcony"], []]
    assert values(spark, T.phones, ["gọi 0912.345.678 hoặc +84 912345678, 012345"]) == [["0912345678"]]
    assert values(spark, T.fold, ["Đà Nẵng", "Thủ Đức"]) == ["da nang", "thu duc"]


def test_log_rules(spark):
    codes = [200, 403, 403, 404, 429, 503, 302, 400, 401]
    df = spark.createDataFrame([(i, c, "Just a Moment..." if i == 2 else None) for i, c in enumerate(codes)], "i int, c int, h string")
    got = [r.s for r in df.select("i", L.classify(F.col("c"), F.col("h")).alias("s")).orderBy("i").collect()]
    assert got == ["success", "access_denied", "cloudflare_challenge", "not_found", "rate_limited", "server_error", "unknown", "bad_request", "unauthorized"]
    assert values(spark, L.decide, ["success", "rate_limited", "timeout", "not_found", None]) == ["parse", "cooldown", "retry_later", "stop", "stop"]
    assert values(spark, L.backoff_seconds, [1, 2, 3, 4, 5, 6], "int") == [2, 4, 8, 16, 30, 30]
    assert values(spark, lambda c: L.cooldown_seconds(F.lit("rate_limited"), c), [0, 1, 2, 3, 4], "int") == [60, 60, 300, 900, 1800]
    assert values(spark, lambda c: L.strategy(c, ("x.com",)), ["https://a.x.com/b", "https://ax.com/", None]) == ["browser", "http", "http"]


@pytest.mark.parametrize("lat,lon,km", [(0.0, 1.0, 111.195), (1.0, 0.0, 111.195)])
def test_haversine(spark, lat, lon, km):
    got = spark.range(1).select(T.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(lat), F.lit(lon)).alias("k")).first().k
    assert got == pytest.approx(km, abs=0.01)


def test_amenities_are_whole_words(spark):
    texts = ["boco gaciado astaco gaco", "co gacs", "Disco gác", "ban công2", "nhà có  gác, sân", "(máy lạnh)", "x_dieu hoa", ""]
    assert values(spark, T.amenity_tags, texts) == [[], [], [], [], ["loft"], ["air_con"], [], []]
