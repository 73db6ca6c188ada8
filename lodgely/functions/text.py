"""Column expressions for titles, prices, areas, places, dates and URLs of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the raw fields. Word edges are spelled out, as Java does not count ² as part of a word.
EDGE_LEFT, EDGE_RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
PRICE = (
    r"(?iU)" + EDGE_LEFT + r"(\d+(?:[.,]\d+)?\s*(?:triệu|tr|nghìn|tỷ|đ|vnđ)(?:\s*/\s*(?:tháng|m[²2]))?"
    r"|\d{1,3}(?:\.\d{3})+\s*(?:đ|vnđ|đồng)(?:\s*/\s*tháng)?|thỏa\s+thuận|giá\s+thỏa\s+thuận)" + EDGE_RIGHT
)
AREA = r"(?iU)" + EDGE_LEFT + r"(\d+(?:[.,]\d+)?\s*m(?:²|2))" + EDGE_RIGHT
PLACE = (
    r"(?iU)((?:Quận|Huyện|Thị\s+xã|TP\.|TP\s+|Thành\s+phố|Phường|Đường|Xã)\s+[^,·\n\r|]{2,40}"
    r"(?:,\s*(?:TP\.?\s*Hồ\s*Chí\s*Minh|TP\.?\s*HCM|Hà\s*Nội|Đà\s*Nẵng|Bình\s*Dương|Đồng\s*Nai|Cần\s*Thơ|[^,·\n\r|]{2,30}))*)"
)
BADGE = r"(?iU)^(?:tin\s+ưu\s+tiên\s*\d*|đã\s+xác\s+thực|môi\s+giới|chính\s+chủ|hot|mới)\s*[:·•|-]?\s*"
PLACE_ENDS = (
    r"(?iU)\s*[·•|-]?\s*\d+\s*(?:giờ|ngày|phút|tháng|năm)\s*trước.*$",
    r"(?iU)\s*[·•|-]?\s*(?:hôm\s+nay|vừa\s+xong|hôm\s+qua).*$",
    r"(?iU)\s*[·•|-]?\s*\d+(?:[.,]\d+)?\s*m(?:²|2).*$",
    r"(?iU)\s*[·•|-]?\s*\d+(?:[.,]\d+)?\s*(?:triệu|tr|nghìn|đ|vnđ).*$",
    r"(?iU)\s*[·•|-]?\s*(?:nội\s+thất\s+đầy\s+đủ|tin\s+ưu\s+tiên\s*\d*|đã\s+xác\s+thực|môi\s+giới|chính\s+chủ).*",
)
NAVIGATION = ("", "/", "/chuyen-muc", "/dashboard", "/login", "/tro-giup")
ID_IN_URL = r"(?i)/(\d+)\.htm"

#: Amenity tags and the words that show them, in folded text.
AMENITIES = {
    "loft": ("gac lung", "gac xep", "co gac"),
    "balcony": ("ban cong",),
    "air_con": ("may lanh", "dieu hoa"),
    "free_hours": ("gio giac tu do", "gio tu do"),
    "private_entrance": ("loi di rieng", "khong chung chu"),
}
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")

_PLAIN = {"a": "àáạảãâầấậẩẫăằắặẳẵ", "e": "èéẹẻẽêềếệểễ", "i": "ìíịỉĩ", "o": "òóọỏõôồốộổỗơờớợởỡ", "u": "ùúụủũưừứựửữ", "y": "ỳýỵỷỹ", "d": "đ"}
#: Marked letters, and the plain one of each.
MARKS, PLAIN = "".join(_PLAIN.values()), "".join(k * len(v) for k, v in _PLAIN.items())


def nonblank(c: Column) -> Column:
    """The value, or null if it is empty or white space."""
    return F.when(F.regexp_replace(c, r"(?U)\s+", "") != "", c)


def collapse(c: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Without control characters and no-break or zero-width blanks, collapsed; null if nothing is left."""
    return F.nullif(collapse(F.regexp_replace(c, r"[\p{Cc} ​﻿]", " ")), F.lit(""))


def fold(c: Column) -> Column:
    """Lower case without Vietnamese marks: a key for comparison that is a plain string. Combining marks are dropped too."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}", ""), MARKS, PLAIN)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def listing_id(url: Column) -> Column:
    return first_match(url, ID_IN_URL)


def clean_title(raw: Column) -> Column:
    t = collapse(F.regexp_replace(strip(raw), BADGE, ""))
    return F.when(F.length(t) >= 3, t)


def extract_price(raw: Column) -> Column:
    return strip(first_match(raw, PRICE))


def extract_area(raw: Column) -> Column:
    return strip(first_match(raw, AREA))


def clean_location(raw: Column) -> Column:
    """A place without badge and without what follows it: age, day, area, price, praise; in this order."""
    t = F.regexp_replace(strip(raw), BADGE, "")
    for end in PLACE_ENDS:
        t = F.regexp_replace(t, end, "")
    t = F.regexp_replace(t, r"^[ ·•|,/-]+|[ ·•|,/-]+$", "")
    return F.when(F.length(t) >= 2, t)


def extract_location(text: Column) -> Column:
    return clean_location(first_match(text, PLACE))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("decimal(18,4)")


def is_negotiable(raw: Column) -> Column:
    return F.coalesce(raw.rlike(r"(?iU)th(?:ỏa|oả)\s+thuận"), F.lit(False))


def price_basis(raw: Column) -> Column:
    """per_m2, per_month, or null if there is no price."""
    return F.when(raw.rlike(r"(?iU)/\s*m[²2]"), "per_m2").when(_amount(raw).isNotNull(), "per_month")


def _amount(raw: Column) -> Column:
    """VND of a price text. The unit tells what . and , mean: a decimal mark before triệu, tr, tỷ, nghìn; grouping before đ."""
    t = strip(F.lower(raw))
    unit = r"(triệu|tr|tỷ|nghìn|ngàn)"
    scale = lambda u: F.when(u.isin("triệu", "tr"), 1_000_000).when(u == "tỷ", 1_000_000_000).when(u.isin("nghìn", "ngàn"), 1000).cast("decimal(18,0)")
    half = rf"(?iU){EDGE_LEFT}(\d+)\s*{unit}\s*rưỡi"
    joined = rf"(?iU){EDGE_LEFT}(\d+)\s*(triệu|tr|tỷ)\s*(\d{{1,3}}){EDGE_RIGHT}"
    plain = rf"(?iU){EDGE_LEFT}(\d+(?:[.,]\d+)?)\s*{unit}{EDGE_RIGHT}"
    grouped = rf"(?iU){EDGE_LEFT}(\d{{1,3}}(?:[.,]\d{{3}})+|\d+)\s*(?:đ|vnđ|vnd|đồng){EDGE_RIGHT}"
    of = lambda p, g: F.regexp_extract(t, p, g)
    tail = of(joined, 3)
    whole = lambda p: _number(F.nullif(of(p, 1), F.lit("")))
    return F.coalesce(
        (whole(half) + F.lit("0.5").cast("decimal(2,1)")) * scale(of(half, 2)),
        _number(F.nullif(F.concat(of(joined, 1), F.lit("."), tail), F.lit("."))) * scale(of(joined, 2)),
        whole(plain) * scale(of(plain, 2)),
        F.regexp_replace(F.nullif(of(grouped, 1), F.lit("")), "[.,]", "").try_cast("decimal(18,0)"),
    )


def price_vnd(raw: Column) -> Column:
    """Monthly VND; null for negotiable, per-area and unreadable prices."""
    return F.when(~is_negotiable(raw) & ~F.coalesce(raw.rlike(r"(?iU)/\s*m[²2]"), F.lit(False)), _amount(raw)).cast("long")


def price_per_m2_quoted(raw: Column) -> Column:
    """The rate of a price that is quoted per square metre."""
    return F.when(raw.rlike(r"(?iU)/\s*m[²2]"), _amount(raw)).cast("long")


def deposit_vnd(raw: Column) -> Column:
    return price_vnd(raw)


def area_m2(raw: Column) -> Column:
    return F.replace(first_match(raw, r"(?iU)(\d+(?:[.,]\d+)?)\s*m\s*(?:²|2)"), F.lit(","), F.lit(".")).try_cast("double")


def price_per_m2(price: Column, area: Column) -> Column:
    return F.try_divide(price.cast("double"), area)


def address(raw: Column) -> Column:
    """struct<ward, district, city>. Q., P. and TP. are spelled out; HCM is Hồ Chí Minh. A place ends at a comma, a seller count or a second name."""
    t = collapse(raw)
    for short, full in ((r"(?iU)(?<![\p{L}])Q\.\s*", "Quận "), (r"(?iU)(?<![\p{L}])P\.\s*", "Phường "), (r"(?iU)(?<![\p{L}])H\.\s*", "Huyện "), (r"(?iU)(?<![\p{L}])TP\.?\s*", "Thành phố "), (r"(?iU)(?<![\p{L}])TX\.?\s*", "Thị xã ")):
        t = F.regexp_replace(t, short, full)
    part = lambda names: collapse(first_match(t, rf"(?iU)(?<![\p{{L}}])(?:{names})\s+([^,·|\n]+?)(?=\s*(?:[,·|\n]|$|\s\d+\s+tin|Quận|Huyện|Phường|Thành\s+phố|Thị\s+xã|Xã\s))"))
    city = part(r"Thành\s+phố|Tỉnh")
    last = F.when(F.size(F.split(t, ",")) > 1, collapse(F.element_at(F.split(t, ","), -1)))
    known = first_match(t, r"(?iU)(Hồ\s+Chí\s+Minh|Hà\s+Nội|Đà\s+Nẵng|Cần\s+Thơ|Hải\s+Phòng|Bình\s+Dương|Đồng\s+Nai)")
    city = F.coalesce(F.when(city.rlike(r"(?iU)^HCM"), F.lit("Hồ Chí Minh")).otherwise(city), known, F.when(~last.rlike(r"(?iU)^(Quận|Huyện|Phường|Xã|Thị)"), last))
    return F.when(raw.isNotNull(), F.struct(part("Phường|Xã").alias("ward"), part(r"Quận|Huyện|Thị\s+xã").alias("district"), city.alias("city")))


def posted_at(raw: Column, now: Column) -> Column:
    """The time a listing was posted, seen at `now`: just now, yesterday, minutes to months ago, or a date (D/M/Y or Y-M-D); else null."""
    t = strip(F.lower(raw))
    ago = lambda unit: F.nullif(F.regexp_extract(t, rf"(?U)(\d+)\s*{unit}\s*trước", 1), F.lit("")).try_cast("int")
    none = F.lit(0)
    back = lambda days=none, hours=none, mins=none: now - F.make_dt_interval(days, hours, mins, none.cast("decimal(8,6)"))
    zone = F.lit("UTC")
    day = r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
    iso = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    at = lambda p, y, m, d: F.try_make_timestamp(*[F.regexp_extract(t, p, g).try_cast("int") for g in (y, m, d)], F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"), zone)
    return (
        F.when(F.contains(t, F.lit("vừa xong")) | F.contains(t, F.lit("hôm nay")), now)
        .when(F.contains(t, F.lit("hôm qua")), back(F.lit(1)))
        .when(ago("phút").isNotNull(), back(mins=ago("phút")))
        .when(ago("giờ").isNotNull(), back(hours=ago("giờ")))
        .when(ago("ngày").isNotNull(), back(ago("ngày")))
        .when(ago("tháng").isNotNull(), back(ago("tháng") * 30))
        .when(t.rlike(iso), at(iso, 1, 2, 3))
        .when(t.rlike(day), at(day, 3, 2, 1))
    )


def in_range(dt: Column, start: Column, end: Column) -> Column:
    """Within both ends; a null date passes."""
    return F.forall(F.array(dt), lambda x: x.isNull() | ((x >= start) & (x <= end)))  # dt is evaluated once


def age_days(crawled: Column, posted: Column) -> Column:
    return F.date_diff(crawled, posted)


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from base, without a fragment. Dot segments of relative paths are left as they are."""
    h = F.split_part(F.trim(href), F.lit("#"), F.lit(1))
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.length(page) > F.length(root), F.regexp_extract(page, r"^(.*/)", 1)).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(page, h))
        .when(h == "", F.split_part(base, F.lit("#"), F.lit(1)))
        .otherwise(F.concat(folder, h))
    )


def build_page_url(base: Column, page: Column) -> Column:
    """base for page 1 or less, else base with its `page` parameter set."""
    bare = F.split_part(base, F.lit("#"), F.lit(1))
    has = bare.rlike(r"[?&]page=")
    n = page.cast("string")
    put = F.when(has, F.regexp_replace(bare, F.lit(r"([?&]page=)[^&]*"), F.concat(F.lit("$1"), n))).otherwise(F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("page="), n))
    return F.when(page <= 1, base).otherwise(put)


def extract_page_number(url: Column) -> Column:
    return F.coalesce(first_match(url, r"[?&]page=(\d+)(?:[&#]|$)").try_cast("int"), F.lit(1))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment or tracking parameters, the others sorted, no slash at the end of the path."""
    bare = F.split_part(F.trim(url), F.lit("#"), F.lit(1))
    head = F.lower(F.regexp_extract(bare, r"^([^:/?]+://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^:/?]+://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.split_part(p, F.lit("="), F.lit(1)).isin(*TRACKING))), "&")
    return F.concat(head, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever the case of its name; where several differ in case only, the last."""
    return F.element_at(F.filter(F.transform(F.map_entries(headers), lambda e: F.when(F.lower(e["key"]) == name.lower(), e["value"])), lambda v: v.isNotNull()), -1)


def phones(text: Column) -> Column:
    """Distinct phone numbers of ten digits in a text: marks dropped, +84 as 0."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d])((?:\+84|0)(?:[ .-]?\d){9})(?!\d)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(p, r"[ .-]", ""), r"^\+84", "0")))


def amenity_tags(text: Column) -> Column:
    """Tags of AMENITIES whose words the text has, as whole words, in order of the table."""
    has = lambda t, w: F.contains(t, F.lit(w)) & t.rlike(EDGE_LEFT + w + EDGE_RIGHT)  # noqa: E731  few texts come to the pattern
    tags = lambda t: F.array_compact(F.array(*[F.when(F.greatest(*[has(t, w) for w in words], F.lit(False)), F.lit(tag)) for tag, words in AMENITIES.items()]))
    return F.transform(F.array(collapse(fold(text))), tags)[0]  # the folded text is made once


def amenity_count(amenities: Column) -> Column:
    return F.size(F.array_distinct(F.coalesce(amenities, F.array().cast("array<string>"))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "'run_'yyyyMMdd_HHmmss")


def run_time(run: Column) -> Column:
    return F.try_to_timestamp(run, F.lit("'run_'yyyyMMdd_HHmmss"))
