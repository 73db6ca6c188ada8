"""Market tables over silver listings (listing_id, price_vnd, area_m2, district, city, posted_at, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .silver import written


def median(c: str, exact: bool = True) -> Column:
    """Exact at the cost of holding a group's values; approximate in bounded memory otherwise."""
    return F.expr(f"percentile({c}, 0.5)") if exact else F.percentile_approx(c, 0.5, 10_000).cast("double")


def search(df: DataFrame, district: str | None = None, min_price: int | None = None, max_price: int | None = None, min_area: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of listings, cheapest first. A bound of None is none; zero is a bound."""
    bounds = ((district, lambda v: F.col("district") == v), (min_price, lambda v: F.col("price_vnd") >= v), (max_price, lambda v: F.col("price_vnd") <= v), (min_area, lambda v: F.col("area_m2") >= v))
    for value, test in bounds:
        df = df if value is None else df.filter(test(value))
    return df.orderBy("price_vnd", "listing_id").offset(offset).limit(limit)


def district_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per district: listings, priced ones, mean and median price, mean area."""
    return df.groupBy("city", "district").agg(
        F.count("*").alias("listings"), F.count("price_vnd").alias("priced"), F.avg("price_vnd").alias("mean_price"), median("price_vnd", exact).alias("median_price"), F.avg("area_m2").alias("mean_area")
    )


def price_histogram(df: DataFrame, low: int, high: int, bins: int) -> DataFrame:
    """Listings per price bin; bin 0 is below low, bins + 1 from high on."""
    return df.filter("price_vnd is not null").groupBy(F.width_bucket("price_vnd", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("listings"), F.min("price_vnd").alias("low"), F.max("price_vnd").alias("high"))


def supply_by_period(df: DataFrame, period: str = "month") -> DataFrame:
    """Listings per district and period, and the growth on the period before."""
    by = df.groupBy("district", F.date_trunc(period, "posted_at").cast("date").alias("period")).agg(F.count("*").alias("listings"))
    before = F.expr("lag(listings) over (partition by district order by period)")
    return by.withColumn("growth", F.try_divide(F.col("listings") - before, before))


def price_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_trunc("month", "posted_at").cast("date").alias("month")).agg(F.count("price_vnd").alias("priced"), F.avg("price_vnd").alias("mean_price"))


def area_price_fit(df: DataFrame) -> DataFrame:
    """Per district: how price depends on area."""
    y, x = F.col("price_vnd").cast("double"), F.col("area_m2")
    return df.filter("price_vnd is not null and area_m2 is not null").groupBy("district").agg(
        F.count("*").alias("n"), F.corr(x, y).alias("corr"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def hotspots(df: DataFrame, cheap: int, step: float = 0.1, k: int = 20) -> DataFrame:
    """The k densest cells of a grid over (lat, lon), with their share of listings under a price."""
    cells = df.groupBy(F.floor(F.col("lat") / step).alias("cell_y"), F.floor(F.col("lon") / step).alias("cell_x")).agg(F.count("*").alias("listings"), F.count_if(F.col("price_vnd") <= cheap).alias("cheap"))
    return cells.withColumn("cheap_share", F.col("cheap") / F.col("listings")).orderBy(F.desc("listings"), "cell_y", "cell_x").limit(k)


def seller_activity(df: DataFrame) -> DataFrame:
    return df.groupBy("seller_id").agg(F.count("*").alias("rows"), F.count_distinct("listing_id").alias("listings"), F.count_distinct("district").alias("districts"))


def place_rollup(df: DataFrame) -> DataFrame:
    """Counts for districts, cities and all; level tells which."""
    return df.rollup("city", "district").agg(F.grouping_id().alias("level"), F.count("*").alias("listings"), F.min("price_vnd").alias("min_price"), F.max("price_vnd").alias("max_price"))


def temporal(df: DataFrame) -> DataFrame:
    return df.groupBy(F.dayofweek("posted_at").alias("weekday"), F.hour("posted_at").alias("hour")).agg(F.count("*").alias("listings"))


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    n = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(n("listing_id").alias("listings"), n("seller_id").alias("sellers"), n("district").alias("districts"))


def _joined(df: DataFrame, by: DataFrame, keys: list[str]) -> DataFrame:
    """df left-joined to figures by keys, where null equals null: listings without a district are a district of their own."""
    right = by.withColumnsRenamed({k: f"_by_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys])
    return df.join(right, same, "left").drop(*[f"_by_{k}" for k in keys])


def with_percentile(df: DataFrame) -> DataFrame:
    """Share of the district's priced listings that are cheaper; those without a district are ranked among themselves. From a running sum over distinct prices, so a large district is no large window."""
    prices = df.filter("price_vnd is not null").groupBy("district", "price_vnd").agg(F.count("*").alias("_n"))
    ranks = prices.withColumn("_below", F.expr("sum(_n) over (partition by district order by price_vnd) - _n")).withColumn("_all", F.expr("sum(_n) over (partition by district)"))
    share = F.when(F.col("_all") > 1, F.col("_below") / (F.col("_all") - 1)).otherwise(0.0)
    return _joined(df, ranks.select("district", "price_vnd", share.alias("price_percentile")), ["district", "price_vnd"])


def with_supply(df: DataFrame) -> DataFrame:
    """Listings of the district (or without one) on each row; counted first, then joined."""
    return _joined(df, df.groupBy("district").agg(F.count("*").alias("district_supply")), ["district"])


def with_outlier(df: DataFrame, method: str = "iqr", exact: bool = True) -> DataFrame:
    """Whether a price stands outside its district: over 1.5 quartile ranges beyond the quartiles, or 3 deviations off the mean."""
    if method == "iqr":
        q = (lambda p: F.expr(f"percentile(price_vnd, {p})")) if exact else (lambda p: F.percentile_approx("price_vnd", p, 10_000).cast("double"))
        stats = df.groupBy("district").agg(q(0.25).alias("_q1"), q(0.75).alias("_q3"))
        low, high = F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1")), F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))
    else:
        stats = df.groupBy("district").agg(F.avg("price_vnd").alias("_q1"), F.stddev_samp("price_vnd").alias("_q3"))
        low, high = F.col("_q1") - 3 * F.col("_q3"), F.col("_q1") + 3 * F.col("_q3")
    out = F.coalesce((F.col("price_vnd") < low) | (F.col("price_vnd") > high), F.lit(False))
    return _joined(df, stats, ["district"]).withColumn("is_outlier", out).drop("_q1", "_q3")


def with_price_change(df: DataFrame, key: str = "listing_id", run: str = "run_no") -> DataFrame:
    """Price less that of the run before, per listing."""
    return df.withColumn("price_before", F.expr(f"lag(price_vnd) over (partition by {key} order by {run})")).withColumn("price_change", F.col("price_vnd") - F.col("price_before"))


def rolling(daily: DataFrame, days: int = 30) -> DataFrame:
    """daily (district, day, listings) with the sum over the last `days` days."""
    return daily.withColumn("recent", F.expr(f"sum(listings) over (partition by district order by day range between interval {days - 1} days preceding and current row)"))


def rolling_median(priced: DataFrame, days: int = 30) -> DataFrame:
    """priced (district, day, price_vnd) -> district, day, recent_median: of the prices of the last `days` days, for each day that has one.

    Prices are counted by day first; each count then goes to the days that see it, so a window holds distinct prices.
    """
    by = priced.filter("price_vnd is not null").groupBy("district", "day", "price_vnd").agg(F.count("*").alias("n"))
    seen = by.select("district", "price_vnd", "n", F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))).alias("day"))
    seen = seen.join(by.select("district", "day").distinct(), ["district", "day"]).groupBy("district", "day", "price_vnd").agg(F.sum("n").alias("n"))
    return seen.groupBy("district", "day").agg(F.expr("percentile(price_vnd, 0.5, n)").alias("recent_median"))


def features(df: DataFrame, centres: DataFrame) -> DataFrame:
    """Per listing: price_per_m2, listing_age_days, distance_to_center, district_supply, price_percentile, seller_activity and, of listings with amenities_raw, amenity_count.

    centres: district, lat, lon, center_lat, center_lon.
    """
    counted = {"amenity_count": T.amenity_count(F.col("amenities_raw"))} if "amenities_raw" in df.columns else {}
    sellers = df.groupBy("seller_id").agg(F.count("*").alias("seller_activity"))
    out = with_supply(with_percentile(df)).join(sellers, "seller_id", "left").join(centres, "district", "left")
    return out.withColumns({
        "price_per_m2": T.price_per_m2(F.col("price_vnd"), F.col("area_m2")),
        "listing_age_days": T.age_days(F.col("crawled_at"), F.col("posted_at")),
        "distance_to_center": T.haversine_km(F.col("lat"), F.col("lon"), F.col("center_lat"), F.col("center_lon")),
        **counted,
    })


def nearby(df: DataFrame, points: DataFrame, km: float) -> DataFrame:
    """Rows of df (lat, lon) within km of points (point_id, point_lat, point_lon), with the distance; anywhere on the globe.

    Both sides meet in cells: bands of latitude as high as the reach, each cut into equal cells at least as wide as the
    reach is there and in the next bands. A point stands in its cell and the eight around it, across 180 degrees too.
    """
    step = km / 110.0
    floor = lambda c: F.floor(c).cast("long")
    edge = F.least(F.greatest(F.abs(F.col("cell_y") * step), F.abs((F.col("cell_y") + 1) * step)) + step, F.lit(90.0))
    reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(km / 2 / 6371.0, 1.5))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12)))))
    count = F.greatest(floor(360 / reach), F.lit(1))
    place = lambda lon: F.pmod(floor((lon + 180) / 360 * F.col("cells")), F.col("cells"))
    own = df.withColumn("cell_y", floor(F.col("lat") / step)).withColumn("cells", count).withColumn("cell_x", place(F.col("lon")))
    around = points.select("point_id", "point_lat", "point_lon", F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("dy"))
    around = around.withColumn("cell_y", floor(F.col("point_lat") / step) + F.col("dy")).withColumn("cells", count)
    beside = F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda dx: F.pmod(place(F.col("point_lon")) + dx, F.col("cells"))))
    around = around.select("point_id", "point_lat", "point_lon", "cell_y", F.explode(beside).alias("cell_x"))
    joined = own.drop("cells").join(around, ["cell_y", "cell_x"])
    return joined.withColumn("km", T.haversine_km(F.col("lat"), F.col("lon"), F.col("point_lat"), F.col("point_lon"))).filter(F.col("km") <= km).drop("cell_y", "cell_x", "point_lat", "point_lon")


def recommend(df: DataFrame, points: DataFrame, km: float, budget: int, k: int = 5) -> DataFrame:
    """The k best districts for each workplace: near, within the budget, well supplied. Ties go by name."""
    near = nearby(df.filter(F.col("price_vnd") <= budget), points, km)
    by = near.groupBy("point_id", "district").agg(F.count("*").alias("listings"), F.avg("price_vnd").alias("mean_price"), F.min("km").alias("km"))
    value = 0.5 * (1 - F.col("km") / km) + 0.3 * (1 - F.col("mean_price") / budget) + 0.2 * F.least(F.lit(1.0), F.col("listings") / 100)
    return by.withColumn("score", F.round(value, 6)).withColumn("rank", F.expr("row_number() over (partition by point_id order by score desc, district)")).filter(F.col("rank") <= k)


def clusters(df: DataFrame, columns: list[str], k: int = 5, seed: int = 1) -> DataFrame:
    """df with `cluster` by k-means over scaled columns. Rows with a null or NaN among them have no part in it and a null cluster.

    df is read once, into a table. Equal rows are one point with their number as its weight, scaled by means and deviations
    over all rows, so iterations and what they keep grow with distinct points.
    """
    known = F.lit(True)
    for c in columns:
        known &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    inputs = [f"_in_{n}" for n in range(len(columns))]
    rows = df.select("*", known.alias("_known"))
    rows = written(rows.withColumns({i: F.when(F.col("_known"), F.col(c).cast("double")).otherwise(0.0) for i, c in zip(inputs, columns)}), "points")
    points = written(rows.filter("_known").groupBy(*inputs).agg(F.count("*").cast("double").alias("_weight")), "weights")
    spread = rows.filter("_known").agg(*[f(i).alias(f"{n}{i}") for i in inputs for n, f in (("mean", F.avg), ("std", F.stddev_samp))]).first()
    scaled = {i: (F.col(i) - F.lit(spread[f"mean{i}"] or 0.0)) / F.lit(spread[f"std{i}"]) if spread[f"std{i}"] else F.lit(0.0) for i in inputs}
    features = VectorAssembler(inputCols=inputs, outputCol="_scaled")
    model = KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="_cluster", maxIter=20, weightCol="_weight").fit(features.transform(points.withColumns(scaled)))
    told = model.transform(features.transform(rows.withColumns(scaled)))
    return told.select(*df.columns, F.when(F.col("_known"), F.col("_cluster")).alias("cluster"))


def flags(df: DataFrame, max_age_days: int = 60, low_share: float = 0.3) -> DataFrame:
    """is_stale: posted too long before the crawl; is_suspect: an outlier or far under the district's mean price."""
    mean = df.groupBy("district").agg(F.avg("price_vnd").alias("_mean"))
    out = _joined(with_outlier(df), mean, ["district"])
    stale = F.coalesce(T.age_days(F.col("crawled_at"), F.col("posted_at")) > max_age_days, F.lit(False))
    suspect = F.coalesce(F.col("is_outlier") | (F.col("price_vnd") < low_share * F.col("_mean")), F.lit(False))
    return out.withColumns({"is_stale": stale, "is_suspect": suspect}).drop("_mean")


def media_refs(df: DataFrame) -> DataFrame:
    """A reference for each image of a listing: object_key, image_url, media_type."""
    each = df.select("source", "listing_key", F.posexplode("image_urls_raw").alias("position", "image_url"))
    kind = F.lower(F.regexp_extract("image_url", r"\.(jpe?g|png|webp|gif)(?:[?#]|$)", 1))
    key = F.format_string("media/%s/%s/img-%03d.jpg", "source", "listing_key", F.col("position") + 1)
    return each.select("source", "listing_key", key.alias("object_key"), "image_url", F.when(kind == "", "image").otherwise(F.concat(F.lit("image/"), F.regexp_replace(kind, "jpg", "jpeg"))).alias("media_type"))


def serving_tables(silver: DataFrame) -> dict[str, DataFrame]:
    """Projections of silver for a serving database: listings, locations, prices, amenities."""
    return {
        "listings": silver.select("source", "listing_key", "url", "title", "area_m2", "posted_at"),
        "locations": silver.select("source", "listing_key", "ward", "district", "city"),
        "prices": silver.select("source", "listing_key", "price_vnd", "is_negotiable", "price_basis", "crawled_ts"),
        "amenities": silver.select("source", "listing_key", F.explode(F.array_distinct(F.coalesce("amenities_raw", F.array().cast("array<string>")))).alias("amenity")),
    }
