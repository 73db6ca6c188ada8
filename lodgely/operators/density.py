"""Places close together: dense areas across cell edges, and the nearest listings of a point."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gold import nearby
from .silver import dup_groups, written


def cell_counts(df: DataFrame, step: float, share: Column | None = None) -> DataFrame:
    """cell_y, cell_x and listings of each cell of a grid of `step` degrees that has any; with `share`, how many rows it holds for (`marked`)."""
    known = df.filter("lat is not null and lon is not null")
    return known.groupBy(F.floor(F.col("lat") / step).alias("cell_y"), F.floor(F.col("lon") / step).alias("cell_x")).agg(F.count("*").alias("listings"), F.count_if(share if share is not None else F.lit(False)).alias("marked"))


def _beside(cells: DataFrame, own: bool) -> DataFrame:
    """cells with y and x of each of the eight cells around them, and of themselves with `own`."""
    steps = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if own or (y, x) != (0, 0)]
    around = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in steps])).alias("s")
    return cells.select("*", around).withColumns({"y": F.col("cell_y") + F.col("s.y"), "x": F.col("cell_x") + F.col("s.x")}).drop("s")


def dense_cells(cells: DataFrame, least: int) -> DataFrame:
    """Of cell_counts(): cells that, with the eight around them, have `least` listings or more; near is that sum. Counts travel, not listings."""
    told = _beside(cells.select("cell_y", "cell_x", "listings"), True).groupBy(F.col("y").alias("cell_y"), F.col("x").alias("cell_x")).agg(F.sum("listings").alias("near"))
    return cells.join(told, ["cell_y", "cell_x"]).filter(F.col("near") >= least)


def density_clusters(df: DataFrame, step: float = 0.1, least: int = 50, share: Column | None = None) -> DataFrame:
    """Dense cells with `cluster`: cells that touch, also at a corner, are one. cell_y, cell_x, listings, marked, near, cluster ("y:x" of its first cell by text)."""
    dense = written(dense_cells(cell_counts(df, step, share), least).withColumn("key", F.concat_ws(":", "cell_y", "cell_x")), "dense")
    beside = _beside(dense.select(F.col("key").alias("a"), "cell_y", "cell_x"), False).select("a", F.concat_ws(":", "y", "x").alias("b"))
    links = beside.join(dense.select(F.col("key").alias("b")), "b").filter("a < b").select("a", "b")
    groups = dup_groups(links, dense)
    return dense.join(groups, "key").drop("key").withColumnRenamed("group", "cluster")


def hotspot_areas(clusters: DataFrame, step: float = 0.1) -> DataFrame:
    """Per cluster: cells, listings, marked and its share, and its bounds in degrees."""
    by = clusters.groupBy("cluster").agg(F.count("*").alias("cells"), F.sum("listings").alias("listings"), F.sum("marked").alias("marked"), *[f(c).alias(n) for n, f, c in (("y0", F.min, "cell_y"), ("y1", F.max, "cell_y"), ("x0", F.min, "cell_x"), ("x1", F.max, "cell_x"))])
    edges = {"south": F.col("y0") * step, "north": (F.col("y1") + 1) * step, "west": F.col("x0") * step, "east": (F.col("x1") + 1) * step}
    return by.withColumns({"marked_share": F.col("marked") / F.col("listings"), **edges}).drop("y0", "y1", "x0", "x1")


def nearest(df: DataFrame, points: DataFrame, k: int, key: str = "listing_id", start_km: float = 1.0) -> DataFrame:
    """The k rows of df (lat, lon) nearest to each point (point_id, point_lat, point_lon), with km and rank; ties by key. All rows, where there are fewer.

    Each round finds what lies within a reach of the points that are left, which doubles: a point that has k rows within
    it is done, as all nearer ones are among them. So a point in a dense area reads its cells alone, and only points far
    from any listing go on to wide ones. Rows without a position are no candidates.
    """
    known = df.filter("lat is not null and lon is not null")
    wanted = min(k, known.limit(k).count())
    left, found, km = written(points.filter("point_lat is not null and point_lon is not null"), "points"), None, start_km
    order = f"row_number() over (partition by point_id order by km, {key})"
    while wanted and not left.isEmpty():
        near = nearby(known, left, km) if km < math.pi * 6371.0 else nearby(known, left, 20_100.0)
        best = written(near.withColumn("rank", F.expr(order)).filter(F.col("rank") <= k), "nearest")
        done = best.filter(F.col("rank") == wanted).select("point_id")
        own = best.join(done, "point_id", "left_semi")
        found = own if found is None else found.unionByName(own)
        left = written(left.join(done, "point_id", "left_anti"), "points")
        km *= 2
    return found if found is not None else nearby(known.limit(0), points, km).withColumn("rank", F.lit(0)).filter("false")


def best_matches(df: DataFrame, points: DataFrame, k: int = 10, budget: int | None = None, least_area: float | None = None, key: str = "listing_id") -> DataFrame:
    """The k nearest listings of each workplace that fit a budget and an area, where these are given."""
    fits = df if budget is None else df.filter(F.col("price_vnd") <= budget)
    return nearest(fits if least_area is None else fits.filter(F.col("area_m2") >= least_area), points, k, key)
