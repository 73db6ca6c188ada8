"""Tables of sketches by place, day, source or run, which merge: quantiles, rolling quantiles and distinct counts without a second scan. Beside them tables of counts, which merge as well and are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .silver import written

#: Sizes of the sketches: a KLL sketch of K = 400 is off by about 0.8 % of the rank, a theta sketch of 2^14 entries by 1.6 %, an HLL sketch of 2^14 cells by 0.8 % (two deviations).
K, LG_THETA, LG_HLL = 400, 14, 14


def quantile_table(df: DataFrame, by: list[str], value: str = "price_vnd", k: int = K) -> DataFrame:
    """by, n and sketch (KLL) of the known values of each group, made before the shuffle; a null in `by` is a group."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint(value, F.lit(k)).alias("sketch"))


def merged(table: DataFrame, by: list[str]) -> DataFrame:
    """A quantile table for coarser groups."""
    return table.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def quantile(rank: float, sketch: str = "sketch") -> Column:
    """The value that about this share of the values does not exceed."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.lit(float(rank)))


def cuts(steps: int = 200, sketch: str = "sketch") -> Column:
    """Array of steps values that stand at equal distances of rank."""
    return F.kll_sketch_get_quantile_bigint(sketch, F.array(*[F.lit((i + 0.5) / steps) for i in range(steps)]))


def with_sketched_percentile(df: DataFrame, by: str = "district", value: str = "price_vnd", k: int = K) -> DataFrame:
    """df with price_percentile, the share of cheaper ones in its group, by 200 cuts of the group's sketch: no window, no list of values. Rows without a value get null; rows without a group are one."""
    table = quantile_table(df, [by], value, k).select(F.col(by).alias("_by"), cuts().alias("_cuts"))
    joined = df.join(table, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    below = F.size(F.filter("_cuts", lambda x: x < F.col(value))) / F.size("_cuts")
    return joined.withColumn("price_percentile", F.when(F.col(value).isNotNull(), below)).drop("_cuts")


def with_sketched_outlier(df: DataFrame, by: str = "district", value: str = "price_vnd", k: int = K) -> DataFrame:
    """df with is_outlier: beyond the sketched quartiles by 1.5 quartile ranges."""
    table = quantile_table(df, [by], value, k).select(F.col(by).alias("_by"), quantile(0.25).alias("_q1"), quantile(0.75).alias("_q3"))
    span = 1.5 * (F.col("_q3") - F.col("_q1"))
    out = (F.col(value) < F.col("_q1") - span) | (F.col(value) > F.col("_q3") + span)
    return df.join(table, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("is_outlier", F.coalesce(out, F.lit(False))).drop("_by", "_q1", "_q3")


def _cover(first: str, end: str, levels: int) -> Column:
    """Array of (level, block) that make up the days from first to before end: blocks of 2^level days that start at multiples of it, at most two of a level."""
    none = "cast(array() as array<struct<level: int, block: bigint>>)"
    low, high = "s.lo + pmod(s.lo, 2)", "s.hi - pmod(s.hi, 2)"
    left = f"if(s.lo < s.hi and pmod(s.lo, 2) = 1, array(struct(j as level, s.lo as block)), {none})"
    right = f"if({low} < s.hi and pmod(s.hi, 2) = 1, array(struct(j as level, s.hi - 1 as block)), {none})"
    step = f"struct(({low}) div 2 as lo, ({high}) div 2 as hi, concat(s.got, {left}, {right}) as got)"
    return F.expr(f"aggregate(sequence(0, {levels - 1}), struct(bigint({first}) as lo, bigint({end}) as hi, {none} as got), (s, j) -> {step}).got")


def rolling_quantiles(table: DataFrame, days: int = 30, ranks: tuple[float, ...] = (0.5,), by: str = "district", day: str = "day") -> DataFrame:
    """Of a quantile table by place and day: place, day, n and recent (an array, one for each rank) over the last `days` days.

    Sketches of days are merged once into blocks of two, four, eight days and so on; a span of days is then a handful of
    blocks (at most two of each size) in place of `days` copies, and work grows with the days that have listings.
    """
    levels = max(1, days.bit_length())
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("long")
    table = written(table, "sketches")  # blocks are made from it level by level, so it is read, not made again
    base = table.select(F.col(by).alias("_by"), number.alias("block"), "n", "sketch")
    cells = base.withColumn("level", F.lit(0))
    for level in range(1, levels):
        base = written(base.groupBy("_by", F.floor(F.col("block") / 2).alias("block")).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch")), "sketches")
        cells = cells.unionByName(base.withColumn("level", F.lit(level)))
    wanted = table.select(F.col(by).alias("_place"), F.col(day).alias("_day"), number.alias("d")).distinct()
    wanted = wanted.select("_place", "_day", F.explode(_cover(f"d - {days - 1}", "d + 1", levels)).alias("c")).select("_place", "_day", "c.level", "c.block")
    met = wanted.join(cells.withColumnsRenamed({"level": "_level", "block": "_block"}), (F.col("level") == F.col("_level")) & (F.col("block") == F.col("_block")) & F.col("_place").eqNullSafe(F.col("_by")))
    found = met.groupBy(F.col("_place").alias(by), F.col("_day").alias(day)).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return found.select(by, day, "n", F.array(*[quantile(r) for r in ranks]).alias("recent"))


def count_table(df: DataFrame, by: list[str], value: str = "price_vnd") -> DataFrame:
    """by, value and n: how often each group has each known value, counted before the shuffle; a null in `by` is a group. It merges by summing n over coarser groups, and what is read from it is exact."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def exact_quantiles(counts: DataFrame, by: list[str], ranks: tuple[float, ...] = (0.5,), value: str = "price_vnd") -> DataFrame:
    """Of a count table: by, n and quantiles (an array, one for each rank), the least value that at least this share of the group's values does not exceed. Windows hold distinct values, and run over them in order."""
    merged_ = counts.groupBy(*by, value).agg(F.sum("n").alias("n"))
    keys = f"partition by {', '.join(by)}"
    run = merged_.withColumn("_upto", F.expr(f"sum(n) over ({keys} order by {value} rows unbounded preceding)")).withColumn("_all", F.expr(f"sum(n) over ({keys})"))
    least = lambda r: F.min(F.when(F.col("_upto") >= F.greatest(F.ceil(F.col("_all") * F.lit(float(r))), F.lit(1)), F.col(value)))
    return run.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*[least(r) for r in ranks]).alias("quantiles"))


def exact_rolling(counts: DataFrame, days: int = 30, ranks: tuple[float, ...] = (0.5,), by: str = "district", day: str = "day", value: str = "price_vnd") -> DataFrame:
    """Of a count table by place and day: place, day, n and recent (an array, one for each rank) over the last `days` days, exact. Counts are summed over blocks of days as in rolling_quantiles(), so a value goes to a day a handful of times in place of `days`."""
    levels = max(1, days.bit_length())
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).cast("long")
    own = counts.select(F.col(by).alias("_by"), number.alias("d"), F.col(value).alias("_v"), "n")
    cells = own.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).groupBy("_by", "level", F.expr("shiftright(d, level)").alias("block"), "_v").agg(F.sum("n").alias("n"))
    wanted = counts.select(F.col(by).alias("_place"), F.col(day).alias("_day"), number.alias("d")).distinct()
    wanted = wanted.select("_place", "_day", F.explode(_cover(f"d - {days - 1}", "d + 1", levels)).alias("c")).select("_place", "_day", F.col("c.level").alias("_level"), F.col("c.block").alias("_block"))
    met = cells.join(wanted, (F.col("level") == F.col("_level")) & (F.col("block") == F.col("_block")) & F.col("_by").eqNullSafe(F.col("_place")))
    return exact_quantiles(met.select("_place", "_day", "_v", "n"), ["_place", "_day"], ranks, "_v").select(F.col("_place").alias(by), F.col("_day").alias(day), "n", F.col("quantiles").alias("recent"))


def distinct_table(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, rows, hll and theta: sketches of the distinct known values of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(value, F.lit(LG_HLL)).alias("hll"), F.theta_sketch_agg(value, F.lit(LG_THETA)).alias("theta"))


def distinct_over(table: DataFrame, by: list[str]) -> DataFrame:
    """Per coarser group: rows and about how many distinct values; a value of several groups counts once."""
    return table.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"))


def distinct_changes(table: DataFrame, order: str) -> DataFrame:
    """Of a table by one column in order (runs, days): about how many values each has, has in common with the one before, has gained and lost."""
    before = F.expr(f"lag(theta) over (order by {order})")
    pairs = table.select(order, "theta", before.alias("before"))
    count = F.theta_sketch_estimate
    return pairs.select(
        order, count("theta").alias("values"), count(F.theta_intersection("theta", "before")).alias("kept"), count(F.theta_difference("theta", "before")).alias("gained"), count(F.theta_difference("before", "theta")).alias("lost")
    )
