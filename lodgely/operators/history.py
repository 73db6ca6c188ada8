"""How listings were over runs: intervals of runs in which nothing about a listing changed, made in one pass or run by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a history beside the key and the values.
SPAN = ("first_run", "last_run", "seen")


def _same(a: str, b: str, values: list[str]) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & F.col(f"{a}.{v}").eqNullSafe(F.col(f"{b}.{v}"))
    return out


def once(rows: DataFrame, key: list[str], run: str, values: list[str], order: list[str]) -> DataFrame:
    """One row of each key and run: the first in an order of columns (nulls first), which a listing that a run met twice needs."""
    best = F.min_by(F.struct(*values), F.struct(*order, *values))
    return rows.groupBy(*key, run).agg(best.alias("v")).select(*key, run, *[F.col(f"v.{v}").alias(v) for v in values])


def intervals(rows: DataFrame, key: list[str], run: str, values: list[str]) -> DataFrame:
    """rows (one of each key and run; runs are whole numbers, all of them present) -> key, values, first_run, last_run, seen.

    An interval ends where a value changes or a run does not have the listing. Null is a value. One window over a
    listing's runs: a change or a gap starts an island, and islands are summed up.
    """
    keys = ", ".join(key)
    order = f"over (partition by {keys} order by {run})"
    now, before = F.struct(*values), F.expr(f"lag(struct({', '.join(values)})) {order}")
    starts = F.when(before.eqNullSafe(now) & (F.expr(f"lag({run}) {order}") == F.col(run) - 1), 0).otherwise(1)
    islands = rows.withColumn("_starts", starts).withColumn("_island", F.expr(f"sum(_starts) {order}"))
    return islands.groupBy(*key, "_island", *values).agg(F.min(run).alias("first_run"), F.max(run).alias("last_run"), F.count("*").alias("seen")).drop("_island")


def extend(history: DataFrame, rows: DataFrame, key: list[str], run_no: int, values: list[str]) -> DataFrame:
    """history (from intervals() or this) with run `run_no`, whose rows are one of each key; runs are added in order.

    Only intervals that reach the run before can grow, so they alone are joined to the new rows; all others are passed on.
    Adding runs one by one gives what intervals() gives of all of them. A run that is added again changes nothing.
    """
    before = history.filter(F.col("first_run") < run_no)
    again = F.col("last_run") >= run_no  # the run has been added before: as it was without it
    before = before.withColumns({"seen": F.when(again, F.col("seen") - 1).otherwise(F.col("seen")), "last_run": F.when(again, F.lit(run_no - 1)).otherwise(F.col("last_run"))})
    open_, closed = before.filter(F.col("last_run") == run_no - 1), before.filter(F.col("last_run") < run_no - 1)
    joined = open_.alias("o").join(rows.withColumn("_here", F.lit(True)).alias("n"), _same("o", "n", [*key, *values]), "full")
    came, went = F.col("n._here").isNotNull(), F.col("o.first_run").isNotNull()
    span = [
        F.when(went, F.col("o.first_run")).otherwise(F.lit(run_no)).alias("first_run"),
        F.when(came, F.lit(run_no)).otherwise(F.col("o.last_run")).alias("last_run"),
        (F.coalesce("o.seen", F.lit(0)) + F.when(came, 1).otherwise(0)).cast("long").alias("seen"),
    ]
    grown = joined.select(*[F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in [*key, *values]], *span)
    return closed.select(*key, *values, *SPAN).unionByName(grown)


def as_of(history: DataFrame, run_no: int) -> DataFrame:
    """Listings as a run had them."""
    return history.filter((F.col("first_run") <= run_no) & (F.col("last_run") >= run_no))


def run_changes(rows: DataFrame, key: str = "listing_id", run: str = "run_no") -> DataFrame:
    """Per run (whole numbers): its listings, and those kept, gained and lost since the run one before; null where there is no such run. Exact: each listing's runs are put in order, nothing is compared across the table."""
    met = rows.select(key, run).distinct().withColumn("_kept", F.expr(f"coalesce(lag({run}) over (partition by {key} order by {run}) = {run} - 1, false)"))
    by = met.groupBy(run).agg(F.count("*").alias("listings"), F.count_if("_kept").alias("kept"))
    before = by.select((F.col(run) + 1).cast(by.schema[run].dataType).alias(run), F.col("listings").alias("_before"))
    known = F.col("_before").isNotNull()
    return by.join(before, run, "left").select(run, "listings", F.when(known, F.col("kept")).alias("kept"), (F.when(known, F.col("listings") - F.col("kept"))).alias("gained"), (F.col("_before") - F.col("kept")).alias("lost"))
