"""Entropy balancing: rates of documents, tilted exponentially, that meet token targets of sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_count, written

#: Weights of sources in order of code points, repeating.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Of counts (source, size, n): source, source_size, docs, target. A target is share x all sizes by weight, at most `most` x its source.

    What a source cannot take goes to the others by weight until none is above; as that only ever raises the level of
    the others, it is a search for one level, with a sum over the sources in each step. The null source comes last.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    nth = F.expr("row_number() over (order by source asc nulls last)") - 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (nth % len(weights) + 1).cast("int")))
    sources = written(sources, "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        above = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        cap, left, count = sources.agg(F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if not left or count == full:
            break
        level, full = (share * total - (cap or 0.0)) / left, count
    return sources.withColumn("target", F.least(F.col("source_size") * F.lit(float(most)), F.lit(level) * F.col("weight")))


def balance(sizes: DataFrame, sources: DataFrame, most: float = 2.0, rounds: int = 60, near: float = 1e-9) -> DataFrame:
    """Of counts (source, size, n) and targets: source and tilt, so that documents at rates min(most, exp(tilt x size / mean size)) sum to the targets.

    These rates are the closest to 1, by relative entropy, that do and that stay under `most`. Each round sums value and
    slope of the convex dual over the counts and takes a Newton step for every source, halving its bracket where the step
    leaves it. Sources whose target is all they can give are left at an infinite tilt, those of target 0 at minus infinity.
    """
    state = sources.select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), (F.col("source_size") * most).alias("all"))
    edge = F.when(F.col("target") >= F.col("all") * (1 - 1e-12), F.lit(math.inf)).when(F.col("target") <= 0, F.lit(-math.inf))
    state = written(state.withColumn("tilt", F.coalesce(edge, F.lit(0.0))).withColumns({"low": F.lit(-math.inf), "high": F.lit(math.inf), "off": F.when(edge.isNull(), 1.0).otherwise(0.0)}), "tilts")
    cells = written(sizes.filter("size > 0"), "counts")
    for _ in range(rounds):
        if (state.agg(F.max("off")).first()[0] or 0.0) <= near:
            break
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(50.0)))
        open_ = state.filter(F.col("off") > near).withColumnRenamed("source", "s")
        gained = cells.join(open_, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * F.least(raw, F.lit(most))).alias("value"),
            F.sum(F.when(raw < most, F.col("n") * F.col("size") * x * raw).otherwise(0.0)).alias("slope"),
        )
        now = state.join(gained, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        over = F.col("value") - F.col("target")
        now = now.withColumns({"low": F.when(over < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))})
        step = F.col("tilt") - F.try_divide(over, F.col("slope"))
        inside = (step > F.col("low")) & (step < F.col("high"))
        half = F.when(F.col("low") == -math.inf, F.col("high") - 4 * (1 + F.abs("high"))).when(F.col("high") == math.inf, F.col("low") + 4 * (1 + F.abs("low"))).otherwise((F.col("low") + F.col("high")) / 2)
        off = F.abs(over) / F.col("target")
        moved = F.col("value").isNotNull() & (off > near)
        flat = (F.col("high") - F.col("low")) <= 1e-14 * (1 + F.abs("tilt"))
        now = now.withColumns({"off": F.when(F.col("value").isNull() | flat, 0.0).otherwise(off), "tilt": F.when(moved & inside, step).when(moved, half).otherwise(F.col("tilt"))})
        state = written(now.drop("value", "slope"), "tilts")
    return state.select("source", "tilt", "mean")


def _whole(cells):
    """Copies of the rows of each size of one source, from the largest size down; each size makes good what those before it are off."""
    cells = cells.sort_values("size", ascending=False)
    owed, copies = 0.0, []
    for size, n, rate, most in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), cells["most"].tolist()):
        want = n * rate * size + owed
        k = min(max(int(want / size + 0.5), 0), int(most * n)) if size else n
        owed = want - k * size
        copies.append(k)
    return cells.assign(copies=copies)[["source", "size", "copies"]]


def with_copies(docs: DataFrame, share: float = 1.5, most: int = 2, blocks: int = 256) -> DataFrame:
    """docs (doc_id, source, text, ...) with size (words), source_size, target, rate and copies (0 to `most`).

    Rates come from balance(). Rows of one source and size have one rate; how many copies they take together is fixed for
    each source from the largest size down, over one row for each size, and the error left is about the smallest size.
    Within a size, copies are dealt in a fixed order: by a hash of the doc_id and text into blocks, then by doc_id and
    hash; so no size needs to be sorted in one task, whatever the ids. Texts without words are taken once. Nulls: a null text has no words, the null source
    is a source, null ids are ids. Extra columns pass through; those named like the new ones are replaced.
    """
    new = ("size", "source_size", "target", "rate", "copies")
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))
    base = docs.select(*[c for c in docs.columns if c not in new], word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("_mix_at"), key.alias("_mix_key")).withColumn("_mix_block", F.pmod(F.col("_mix_at"), F.lit(blocks)))
    counts = written(base.groupBy("source", "_mix_key", "size", "_mix_block").agg(F.count("*").alias("n")), "blocks")
    sizes = written(counts.groupBy("source", "size").agg(F.sum("n").alias("n")), "sizes")
    sources = written(source_targets(sizes, share, most), "targets")
    tilts = balance(sizes, sources, most)
    s = tilts.withColumnRenamed("source", "_mix_s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("tilt") == math.inf, float(most)).when(F.col("tilt") == -math.inf, 0.0).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = written(sizes.join(s, F.col("source").eqNullSafe(F.col("_mix_s"))).select("source", "size", "n", rate.alias("rate"), F.lit(most).alias("most")), "rates")
    kind = sizes.schema["source"].dataType.simpleString()
    dealt = rated.groupBy("source").applyInPandas(_whole, f"source {kind}, size long, copies long")
    cells = rated.select(F.col("source").alias("_mix_s"), F.col("size").alias("_mix_z"), F.col("n").alias("_mix_n"), "rate")
    cells = cells.join(dealt, F.col("_mix_s").eqNullSafe(F.col("source")) & (F.col("_mix_z") == F.col("size"))).select("_mix_s", "_mix_z", "_mix_n", "rate", F.col("copies").alias("_mix_copies"))
    starts = counts.withColumn("_mix_before", F.expr("sum(n) over (partition by source, size order by _mix_block) - n")).drop("n")
    starts = starts.join(cells, F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("size") == F.col("_mix_z"))).drop("source", "size")
    t = sources.select(F.col("source").alias("_mix_t"), "source_size", "target")
    starts = written(starts.join(t, F.col("_mix_s").eqNullSafe(F.col("_mix_t"))).withColumnRenamed("_mix_z", "size").drop("_mix_t", "_mix_s"), "starts")
    # joined and numbered by the same columns, so whole rows are shuffled once
    placed = base.join(starts, ["_mix_key", "size", "_mix_block"])
    place = F.expr("row_number() over (partition by _mix_key, size, _mix_block order by doc_id, _mix_at) - 1") + F.col("_mix_before")
    copies = F.floor(F.col("_mix_copies") / F.col("_mix_n")) + F.when(place < F.col("_mix_copies") % F.col("_mix_n"), 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("int")).drop("_mix_key", "_mix_block", "_mix_at", "_mix_before", "_mix_n", "_mix_copies")


def op5_mixing(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, source, rate, copies. See with_copies() for nulls and clashing names; very long texts are counted whole, repeated rows are dealt copies each, equal sizes by id and hash, an empty table gives an empty one."""
    mixed = with_copies(docs.select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")
