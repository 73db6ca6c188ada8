"""Balanced label propagation: linked documents move to the shards of their neighbours while counts stay even."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def _at(values: list[float], index: Column) -> Column:
    """The value of a short list at a 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def uniform(*columns: Column) -> Column:
    """A fixed number in [0, 1) for the values of some columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def row_hash(seed: int) -> Column:
    """A hash of a row's doc_id or, where that is null, of its key: rows without an id are spread like others."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(seed))).otherwise(F.xxhash64("key", F.lit(seed)))


def _pick(u: Column, shares: list[float]) -> Column:
    """The index whose share of [0, 1) holds u."""
    total, run, out = sum(shares) or 1.0, 0.0, None
    for i, share in enumerate(shares):
        run += share / total
        out = F.when(u < run, i) if out is None else out.when(u < run, i)
    return out.otherwise(max(range(len(shares)), key=shares.__getitem__))


def both_ways(edges: DataFrame) -> DataFrame:
    """edges (a, b, weight) between keys in both directions, summed; null ends and loops are left out."""
    there = edges.select("a", "b", F.col("weight").cast("double").alias("weight"))
    return there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).filter("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight"))


#: Cells of a task: the state of a round shrinks to fewer tasks than the session's shuffles have where it is small.
TASK_CELLS = 20_000


def _drawn(cells: DataFrame, links: DataFrame, free: list[float] | None, tasks: int) -> DataFrame:
    """cells (key, shard, n) with the target of each: of the shards with free places the one that holds most of its neighbours, unless its own holds more. Without `free`, of all shards, if it holds more than its own.

    A join brings the cells of each key's neighbours (itself among them, if it has several rows) to the key, and they are
    added up by shard.
    """
    there = links.select("a", F.col("b").alias("key"), "weight").join(cells, "key")
    votes = there.groupBy(F.col("a").alias("key"), "shard").agg(F.sum(F.col("weight") * F.col("n")).alias("votes")).coalesce(tasks)
    best = (votes if free is None else votes.filter(_at(free, F.col("shard")) >= 1)).groupBy("key").agg(F.max(F.struct("votes", (-F.col("shard")).alias("neg"))).alias("best")).coalesce(tasks)
    held = cells.join(votes, ["key", "shard"], "left").join(best, "key", "left").coalesce(tasks)
    own = F.coalesce("votes", F.lit(0.0))
    moves = F.coalesce((F.col("best.votes") > own if free is None else F.col("best.votes") >= own) & (F.col("best.neg") != -F.col("shard")), F.lit(False))
    return held.select("key", "shard", "n", F.when(moves, -F.col("best.neg")).otherwise(F.col("shard")).alias("target"))


def cut_edges(placed: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Of rows (key, shard): one row with `cut`, the weight of links between rows of different shards, and `total`, that of all.

    Rows of one key are linked pair by pair with weight 1, rows of keys that edges (a, b, weight) link with that weight.
    From counts of rows by key and shard, so no pair of rows is made.
    """
    cells = placed.groupBy("key", "shard").agg(F.count("*").cast("double").alias("n"))
    sums = cells.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"))
    found = sums.select(((F.col("all") ** 2 - F.col("same")) / 2).alias("cut"), (F.col("all") * (F.col("all") - 1) / 2).alias("total"))
    if edges is not None:
        links = both_ways(edges).filter("a < b")
        ends = lambda k: sums.select(F.col("key").alias(k), F.col("all").alias(f"all_{k}"))
        total = links.join(ends("a"), "a").join(ends("b"), "b").select((F.col("weight") * F.col("all_a") * F.col("all_b")).alias("total"))
        one, two = (cells.select(F.col("key").alias(k), "shard", F.col("n").alias(f"n_{k}")) for k in ("a", "b"))
        kept = links.join(one, "a").join(two, ["b", "shard"]).select((F.col("weight") * F.col("n_a") * F.col("n_b")).alias("kept"))
        found = found.unionByName(total.select(F.col("total").alias("cut"), "total")).unionByName(kept.select((-F.col("kept")).alias("cut"), F.lit(0.0).alias("total")))
    return found.agg(F.coalesce(F.sum("cut"), F.lit(0.0)).alias("cut"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))


def propagate(rows: DataFrame, shards: int, rounds: int = 16, edges: DataFrame | None = None) -> tuple[DataFrame, list[float]]:
    """Of rows (key, start), where rows of one key are linked, and keys by edges (a, b, weight): cells (key, shard, n) after the moves, and the linked rows of each shard.

    All rows of a key in a shard are one cell, so a group of any size is at most `shards` cells. In each round a join
    brings the cells of neighbours to each cell, which is drawn to the shard that holds most of them: in every other round
    of those with free places, which take no more than these, in the rounds between of all, and as many rows go from one
    shard to another as come back. Where more are drawn, each cell sends its share, rounded by a hash. It ends when no
    row moves, or after `rounds`.
    """
    n = rows.count()
    counted = rows.groupBy("key", F.col("start").alias("shard")).agg(F.count("*").alias("n"))
    links = counted.groupBy("key").agg(F.sum("n").alias("all")).filter("all > 1").select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("weight"))
    if edges is not None:
        links = links.unionByName(both_ways(edges))
    links = written(links, "edges")
    cells = written(counted.join(links.select(F.col("a").alias("key")).distinct(), "key", "left_semi"), "cells")
    still = 0
    for turn in range(rounds + 1):
        load = {r[0]: r[1:] for r in cells.groupBy("shard").agg(F.sum("n"), F.count("*")).collect()}
        held = [float(load.get(s, (0, 0))[0]) for s in range(shards)]
        tasks = max(6, sum(k for _, k in load.values()) // TASK_CELLS)
        free = [max(0.0, n / shards - h) for h in held]
        if turn == rounds or still == 2:
            return cells, held
        swap = turn % 2 == 1
        drawn = written(_drawn(cells, links, None if swap else free, tasks), "drawn")
        asked = {(r[0], r[1]): r[2] for r in drawn.filter("shard <> target").groupBy("shard", "target").agg(F.sum("n")).collect()}
        total = [sum(x for (_, t), x in asked.items() if t == s) for s in range(shards)]
        share = lambda s, t, x: min(x, asked.get((t, s), 0)) / x if swap else min(1.0, free[t] / total[t])
        rate = [share(s, t, asked[s, t]) if (s, t) in asked else 0.0 for s in range(shards) for t in range(shards)]
        if not any(rate):
            still += 1
            continue
        still = 0
        sent = F.floor(F.col("n") * _at(rate, F.col("shard") * shards + F.col("target")) + uniform(F.col("key"), F.col("shard"), F.lit(turn))).cast("long")
        moved = drawn.withColumn("sent", F.when(F.col("shard") == F.col("target"), F.lit(0)).otherwise(F.least("n", sent)))
        moved = moved.select("key", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("sent")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("sent").alias("n")))).alias("c"))
        cells = written(moved.filter("c.n > 0").groupBy("key", "c.shard").agg(F.sum("c.n").alias("n")).coalesce(tasks), "cells")


def shard(rows: DataFrame, shards: int = 24, block_rows: int = 500, edges: DataFrame | None = None) -> DataFrame:
    """rows (doc_id, key, ...) with shard and slot: counts of shards are at most one apart, and slots of each are gapless from 0.

    Linked rows (equal keys, and keys that edges (a, b, weight) link) prefer the shard that propagate() gives them, rows of a key in several shards by a hash of
    their doc_id in proportion; other rows fill the free places. All rows then stand in one order of preferred shards,
    with unlinked rows at both ends of each, and the order is cut at equal counts, so that nearly all rows that change
    hands there are unlinked. A null doc_id is a value like any other (such rows go by a hash of their key), repeated rows are rows of their own, a row's size
    does not matter, and an empty table gives an empty one. Other columns pass through; those named start, u, pref, side,
    block, before, nth, place, shard or slot are replaced.
    """
    rows = rows.drop("start", "u", "pref", "side", "block", "before", "nth", "place", "shard", "slot")
    rows = rows.withColumn("start", F.pmod(row_hash(1), F.lit(shards)).cast("int"))
    cells, held = propagate(rows.select("key", "start"), shards, edges=edges)
    n = rows.count()
    free = [max(0.0, n / shards - h) for h in held]
    plan = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("cells"), F.sum("n").alias("linked"))
    own = "aggregate(cells, struct(0L as run, -1 as shard), (a, c) -> struct(a.run + c.n as run, if(a.shard < 0 and u * linked < a.run + c.n, c.shard, a.shard) as shard)).shard"
    spread = rows.drop("start").join(plan, "key", "left").withColumn("u", F.pmod(row_hash(2), F.lit(1 << 40)) / F.lit(float(1 << 40)))
    spread = spread.withColumn("pref", F.when(F.col("linked").isNull(), _pick(F.col("u"), free)).otherwise(F.expr(own)).cast("int"))
    side = F.when(F.col("linked").isNotNull(), 1).otherwise(F.pmod(row_hash(3), F.lit(2)) * 2).cast("int")
    blocks = max(1, -(-n // (shards * block_rows)))
    spread = spread.withColumn("side", side).withColumn("block", F.pmod(row_hash(4), F.lit(blocks)))
    spread = written(spread.drop("cells", "linked", "u"), "preferred")
    sizes = spread.groupBy("pref", "side", "block").agg(F.count("*").alias("n"))
    totals = {r[0]: r[1] for r in sizes.groupBy("pref").agg(F.sum("n")).collect()}
    before = [sum(totals.get(s, 0) for s in range(k)) for k in range(shards)]
    starts = sizes.withColumn("before", F.expr("sum(n) over (partition by pref order by side, block) - n")).drop("n")
    placed = spread.join(starts, ["pref", "side", "block"]).withColumn("nth", F.expr("row_number() over (partition by pref, side, block order by doc_id, key)"))
    place = (_at(before, F.col("pref")) + F.col("before") + F.col("nth") - 1).cast("long")
    low, more = divmod(n, shards)
    cut = more * (low + 1)
    rest = F.lit(max(1, low))
    placed = placed.withColumn("place", place)
    number = F.when(F.col("place") < cut, F.floor(F.col("place") / (low + 1))).otherwise(more + F.floor((F.col("place") - cut) / rest)).cast("int")
    first = F.when(F.col("shard") <= more, F.col("shard") * (low + 1)).otherwise(F.lit(cut) + (F.col("shard") - more) * low)
    return placed.withColumn("shard", number).withColumn("slot", (F.col("place") - first).cast("long")).drop("pref", "side", "block", "before", "nth", "place")


def documents_by_text(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8 for the id), text_crc32 and key, equal for equal texts; a null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def op2_sharding(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law (rows), shard, slot. Documents of equal texts are linked, null and empty texts among them; see shard() for the rest."""
    base = written(documents_by_text(docs), "sizes")
    return shard(base, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
