"""Hard negatives by a vertical scan: columns of vectors are read in each anchor's order of magnitude, and bounds of what is unread drop candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import open_fs, released, shared_dir, written

#: Rows of a task and of a block of columns in it; anchors that are read at a time.
TASK_ROWS, BLOCK_ROWS, ANCHORS = 65_536, 8_192, 256
VECTORS = "id long, label long, vector array<long>"


class Block:
    """Some rows in columns, by label and id: x[d] is dimension d of all rows, low[d] and high[d] its least and largest value."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.largest = int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0
        whole = np.ascontiguousarray(x[order].T)
        self.low, self.high = (whole.min(1), whole.max(1)) if x.size else (np.zeros(len(whole)),) * 2
        self.kinds, self.whole = {}, whole

    def columns(self, largest: int) -> np.ndarray:
        """The columns as the smallest kind of number in which inner products with numbers up to `largest` are exact."""
        most = self.largest * largest * max(1, len(self.whole))
        kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
        if kind not in self.kinds:
            self.kinds[kind] = self.whole.astype(kind)
        return self.kinds[kind]

    def same(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


def vertical_scan(block: Block, anchor: np.ndarray, at: np.ndarray, goal) -> tuple[np.ndarray, np.ndarray]:
    """Rows `at` of a block that may matter to goal, with their exact inner products.

    Dimensions are taken by falling magnitude in the anchor, some at a time. With the least and largest that the others can
    add, each row has bounds, and goal(least, largest) marks the rows that stay.
    """
    if not len(at):
        return at, np.zeros(0, np.int64)
    columns = block.columns(int(np.abs(anchor).max()) if len(anchor) else 0)
    a = anchor.astype(columns.dtype)
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.sort(np.stack([a * block.low.astype(a.dtype), a * block.high.astype(a.dtype)]), axis=0)[:, order]
    left = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1), a.dtype)], axis=1)
    got, step, done = np.zeros(len(at), a.dtype), max(4, len(order) // 8), 0
    while done < len(order):
        dims = order[done : done + step]
        done += len(dims)
        got = got + (a[dims] @ (columns[dims] if len(at) == columns.shape[1] else columns[dims][:, at] if 2 * len(at) > columns.shape[1] else columns[np.ix_(dims, at)]))
        stays = goal(got + left[0, done], got + left[1, done])
        if not stays.all():
            at, got = at[stays], got[stays]
            if not len(at):
                break
    return at, got.astype(np.int64)


def _kth(x: np.ndarray, k: int):
    """The k-th largest, or None if there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else None


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _more(held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return _best(np.concatenate([held[0], ids]), np.concatenate([held[1], scores]), k)


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def nearest_alike(blocks: list[Block], anchor: np.ndarray, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of the anchor's label with the largest products, ties by id; the anchor's own row among them."""
    best = _NONE
    for block in blocks:
        lo, hi = block.same(label)
        floor = best[1][-1] if len(best[1]) == k else None

        def goal(least, largest):
            own = _kth(least, k)
            bar = floor if own is None else own if floor is None else max(own, floor)
            return np.ones(len(least), bool) if bar is None else largest >= bar

        at, scores = vertical_scan(block, anchor, np.arange(lo, hi), goal)
        best = _more(best, block.ids[at], scores, k)
    return best


def in_windows(blocks: list[Block], anchor: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per window (low, high): the k rows of other labels with the largest products in it, ties by id."""
    best = [_NONE] * len(windows)
    for block in blocks:
        lo, hi = block.same(label)

        def goal(least, largest):
            stays = np.zeros(len(least), bool)
            for (low, high), held in zip(windows, best):
                may = (largest >= low) & (least <= high)
                bar = _kth(least[may & (least >= low) & (largest <= high)], k)
                if len(held[1]) == k and (bar is None or held[1][-1] > bar):
                    bar = held[1][-1]
                stays |= may if bar is None else may & (largest >= bar)
            return stays

        at, scores = vertical_scan(block, anchor, np.concatenate([np.arange(lo), np.arange(hi, len(block.ids))]), goal)
        for w, (low, high) in enumerate(windows):
            inside = (scores >= low) & (scores <= high)
            best[w] = _more(best[w], block.ids[at[inside]], scores[inside], k)
    return best


def _matrix(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of a column of arrays: (dimensions, rows, matrix) for each number of dimensions."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, int)
    out = []
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        out.append((d, rows, flat[starts[rows][:, None] + np.arange(d)].reshape(len(rows), d)))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> dict[int, list[Block]]:
    """The rows (id, label, vector) of a task as blocks, by number of dimensions."""
    parts: dict[int, list[tuple]] = {}
    for b in batches:
        ids, labels = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        for d, rows, x in _matrix(b.column(b.schema.get_field_index("vector"))):
            parts.setdefault(d, []).append((ids[rows], labels[rows], x))
    out: dict[int, list[Block]] = {}
    for d, some in parts.items():
        ids, labels, x = (np.concatenate(c) for c in zip(*some))
        out[d] = [Block(ids[k : k + BLOCK_ROWS], labels[k : k + BLOCK_ROWS], x[k : k + BLOCK_ROWS]) for k in range(0, len(ids), BLOCK_ROWS)]
    return out


def _anchors(folder: str, columns: list[str]) -> Iterator[dict]:
    """Rows of a written table of anchors, ANCHORS at a time, with `vector` as an array of numbers."""
    fs, base = open_fs(folder)
    for info in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                for batch in pq.ParquetFile(file).iter_batches(ANCHORS, columns=columns):
                    other = [c for c in columns if c != "vector"]
                    rows = batch.select(other).to_pylist()
                    for _, at, x in _matrix(batch.column(batch.schema.get_field_index("vector"))):
                        for k, v in zip(at.tolist(), x):
                            rows[k]["vector"] = v
                    yield from rows


def _scanned(rows: DataFrame, folder: str, columns: list[str], found, schema: str, shape: pa.Schema) -> DataFrame:
    """found(blocks, anchor) -> tuples, for every task's rows and every anchor of a written table.

    A task holds its own rows (TASK_ROWS, see spread()) and reads the anchors past them, so nothing is replicated or
    broadcast, whatever the number of anchors.
    """

    def run(batches):
        blocks, held = _blocks(batches), []
        for anchor in _anchors(folder, columns) if blocks else ():
            held += found(blocks.get(len(anchor["vector"]), []), anchor)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)

    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


def spread(rows: DataFrame) -> DataFrame:
    """rows (id, label, vector) as a written table in parts of TASK_ROWS at most on average, whatever their ids and labels."""
    spark = rows.sparkSession
    kept = written(rows, "vectors")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // TASK_ROWS))
    return kept.repartition(parts)


def top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows (other, score) of each group, by falling score and then id, with their rank; tasks keep k of a group before the shuffle."""
    order = f"row_number() over (partition by {', '.join(by)} order by score desc, other)"
    return found.withColumn("rank", F.expr(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows (id, label, vector of whole numbers) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is an inner product, exact; a larger one comes first, ties by smaller id. An anchor's positives are its first
    other rows of the same label. For each, negatives are the first rows of other labels whose score is from `low` to
    `high` percent of the positive's; rank counts them from 1. A positive without negatives gives no row.

    Rows with a null id, label or vector, or a null in it, take no part; rows with another number of dimensions than the
    anchor's are none of its candidates. Repeated rows are rows each: a copy of an anchor is another row of its label, and
    each copy gives the anchor's result. Scores that do not fit a long are an error. An empty table gives an empty one,
    other columns are left out. Two scans of all rows, one for positives and one for negatives, each by vertical_scan().
    """
    spark = rows.sparkSession
    good = rows.filter("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    own = written(good.filter(is_anchor).groupBy("id", "label", "vector").agg(F.count("*").alias("copies")).withColumn("key", F.monotonically_increasing_id()), "anchors")
    parts = spread(good.select("id", "label", "vector"))
    folder = shared_dir(spark, "anchor-vectors")
    own.select("key", "label", "vector").write.parquet(folder)
    pair = pa.schema([("key", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])
    near = lambda blocks, a: [(a["key"], i, s) for i, s in zip(*(x.tolist() for x in nearest_alike(blocks, a["vector"], a["label"], positives + 1)))]
    first = top(_scanned(parts, folder, ["key", "label", "vector"], near, "key long, other long, score long", pair), ["key"], positives + 1)
    itself = own.select("key", F.col("id").alias("anchor_id"), "copies", F.expr("aggregate(vector, 0L, (s, x) -> s + x * x)").alias("norm"))
    first = first.join(itself, "key").withColumn("mine", F.expr("other = anchor_id and score = norm"))
    # of several rows that look like the anchor one is itself
    first = first.withColumn("before", F.expr("count_if(mine) over (partition by key order by rank rows between unbounded preceding and 1 preceding)")).filter("not (mine and before = 0)")
    first = first.withColumn("place", F.expr("row_number() over (partition by key order by rank)")).filter(F.col("place") <= positives)
    first = written(first.select("key", "anchor_id", "copies", F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "positives")
    wanted = own.join(first.groupBy("key").agg(F.sort_array(F.collect_set("positive_score")).alias("scores")), "key")
    folder = shared_dir(spark, "anchor-windows")
    wanted.select("key", "label", "vector", "scores").write.parquet(folder)
    triple = pa.schema([("key", pa.int64()), ("positive_score", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])

    def between(blocks, a):
        windows = [(p, (-(-low * p // 100), high * p // 100)) for p in a["scores"]]
        windows = [(p, w) for p, w in windows if w[0] <= w[1]]
        got = in_windows(blocks, a["vector"], a["label"], [w for _, w in windows], negatives) if windows else []
        return [(a["key"], p, i, s) for (p, _), (ids, scores) in zip(windows, got) for i, s in zip(ids.tolist(), scores.tolist())]

    found = top(_scanned(parts, folder, ["key", "label", "vector", "scores"], between, "key long, positive_score long, other long, score long", triple), ["key", "positive_score"], negatives)
    joined = first.join(found, ["key", "positive_score"])
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("place").cast("int").alias("positive_rank"))


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> id, label, vector of floor(scale x component); rows with a null label or vector, or a null or non-finite component, go. Labels of ids that 7 divides become (label + 1) % 10."""
    good = embeddings.filter("label is not null and embedding is not null and forall(embedding, x -> x is not null and abs(cast(x as double)) < double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return good.select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), F.expr(f"transform(embedding, x -> floor({scale}d * cast(x as double)))").alias("vector"))


def op12_bond(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the rows whose vec_id divides by 50, among all rows; see whole_vectors() and hard_negatives()."""
    return hard_negatives(whole_vectors(embeddings), F.col("id") % 50 == 0)


#: The query as DuckDB SQL.
ORACLE_SQL = """
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (select *, row_number() over (partition by anchor_id order by score desc, other) as place from s where same qualify place <= 5),
n as (
  select p.anchor_id, p.other as positive_id, row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) as rank, s.other as negative_id, p.score as positive_score, s.score as negative_score, p.place
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score qualify rank <= 3)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score, place::integer as positive_rank from n
"""
