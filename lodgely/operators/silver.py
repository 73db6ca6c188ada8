"""Bronze to silver: checks, cleaning, normal forms, repeated and cross-posted listings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, a temporary one on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset; tables between steps need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, so that iterations do not grow the plan."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listing_key() -> Column:
    """The listing's id within its source or, where it has none, a digest of its canonical URL."""
    return F.coalesce(T.nonblank(F.col("listing_id")), F.sha2(T.canonical_url(F.col("url")), 256))


def issues(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail, in order; an unknown result counts as a failure."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def bronze_checks() -> dict[str, Column]:
    return {
        "missing_url": T.nonblank(F.col("url")).isNotNull(),
        "bad_url": T.host(F.col("url")).isNotNull(),
        "missing_price": T.nonblank(F.col("price_raw")).isNotNull(),
        "unreadable_price": T.nonblank(F.col("price_raw")).isNull() | T.is_negotiable(F.col("price_raw")) | T.price_basis(F.col("price_raw")).isNotNull(),
        "unreadable_area": T.nonblank(F.col("area_raw")).isNull() | T.area_m2(F.col("area_raw")).isNotNull(),
    }


def validate(bronze: DataFrame, fatal: tuple[str, ...] = ("missing_url", "bad_url")) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined records, both with their issues; a record with a fatal issue is quarantined."""
    checked = bronze.withColumn("issues", issues(bronze_checks()))
    bad = F.arrays_overlap("issues", F.array(*[F.lit(x) for x in fatal]))
    return checked.filter(~bad), checked.filter(bad)


def normalize(bronze: DataFrame) -> DataFrame:
    """Typed columns beside the raw ones: price, area, place, times, key. crawled_at may be a string or a timestamp."""
    crawled = F.col("crawled_at").cast("timestamp")
    return bronze.withColumns({
        "listing_key": listing_key(),
        "title": T.clean(F.col("title_raw")),
        "price_vnd": T.price_vnd(F.col("price_raw")),
        "is_negotiable": T.is_negotiable(F.col("price_raw")),
        "price_basis": T.price_basis(F.col("price_raw")),
        "area_m2": T.area_m2(F.col("area_raw")),
        "place": T.address(F.coalesce(F.col("address_raw"), F.col("location_raw"))),
        "posted_at": T.posted_at(F.col("posted_at_raw"), crawled),
        "crawled_ts": crawled,
    }).withColumns({"ward": F.col("place.ward"), "district": F.col("place.district"), "city": F.col("place.city")}).drop("place")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; order must be total."""
    return df.withColumn("_nth", F.expr(f"row_number() over (partition by {', '.join(keys)} order by {', '.join(order)})")).filter("_nth = 1").drop("_nth")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; order must be total."""
    return first_seen(df, keys, [f"{c} desc" for c in order])


def resolve_place(df: DataFrame, places: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df (district) with the names that a dictionary (alias, district, city) gives; marks and case of aliases do not matter.

    The dictionary is broadcast if it has most_rows rows at most, else joined as it comes.
    """
    d = places.select(T.fold(F.col("alias")).alias("_alias"), F.col("district").alias("place_district"), F.col("city").alias("place_city")).dropDuplicates(["_alias"])
    small = d.limit(most_rows + 1).count() <= most_rows
    return df.join(F.broadcast(d) if small else d, T.fold(F.col("district")) == F.col("_alias"), "left").drop("_alias")


def quality(df: DataFrame) -> DataFrame:
    """One row of counts over silver records: rows, missing fields, out of range, repeated keys."""
    missing = {f"missing_{c}": F.count_if(F.col(c).isNull()) for c in ("title", "price_vnd", "area_m2", "district", "posted_at")}
    counts = {"rows": F.count("*"), **missing, "bad_price": F.count_if(F.col("price_vnd") <= 0), "bad_area": F.count_if(F.col("area_m2") <= 0), "posted_later": F.count_if(F.col("posted_at") > F.col("crawled_ts"))}
    repeated = F.count("*") - F.count_distinct(F.struct("source", "listing_key"))
    return df.agg(*[c.alias(n) for n, c in counts.items()], repeated.alias("repeated"))


def candidate_pairs(df: DataFrame, blocks: list[Column], key: str = "listing_key") -> DataFrame:
    """Pairs (a, b) of keys, a < b, that share a value of some block column; null blocks pair nothing.

    Rows of a block meet through one join on its value, and each block's share of rows is small by choice of its columns
    (phone; or place, price band and area band; or grid cell).
    """
    keyed = None
    for i, block in enumerate(blocks):
        one = df.select(F.col(key).alias("k"), F.concat(F.lit(f"{i}:"), block.cast("string")).alias("block")).filter("block is not null").distinct()
        keyed = one if keyed is None else keyed.unionByName(one)
    a, b = keyed.select(F.col("k").alias("a"), "block"), keyed.select(F.col("k").alias("b"), "block")
    return a.join(b, "block").filter("a < b").select("a", "b").distinct()


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(T.fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))


def word_classes(df: DataFrame, text: str, key: str) -> DataFrame:
    """Per row (key, words): its class, the smallest key with the same set of words. Texts without words are one class."""
    words = df.select(F.col(key).alias("key"), word_set(F.col(text)).alias("words"))
    words = words.withColumn("digest", F.sha2(F.array_join(F.array_sort("words"), " "), 256))
    least = words.groupBy("digest").agg(F.min("key").alias("class"))
    return words.join(least, "digest").select("key", "class", "words")


#: Slots of the table of word counts, in two rows; a fixed size, so it reaches the driver whatever the input.
SLOTS = 1 << 20


def _slots(h: np.ndarray) -> list[np.ndarray]:
    """The slot of each word hash in both rows of the table of counts."""
    return [(h & (SLOTS - 1)).astype(np.int64), ((h >> 24) & (SLOTS - 1)).astype(np.int64) + SLOTS]


def _word_counts(hashed: DataFrame) -> np.ndarray:
    """About how many rows have a word, for each slot of _slots(): quarter powers of two, never less than it is; 0 is one row. Of hashed (hashes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * SLOTS, np.int64)
        for batch in batches:
            for at in _slots(batch.column("hashes").flatten().to_numpy(zero_copy_only=False)):
                n += np.bincount(at, minlength=2 * SLOTS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.zeros(2 * SLOTS, np.uint8)
        for batch in batches:
            scale[batch.column("slot").to_numpy()] = np.minimum(np.ceil(4 * np.log2(batch.column("n").to_numpy())), 255)
        yield pa.RecordBatch.from_arrays([pa.array([scale.tobytes()], pa.binary())], ["scale"])

    counts = hashed.select("hashes").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    return np.frombuffer(counts.coalesce(1).mapInArrow(table, "scale binary").first()[0], np.uint8)


def rare_words(words: DataFrame, threshold: float, shared: int = 4) -> DataFrame:
    """words (key, words) -> key, size, least, places, hashes: of each row's words, rarest first, as many as a pair that is alike must share `least` of (`shared`, or fewer for small sets); those of one row alone are left out.

    Words stand as 64-bit hashes, in one order for all rows: by about how many rows have them, then by hash. Equal hashes
    of different words make more candidates, never fewer. The order is made in place, from a table of fixed size, so words
    are not shuffled.
    """
    hashed = words.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    scale = words.sparkSession.sparkContext.broadcast(_word_counts(hashed))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            h, size = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64)
            start = np.cumsum(size) - size
            one, two = _slots(h)
            n = np.minimum(scale.value[one], scale.value[two])
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((h, n, row))
            least = np.minimum(shared, 1 + size // 10)
            some = size - np.ceil(size * threshold - 1e-9).astype(np.int64) + least
            place = np.arange(len(h)) - start[row]
            kept = (place < some[row]) & (n[order] > 0)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row[kept], minlength=len(size))))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (place[kept].astype(np.int32), h[order][kept])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(size.astype(np.int32)), pa.array(least.astype(np.int32)), *lists], ["key", "size", "least", "places", "hashes"])

    return hashed.mapInArrow(prefixes, f"key {words.schema['key'].dataType.simpleString()}, size int, least int, places array<int>, hashes array<long>")


def _near(df: DataFrame, text: str, key: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes (key, class) and the pairs of near_dup()."""
    words = df.select(F.col(key).alias("key"), F.array_sort(word_set(F.col(text))).alias("words"))
    words = written(words.select("key", F.array_join("words", " ").alias("words")).withColumn("digest", F.sha2("words", 256)), "words")
    told = words.groupBy("digest").agg(F.min("key").alias("class"))
    classes = written(words.select("key", "digest").join(told, "digest").select("key", "class"), "classes")
    reps = classes.filter("key = class").select("key").distinct()
    rare = rare_words(words.filter("words <> ''").select("key", F.split("words", " ").alias("words")), threshold)
    rare = rare.filter(F.size("hashes") > 0).join(reps, "key", "left_semi").dropDuplicates(["key"])
    rare = written(rare.select("key", "size", "least", F.explode(F.arrays_zip("places", "hashes")).alias("x")).select("key", "size", "least", (F.col("size") - F.col("x.places")).alias("left"), F.col("x.hashes").alias("hash")), "rare")
    a, b = (rare.select("hash", *[F.col(c).alias(f"{k}_{c}") for c in ("key", "size", "least", "left")]) for k in ("a", "b"))
    least = F.least("a_least", "b_least")
    need = (F.col("a_size") + F.col("b_size")) * (threshold / (1 + threshold)) - 1e-9
    fits = (F.col("a_key") < F.col("b_key")) & (F.least("a_size", "b_size") >= F.greatest("a_size", "b_size") * threshold - 1e-9) & (F.least("a_left", "b_left") >= need - least + 1)
    met = a.join(b, "hash").filter(fits).groupBy(F.col("a_key").alias("a"), F.col("b_key").alias("b"), least.alias("least")).agg(F.count("*").alias("n"))
    found = written(met.filter("n >= least").select("a", "b"), "found")
    whole = words.select("key", "words")
    met = found.join(whole.select(F.col("key").alias("a"), F.col("words").alias("x")), "a").join(whole.select(F.col("key").alias("b"), F.col("words").alias("y")), "b")
    pairs = met.select("a", "b", jaccard(F.split("x", " "), F.split("y", " ")).alias("similarity")).filter(F.col("similarity") >= threshold)
    return classes, pairs.distinct()


def near_dup(df: DataFrame, text: str, key: str, threshold: float = 0.8) -> DataFrame:
    """All pairs (a, b, similarity), a < b, of classes of word_classes() that are at least `threshold` alike.

    Such a pair shares several of the rarest words of each (a prefix of its words by frequency), at places that leave enough
    words after them, and has near enough sizes; what meets so is checked on the whole sets. Copies are one class, so a
    group of copies makes no pairs of its own; near_classes() has their members.
    """
    return _near(df, text, key, threshold)[1]


def near_classes(df: DataFrame, text: str, key: str, threshold: float = 0.8) -> DataFrame:
    """Per row: key, its class of equal word sets, and `links`, the number of other classes that are at least `threshold` alike."""
    classes, pairs = _near(df, text, key, threshold)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return classes.join(links, "class", "left").select("key", "class", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def dup_groups(pairs: DataFrame, nodes: DataFrame, rounds: int = 50) -> DataFrame:
    """Rows (key, group) of all nodes (key); group is the smallest key that pairs (a, b) lead to.

    Each round takes the smallest label of the neighbours and then the label of that label, so labels travel in jumps; it
    ends when none changes. Labels are a written table between rounds.
    """
    both = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = written(nodes.select("key").distinct().withColumn("group", F.col("key")), "labels")
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("group").alias("least"))
        down = labels.join(near, labels["key"] == near["a"], "left").select("key", F.least("group", F.coalesce("least", "group")).alias("group"), F.col("group").alias("old"))
        down = written(down, "labels")
        hop = down.select(F.col("key").alias("k"), F.col("group").alias("g"))
        new = written(down.join(hop, down["group"] == hop["k"]).select("key", F.col("g").alias("group"), "old"), "labels")
        labels = new.select("key", "group")
        if new.filter("group <> old").isEmpty():
            return labels
    raise RuntimeError("the groups did not settle")


def survivors(df: DataFrame, groups: DataFrame, order: list[str], key: str = "listing_key") -> DataFrame:
    """The first row of each group in an order of columns, with its group."""
    joined = df.join(groups.withColumnRenamed("key", key), key)
    return first_seen(joined, ["`group`"], order)
