"""Closed syncmers of words as document fingerprints, with DataFrame and SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words of a k-mer and of the inner substrings.
K, S = 5, 2
_WORDS = r"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def _syncmers(text: str, k: int, s: int, out: Callable[[str, str], str]) -> str:
    """SQL for an array with out(position, hash) of each closed syncmer: k words whose least hash of s words in a row is the first or last of them.

    h and b bind the hashes of words and of s words once for a text, i is a position. Texts of fewer words than k are one
    anchor, those without words none.
    """
    inner = k - s
    run = lambda n: "xxhash64(" + ", ".join(f"h[i + {j}]" for j in range(n)) + ")"
    edge = f"least(b[i], b[i + {inner}])"
    middle = [f"b[i + {j}]" for j in range(1, inner)]
    least = f"least({', '.join(middle)})" if len(middle) > 1 else middle[0]
    found = f"transform(filter(sequence(0, size(b) - {inner + 1}), i -> {edge} <= {least}), i -> {out('i', run(k))})"
    many = f"transform(array(transform(sequence(0, size(h) - {s}), i -> {run(s)})), b -> {found})[0]"
    whole = f"array({out('0', 'xxhash64(h)')})"
    hashes = f"transform({_WORDS.format(text=text)}, w -> xxhash64(w))"
    return f"transform(array({hashes}), h -> case when size(h) = 0 then slice({whole}, 1, 0) when size(h) < {k} then {whole} else {many} end)[0]"


def anchors(text: str = "text", k: int = K, s: int = S) -> Column:
    """Array of (position, hash) of the closed syncmers of a text column; a null text has none. Position: index of the first word."""
    return F.expr(_syncmers(f"coalesce({text}, '')", k, s, lambda at, h: f"named_struct('position', {at}, 'hash', {h})"))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two arrays of distinct longs. Two empty ones are alike."""
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1d else transform(array(size(array_intersect({a}, {b}))), n -> n / (size({a}) + size({b}) - n))[0] end")


def hashes(found: str) -> Column:
    """The distinct full-width hashes of anchors(), ascending."""
    return F.expr(f"sort_array(array_distinct(transform({found}, x -> x.hash)))")


def places(found: str) -> Column:
    """A long for each of anchors(), of its position and hash: equal in two texts where they are aligned without a shift."""
    return F.expr(f"transform({found}, x -> xxhash64(x.position, x.hash))")


def as_text(prints: str, digits: int = 16) -> Column:
    return F.expr(f"array_join(transform({prints}, x -> lower(lpad(hex(x), {digits}, '0'))), '')")


def matches(a: DataFrame, b: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Aligned passages of texts of a and b (doc_id, text): a_id, b_id, shift, anchors, first and last word in a.

    Anchors depend on their own words alone, so equal passages have equal anchors at one shift of positions. Every place
    of a repeated anchor counts; pairs of places are summed by shift before they are shuffled.
    """
    of = lambda d, n: d.select(F.col("doc_id").alias(f"{n}_id"), F.explode(anchors("text", k, s)).alias("x")).select(f"{n}_id", "x.hash", F.col("x.position").alias(f"{n}_at"))
    both = of(a, "a").join(of(b, "b"), "hash")
    return both.groupBy("a_id", "b_id", (F.col("b_at") - F.col("a_at")).alias("shift")).agg(F.count("*").alias("anchors"), F.min("a_at").alias("first"), (F.max("a_at") + k - 1).alias("last"))


def neighbours(ids: DataFrame) -> DataFrame:
    """Of distinct rows (doc_id, key, n) in ascending order: each with the row before it, as prev_id, prev_key, prev_n.

    The first row follows the last. Rows are cut into ranges, and each range learns the last row of the one before it
    from a table with a row for each range, so nothing but that table is in one task.
    """
    spark = ids.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = written(ids.repartitionByRange(ranges, "doc_id", "key").withColumn("part", F.spark_partition_id()), "ranges")
    ends = cut.groupBy("part").agg(F.max(F.struct("doc_id", "key", "n")).alias("end"))
    ends = ends.withColumn("end", F.expr("coalesce(lag(end) over (order by part), last(end) over (order by part rows between unbounded preceding and unbounded following))"))
    own = cut.withColumn("prev", F.expr("lag(struct(doc_id, key, n)) over (partition by part order by doc_id, key)"))
    return own.join(ends, "part").withColumn("prev", F.coalesce("prev", "end")).select("doc_id", "key", "n", F.col("prev.doc_id").alias("prev_id"), F.col("prev.key").alias("prev_key"), F.col("prev.n").alias("prev_n"))


def with_edits(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, edited, next_text, where the last quarter of a text is replaced by the start of the next one.

    The order is that of doc_id (nulls first), then of the text's digest. Rows with equal id and text are one document
    there and get equal results. A null text is an empty one. A text goes to the document before it; both joins use one
    shuffle of the texts.
    """
    text = F.coalesce("text", F.lit(""))
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias  # noqa: E731  never null, so that joins and the window share a partitioning
    keyed = docs.select("doc_id", text.alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))
    ids = written(keyed.select("doc_id", "key", F.length("text").cast("long").alias("n")).distinct(), "ids")
    nav = written(neighbours(ids), "order").select(name("doc_id")("id"), "key", name("prev_id")("prev_id"), "prev_key")
    base = keyed.select(name("doc_id")("id"), "key", "text")  # of the same columns at both its places, so it is shuffled once
    one = base.withColumn("more", F.expr("lag(true) over (partition by id, key order by id)")).filter("more is null")
    given = one.join(nav, ["id", "key"]).select("prev_id", "prev_key", F.col("text").alias("next_text"))
    both = base.join(given, (base["id"] == given["prev_id"]) & (base["key"] == given["prev_key"])).withColumn("doc_id", F.when(F.col("id") != "", F.substring("id", 2, 1 << 30)).cast(docs.schema["doc_id"].dataType))
    quarter = "cast(length(text) div 4 as int)"
    return both.select("doc_id", "text", F.expr(f"concat(substring(text, 1, length(text) - {quarter}), substring(next_text, 1, {quarter}))").alias("edited"), "next_text")


def op6_syncmers(docs: DataFrame) -> DataFrame:
    """Fingerprints (all distinct anchors, ascending) of texts and of their edited texts; near_edited and near_next are the Jaccard likeness of its fingerprint to theirs.

    near_placed is the share of anchors that stand at the same place in the text and its edited text. Null texts are
    empty; texts without words have no anchors and are alike. See with_edits() for the order, ties and repeated rows.
    """
    got = with_edits(docs.select("doc_id", "text")).select("doc_id", "text", "edited", anchors().alias("own"), anchors("edited").alias("other"), anchors("next_text").alias("next"))
    got = got.select("doc_id", "text", "edited", hashes("own").alias("fp"), hashes("other").alias("edited_fp"), hashes("next").alias("next_fp"), places("own").alias("at"), places("other").alias("edited_at"))
    return got.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), likeness("at", "edited_at").alias("near_placed"),
    )
