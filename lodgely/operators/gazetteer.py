"""Finding place names in texts, misspelt ones too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def letters(c: Column) -> Column:
    """A name for comparison: lower case, no marks, letters and digits, single blanks."""
    return F.trim(F.regexp_replace(T.fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def edits_allowed(name: Column) -> Column:
    """How many letters of a name may be wrong: none of up to three, one of up to seven, two of more."""
    n = F.length(name)
    return F.when(n <= 3, 0).when(n <= 7, 1).otherwise(2)


def _without_letters(c: str, edits: str) -> Column:
    """Hashes of a text and of what is left of it without one letter or, for two edits, two: texts within so many edits share one."""
    one = "transform(sequence(1, length({x})), i -> concat(substring({x}, 1, i - 1), substring({x}, i + 1)))"
    first = f"case when {edits} > 0 and length({c}) > 1 then {one.format(x=c)} else array() end"
    second = f"case when {edits} > 1 and length({c}) > 2 then flatten(transform({one.format(x=c)}, y -> {one.format(x='y')})) else array() end"
    return F.expr(f"transform(array_distinct(concat(array({c}), {first}, {second})), v -> xxhash64(v))")


def find_places(df: DataFrame, key: str, text: str, places: DataFrame, most_words: int = 4) -> DataFrame:
    """key, alias, edits, start and words of the best place name in each text, of a gazetteer (alias, ...), with its other columns; texts without one have no row.

    Every run of up to most_words words is held against the names through the letters that both keep when one or two are
    taken out, and then by edit distance; marks and case do not count. The longest name wins, then the fewest edits, the
    first place in the text and the first name, so words that follow a place do not count. Spans of equal letters are
    looked up once, however many texts have them. Names and spans of over 40 letters are no names.
    """
    names = places.withColumn("_name", letters(F.col("alias"))).filter("length(_name) between 1 and 40").dropDuplicates(["_name"]).withColumn("_allowed", edits_allowed(F.col("_name")))
    words = df.select(F.col(key).alias("_key"), F.filter(F.split(letters(F.col(text)), " "), lambda w: w != "").alias("w"))
    at = words.select("_key", "w", F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))).alias("start"))
    spans = at.select("_key", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size("w") - F.col("start")))).alias("words"), "w")
    spans = spans.select("_key", "start", "words", F.array_join(F.slice("w", F.col("start") + 1, F.col("words")), " ").alias("span")).filter("length(span) <= 40")
    # a span may have up to two letters more or fewer than the name, so it is cut by what its own length and two more allow
    lookup = spans.select("span").distinct().withColumn("most", edits_allowed(F.concat("span", F.lit("xx"))))
    told = lookup.select("span", F.explode(_without_letters("span", "most")).alias("h"))
    known = names.select("_name", "_allowed", F.explode(_without_letters("_name", "_allowed")).alias("h"))
    pairs = told.join(known, "h").select("span", "_name", "_allowed").distinct().withColumn("edits", F.levenshtein("span", "_name")).filter("edits <= _allowed").select("span", "_name", "edits")
    met = spans.join(pairs, "span")
    best = met.groupBy("_key").agg(F.min(F.struct((-F.length("_name")).alias("long"), "edits", "start", "_name", "words")).alias("b"))
    return best.select(F.col("_key").alias(key), F.col("b._name").alias("_name"), "b.edits", "b.start", "b.words").join(names.drop("_allowed"), "_name").drop("_name")
