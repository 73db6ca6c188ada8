"""From raw documents to token ids: toxic documents go, near copies go, sources are mixed, texts are encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgely.llm import bpe, mixing, simhash, toxicity
from lodgely.llm.common import written


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns but doc_id, source and text under names that no operator uses, and the way back; so no stage writes over a column of its input."""
    back = {f"_own_{k}": c for k, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, taught by the labels, scores below one half stay; null and empty texts have no words and stay.

    Rows keep all their columns as they came. Repeated rows are judged alike, a null doc_id has no label, very long texts
    are tagged whole, an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, back = own_names(docs)
    return toxicity.score(rows, toxicity.learn(docs, labels)).filter("score < 0.5").select(rows.columns).withColumnsRenamed(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, likeness 0.8 or more) stays: that with the smallest doc_id and, of its texts, the smallest digest, once.

    A doc_id with several texts is a document for each. Rows without a doc_id cannot be named and stay. Empty tables give
    empty ones; other columns pass through.
    """
    rows, back = own_names(docs)
    found = simhash.near_duplicates(docs).filter("doc_id is not null")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_md5")).alias("first")).select("first.doc_id", F.col("first.text_md5").alias("_near_md5"))
    marked = rows.withColumn("_near_md5", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    named = marked.join(first, ["doc_id", "_near_md5"], "left_semi").dropDuplicates(["doc_id", "_near_md5"]).select(rows.columns)
    return named.unionByName(rows.filter("doc_id is null")).withColumnsRenamed(back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document: none, one or two. Null sources and texts as in mixing.with_copies(); rows keep all their columns as they came, an empty table gives an empty one."""
    rows, back = own_names(docs)
    mixed = mixing.with_copies(rows).filter("copies > 0")
    return mixed.select(*rows.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy").withColumnsRenamed(back)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every row that is left; null and empty texts have no ids."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: A trained tagger, fingerprints, entropy balancing and token ids cannot be written as SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of each but the last are written in the shared folder and read again, so each stage runs once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
