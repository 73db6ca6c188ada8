"""Shared helpers: tables in the cluster's shared folder, file access for tasks, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in the contracts; everything else is part of a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, one in a temporary folder on a local master, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset; tables between steps need a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder and read back, so that lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for a folder on a local mount, HDFS, S3 or GCS; used inside tasks."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def text_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of a few columns of Arrow batches, converted 64 at a time to bound memory."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for lo in range(0, batch.num_rows, 64):
            yield from zip(*(c.slice(lo, 64).to_pylist() for c in columns))


def in_batches(rows: Iterator[tuple], schema: pa.Schema, count: int = 512, size: int = 8 << 20, weigh=None) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `count` rows, or about `size` bytes by weigh(row)."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += weigh(row) if weigh else 0
        if len(held) >= count or total >= size:
            yield to_batch(held, schema)
            held, total = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, Arrow's free memory goes back to the system, as Python workers outlive their tasks."""
    yield from batches
    pa.default_memory_pool().release_unused()


def small_arrow_batches(spark: SparkSession) -> None:
    """Texts may be very long: few rows in each batch between the JVM and Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def id_text(doc_id: str | Column = "doc_id") -> Column:
    """doc_id as text; a null id counts as the empty text."""
    return F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))


def id_remainder(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n: the fold of a row."""
    return F.crc32(id_text(doc_id).cast("binary")) % n


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
