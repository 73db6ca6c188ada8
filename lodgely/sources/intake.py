"""Reading with nothing lost: records that cannot be taken are kept apart, with where they stood and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, MapType, StringType, StructType

from .. import schemas
from ..functions import text as T
from . import lake

#: Kinds of JSON value (a pattern over Spark's name of it) that a field of a type takes; a JSON null always is one.
_KINDS = {StringType: "STRING", IntegerType: "BIGINT", LongType: "BIGINT", DoubleType: "DOUBLE|BIGINT|DECIMAL.*", MapType: "OBJECT<.*>"}


def _kinds(kind: DataType) -> str:
    inner = f"ARRAY<(VOID|{_kinds(kind.elementType)})>" if isinstance(kind, ArrayType) else _KINDS.get(type(kind), "BOOLEAN")
    return f"VOID|{inner}"


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _found(path: Column) -> list[Column]:
    """source, ingest_date and run_id of a file by its folders; names like run_id=r1 count without what stands before =."""
    parts = F.split(path, "/")
    return [F.regexp_replace(F.element_at(parts, -4 + i), "^[^=]*=", "").alias(n) for i, n in enumerate(lake.RUN_KEYS)]


def read_blocks(spark: SparkSession, path: str, pattern: str = "*/*/*/*.json") -> DataFrame:
    """Per record of files of JSON arrays: file, source, ingest_date, run_id, position in the array, record (its text) and block (a variant).

    A file that is no JSON (cut off, or not in UTF-8) is one row with its text, neither position nor block; one that is no array is one row without a
    position. A file is one run of one source, so a task holds one at a time; Spark passes over files of no bytes.
    """
    text = F.col("content").cast("string")
    read = spark.read.format("binaryFile").load(f"{path}/{pattern}").select(F.col("path").alias("file"), *_found(F.col("path")), F.make_valid_utf8(text).alias("record"), F.try_parse_json(F.try_validate_utf8(text)).alias("block"))
    read = read.withColumn("is_array", F.coalesce(F.schema_of_variant("block").like("ARRAY%"), F.lit(False)))
    keys = ["file", *lake.RUN_KEYS]
    each = read.filter("is_array").lateralJoin(spark.tvf.variant_explode(F.col("block").outer()))
    each = each.select(*keys, F.col("pos").alias("position"), F.to_json("value").alias("record"), F.col("value").alias("block"))
    return each.unionByName(read.filter("not is_array").select(*keys, F.lit(None).cast("int").alias("position"), "record", "block"))


def faults(block: Column, position: Column, schema: StructType, required: tuple[str, ...], urls: tuple[str, ...]) -> Column:
    """Codes of what keeps a block from being a record: unreadable_file, not_an_array, not_an_object, missing_field:f, wrong_type:f, bad_url:f."""
    value = lambda f: F.try_variant_get(block, f"$.{f}", "variant")
    text = lambda f: F.try_variant_get(block, f"$.{f}", "string")
    kind = lambda f: F.schema_of_variant(value(f))
    absent = lambda f: value(f).isNull() | (kind(f) == "VOID") | ((kind(f) == "STRING") & T.nonblank(text(f)).isNull())
    own = [F.when(absent(f), f"missing_field:{f}") for f in required]
    own += [F.when(~kind(f.name).rlike(f"^({_kinds(f.dataType)})$"), f"wrong_type:{f.name}") for f in schema]
    own += [F.when((kind(f) == "STRING") & T.nonblank(text(f)).isNotNull() & T.host(text(f)).isNull(), f"bad_url:{f}") for f in urls]
    return (
        F.when(block.isNull(), F.array(F.lit("unreadable_file")))
        .when(position.isNull(), F.array(F.lit("not_an_array")))
        .when(~F.schema_of_variant(block).like("OBJECT%"), F.array(F.lit("not_an_object")))
        .otherwise(F.array_compact(F.array(*own)))
    )


def checked(spark: SparkSession, path: str, ddl: str = schemas.BRONZE, required: tuple[str, ...] = ("source", "url"), urls: tuple[str, ...] = ("url",), pattern: str = "*/*/*/*.json") -> tuple[DataFrame, DataFrame]:
    """Accepted records (the fields of ddl, folder_source, ingest_date, run_id, file, position) and quarantined ones (source, ingest_date, run_id, file, position, codes, record).

    Every record of every file is in one of the two, once; none is a row of nulls. Fields that are absent or null and not
    required are null; fields that the schema does not name stay out. A required field must be there and not blank.
    """
    schema = _schema(ddl)
    read = read_blocks(spark, path, pattern).withColumn("codes", faults(F.col("block"), F.col("position"), schema, required, urls))
    fields = [F.try_variant_get("block", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema]
    good = read.filter(F.size("codes") == 0).select(*fields, F.col("source").alias("folder_source"), *[F.col(k).alias(k) for k in lake.RUN_KEYS[1:] if k not in schema.names], "file", "position")
    return good, read.filter(F.size("codes") > 0).select(*lake.RUN_KEYS, "file", "position", "codes", "record")


def take_in(spark: SparkSession, path: str, out: str, **options) -> None:
    """Commits accepted and quarantined records of all runs below path as two tables of out; a run that is taken in again replaces its own folders in both."""
    good, bad = checked(spark, path, **options)
    day = F.col("ingest_date").try_cast("date")
    lake.commit(good.drop("source").withColumn("ingest_date", day).withColumnRenamed("folder_source", "source"), f"{out}/accepted")
    lake.commit(bad.withColumn("ingest_date", day), f"{out}/quarantine")


def checked_flat(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files (with a header) that fit the schema, and the lines that do not: file and record."""
    reader = spark.read.schema(f"{ddl}, _corrupt_record string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    read = reader.csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    fields = F.to_json(F.struct(*_schema(ddl).names))
    line = F.concat("_corrupt_record", F.substring(fields, 1, 0))  # Spark reads a corrupt line only beside other fields
    good = read.filter(line.isNull()).drop("_corrupt_record")
    return good, read.select("file", line.alias("record")).filter("record is not null")
