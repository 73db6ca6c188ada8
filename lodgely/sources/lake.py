"""Readers and writers of the layers: raw pages, bronze runs, silver, gold and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import extract

RUN_KEYS = ("source", "ingest_date", "run_id")


def commit(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes a run's table below source / ingest_date / run_id; a run that is committed again replaces its own folder and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEYS).format(fmt).save(path)


def read(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A committed table; filters on the run's keys read only its folders."""
    return spark.read.schema(f"{schema}, source string, ingest_date date, run_id string").format(fmt).load(path)


def commit_run(listings: DataFrame, metadata: DataFrame, manifest: DataFrame, path: str, attempt: str, fmt: str = "parquet") -> None:
    """Writes the three tables of one or more runs, so that readers see all of a run or nothing of it.

    Listings and metadata go below the run's keys and the attempt's name; the manifest, written last, names the attempt
    that counts and replaces the one before. An attempt that is lost on the way leaves the run as it was, and one that is
    repeated under its name replaces its own folders. Superseded folders stay until they are removed.
    """
    for name, df in (("listings", listings), ("metadata", metadata)):
        rows = df.withColumn("attempt", F.lit(attempt))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RUN_KEYS, "attempt").format(fmt).save(f"{path}/{name}")
    commit(manifest.withColumn("attempt", F.lit(attempt)), f"{path}/manifest", fmt)


def read_run(spark: SparkSession, path: str, name: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Listings, metadata or manifest of committed runs."""
    if name == "manifest":
        return read(spark, f"{path}/manifest", f"{schema}, attempt string", fmt).drop("attempt")
    rows = read(spark, f"{path}/{name}", f"{schema}, attempt string", fmt)
    counted = read(spark, f"{path}/manifest", "attempt string", fmt)
    return rows.join(counted, [*RUN_KEYS, "attempt"], "left_semi").drop("attempt")


def _folders(path: Column, names: tuple[str, ...]) -> list[Column]:
    parts = F.split(path, "/")
    return [F.element_at(parts, -1 - len(names) + i).alias(n) for i, n in enumerate(names)]


def read_bronze_json(spark: SparkSession, path: str) -> DataFrame:
    """Bronze listings of <path>/<source>/<date>/<run>/listings.json, each an array over many lines; where a file stands tells its run."""
    df = spark.read.schema(schemas.BRONZE).option("multiLine", True).json(f"{path}/*/*/*/listings.json")
    return df.select("*", *_folders(F.col("_metadata.file_path"), ("folder_source", "ingest_date", "run_id")))


def read_request_log_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REQUEST_LOG).option("multiLine", True).json(f"{path}/*/*/*/metadata.json")


def read_manifest_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(f"{path}/*/*/*/manifest.json")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots of <path>/<source>/<kind>/<date>/<run>/*.html, one row a page."""
    return raw_columns(spark.read.format("text").option("wholetext", True).load(f"{path}/*/*/*/*/*.html"))


def raw_columns(df: DataFrame) -> DataFrame:
    """Whole files (value) of page snapshots with what their place tells: html, path, source, kind, ingest_date, run_id."""
    return df.select(F.col("value").alias("html"), F.col("_metadata.file_path").alias("path"), *_folders(F.col("_metadata.file_path"), ("source", "kind", "ingest_date", "run_id")))


def reparse(spark: SparkSession, path: str, run_id: str, url: Column) -> DataFrame:
    """Cards of a run's stored listing pages, without fetching; url makes a page's address from its path."""
    pages = read_raw(spark, path).filter((F.col("run_id") == run_id) & (F.col("kind") == "listing"))
    return extract.cards(pages.select(url.alias("url"), "html", F.lit(1).alias("page_number"), "run_id"))


def read_flat(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    """CSV (with a header) or Parquet."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def write_silver(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city").parquet(path)


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report as CSV, Parquet or JSON."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def publish_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str]) -> None:
    """Replaces the rows of a serving table and keeps its definition."""
    df.write.option("truncate", True).jdbc(url, name, mode="overwrite", properties=properties)


def _in_one_transaction(spark: SparkSession, url: str, properties: dict[str, str], statements: list[str]) -> None:
    """Runs statements on one connection of the driver; all of them take effect or none."""
    given = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        given.setProperty(k, v)
    if "driver" in properties:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(properties["driver"])
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, given)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.executeUpdate(sql)
        statement.close()
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def publish_staged(df: DataFrame, url: str, name: str, properties: dict[str, str], key: tuple[str, ...] = (), types: str | None = None) -> None:
    """Puts the rows of df into a serving table so that its readers see the old rows or the new ones, never a part.

    Tasks load a table beside it (name_stage); then one transaction of the database takes out the rows whose key (columns
    that df has) is among the new ones, or without a key all, and puts the new ones in. A load that fails leaves the
    serving table as it was, and one that is repeated gives the same rows. The serving table is made if it is missing;
    `types` are column types for that, as in createTableColumnTypes (databases compare short texts only).
    """
    spark, stage = df.sparkSession, f"{name}_stage"
    typed = lambda w: w.option("createTableColumnTypes", types) if types else w
    typed(df.write).jdbc(url, stage, mode="overwrite", properties=properties)
    typed(df.limit(0).write).jdbc(url, name, mode="append", properties=properties)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    same = " AND ".join(f'{stage}."{k}" = {name}."{k}"' for k in key)
    old = f"DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM {stage} WHERE {same})" if key else f"DELETE FROM {name}"
    _in_one_transaction(spark, url, properties, [old, f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {stage}"])
