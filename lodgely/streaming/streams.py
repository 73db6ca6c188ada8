"""Streams: new bronze runs to silver, first sight of listings, crawl health, price changes."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import extract, silver
from ..sources import lake


def files(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files that appear below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Takes all that is there, writes it as Parquet and ends; the next call goes on where this one stopped."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def bronze_to_silver(stream: DataFrame) -> DataFrame:
    """Accepted records of a stream of bronze, in normal form."""
    accepted, _ = silver.validate(stream)
    return silver.normalize(accepted)


def snapshots(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the page snapshots that appear at <path>/<source>/<kind>/<date>/<run>/*.html, in the columns of lake.read_raw()."""
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).load(f"{path}/*/*/*/*/*.html")
    return lake.raw_columns(rows)


def parse_snapshots(stream: DataFrame, out: str, checkpoint: str, url: Column, parser: str = "v1") -> StreamingQuery:
    """Cards of new listing pages, committed batch by batch below out; takes all that is there and ends.

    A batch is a run of its own, named by the parser's version and the batch's number, with its cards, a line for each page
    and a manifest that counts (lake.commit_run): a batch that is repeated after a failure replaces what it wrote, and one
    that fails before its manifest has never been. Another parser version is another stream over all snapshots, which
    fetches nothing. A page without cards is in the log alone.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        keys = ["source", "ingest_date", F.lit(f"{parser}_{batch_id}").alias("run_id")]
        pages = batch.filter("kind = 'listing'").withColumn("url", url).withColumnRenamed("run_id", "page_run")
        pages = silver.written(pages.select("source", F.col("ingest_date").try_cast("date").alias("ingest_date"), "page_run", "url", "path", "html").filter("ingest_date is not null"), "snapshots")
        # a page's path stands in for its run while cards are cut, so that equal URLs of two runs stay apart
        cards = extract.cards(pages.select("url", "html", F.lit(1).alias("page_number"), F.col("path").alias("run_id"))).drop("source")
        cards = cards.withColumnRenamed("run_id", "path").join(pages.select("path", "source", "ingest_date", "page_run"), "path").select(*keys, *[c for c in cards.columns if c not in ("run_id", "source")], "path", "page_run")
        log = pages.select(*keys, "path", "page_run", F.length("html").cast("long").alias("html_size"))
        lake.commit_run(cards, log, log.groupBy(*lake.RUN_KEYS).agg(F.count("*").alias("pages")), out, f"batch{batch_id}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def dedup(stream: DataFrame, keys: list[str], time: str, delay: str = "7 days") -> DataFrame:
    """The first row of each key within the delay; older keys are forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def health(stream: DataFrame, time: str = "finished_at", width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests and mean time of each window, source and status."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "source", "crawl_status").agg(F.count("*").alias("requests"), F.avg("elapsed_ms").alias("mean_ms")).select(F.col("w.start").alias("start"), "source", "crawl_status", "requests", "mean_ms")


def health_tables(stream: DataFrame, path: str, checkpoint: str, time: str = "finished_at", width: str = "10 minutes", delay: str = "10 minutes") -> StreamingQuery:
    """Counts of all requests of a stream by window, source and status, kept as parts below path, one folder for each batch; takes all that is there and ends.

    A batch that is repeated after a failure replaces its own folder. A request whose window had closed (its end is `delay`
    or more behind the latest time of the batches before) counts in its part and goes to the side table `late` whole.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        seen = spark.read.schema("batch long, latest timestamp").parquet(f"{path}/seen") if batch_id else spark.createDataFrame([], "batch long, latest timestamp")
        before = seen.filter(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        closed = F.lit(before).cast("timestamp") - F.expr(f"interval {delay}")
        rows = batch.withColumn("w", F.window(time, width)).withColumn("is_late", F.coalesce(F.col("w.end") <= closed, F.lit(False)))
        parts = rows.filter(F.col("w").isNotNull()).groupBy(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "source", "crawl_status")
        sums = parts.agg(F.count("*").alias("requests"), F.count_if("is_late").alias("late"), F.count("elapsed_ms").alias("timed"), F.sum("elapsed_ms").alias("total_ms"))
        sums.write.mode("overwrite").parquet(f"{path}/parts/batch={batch_id}")
        rows.filter("is_late").drop("w", "is_late").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        latest = batch.agg(F.lit(batch_id).cast("long").alias("batch"), F.max(time).alias("latest"))
        latest.write.mode("overwrite").parquet(f"{path}/seen/part={batch_id}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def health_windows(spark: SparkSession, path: str, closing: bool = False, delay: str = "10 minutes") -> DataFrame:
    """start, source, crawl_status, requests, late, mean_ms of the windows of health_tables() that the delay has closed; with `closing`, of all, as nothing more will come."""
    parts = spark.read.schema("start timestamp, end timestamp, source string, crawl_status string, requests long, late long, timed long, total_ms double, batch long").parquet(f"{path}/parts")
    by = parts.groupBy("start", "end", "source", "crawl_status").agg(F.sum("requests").alias("requests"), F.sum("late").alias("late"), F.try_divide(F.sum("total_ms"), F.sum("timed")).alias("mean_ms"))
    if not closing:
        latest = spark.read.schema("batch long, latest timestamp").parquet(f"{path}/seen").agg(F.max("latest")).first()[0]
        by = by.filter(F.col("end") <= F.lit(latest).cast("timestamp") - F.expr(f"interval {delay}"))
    return by.drop("end")


def late_requests(spark: SparkSession, path: str) -> DataFrame:
    """The side table of health_tables(): requests that came after their window had closed, with their batch."""
    return spark.read.parquet(f"{path}/late")


ALERT = "key string, run_no long, price_before long, price_vnd long"
#: Alerts need the state store that keeps several variables and timers for a key.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class PriceAlerts(StatefulProcessor):
    """Changes of a listing's known price, in order of time and run, whatever the order in which rows come.

    Rows wait in a list until the watermark has passed them; then they are put in order and held against the last price. A
    row of a time that has been settled, or of a run that has been seen, changes nothing. A listing without news for
    `forget` is forgotten: its next price starts anew. Prices that a run repeats count once, the highest.
    """

    def __init__(self, forget: timedelta):
        self.forget = int(forget.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "run_no long, price long, at long")
        self.waiting = handle.getListState("waiting", "at long, run_no long, price long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled = self.last.get()[2] if self.last.exists() else None
        for frame in rows:
            known = frame[frame["price_vnd"].notna() & frame["at"].notna()]
            for at, run_no, price in zip(known["at"], known["run_no"], known["price_vnd"]):
                ms = int(at.timestamp() * 1000)
                if settled is None or ms > settled:
                    self.waiting.appendValue((ms, int(run_no), int(price)))
                    self.handle.registerTimer(ms)
        yield pd.DataFrame([], columns=["key", "run_no", "price_before", "price_vnd"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1], -r[2])) if self.waiting.exists() else []
        due, rest = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        last, out = tuple(self.last.get()) if self.last.exists() else None, []
        for at, run_no, price in due:
            if last is not None and at - last[2] >= self.forget:
                last = None
            if last is not None and run_no <= last[0]:
                continue
            if last is not None and price != last[1]:
                out.append((key[0], run_no, last[1], price))
            last = (run_no, price, at)
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.last.update(last)
            self.handle.registerTimer(last[2] + self.forget)
        elif last is not None and not rest and last[2] + self.forget <= now:
            self.last.clear()
        yield pd.DataFrame(out, columns=["key", "run_no", "price_before", "price_vnd"])

    def close(self) -> None:
        pass


def price_alerts(stream: DataFrame, delay: str = "1 day", forget: timedelta = timedelta(days=365)) -> DataFrame:
    """A row for each change of a listing's known price: key, run_no, price_before, price_vnd, of a stream (key, run_no, at, price_vnd).

    Rows may come up to `delay` late and in any order. What is within `delay` of the latest time waits for later rows;
    closing_row() ends a stream that has no more.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    timed = stream.select("key", "run_no", "at", "price_vnd").withWatermark("at", delay)
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=PriceAlerts(forget), outputStructType=ALERT, outputMode="Append", timeMode="EventTime")


def closing_row(rows: DataFrame, after: str = "2 days") -> DataFrame:
    """A row without a price that is later than all rows (key, run_no, at, price_vnd) by `after`, which must exceed the stream's delay: it makes the stream settle them."""
    return rows.agg(F.max("at").alias("at")).filter("at is not null").select(F.lit("").alias("key"), F.lit(0).cast("long").alias("run_no"), (F.col("at") + F.expr(f"interval {after}")).alias("at"), F.lit(None).cast("long").alias("price_vnd"))


_HELD = "key string, run_no long, price_before long, price_vnd long, at long, kind string"


def _settle(now: int, forget: int):
    """Rows sorted by key, kind, time, run and falling price, each key's last price before its rows -> alerts and new last prices, row after row; of a key only its last price is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            out: list[tuple] = []

            def close() -> None:
                if last is not None and last[2] + forget > now:
                    out.append((key, last[0], None, last[1], last[2], "last"))

            for k, kind, at, run_no, price in zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "at", "run_no", "price_vnd"))):
                if k != key:
                    close()
                    key, last = k, None
                if kind == "last":
                    last = (run_no, price, at)
                    continue
                if last is not None and at - last[2] >= forget:
                    last = None
                if last is not None and run_no <= last[0]:
                    continue
                if last is not None and price != last[1]:
                    out.append((k, run_no, last[1], price, at, "alert"))
                last = (run_no, price, at)
            yield _held(out)
        out = []
        if last is not None and last[2] + forget > now:
            out.append((key, last[0], None, last[1], last[2], "last"))
        yield _held(out)

    return run


def _held(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "run_no", "price_before", "price_vnd", "at", "kind"])


def alert_tables(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 day", forget: timedelta = timedelta(days=365)) -> StreamingQuery:
    """The alerts of price_alerts() as tables below path, one folder for each batch; takes all that is there and ends.

    Last prices and rows that wait are a table as well, which a batch reads from one of two folders and writes to the other,
    so a batch that is repeated after a failure finds what it found before. A batch is one sort by key; its time is settled
    with its own latest row. Rows of a time that an earlier batch has settled change nothing.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        held = spark.read.schema(_HELD).parquet(f"{path}/turn={(batch_id - 1) % 2}") if batch_id else spark.createDataFrame([], _HELD)
        back = lambda t: F.unix_micros(F.timestamp_micros(t) - F.expr(f"interval {delay}"))
        before = held.filter("kind = 'latest'").agg(F.max("at").alias("t"))
        times = before.crossJoin(batch.agg(F.max(F.unix_micros(F.col("at").cast("timestamp"))).alias("u")))
        latest, settled, now = times.select(F.greatest("t", "u"), back(F.col("t")), back(F.greatest("t", "u"))).first()
        rows = batch.select("key", "run_no", F.lit(None).cast("long").alias("price_before"), "price_vnd", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.lit("waiting").alias("kind")).filter("price_vnd is not null and at is not null")
        rows = held.filter("kind = 'waiting'").unionByName(rows if settled is None else rows.filter(F.col("at") > settled))
        due = held.filter("kind = 'last'").unionByName(rows.filter(F.col("at") <= F.lit(now)))
        due = due.repartition("key").sortWithinPartitions("key", "kind", "at", "run_no", F.desc("price_vnd"))
        told = due.select("key", "kind", "at", "run_no", "price_vnd").mapInArrow(_settle(now or 0, forget // timedelta(microseconds=1)), _HELD)
        mark = spark.range(1).select(*[F.lit(None).cast(k).alias(c) for c, k in (("key", "string"), ("run_no", "long"), ("price_before", "long"), ("price_vnd", "long"))], F.lit(latest).cast("long").alias("at"), F.lit("latest").alias("kind"))
        turn = f"{path}/turn={batch_id % 2}"
        told.unionByName(rows.filter(F.col("at") > F.lit(now))).unionByName(mark).write.mode("overwrite").partitionBy("kind").parquet(turn)
        spark.read.schema(_HELD).parquet(turn).filter("kind = 'alert'").select("key", "run_no", "price_before", "price_vnd").write.mode("overwrite").parquet(f"{path}/alerts/batch={batch_id}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def told_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All alerts of alert_tables()."""
    return spark.read.schema(f"{ALERT}, batch long").parquet(f"{path}/alerts").drop("batch")
