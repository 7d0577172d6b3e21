"""Daily limits on a stream: a ledger of the calls made, and what is left for the next batch.

Both are tables in versions, one per batch of the stream. Batch n reads version n - 1 and writes
version n, so a batch that is repeated after a failure starts from the same table and replaces
only what it wrote itself: no call is counted twice, and no capacity is given away twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candidata.cluster import written
from candidata.inference.client import Client
from candidata.operators.extraction import extract_documents
from candidata.operators.records import MAX_ATTEMPTS
from candidata.operators.usage import (
    capacity_intervals,
    catalog_by_day,
    merge_usage,
    remaining_intervals,
    route_attempts,
    usage_counts,
)
from candidata.streaming.runs import each_batch, get_version, put_version

USAGE = T.StructType(
    [*[T.StructField(n, T.StringType()) for n in ("provider", "model", "day")], T.StructField("calls", T.LongType())]
)


def open_ledger(usage: DataFrame, path: str) -> None:
    """Begin a ledger with the usage so far."""
    put_version(usage.select(USAGE.fieldNames()), path, -1)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Calls per provider, model and day, as of the newest complete batch."""
    return get_version(spark, path, USAGE)


def upsert_ledger(spark: SparkSession, path: str, added: DataFrame, number: int) -> None:
    """Add the counts of batch `number`, exactly once however often the batch is repeated.

    The new ledger is a table of its own; readers see the one before until it is complete.
    """
    before = get_version(spark, path, USAGE, number - 1)
    put_version(merge_usage(before, added.select(USAGE.fieldNames())), path, number)


def ledger_stream(log: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Count the calls of a log (provider, model, ts) into the ledger, batch by batch; returns it."""
    spark = log.sparkSession
    each_batch(log, checkpoint, lambda batch, n: upsert_ledger(spark, path, usage_counts(batch), n))
    return read_ledger(spark, path)


def open_quota(intervals: DataFrame, path: str) -> None:
    """Begin a quota with the request numbers each model takes per day."""
    put_version(intervals, f"{path}/left", -1)


def route_stream(
    files: DataFrame,
    order: Sequence[str],
    path: str,
    checkpoint: str,
    attempts: int = MAX_ATTEMPTS,
    day: str = "day",
) -> DataFrame:
    """Route the files of a stream as `route_attempts` does, each batch with what the ones before left.

    The result is that of `route_attempts` over all files with the batch as `wave`. `path` was begun by
    `open_quota`; the intervals left are stored with every batch.
    """
    spark = files.sparkSession
    shape = spark.read.parquet(f"{path}/left/version=-1").schema

    def store(batch: DataFrame, number: int) -> None:
        rows = written(batch, "files")
        left = get_version(spark, f"{path}/left", shape, number - 1)
        routed = route_attempts(rows, left, order, attempts, day).withColumn("batch", F.lit(number).cast("bigint"))
        routed.write.mode("overwrite").parquet(f"{path}/routed/{number}")
        asked = rows.groupBy(day).agg((F.count(F.lit(1)) * attempts).alias("_asked"))
        put_version(remaining_intervals(left, asked, day), f"{path}/left", number)

    each_batch(files, checkpoint, store)
    return spark.read.parquet(f"{path}/routed/*")


def extract_stream(
    files: DataFrame,
    client_factory: Callable[[], Client],
    catalog: DataFrame,
    day: Column,
    order: Sequence[str],
    path: str,
    checkpoint: str,
    chat_providers: Sequence[str],
    attempts: int = MAX_ATTEMPTS,
    concurrency: int | None = None,
) -> DataFrame:
    """Extract the files of a stream within the daily limits of the catalog; returns the records.

    Each batch is planned with what the ledger in `path/ledger` (see `open_ledger`) leaves of its days,
    reserving all attempts; then the calls really made are added to it, so attempts that were not
    needed are there for the next batch. `day` is the day a file counts for, `order` tells files apart.
    A repeated batch asks the models again, and replaces its records and its counts.
    """
    spark = files.sparkSession
    ledger = f"{path}/ledger"

    def store(batch: DataFrame, number: int) -> None:
        rows = written(batch.withColumn("day", day), "files")
        first, last = rows.agg(F.min("day"), F.max("day")).first()
        if first is None:
            upsert_ledger(spark, ledger, spark.createDataFrame([], USAGE), number)
            return
        days = catalog_by_day(catalog, F.lit(first), F.lit(last))
        intervals = capacity_intervals(days, get_version(spark, ledger, USAGE, number - 1))
        planned = route_attempts(rows, intervals, order, attempts)
        records = extract_documents(
            planned.withColumnRenamed("attempts", "_planned"),
            client_factory, F.col("_planned"), chat_providers, concurrency, keep=("day",),
        )
        target = f"{path}/records/{number}"
        records.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(target)
        calls = spark.read.parquet(target).select("day", F.inline("calls"))
        counts = calls.groupBy("provider", "model", "day").agg(F.count(F.lit(1)).alias("calls"))
        upsert_ledger(spark, ledger, counts, number)

    each_batch(files, checkpoint, store)
    return spark.read.parquet(f"{path}/records/*")

