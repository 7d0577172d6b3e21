"""Running a stream over what is there now and keeping its results as tables.

Every batch of a stream has a number, and what it stores lies in a folder of that number. A batch
that is repeated after a failure replaces its own folder and nothing else. What a reader needs to
know, the number up to which all is stored, is written last, as a marker of its own.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Fixed name: the setting for the greatest number of tasks that list the folders of a source.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextlib.contextmanager
def listed_in(spark: SparkSession, tasks: int = 64) -> Iterator[None]:
    """Sources opened and streams run in this block list their folders in at most so many tasks.

    By default a folder is a task of its own, whose report to the driver is longer than what it found.
    """
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, tasks)
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


# Fixed name: the setting for the number of partitions of a shuffle, and so of a new stream's state.
PARTITIONS = "spark.sql.shuffle.partitions"


@contextlib.contextmanager
def state_per_core(spark: SparkSession) -> Iterator[None]:
    """Streams begun in this block keep their state in one partition per core of the cluster.

    Every batch opens and commits every partition of the state, however few rows it has. For many small batches that
    is most of their time. A stream that goes on from a checkpoint keeps the number it began with.
    """
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, min(int(before), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all available input, append the results to a table, and read it."""
    run = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def append_side_by_side(streams: Sequence[DataFrame], path: str, checkpoint: str) -> DataFrame:
    """As `append_to` for streams that share no input, all at the same time; reads the rows of all.

    Most of the time of a batch of a few files is that of planning and committing it, which keeps no core busy, so
    other streams use the cores meanwhile. Every stream has a table and a checkpoint of its own, below the folders
    given. If one fails, the others are stopped.
    """
    runs = []
    try:
        for n, stream in enumerate(streams):
            writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/{n}")
            runs.append(writer.option("checkpointLocation", f"{checkpoint}/{n}").trigger(availableNow=True).start())
        left = runs
        while left:
            left = [run for run in left if not run.awaitTermination(0.5)]
    finally:
        for run in runs:
            run.stop()
    tables = [s.sparkSession.read.schema(s.schema).parquet(f"{path}/{n}") for n, s in enumerate(streams)]
    return functools.reduce(DataFrame.unionByName, tables)


def each_batch(
    stream: DataFrame, checkpoint: str, store: Callable[[DataFrame, int], None], mode: str = "append"
) -> None:
    """Process all available input, batch by batch; `store` has to be repeatable."""
    run = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()


def update_log(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all available input in update mode and keep every changed row.

    A batch owns one folder and replaces it when it is repeated after a failure.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    each_batch(stream, checkpoint, store, "update")
    return stream.sparkSession.read.option("basePath", path).parquet(f"{path}/batch=*")


def latest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key of an update log."""
    return newest_rows(log, keys).drop("batch")


def newest_rows(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As `latest`, with the number of the batch a row comes from."""
    values = [c for c in log.columns if c not in keys]
    return (
        log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row")).select(*keys, "_row.*")
    ).select(log.columns)


def compact(log: DataFrame, keys: Sequence[str], path: str, batch: int) -> None:
    """Store the newest rows of an update log as one batch of another log.

    Readers can then go on with the new log, and the old one need not be kept.
    """
    latest(log, keys).write.mode("overwrite").parquet(f"{path}/batch={batch}")


# ---- tables in versions


def put_version(table: DataFrame, path: str, number: int) -> None:
    """Store version `number` of a table, then say that it is there."""
    table.write.mode("overwrite").parquet(f"{path}/version={number}")
    marker = table.sparkSession.range(1).select(F.lit(number).cast("bigint").alias("at"))
    marker.write.mode("overwrite").parquet(f"{path}/done/version={number}")


def newest_version(spark: SparkSession, path: str) -> int:
    """The greatest version that is complete."""
    return spark.read.schema("at bigint").parquet(f"{path}/done/version=*").agg(F.max("at")).first()[0]


def get_version(spark: SparkSession, path: str, schema: T.StructType, number: int | None = None) -> DataFrame:
    """A version of the table, the newest by default."""
    number = newest_version(spark, path) if number is None else number
    return spark.read.schema(schema).parquet(f"{path}/version={number}")


# ---- logs with snapshots


def _logged(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch", T.LongType())])


def _log_from(spark: SparkSession, path: str, schema: T.StructType, snapshot: int) -> DataFrame:
    """Snapshot number `snapshot` and the batches of the folder opened with it."""
    shape = _logged(schema)
    rows = get_version(spark, f"{path}/snapshots", shape, snapshot)
    newer = spark.read.schema(shape).parquet(f"{path}/batches/after={snapshot}/*")
    return rows.unionByName(newer)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The newest snapshot of a log of `snapshot_log` and the batches since, `batch` being their number.

    Only these folders are listed and read, however long the stream has run.
    """
    return _log_from(spark, path, schema, newest_version(spark, f"{path}/snapshots"))


def snapshot_log(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    newest: Callable[[DataFrame], DataFrame],
    every: int = 32,
    mode: str = "append",
) -> DataFrame:
    """Process all available input and keep its rows in a log of bounded length; returns the log.

    After every `every` batches, what `newest` leaves of the log is stored as a snapshot, while
    the stream runs, and a new folder is begun for the batches after it. Older folders are not
    read again. Snapshot k holds the batches below k * every; one that is made again after a
    failure is made from the same rows.
    """
    spark, schema = stream.sparkSession, stream.schema

    def begin(rows: DataFrame, number: int) -> None:
        nothing = spark.createDataFrame([], _logged(schema))
        nothing.write.mode("overwrite").parquet(f"{path}/batches/after={number}/none")
        put_version(rows, f"{path}/snapshots", number)

    def store(batch: DataFrame, number: int) -> None:
        after, place = divmod(number, every)
        if number == 0:
            begin(spark.createDataFrame([], _logged(schema)), 0)
        rows = batch.withColumn("batch", F.lit(number).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{path}/batches/after={after}/{number}")
        if place == every - 1:
            begin(newest(_log_from(spark, path, schema, after)), after + 1)

    each_batch(stream, checkpoint, store, mode)
    return read_log(spark, path, schema)
