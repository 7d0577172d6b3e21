"""Streams of many small batches, and states that hold many keys."""

import datetime
import os

from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.sources.documents import drop_repeated_uploads, stream_documents
from candidata.streaming.jobs import BUCKETS as JOB_BUCKETS
from candidata.streaming.jobs import current_states, follow_jobs
from candidata.streaming.rates import BUCKETS as KEY_BUCKETS
from candidata.streaming.rates import rocksdb_state, stream_requests_in_window
from candidata.streaming.runs import PARTITIONS, append_to, latest, state_per_core, update_log

T0 = datetime.datetime(2025, 1, 1)


def test_a_small_stream_has_one_state_partition_per_core(spark, tmp_path):
    """However many partitions the session's shuffles have, and all batches see the same state."""
    for n, text in enumerate(["a", "b", "a", "c", "b"]):
        (tmp_path / f"{n}.txt").write_text(text)
    before, folder = spark.conf.get(PARTITIONS), fresh_path(spark, "stream")
    spark.conf.set(PARTITIONS, "100")
    try:
        with state_per_core(spark):
            files = drop_repeated_uploads(stream_documents(spark, str(tmp_path), 2), "1 day")
            found = append_to(files.select("content"), f"{folder}/rows", f"{folder}/checkpoint")
        assert spark.conf.get(PARTITIONS) == "100"
    finally:
        spark.conf.set(PARTITIONS, before)
    assert sorted(bytes(r["content"]) for r in found.collect()) == [b"a", b"b", b"c"]
    stores = spark.read.format("statestore").load(f"{folder}/checkpoint")
    assert stores.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_uploads_to_several_folders_meet_in_one_state(spark, tmp_path):
    """A batch takes a file of each folder; old files of one folder are not late because of newer ones of another."""
    days = [[(0, "a"), (0.1, "b"), (5, "c"), (10, "d")], [(10, "d"), (900, "x"), (900.1, "y"), (900.2, "x")]]
    for k, files in enumerate(days):
        (tmp_path / str(k)).mkdir()
        for n, (day, text) in enumerate(files):
            path = tmp_path / str(k) / f"{n}.txt"
            path.write_text(text)
            os.utime(path, (1.6e9 + day * 86_400,) * 2)
    folder = fresh_path(spark, "stream")
    with state_per_core(spark):
        files = drop_repeated_uploads([stream_documents(spark, str(tmp_path / str(k)), 1) for k in range(2)], "1 day")
        found = append_to(files.select("content"), f"{folder}/rows", f"{folder}/checkpoint")
    assert sorted(bytes(r["content"]).decode() for r in found.collect()) == list("abcdxy")
    # One more may follow the last files, without rows.
    assert spark.read.text(f"{folder}/checkpoint/commits").select(F.input_file_name()).distinct().count() <= 5


def _arriving(spark, rows, path):
    """The rows as a stream of two batches, of odd and even numbers."""
    for n in (0, 1):
        rows.filter(F.col("event_id") % 2 == n).coalesce(1).write.parquet(f"{path}/{n}")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    return source.parquet(path)


def test_jobs_share_states(spark):
    """Thousands of jobs are kept in a bounded number of states, each job with its own values, the null job too."""
    folder, n = fresh_path(spark, "jobs"), 2 * JOB_BUCKETS + 500
    job = F.when(F.col("id") >= 2, F.floor(F.col("id") / 2))
    rows = spark.range(2 * n).select(
        job.alias("job_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 50).alias("ts"), F.col("id").alias("event_id"),
        F.lit("t").alias("type"), F.lit("pending").alias("status"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("progress"),
    )
    followed = append_to(follow_jobs(_arriving(spark, rows, f"{folder}/in"), "1 day"), f"{folder}/rows", f"{folder}/checkpoint")
    got = {r["job_id"]: (r["progress"], r["created_at"].second) for r in current_states(followed).collect()}
    want = {}
    for i in range(2 * n):
        key, second = (i // 2 if i >= 2 else None), datetime.datetime.fromtimestamp(1_700_000_000 + i % 50).second
        want[key] = (i - i % 2, want[key][1] if key in want else second)
    assert got == want
    states = spark.read.format("statestore").load(f"{folder}/checkpoint").count()
    assert 0 < states <= JOB_BUCKETS + 1


def test_keys_share_states(spark):
    """Thousands of keys are kept in a bounded number of states a span; big numbers and null stay what they are."""
    folder, n = fresh_path(spark, "keys"), 2 * KEY_BUCKETS + 500
    key = F.when(F.col("id") >= 2, F.floor(F.col("id") / 2) + (1 << 60))
    rows = spark.range(2 * n).select(
        key.alias("k"), F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 2).alias("ts")
    )
    with rocksdb_state(spark):
        stream = _arriving(spark, rows, f"{folder}/in")
        counts = stream_requests_in_window(stream, "k", "event_id", seconds=20, delay="1 day")
        found = latest(update_log(counts, f"{folder}/log", f"{folder}/checkpoint"), ["event_id"]).collect()
    got = {r["event_id"]: (r["k"], r["in_window"]) for r in found}
    assert got == {i: (i // 2 + (1 << 60) if i >= 2 else None, 1 + i % 2) for i in range(2 * n)}
    states = spark.read.format("statestore").option("stateVarName", "requests").load(f"{folder}/checkpoint")
    assert 0 < states.select("key").distinct().count() <= KEY_BUCKETS
