"""Ledgers, quotas, snapshots and per-request counts on streams, over several runs and repeated batches."""

import datetime
import functools
import random

import pytest
from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.inference.client import OfflineClient
from candidata.operators import usage
from candidata.streaming import quota
from candidata.streaming.jobs import current_states, follow_jobs, newest_states
from candidata.streaming.rates import rocksdb_state, stream_requests_in_window
from candidata.streaming.runs import LISTING, latest, listed_in, newest_version, read_log, snapshot_log, update_log

T0 = datetime.datetime(2025, 1, 1)
USED = "provider string, model string, day string, calls long"


def fed(spark, batches, schema, run):
    """The result of `run` on a stream after the last batch; each batch is a file more."""
    folder, out = fresh_path(spark, "in"), None
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/{n}")
        out = run(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder))
    return out


def counted(df):
    return sorted((r["provider"], r["model"], r["day"], r["calls"]) for r in df.collect())


def test_a_repeated_batch_changes_nothing(spark):
    path = fresh_path(spark, "ledger")
    start = spark.createDataFrame([("p", "m", "d1", 5)], USED)
    quota.open_ledger(start, path)
    first = spark.createDataFrame([("p", "m", "d1", 2), ("p", "n", "d1", 1)], USED)
    second = spark.createDataFrame([("p", "m", "d2", 7)], USED)
    for _ in range(3):
        quota.upsert_ledger(spark, path, first, 0)
    assert counted(quota.read_ledger(spark, path)) == [("p", "m", "d1", 7), ("p", "n", "d1", 1)]
    quota.upsert_ledger(spark, path, second, 1)
    before = counted(quota.read_ledger(spark, path))
    # A batch that was stored but not yet committed by its stream comes once more.
    quota.upsert_ledger(spark, path, second, 1)
    assert counted(quota.read_ledger(spark, path)) == before == [("p", "m", "d1", 7), ("p", "m", "d2", 7), ("p", "n", "d1", 1)]


def test_readers_see_the_ledger_before_until_the_new_one_is_complete(spark):
    path = fresh_path(spark, "ledger")
    quota.open_ledger(spark.createDataFrame([("p", "m", "d", 1)], USED), path)
    # A version without its marker: the job died before the end.
    spark.createDataFrame([("p", "m", "d", 99)], USED).write.parquet(f"{path}/version=0")
    assert newest_version(spark, path) == -1 and counted(quota.read_ledger(spark, path)) == [("p", "m", "d", 1)]


def test_ledger_of_a_stream(spark):
    path = fresh_path(spark, "ledger")
    quota.open_ledger(spark.createDataFrame([], USED), path)
    at = lambda day: T0 + datetime.timedelta(days=day)
    batches = [[("p", "m", at(0)), ("p", "m", at(0))], [("p", "m", at(0)), ("q", "n", at(1))], [("q", "n", at(1))]]
    ledger = fed(spark, batches, "provider string, model string, ts timestamp", lambda s: quota.ledger_stream(s, path, f"{path}-checkpoint"))
    assert counted(ledger) == [("p", "m", "2025-01-01", 3), ("q", "n", "2025-01-02", 2)]


def test_a_stream_routes_as_a_batch_in_waves(spark):
    draw = random.Random(1)
    batches = [[(i, draw.choice("de"), w) for i in range(w * 100, w * 100 + draw.randint(1, 30))] for w in range(4)]
    intervals = spark.createDataFrame(
        [(d, lo, hi, "p", f"m{lo}") for d in "de" for lo, hi in ((0, 7), (7, 20), (20, 21), (21, 60))],
        "day string, lo long, hi long, provider string, model string",
    )
    path = fresh_path(spark, "quota")
    quota.open_quota(intervals, path)
    run = lambda s: quota.route_stream(s, ["id"], path, f"{path}/checkpoint", attempts=2)
    streamed = fed(spark, batches, "id long, day string, wave int", run)
    every = spark.createDataFrame([r for b in batches for r in b], "id long, day string, wave int")
    whole = usage.route_attempts(every, intervals, ["id"], attempts=2, wave="wave")
    shown = lambda df: {r["id"]: [a["model"] for a in r["attempts"]] for r in df.collect()}
    assert shown(streamed) == shown(whole) and len({tuple(v) for v in shown(whole).values()}) > 4
    assert {r["wave"] == r["batch"] for r in streamed.collect()} == {True}


def test_limits_hold_while_files_come_in(spark):
    """No model is asked more often than its limit, and what a plan did not need is there for the next batch."""
    rows = [("p1", 1, "m2", 1, 5, True), ("p2", 2, "m1", 1, 4, True), ("p3", 3, "m9", 1, 50, False)]
    catalog = spark.createDataFrame(rows, "provider string, provider_ord int, model string, model_ord int, daily_limit long, enabled boolean")
    path = fresh_path(spark, "limited")
    quota.open_ledger(spark.createDataFrame([("p1", "m2", "d", 1)], USED).withColumn("day", F.lit("2025-01-01")), f"{path}/ledger")
    batches = [[(i, "abc" * (i + 1)) for i in range(w * 3, w * 3 + 3)] for w in range(4)]

    def run(stream):
        files = stream.select("id", "text", F.concat("id", F.lit(".docx")).alias("filename"), F.lit(None).cast("string").alias("mime_type"))
        client = functools.partial(OfflineClient, frozenset({"p2"}))
        return quota.extract_stream(files, client, catalog, F.lit("2025-01-01"), ["id"], path, f"{path}/checkpoint", ["p2"], attempts=2)

    records = fed(spark, batches, "id long, text string", run).collect()
    assert len(records) == 12 and len({r["filename"] for r in records}) == 12
    ledger = {r["model"]: r["calls"] for r in quota.read_ledger(spark, f"{path}/ledger").collect()}
    made = [c["model"] for r in records for c in r["calls"]]
    assert ledger == {"m2": 1 + made.count("m2"), "m1": made.count("m1")}
    assert ledger["m2"] == 5 and ledger["m1"] <= 4
    refused = [r for r in records if not r["calls"]]
    assert refused and {r["error"] for r in refused} == {"All API providers have reached their daily limits."}


STEP = "job_id bigint, ts timestamp, event_id bigint, type string, status string, progress bigint"


def test_a_log_is_read_from_its_snapshot(spark):
    batches = [[(j, T0 + datetime.timedelta(seconds=10 * n + j), 10 * n + j, "t", "pending" if n == 0 else f"s{n}", n) for j in range(5)] for n in range(7)]
    path = fresh_path(spark, "log")
    run = lambda s: snapshot_log(follow_jobs(s, "100 seconds", 9000), path, f"{path}-checkpoint", newest_states, every=4)
    log = fed(spark, batches, STEP, run)
    states = {r["job_id"]: (r["status"], r["progress"], r["created_at"]) for r in current_states(log.drop("batch")).collect()}
    assert states == {j: ("s6", 6, T0 + datetime.timedelta(seconds=j)) for j in range(5)}
    last = newest_version(spark, f"{path}/snapshots")
    assert last >= 1
    # One snapshot and the folder begun with it, of at most `every` batches.
    files = {f.rsplit("/", 2)[-2] for f in log.inputFiles()}
    assert f"version={last}" in files and len(files - {"none", f"version={last}"}) <= 4
    assert not any(f"after={k}/" in f for f in log.inputFiles() for k in range(last))
    assert {r["batch"] for r in log.collect()} <= set(range(20)) and log.count() < 35


def test_a_snapshot_that_is_made_again_is_the_same(spark):
    path = fresh_path(spark, "log")
    stream_of = lambda s: s
    schema = "k string, v long"
    newest = lambda log: log.groupBy("k").agg(F.max_by(F.struct("v", "batch"), "v").alias("r")).select("k", "r.*")
    batches = [[("a", n), ("b", -n)] for n in range(5)]
    log = fed(spark, batches, schema, lambda s: snapshot_log(stream_of(s), path, f"{path}-checkpoint", newest, every=2))
    before = sorted(map(tuple, newest(log).collect()))
    # The same input under a new checkpoint: every batch and snapshot is stored once more.
    fed(spark, batches, schema, lambda s: snapshot_log(stream_of(s), path, f"{path}-again", newest, every=2))
    again = read_log(spark, path, log.drop("batch").schema)
    assert sorted(map(tuple, newest(again).collect())) == before == [("a", 4, 4), ("b", 0, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_each_request_has_its_exact_count(spark, seed):
    draw = random.Random(seed)
    batches, now, n = [], 0, 0
    for _ in range(6):
        now, batch = now + 90, []
        for _ in range(60):
            late = draw.randrange(0, 80) if draw.random() < 0.3 else 0
            at = now + draw.randrange(0, 90) - late if draw.random() < 0.8 else now
            batch.append((n, "hot" if n % 2 else draw.choice(["a", "b", None]), T0 + datetime.timedelta(seconds=at, microseconds=draw.choice([0, 1, 500_000]))))
            n += 1
        batches.append(batch)
    folder = fresh_path(spark, "rate")

    def run(stream):
        counts = stream_requests_in_window(stream, "k", "id", seconds=20, max_requests=3, delay="200 seconds")
        return update_log(counts, f"{folder}/log", f"{folder}/checkpoint")

    with rocksdb_state(spark):
        log = fed(spark, batches, "id long, k string, ts timestamp", run)
    got = {r["id"]: (r["in_window"], r["over_limit"]) for r in latest(log, ["id"]).collect()}
    every = [r for b in batches for r in b]
    window = datetime.timedelta(seconds=20)
    counts = {i: sum(1 for _, k2, t2 in every if k2 == k and t - window < t2 <= t) for i, k, t in every}
    assert got == {i: (c, c > 3) for i, c in counts.items()}


def test_requests_beyond_the_delay_are_not_counted(spark):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    batches = [[(1, "a", at(0)), (2, "a", at(1000))], [(3, "a", at(990)), (4, "a", at(1))], [(5, "a", at(1005)), (6, "a", at(2))]]
    folder = fresh_path(spark, "rate")

    def run(stream):
        counts = stream_requests_in_window(stream, "k", "id", seconds=20, delay="100 seconds")
        return update_log(counts, f"{folder}/log", f"{folder}/checkpoint")

    with rocksdb_state(spark):
        log = fed(spark, batches, "id long, k string, ts timestamp", run)
    got = {r["id"]: r["in_window"] for r in latest(log, ["id"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 5: 3}


def test_folders_are_listed_in_few_tasks(spark):
    """A source with a folder per file is listed by a bounded number of tasks, and the setting comes back."""
    folder = fresh_path(spark, "in")
    spark.range(120).select(F.col("id").alias("n"), F.col("id").cast("string").alias("value")).write.partitionBy("n").text(folder)
    before, group = spark.conf.get(LISTING), fresh_path(spark, "listing")
    spark.sparkContext.setJobGroup(group, "listing")
    with listed_in(spark, 8):
        rows = spark.read.option("recursiveFileLookup", True).text(folder)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 8
    assert rows.count() == 120 and spark.conf.get(LISTING) == before
