"""Streams over several batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.operators.jobs import expire_jobs, job_state
from candidata.streaming.jobs import current_states, follow_jobs
from candidata.sources.documents import as_one_stream, stream_documents
from candidata.streaming.runs import append_side_by_side, append_to, compact, latest, update_log

SCHEMA = "job_id bigint, ts timestamp, event_id bigint, type string, status string, progress bigint"
T0 = datetime.datetime(2025, 1, 1)


def event(job, second, status, n=0):
    return (job, T0 + datetime.timedelta(seconds=second), n, "extraction", status, None)


BATCHES = [
    [event(1, 0, "pending"), event(1, 5, "processing", 1), event(9, 6, "processing", 2)],
    [event(2, 3000, "pending", 3), event(1, 3500, "failed", 4)],
    [event(3, 3601, "pending", 5), event(2, 3650, "completed", 6)],
    [event(4, 6700, "pending", 7)],
]


@pytest.fixture()
def events(spark, tmp_path):
    """The batches as files that are read one at a time."""
    for n, batch in enumerate(BATCHES):
        rows = spark.createDataFrame(batch, SCHEMA).coalesce(1)
        rows.write.parquet(str(tmp_path / "in" / f"n={n}"))
    return (
        spark.readStream.schema(SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .parquet(str(tmp_path / "in"))
    )


def all_events(spark):
    return spark.createDataFrame([e for b in BATCHES for e in b], SCHEMA)


def test_state_is_the_same_as_in_a_batch(spark, events):
    folder = fresh_path(spark, "stream")
    order = ("ts", "event_id")
    log = update_log(job_state(events, order=order), f"{folder}/log", f"{folder}/checkpoint")
    assert log.select("batch").distinct().count() > 1
    streamed = latest(log, ["job_id"]).orderBy("job_id").collect()
    assert streamed == job_state(all_events(spark), order=order).orderBy("job_id").collect()
    assert [r["job_id"] for r in streamed] == [1, 2, 3, 4]


def test_jobs_expire_by_their_creation(spark, events):
    folder = fresh_path(spark, "stream")
    followed = append_to(follow_jobs(events, "0 seconds", 3600), f"{folder}/rows", f"{folder}/checkpoint")
    states = {r["job_id"]: (r["status"], r["expired"]) for r in current_states(followed).collect()}
    assert states == {1: ("failed", True), 2: ("completed", True), 3: ("pending", False), 4: ("pending", False)}


LATE = [
    [event(1, 0, "pending"), event(2, 10, "processing", 1), event(5, 20, "failed", 8)],
    [event(1, 5000, "processing", 2), event(7, 5000, "pending", 9)],
    [event(3, 5001, "pending", 3)],
    # The creation of 4 is late, its other events are not; 2 is created, after its first event.
    [event(4, 100, "pending", 4), event(4, 5500, "processing", 5), event(2, 5400, "pending", 6), event(4, 5600, "pending", 7)],
    [event(3, 20_000, "completed", 10)],
]


@pytest.mark.parametrize("arrow_rows", [1, 2, 10_000])
def test_late_events_do_not_depend_on_arrow_batches(spark, tmp_path, arrow_rows):
    for n, batch in enumerate(LATE):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    stream = (
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(str(tmp_path / "in"))
    )
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
        rows = append_to(follow_jobs(stream, "600 seconds", 8000), str(tmp_path / "rows"), str(tmp_path / "checkpoint"))
        states = {r["job_id"]: (r["status"], (r["created_at"] - T0).seconds, r["expired"]) for r in current_states(rows).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert states == {
        1: ("processing", 0, True), 2: ("pending", 5400, True), 3: ("completed", 5001, True), 4: ("pending", 5600, True), 7: ("pending", 5000, True),
    }


def test_a_log_can_be_compacted(spark, events):
    folder = fresh_path(spark, "stream")
    log = update_log(job_state(events, order=("ts", "event_id")), f"{folder}/log", f"{folder}/checkpoint")
    compact(log, ["job_id"], f"{folder}/short", 9)
    short = spark.read.option("basePath", f"{folder}/short").parquet(f"{folder}/short/batch=*")
    assert short.count() == 4 < log.count()
    assert latest(short, ["job_id"]).orderBy("job_id").collect() == latest(log, ["job_id"]).orderBy("job_id").collect()


def test_a_job_lives_through_the_last_second(spark):
    states = job_state(all_events(spark))
    kept = lambda now: {
        r["job_id"] for r in expire_jobs(states, F.lit(T0 + datetime.timedelta(seconds=now)), 3600).collect()
    }
    assert kept(3600) == {1, 2, 3, 4}
    assert kept(3600.000001) == {2, 3, 4}


def test_folders_are_followed_side_by_side(spark, tmp_path):
    """The first file of each folder is not done before that of the other has begun; later files are added."""
    folders = [tmp_path / "in" / str(k) for k in range(2)]
    for k, folder in enumerate(folders):
        folder.mkdir(parents=True)
        for n in range(3):
            (folder / f"{n}.txt").write_text(f"{k}-{n}")
    begun = tmp_path / "begun"
    begun.mkdir()

    def streams():
        def wait(k):
            def meet(batches):
                import time

                (begun / str(k)).touch()
                for _ in range(600):
                    if len(list(begun.iterdir())) == 2:
                        break
                    time.sleep(0.1)
                else:
                    raise TimeoutError("the other folder is not followed")
                yield from batches

            return meet

        files = [stream_documents(spark, str(folder), 1).select(F.decode("content", "UTF-8").alias("text")) for folder in folders]
        return [f.mapInPandas(wait(k), "text string") for k, f in enumerate(files)]

    run = lambda made: sorted(r["text"] for r in append_side_by_side(made, f"{tmp_path}/rows", f"{tmp_path}/at").collect())
    expected = [f"{k}-{n}" for k in range(2) for n in range(3)]
    assert run(streams()) == expected
    batches = [sum(x.name.isdigit() for x in (tmp_path / "at" / str(k) / "commits").iterdir()) for k in range(2)]
    assert batches == [3, 3]
    (folders[1] / "3.txt").write_text("1-3")
    assert run(streams()) == [*expected, "1-3"]


def test_one_stream_follows_several_folders(spark, tmp_path):
    """A batch takes a file of each folder, in two tasks per core; later files are added."""
    n_folders = 2 * spark.sparkContext.defaultParallelism + 4
    for k in range(n_folders):
        (tmp_path / "in" / str(k)).mkdir(parents=True)
        for n in range(2):
            (tmp_path / "in" / str(k) / f"{n}.txt").write_text(f"{k}-{n}")

    def run():
        streams = [stream_documents(spark, f"{tmp_path}/in/{k}", 1) for k in range(n_folders)]
        texts = as_one_stream(streams).select(F.decode("content", "UTF-8").alias("text"))
        return sorted(r["text"] for r in append_to(texts, f"{tmp_path}/rows", f"{tmp_path}/at").collect())

    expected = [f"{k}-{n}" for k in range(n_folders) for n in range(2)]
    assert run() == sorted(expected)
    assert sum(x.name.isdigit() for x in (tmp_path / "at" / "commits").iterdir()) == 2
    assert len(list((tmp_path / "rows").glob("part-*"))) <= 4 * spark.sparkContext.defaultParallelism
    (tmp_path / "in" / "3" / "9.txt").write_text("later")
    assert run() == sorted([*expected, "later"])


def test_a_failed_stream_ends_the_others(spark, tmp_path):
    for k in range(2):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "a.txt").write_text("x")
    streams = [stream_documents(spark, str(tmp_path / str(k)), 1).select("filename") for k in range(2)]
    streams[0] = streams[0].select(F.raise_error(F.lit("broken")).cast("string").alias("filename"))
    with pytest.raises(Exception, match="broken"):
        append_side_by_side(streams, f"{tmp_path}/rows", f"{tmp_path}/at")
    assert not spark.streams.active
