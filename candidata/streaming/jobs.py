"""Job states kept by a stream, with a time to live."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candidata.operators.jobs import TTL_SECONDS

STEP = "job_id bigint, ts timestamp, us bigint, event_id bigint, type string, status string, progress bigint"
STATE = (
    "job_id array<bigint>, created_us array<bigint>, updated_us array<bigint>, updated_id array<bigint>, type array<string>, "
    "status array<string>, progress array<bigint>, progress_us array<bigint>, progress_id array<bigint>"
)
FOLLOWED = "job_id bigint, created_us bigint, updated_us bigint, updated_id bigint, type string, status string, progress bigint, expired boolean"

# A bucket of jobs: a row per job, in the order of the state.
JOBS = {
    "job_id": "int64", "created_us": "Int64", "updated_us": "int64", "updated_id": "int64", "type": "object",
    "status": "object", "progress": "Int64", "progress_us": "Int64", "progress_id": "Int64",
}

#: Buckets of jobs: Python is called once per bucket that a batch touches, not once per job.
BUCKETS = 1024

#: The bucket of events without a job, which share a state.
NO_JOB = -1


def _matters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each job and Arrow batch: all creations, the newest event, the newest progress.

    The rows of a busy job are thinned out here, before they are sent to the one task that
    holds its state. Each keeps its own time, so whether it is late does not depend on its
    neighbours.
    """
    for batch in batches:
        ordered = batch.sort_values(["us", "event_id"], kind="stable")
        newest = ordered.groupby("job_id", sort=False).tail(1).index
        moved = ordered[ordered["progress"].notna()].groupby("job_id", sort=False).tail(1).index
        created = ordered.index[ordered["status"] == "pending"]
        yield ordered.loc[newest.union(moved).union(created)]


def _jobs(columns: Sequence[Sequence]) -> pd.DataFrame:
    """The jobs of a bucket, from the arrays of its state."""
    return pd.DataFrame({name: pd.Series(list(values), dtype=JOBS[name]) for name, values in zip(JOBS, columns)})


def _followed(jobs: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """The jobs after these steps. Of steps at the same time and of the same number the last counts."""

    def newest(known: pd.DataFrame, steps: pd.DataFrame, at: list[str], values: list[str]) -> pd.DataFrame:
        names = dict(zip(["us", "event_id", *values], [*at, *values]))
        parts = known[["job_id", *names.values()]], steps[["job_id", *names]].rename(columns=names)
        rows = pd.concat([part.astype({c: JOBS[c] for c in part}) for part in parts])
        return rows.sort_values(at, kind="stable").drop_duplicates("job_id", keep="last").set_index("job_id")

    updated = newest(jobs, steps, ["updated_us", "updated_id"], ["type", "status"])
    moved = newest(
        jobs[jobs["progress_us"].notna()], steps[steps["progress"].notna()], ["progress_us", "progress_id"], ["progress"]
    )
    begun = steps.loc[steps["status"] == "pending", ["job_id", "us"]].rename(columns={"us": "created_us"})
    begun = pd.concat([jobs.loc[jobs["created_us"].notna(), ["job_id", "created_us"]], begun.astype({"created_us": "Int64"})])
    created = begun.groupby("job_id").min()
    return updated.join(moved).join(created).reset_index()[[*JOBS]]


def follow_jobs(events: DataFrame, delay: str, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """A row for every job that changed in a micro-batch, and a last one, `expired`, for each job
    created more than the time to live ago; then the job is forgotten.

    Time is the watermark of the events, `delay` how late they may come. A `pending` event
    creates a job; events that come before it are kept with it, and forgotten after the same
    time if none comes. Events: job_id, ts, event_id, type, status, progress.

    A state holds one of `BUCKETS` buckets of jobs, and its timer the time at which the first of them is due.
    """
    ttl_ms = int(ttl_seconds * 1000)

    def shown(bucket: int, some: pd.DataFrame, expired: bool) -> pd.DataFrame:
        some = some[some["created_us"].notna()]
        rows = some[["job_id", "created_us", "updated_us", "updated_id", "type", "status", "progress"]].copy()
        rows["progress"] = rows["progress"].fillna(0)
        rows["expired"] = expired
        if bucket == NO_JOB:
            rows["job_id"] = pd.array([None] * len(rows), "Int64")
        return rows

    def follow(key, steps: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = _jobs(state.get if state.exists else ([],) * len(JOBS))
        touched = np.zeros(len(jobs), bool)
        if not state.hasTimedOut:
            new = pd.concat([*steps])
            jobs = _followed(jobs, new)
            touched = jobs["job_id"].isin(new["job_id"]).to_numpy()
        since = jobs["created_us"].fillna(jobs["updated_us"]).to_numpy(np.int64)
        due, now = -(-since // 1000) + ttl_ms, state.getCurrentWatermarkMs()
        over = due < now
        for rows in (shown(key[0], jobs[over], True), shown(key[0], jobs[touched & ~over], False)):
            if len(rows):
                yield rows
        jobs = jobs[~over]
        if len(jobs):
            state.update(tuple(jobs[c].astype(object).where(jobs[c].notna(), None).tolist() for c in JOBS))
            # The watermark may stand exactly at the due time; a timeout must lie after it.
            state.setTimeoutTimestamp(max(int(due[~over].min()), now + 1))
        elif state.exists:
            state.remove()

    steps = (
        events.select("job_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "type", "status", "progress")
        .mapInPandas(_matters, STEP)
        .withColumn("bucket", F.when(F.col("job_id").isNull(), NO_JOB).otherwise(F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS))))
        .withColumn("job_id", F.coalesce("job_id", F.lit(0)))
        .withWatermark("ts", delay)
    )
    return steps.groupBy("bucket").applyInPandasWithState(
        follow, FOLLOWED, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def newest_states(followed: DataFrame) -> DataFrame:
    """The newest row of every job out of the stored rows of `follow_jobs`, for `snapshot_log`."""
    order = F.struct("updated_us", "updated_id", (-F.col("created_us")).alias("earlier"), "expired")
    values = [c for c in followed.columns if c != "job_id"]
    newest = followed.groupBy("job_id").agg(F.max_by(F.struct(*values), order).alias("r"))
    return newest.select("job_id", "r.*").select(followed.columns)


def current_states(followed: DataFrame) -> DataFrame:
    """The state of every job out of the stored rows of `follow_jobs`."""
    return newest_states(followed).select(
        *["job_id", "status", "type", "progress"],
        F.timestamp_micros("created_us").alias("created_at"),
        F.timestamp_micros("updated_us").alias("updated_at"),
        "expired",
    )
