"""Jobs: state, progress, batches and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidata.operators.positions import position

# Fixed values.
FILES_PER_BATCH = 50
CANDIDATES_PER_BATCH = 15
PER_MINUTE = 15
TTL_SECONDS = 3600
ACTIVE = ("pending", "processing")


def job_state(events: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Current state of every job that was created; events of unknown jobs are ignored.

    A `pending` event creates a job. Works on a batch and, with one order column, on
    a stream; all aggregates are combined before the shuffle.
    """
    when = F.struct(*order) if len(order) > 1 else F.col(order[0])
    created = F.when(F.col("status") == "pending", F.col("ts"))
    moved = F.when(F.col("progress").isNotNull(), when)
    return (
        events.groupBy(job)
        .agg(
            F.max_by("status", when).alias("status"),
            F.max_by("type", when).alias("type"),
            F.coalesce(F.max_by("progress", moved), F.lit(0)).alias("progress"),
            F.min(created).alias("created_at"),
            F.max("ts").alias("updated_at"),
        )
        .filter(F.col("created_at").isNotNull())
    )


def job_overview(jobs: DataFrame) -> DataFrame:
    """Number of jobs per state and type, and how many of them are active."""
    return jobs.groupBy("status", "type").agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("n_active"),
    )


def expire_jobs(jobs: DataFrame, now: Column, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """Jobs that are not older than the time to live, counted from their creation."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return jobs.filter(age <= int(ttl_seconds * 1_000_000))


def progress(items: DataFrame, job: str, order: list[Column]) -> DataFrame:
    """Add `progress`: the whole percentage of the job's items up to this one."""
    numbered = position(items, [job], order, "_n", total="_total")
    share = F.floor(F.col("_n") * 100 / F.col("_total")).cast("int")
    return numbered.withColumn("progress", share).drop("_n", "_total")


def assign_batches(items: DataFrame, request: str, order: list[Column], size: int) -> DataFrame:
    """Add `batch`: items of a request in input order, `size` at a time, from 0."""
    numbered = position(items, [request], order, "_n")
    return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def estimate_minutes(n: Column) -> Column:
    return F.floor(n / PER_MINUTE) + 1


def batch_summary(records: DataFrame, request: str) -> DataFrame:
    """Successful and all records of a request."""
    return records.groupBy(request).agg(
        F.count_if(F.col("success")).alias("successful"), F.count(F.lit(1)).alias("total")
    )


def latest_experience(candidates: DataFrame) -> DataFrame:
    """Add the title and description of the first, current position."""
    current = F.try_element_at("experience", F.lit(1))
    return candidates.withColumns(
        {
            "designation": F.coalesce(current["title"], F.lit("")),
            "description": F.coalesce(current["description"], F.lit("")),
        }
    )
