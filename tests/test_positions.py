"""Running totals in groups of any size, against a plain loop."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from candidata.operators.jobs import assign_batches, progress
from candidata.operators.positions import position, running_total
from candidata.operators.usage import requests_in_window


def rows(n=2000, seed=1):
    """A third of the rows has one key; some keys are null."""
    rng = random.Random(seed)
    keys = ["hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None]) for _ in range(n)]
    return [(k, i, rng.randrange(-5, 9)) for i, k in enumerate(keys)]


@pytest.mark.parametrize("partitions", [1, 7, 3])
def test_positions_and_totals(spark, partitions):
    data = rows()
    df = spark.createDataFrame(data, "k string, id bigint, v bigint").repartition(partitions)
    got = position(df, ["k"], [F.col("id")], "n", total="size")
    got = running_total(got, ["k"], [F.col("id")], F.col("v"), "sum")
    counts, sums, expected = defaultdict(int), defaultdict(int), set()
    for k, i, v in data:
        counts[k] += 1
        sums[k] += v
        expected.add((k, i, counts[k], sums[k]))
    result = got.collect()
    assert {(r["k"], r["id"], r["n"], r["sum"]) for r in result} == expected
    assert len(result) == len(data)
    assert {(r["k"], r["size"]) for r in result} == set(counts.items())


def test_positions_without_keys(spark):
    df = spark.range(1000).repartition(5)
    got = position(df, [], [F.col("id")], "n").collect()
    assert sorted((r["id"], r["n"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_progress_and_batches(spark):
    df = spark.createDataFrame([("j", i) for i in range(7)], "job string, i int")
    done = progress(df, "job", [F.col("i")]).orderBy("i").collect()
    assert [r["progress"] for r in done] == [14, 28, 42, 57, 71, 85, 100]
    batches = assign_batches(df, "job", [F.col("i")], 3).orderBy("i").collect()
    assert [r["batch"] for r in batches] == [0, 0, 0, 1, 1, 1, 2]


def test_request_window_is_open_on_the_left(spark):
    rng = random.Random(3)
    times = [0, 60, 59, 60, 120, 119.999999] + [rng.randrange(0, 400) for _ in range(150)]
    data = [("hot" if i % 3 else "k", float(t)) for i, t in enumerate(times)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(data)], "k string, t double, i int")
    df = df.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")))
    got = requests_in_window(df, "k", seconds=60, max_requests=4)
    for r in got.collect():
        k, now = data[r["i"]]
        expected = sum(1 for k2, t in data if k2 == k and now - 60 < t <= now)
        assert (r["in_window"], r["over_limit"]) == (expected, expected > 4)
    assert got.count() == len(data)
