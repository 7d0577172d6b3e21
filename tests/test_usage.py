"""Limits and ledgers."""

import json
import random

from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.operators import usage
from candidata.operators.ranking import compare_top
from candidata.sources.records import scan_usage_ledger

CATALOG = "provider string, provider_ord int, model string, model_ord int, daily_limit bigint, enabled boolean"


def catalog(spark):
    rows = [("b", 2, "b1", 1, 4, True), ("a", 1, "a2", 2, 3, True), ("a", 1, "a1", 1, 2, True), ("c", 3, "c1", 1, 99, False)]
    return spark.createDataFrame(rows, CATALOG).withColumn("day", F.lit("2025-01-01"))


def test_models_are_used_in_order_up_to_their_limits(spark):
    used = spark.createDataFrame([("a", "a2", "2025-01-01", 2), ("b", "b1", "2025-01-01", 9)], "provider string, model string, day string, calls bigint")
    intervals = usage.capacity_intervals(catalog(spark), used)
    requests = spark.range(5).withColumn("day", F.lit("2025-01-01")).repartition(3)
    routed = usage.route_models(requests, intervals, ["id"]).orderBy("id").collect()
    assert [r["routed_model"] for r in routed] == ["a1", "a1", "a2", None, None]
    assert [r["error"] for r in routed] == [None] * 3 + [usage.ALL_EXHAUSTED] * 2


def test_a_day_without_models_has_no_capacity(spark):
    intervals = usage.capacity_intervals(catalog(spark), spark.createDataFrame([], "provider string, model string, day string, calls bigint"))
    requests = spark.range(2).withColumn("day", F.lit("2025-02-02"))
    routed = usage.route_models(requests, intervals, ["id"])
    assert {r["error"] for r in routed.collect()} == {usage.ALL_EXHAUSTED}


def test_summary_counts_models_outside_the_catalog(spark):
    used = spark.createDataFrame([("a", "a1", "2025-01-01", 2), ("a", "old", "2025-01-01", 3)], "provider string, model string, day string, calls bigint")
    rows = {r["provider"]: r for r in usage.usage_summary(catalog(spark), used).collect()}
    assert set(rows) == {"a", "b"}
    a = rows["a"]
    assert (a["total_usage"], a["daily_limit"], a["remaining"], a["usage_percentage"], a["status"]) == (5, 5, 0, 100.0, "Exhausted")
    assert a["models"]["a1"].asDict() == {"usage": 2, "last_used": "Today"}
    assert a["models"]["a2"].asDict() == {"usage": 0, "last_used": "Not used today"}


def test_later_attempts_get_what_is_left(spark):
    nothing = spark.createDataFrame([], "provider string, model string, day string, calls bigint")
    intervals = usage.capacity_intervals(catalog(spark), nothing)
    files = spark.range(4).withColumn("day", F.lit("2025-01-01"))
    rows = usage.route_attempts(files, intervals, ["id"], attempts=3).orderBy("id").collect()
    models = [[a["model"] for a in r["attempts"]] for r in rows]
    # Nine calls a day: two for a1, three for a2, four for b1.
    assert models == [["a1", "a2", "b1"], ["a1", "b1"], ["a2", "b1"], ["a2", "b1"]]


def test_ledger_files(spark):
    path = fresh_path(spark, "ledger")
    assert scan_usage_ledger(spark, path).collect() == []
    ledger = {"p": {"m": {"2025-01-01": 3, "2025-01-02": 1}}, "q": {"n": {}}}
    spark.createDataFrame([(json.dumps(ledger, indent=2),)], "v string").coalesce(1).write.text(path)
    rows = scan_usage_ledger(spark, path).collect()
    assert {tuple(r) for r in rows} == {("p", "m", "2025-01-01", 3), ("p", "m", "2025-01-02", 1)}
    broken = fresh_path(spark, "ledger")
    spark.createDataFrame([("{not json",)], "v string").write.text(broken)
    assert scan_usage_ledger(spark, broken).collect() == []


def test_thousands_of_models_a_day(spark):
    """Requests meet only the intervals of their block of numbers."""
    draw = random.Random(4)
    rows, expected = [], {}
    for day, asked in (("2025-01-01", 5000), ("2025-01-02", 40)):
        lo, owner = 0, {}
        for m in range(3000):
            size = draw.choice([0, 1, 1, 2, 3, 900])
            rows.append((day, lo, lo + size, "p", f"m{m}"))
            owner.update({n: f"m{m}" for n in range(lo + 1, min(lo + size, asked) + 1)})
            lo += size
        expected |= {(day, i): owner.get(i + 1) for i in range(asked)}
    intervals = spark.createDataFrame(rows, "day string, lo long, hi long, provider string, model string")
    requests = spark.createDataFrame(list(expected), "day string, id long").repartition(5)
    blocks = usage.interval_blocks(intervals, requests.groupBy("day").agg(F.count("*").alias("_asked")))
    assert blocks.groupBy("day", "_block").count().agg(F.max("count")).first()[0] <= usage.BLOCK
    routed = usage.route_models(requests, intervals, ["id"]).collect()
    assert {(r["day"], r["id"]): r["routed_model"] for r in routed} == expected


def test_what_is_left_of_intervals(spark):
    rows = [("d", 0, 2, "p", "a"), ("d", 2, 5, "p", "b"), ("e", 0, 4, "p", "a")]
    intervals = spark.createDataFrame(rows, "day string, lo long, hi long, provider string, model string")
    asked = spark.createDataFrame([("d", 3), ("f", 9)], "day string, _asked long")
    left = usage.remaining_intervals(intervals, asked).orderBy("day").collect()
    assert [tuple(r) for r in left] == [("d", 0, 2, "p", "b"), ("e", 0, 4, "p", "a")]


def test_pairs_of_the_best(spark):
    rows = [("j", i, f"n{i}", p) for i, p in enumerate([70, 90, 90, 10, 80])] + [("k", 9, "x", 5)]
    fit = spark.createDataFrame(rows, "job string, id long, candidate_name string, fit_percentage int")
    nothing = F.array().cast("array<string>")
    fit = fit.withColumns({"summary": F.lit("s"), "key_matches": nothing, "key_gaps": nothing})
    got = [(r["job"], r["rank_a"], r["rank_b"], r["candidate_name_a"], r["candidate_name_b"], r["lead"]) for r in compare_top(fit, "job", "id", 3).orderBy("rank_a", "rank_b").collect()]
    assert got == [("j", 1, 2, "n1", "n2", 0), ("j", 1, 3, "n1", "n4", 10), ("j", 2, 3, "n2", "n4", 10)]
