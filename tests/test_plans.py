"""Physical plans: what is read, shuffled and broadcast."""

import importlib
import re

from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.operators import matching, positions, records, usage
from candidata.operators.grid import read_page, store_grid
from candidata.plans import fixtures, registry
from candidata.sources.documents import scan_documents
from conftest import SMALL

for _name in ("document", "answer", "fit", "export", "usage", "job"):
    importlib.import_module(f"candidata.plans.{_name}_queries")
QUERIES = registry.QUERIES
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_candidates_are_cut_before_the_shuffle(spark):
    text = plan(QUERIES["top_candidates"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 2


def test_checks_run_once_after_the_join(spark):
    text = plan(QUERIES["match_requirements"](spark, SMALL))
    assert text.count("transform(requirements") == 1


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["assign_batches"](spark, SMALL))
    # The positions are read from stored parts with what the query needs of a document.
    assert "ReadSchema: struct<doc_id:bigint,source:string,_place:bigint>" in text
    files = plan(scan_documents(spark, SMALL).select("filename", "length"))
    assert "content" not in files


def test_positions_are_read_in_place(spark):
    """The stored parts meet a small table of offsets; their rows are not shuffled again."""
    text = plan(QUERIES["progress"](spark, SMALL))
    assert "BroadcastHashJoin" in text and "rangepartitioning" not in text and "hashpartitioning" not in text
    routed = plan(QUERIES["route_models"](spark, SMALL))
    assert routed.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in routed


def test_jobs_are_only_broadcast_while_they_are_small(spark):
    people = fixtures.applications(fixtures.stored_candidates(spark, SMALL))
    jobs = fixtures.valid_jobs(spark, SMALL)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    small = plan(matching.pair_candidates(people, jobs, "job_id"))
    assert "BroadcastHashJoin" in small
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        large = plan(matching.pair_candidates(people, jobs, "job_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in large and "BroadcastHashJoin" not in large


def test_a_hot_request_is_split(spark):
    """Two thirds of the candidates belong to one of 300 jobs, and no side may be broadcast."""
    n = F.col("candidate_id")
    people = fixtures.stored_candidates(spark, SMALL).drop("r_regionkey")
    sent = people.select("candidate_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("copy"))
    sent = sent.withColumn("job_id", F.when(n % 3 != 0, 7).otherwise((n * 10 + F.col("copy")) % 300).cast("bigint"))
    described = matching.describe(people, F.lit(fixtures.AS_OF_DAY), keep=("candidate_id",))
    job = fixtures.valid_jobs(spark, SMALL).filter("job_id = 0").drop("job_id")
    jobs = job.withColumn("job_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(299).cast("bigint"))))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        fit = matching.evaluate_fit(described.repartition(8), sent, jobs, "job_id", keep=("candidate_id",))
        assert len(fit.collect()) == sent.count()
        assert "SortMergeJoin(skew=true)" in plan(fit)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_key_is_shared_by_many_parts(spark):
    """One day, hour and key hold nine tenths of the rows, with ids like hashes."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        key = F.when(F.col("id") % 10 != 0, "hot").otherwise(F.col("id").cast("string"))
        rows = spark.range(40_000).select(key.alias("k"), F.xxhash64("id").alias("at"))
        placed = positions.position(rows, ["k"], [F.col("at")], "n", total="size")
        sizes = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < 0.15 * 40_000
        stored = [line for line in plan(placed).splitlines() if "parts-" in line]
        assert stored
        hot = placed.filter("k = 'hot'").orderBy("at").collect()
        assert [r["n"] for r in hot] == list(range(1, 36_001)) and {r["size"] for r in hot} == {36_000}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_hot_instant_is_counted_before_the_shuffle(spark):
    """Nine tenths of the requests have one key and instant; no task counts or gets more than its share."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    n = 100_000
    second = F.when(F.col("id") % 10 != 0, 1000).otherwise(F.col("id"))
    log = spark.range(0, n, 1, 16).select(F.lit("k").alias("k"), F.timestamp_seconds(second).alias("ts"), "id")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        counted = usage.requests_in_window(log, "k", seconds=60)
        sizes = [r["n"] for r in counted.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) < n / 2
        # Per key and instant first: partial and final count, before any range of instants.
        assert counted.filter("id = 1").first()["in_window"] == n * 9 // 10 + 6
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_page_reads_only_its_parts(spark):
    rows = spark.range(0, 4000, 1, 8).select(F.col("id"), F.concat(F.lit("row "), F.col("id") % 97).alias("name"))
    path = fresh_path(spark, "grid")
    store_grid(rows, [F.desc("id")], path, parts=20)
    page = read_page(spark, path, offset=1000, limit=50)
    assert [r["id"] for r in page.collect()] == list(range(2999, 2949, -1))
    assert "PartitionFilters: [isnotnull(_part" in plan(page)
    read = page._jdf.queryExecution().optimizedPlan().toString()
    first, last = re.search(r"_part#\d+L? >= (\d+)\) AND \(_part#\d+L? <= (\d+)\)", read).groups()
    assert 0 < int(first) <= int(last) <= int(first) + 1
    found = read_page(spark, path, ["ROW 5", "w 5"], offset=40, limit=10)
    hits = [i for i in range(3999, -1, -1) if f"row {i % 97}".startswith("row 5") or " row 5" in f"{i} row {i % 97}"]
    assert [r["id"] for r in found.collect()] == hits[40:50]
    index = spark.read.parquet(f"{path}/grams")
    assert "PartitionFilters: [isnotnull(bucket" in plan(index.filter("bucket = 3"))


def test_words_meet_the_first_words_of_phrases(spark):
    """Only runs that begin a phrase are built, after the join with the first words."""
    docs = spark.createDataFrame([(1, "a b c")], "id long, text string")
    skills = spark.createDataFrame([("b c d e f g h i j k l m",)], "skill string")
    text = plan(records.rule_extract(docs, "id", "text", skills, "skill"))
    assert "slice(_words" in text and "CartesianProduct" not in text


def test_listed_options_are_dealt_by_key(spark):
    """Rows made of a small table are large: none of them is broadcast, and no task makes them all."""
    plan = registry.QUERIES["listed_options"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert "REPARTITION_BY_COL" in plan
