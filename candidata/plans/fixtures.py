"""Inputs of the queries, derived from the tables of a test-data folder."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.functions.measures import day_key
from candidata.operators.admission import validate_weights
from candidata.operators.matching import describe, evaluate_fit, requirements
from candidata.operators.ranking import rank_after_filter
from candidata.operators.records import clean_record
from candidata.schemas import ARRAY_FIELDS

AS_OF_DAY = datetime.date(2024, 1, 1)
EXTENSIONS = (".pdf", ".doc", ".DOCX", ".xls", ".xlsx", ".txt", ".zip")
CHAT_PROVIDERS = ["p2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(number: Column, *values) -> Column:
    """The value at position `number`."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), number.cast("int") + 1)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id"), pick(F.col("doc_id") % 7, *EXTENSIONS))
    octets = "application/octet-stream"
    mime = pick(F.col("doc_id") % 5, "text/plain", "application/pdf", octets, octets, None)
    return documents.withColumns({"filename": name, "mime_type": mime})


def escaped(c: Column) -> Column:
    """Text as it stands between the quotes of a JSON string."""
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts per document with good, broken and missing answers."""
    doc = F.col("doc_id")
    score = (doc % 101).cast("string")
    percent = pick(doc % 5, 0, 1, 2, 3, 4)
    percent = (
        F.when(percent == 0, score)
        .when(percent == 1, F.concat(F.lit('"'), score, F.lit('%"')))
        .when(percent == 2, F.concat(F.lit('"'), score, F.lit('.5"')))
        .when(percent == 3, F.lit('"n/a"'))
        .otherwise("null")
    )
    lists = [
        F.lit(', "key_matches": ["lang '),
        F.col("lang"),
        F.lit('", "document"]'),
    ]
    gaps = [F.lit(', "key_gaps": ["'), F.col("source"), F.lit('"]')]
    head = [F.lit('{"summary": "'), escaped(F.col("text")), F.lit('", "fit_percentage": '), percent]
    record = F.concat(*head, *lists, *gaps, F.lit("}"))
    without_gaps = F.concat(*head, *lists, F.lit("}"))
    kind = (doc + F.col("attempt")) % 7
    answer = (
        F.when(
            kind == 0,
            F.concat(F.lit("Here it is:\n```json\n"), record, F.lit("\n```\nAnything else?")),
        )
        .when(kind == 1, record)
        .when(kind == 2, F.lit('{"a": 1} and {"b": 2}'))
        .when(kind == 3, F.left(record, F.lit(40)))
        .when(kind == 4, F.concat(F.lit("  No record for: "), F.col("text"), F.lit("\n")))
        .when(kind == 5, F.concat(F.lit("```json\n"), without_gaps, F.lit("\n```\n")))
    )
    attempts = (
        table(spark, sf_dir, "documents")
        .withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .withColumn("provider", F.when(doc % 2 == 0, "p1").otherwise("p2"))
        .withColumn("answer", answer)
    )
    quoted = F.concat(F.lit('"'), escaped(F.col("answer")), F.lit('"'))
    body = F.when(
        F.col("provider") == "p1",
        F.concat(F.lit('{"candidates": [{"content": {"parts": [{"text": '), quoted, F.lit("}]}}]}")),
    ).otherwise(F.concat(F.lit('{"choices": [{"message": {"content": '), quoted, F.lit("}}]}")))
    return attempts.withColumn("body", body)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per customer, as a model might have answered: contact data inside text."""
    t = lambda name: table(spark, sf_dir, name)
    key = F.col("c_custkey")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    brands = (
        t("lineitem")
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .select("l_orderkey", "p_brand")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_custkey", "p_brand")
        .distinct()
        .groupBy("o_custkey")
        .agg(F.array_sort(F.collect_list("p_brand")).alias("skills"))
    )
    # Newest first.
    order = F.struct("o_orderdate", "o_orderkey", "o_orderpriority", "o_orderstatus")
    recent = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(order), asc=False).alias("recent"))
    first = orders.groupBy("o_custkey").agg(F.year(F.min("o_orderdate")).alias("first_year"))
    people = (
        t("customer")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    for part in (brands, recent, first):
        people = people.join(part, key == part["o_custkey"], "left").drop("o_custkey")
    email = F.concat(
        F.lit("Contact: c"), key, F.lit("@mail"), key % 10, F.lit(".example.com (work)")
    )
    phone = F.concat(
        F.lit("Tel. +"),
        F.col("c_nationkey") + 1,
        F.lit(" ("),
        F.lpad((key % 1000).cast("string"), 3, "0"),
        F.lit(") 555-"),
        F.lpad((key % 10000).cast("string"), 4, "0"),
    )
    empty = {
        name: F.when(key % 10 != 0, F.array().cast(ARRAY_FIELDS[name]))
        for name in ("certifications", "projects", "languages", "awards")
    }
    return people.select(
        key.alias("candidate_id"),
        "r_regionkey",
        F.struct(
            F.when(key % 97 != 0, F.col("c_name")).alias("name"),
            F.when(key % 50 == 0, "n/a").otherwise(email).alias("email"),
            phone.alias("phone"),
            F.concat("n_name", F.lit(", "), "r_name").alias("location"),
            F.lit("").alias("linkedin"),
            F.lit("").alias("portfolio"),
        ).alias("personal_info"),
        F.lit("").alias("summary"),
        "skills",
        F.transform(
            "recent",
            lambda o: F.struct(
                o["o_orderpriority"].alias("title"),
                F.concat(F.lit("Company "), o["o_orderstatus"]).alias("company"),
                F.col("n_name").alias("location"),
                F.date_format(o["o_orderdate"], "MM/yyyy").alias("duration"),
                F.lit("").alias("description"),
            ),
        ).alias("experience"),
        F.array(
            F.struct(
                F.col("c_mktsegment").alias("degree"),
                F.col("r_name").alias("institution"),
                F.col("n_name").alias("location"),
                F.coalesce(F.col("first_year").cast("string"), F.lit("")).alias("year"),
                F.lit("").alias("gpa"),
            )
        ).alias("education"),
        *[c.alias(n) for n, c in empty.items()],
        F.concat(F.lit("cv_"), key, F.lit(".pdf")).alias("filename"),
        (F.col("c_acctbal") >= 0).alias("success"),
    )


def clean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_record(candidates(spark, sf_dir))


def job_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per region with the options of its form; weights of region 3 are wrong."""
    r = F.col("r_regionkey")
    brand = lambda n: F.concat(F.lit("Brand#"), r + n)
    return table(spark, sf_dir, "region").select(
        r.cast("bigint").alias("job_id"),
        F.concat(F.lit("\n Specialist for "), "r_name", F.lit(" \t")).alias("description"),
        F.concat(F.lit(" "), brand(1), F.lit(" , "), brand(2), F.lit(",")).alias("priority_keywords"),
        brand(6).alias("required_skills"),
        F.lit("5").alias("min_experience"),
        pick(r, "BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE").alias("edu_requirements"),
        pick(r, "40", None, "50", "40", "60").alias("weight_skills"),
        pick(r, "40", None, "30", "40", "20").alias("weight_experience"),
        pick(r, "20", None, "20", "30", "").alias("weight_education"),
        F.concat(brand(11), F.lit(" ,")).alias("deal_breakers"),
        F.concat(brand(16), F.lit(",  "), brand(17)).alias("nice_to_have"),
        F.lit("1-URGENT , company o,").alias("experience_areas"),
        F.when(r != 2, brand(21)).alias("technical_skills"),
        F.when(r == 4, "specified").alias("cf_requirements"),
        F.when(r != 1, "50").alias("min_fit_percent"),
        pick(r, "africa", "", None, "nation_3", " MIDDLE ").alias("location_preference"),
        F.when(r == 0, "50-60k").alias("salary_range"),
    )


def part_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per part."""
    size, name = F.col("p_size"), F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("job_id"),
        F.concat(F.lit(" "), "p_brand", F.lit(" ,, "), "p_type", F.lit(" ")).alias("priority_keywords"),
        F.concat(name[0], F.lit(" , "), name[1], F.lit(","), name[0]).alias("required_skills"),
        F.when(size % 4 > 0, (size % 4).cast("string")).alias("min_experience"),
        F.when(size % 3 > 0, F.col("p_type")).otherwise("").alias("edu_requirements"),
        size.cast("string").alias("weight_skills"),
        F.when(size % 5 > 0, (60 - size).cast("string")).alias("weight_experience"),
        F.lit("").alias("weight_education"),
        F.col("p_name").alias("deal_breakers"),
        F.concat(F.lit("Node.js,"), "p_brand").alias("nice_to_have"),
        F.lit(None).cast("string").alias("experience_areas"),
        F.lit(" , ").alias("technical_skills"),
        F.when(size % 2 == 0, F.concat(F.lit("c"), size)).alias("cf_requirements"),
        F.when(size % 7 == 0, "Berlin").alias("location_preference"),
        F.when(size % 9 == 0, F.concat(size, F.lit("k"))).alias("salary_range"),
    )


def valid_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requirements(validate_weights(job_options(spark, sf_dir)).filter("error is null")).drop(
        "error"
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the candidates and their regions."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    people = table(spark, sf_dir, "customer")
    return people.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("candidate_id"), "r_regionkey"
    )


def applications(people: DataFrame) -> DataFrame:
    """Candidates with the jobs they are sent to: of their own region and one by number."""
    own_and_other = F.array_distinct(
        F.array(F.col("r_regionkey").cast("bigint"), F.col("candidate_id") % 5)
    )
    return people.withColumn("job_id", F.explode(own_and_other)).drop("r_regionkey")


def fit_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = clean_candidates(spark, sf_dir).filter("success")
    described = describe(people.drop("r_regionkey"), F.lit(AS_OF_DAY), keep=("candidate_id",))
    sent = applications(customers(spark, sf_dir))
    return evaluate_fit(described, sent, valid_jobs(spark, sf_dir), "job_id", keep=("candidate_id",))


def stored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean records as a table, for operators that read their input more than once."""
    return written(clean_candidates(spark, sf_dir), "candidates")


def ranked_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over stored results: ranking reads its input twice, evaluation should run once."""
    stored = written(fit_results(spark, sf_dir), "fit")
    return rank_after_filter(stored, "job_id", "candidate_id", F.col("min_fit_percent"))


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind.isin("click", "view"), "p1").otherwise("p2").alias("provider"),
        kind.alias("model"),
        day_key(F.col("ts")).alias("day"),
    )


def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of the log with limits a little above their mean daily use.

    A disabled provider is listed as well.
    """
    order = {"click": 1, "view": 2, "signup": 1, "purchase": 2, "error": 3}
    known = F.col("model")
    position = F.lit(9)
    for model, n in order.items():
        position = F.when(known == model, n).otherwise(position)
    used = call_log(spark, sf_dir).groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("days")
    )
    enabled = used.select(
        "provider",
        F.when(F.col("provider") == "p1", 1).otherwise(2).alias("provider_ord"),
        "model",
        position.alias("model_ord"),
        F.floor(F.col("n") * 102 / (F.col("days") * 100)).alias("daily_limit"),
        F.lit(True).alias("enabled"),
    )
    spare = used.groupBy().agg(F.max("n").alias("daily_limit")).select(
        F.lit("p3").alias("provider"),
        F.lit(3).alias("provider_ord"),
        F.lit("spare").alias("model"),
        F.lit(1).alias("model_ord"),
        "daily_limit",
        F.lit(False).alias("enabled"),
    )
    return enabled.unionByName(spare)


def first_and_last_day(log: DataFrame) -> tuple[Column, Column]:
    return (
        log.agg(F.min("day").alias("d")).scalar(),
        log.agg(F.max("day").alias("d")).scalar(),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(table(spark, sf_dir, "events"))


def as_job_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("job_id"),
        F.when(F.col("user_id") % 2 == 0, "extraction").otherwise("candidate_fit").alias("type"),
        F.when(kind == "signup", "pending")
        .when(kind == "purchase", "completed")
        .when(kind == "error", "failed")
        .otherwise("processing")
        .alias("status"),
        F.when(kind == "signup", F.lit(0).cast("bigint"))
        .when(kind == "purchase", 100)
        .when(kind != "error", F.col("event_id") % 100)
        .alias("progress"),
    )
