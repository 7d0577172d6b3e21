"""Matching and ranking."""

from pyspark.sql import functions as F

from candidata.functions.text import search_text
from candidata.inference.prompts import fit_instructions, option_texts
from candidata.operators import matching, ranking
from candidata.operators.admission import validate_weights
from candidata.plans import fixtures
from conftest import SMALL


def test_every_requirement_is_listed_once(spark):
    fit = fixtures.fit_results(spark, SMALL)
    jobs = fixtures.valid_jobs(spark, SMALL).select(
        "job_id", F.transform("requirements", lambda r: r["kind"]).alias("kinds")
    )
    sizes = fit.join(jobs, "job_id").select(
        F.size("key_matches").alias("m"),
        F.size("key_gaps").alias("g"),
        F.size("kinds").alias("n"),
        F.size(F.filter("kinds", lambda k: k == "nice_to_have")).alias("extras"),
        F.size(F.filter("key_matches", lambda m: m.endswith(matching.EXTRA_MARK))).alias("got"),
        "fit_percentage",
    )
    rows = sizes.collect()
    assert rows
    assert all(r["m"] + r["g"] == r["n"] - r["extras"] + r["got"] for r in rows)
    assert all(0 <= r["fit_percentage"] <= 100 for r in rows)


def test_ranks_count_from_one(spark):
    ranked = fixtures.ranked_fit(spark, SMALL).select("job_id", "rank", "fit_percentage").collect()
    for job in {r["job_id"] for r in ranked}:
        mine = sorted((r["rank"], r["fit_percentage"]) for r in ranked if r["job_id"] == job)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        scores = [s for _, s in mine]
        assert scores == sorted(scores, reverse=True)


def test_rank_of_a_hot_job_with_odd_scores(spark):
    scores = ["90%", "90", "n/a", None, "90.5", "12", "90"] * 50
    data = [("hot" if i % 3 else "cold", i, s, None) for i, s in enumerate(scores)]
    fit = spark.createDataFrame(data, "job string, id bigint, fit_percentage string, candidate_name string")
    got = ranking.rank_after_filter(fit, "job", "id", F.lit("10")).collect()

    def number(s):
        return {"90%": 90, "90": 90, "90.5": 90.5, "12": 12}.get(s, 0)

    for job in ("hot", "cold"):
        expected = sorted((-number(s), i) for j, i, s, _ in data if j == job and number(s) >= 10)
        mine = {r["rank"]: r for r in got if r["job"] == job}
        assert [mine[n]["id"] for n in range(1, len(mine) + 1)] == [i for _, i in expected]
        assert all(r["candidate_name"] == f"Candidate {n}" for n, r in mine.items())


def test_requirements_are_trimmed_and_distinct(spark):
    jobs = spark.createDataFrame(
        [(1, " a, b ,a,", "", None, "x", "y")],
        "job_id int, required_skills string, deal_breakers string, nice_to_have string, "
        "certifications string, cf_requirements string",
    )
    rows = matching.requirement_rows(matching.requirements(jobs), "job_id").collect()
    assert [(r["kind"], r["term"]) for r in rows] == [
        ("required_skills", "a"),
        ("required_skills", "b"),
        ("certifications", "x"),
        ("certifications", "y"),
    ]


def test_a_job_without_requirements_gives_full_marks(spark):
    jobs = matching.requirements(
        validate_weights(
            spark.createDataFrame(
                [(1, "", None, None, None, None)],
                "job_id int, required_skills string, min_experience string, weight_skills string, "
                "weight_experience string, weight_education string",
            )
        )
    ).withColumn("min_fit_percent", F.lit(None).cast("string"))
    people = fixtures.clean_candidates(spark, SMALL).drop("r_regionkey")
    described = matching.describe(people, F.lit(fixtures.AS_OF_DAY), keep=("candidate_id",))
    sent = fixtures.applications(fixtures.customers(spark, SMALL)).filter("job_id = 1")
    fit = matching.evaluate_fit(described, sent, jobs, "job_id", keep=("candidate_id",))
    assert {r["fit_percentage"] for r in fit.collect()} == {100}


def test_options_may_be_lists(spark):
    jobs = spark.createDataFrame(
        [(1, [" Python ", "Go", "", "Node.js, Deno", "Go"], [" BSc", "MSc "], None)],
        "job_id int, required_skills array<string>, edu_requirements array<string>, nice_to_have array<string>",
    )
    rows = matching.requirement_rows(matching.requirements(jobs), "job_id").collect()
    assert [(r["kind"], r["term"]) for r in rows] == [
        ("required_skills", "Python"),
        ("required_skills", "Go"),
        ("required_skills", "Node.js, Deno"),
        ("edu_requirements", "BSc, MSc"),
    ]
    lines = jobs.select(fit_instructions(option_texts(jobs))).first()[0].splitlines()
    assert lines[1] == "- Skills that must be present: Python, Go, Node.js, Deno, Go"


def test_kinds_keep_their_order_with_many_terms(spark):
    many = ",".join(f"t{i}" for i in range(1500))
    jobs = spark.createDataFrame([(1, many, "x")], "job_id int, priority_keywords string, required_skills string")
    rows = matching.requirement_rows(matching.requirements(jobs), "job_id").orderBy("ord").collect()
    assert [r["term"] for r in rows] == [f"t{i}" for i in range(1500)] + ["x"]


def test_missing_years_do_not_meet_a_minimum(spark):
    pairs = spark.createDataFrame(
        [(" x ", None, [], [(0, "min_experience", "5", " 5 ")])],
        "search_text string, years double, education array<struct<degree:string>>, "
        "requirements " + matching.REQUIREMENT,
    )
    check = matching.check_requirements(pairs).first()["checks"][0]
    assert (check["found"], check["label"]) == (False, "Lacks minimum experience requirement (5 years)")


def test_pairs_hold_what_they_found(spark):
    """Jobs with many terms: counts, matches and gaps are those of all checks, and no pair lists every term."""
    terms = [f"word{n} of" for n in range(400)] + ["of", "word7", "word7"]
    jobs = matching.requirements(
        spark.createDataFrame(
            [(1, terms, "2", ["of", "rare thing"], "Law"), (2, ["nothing"], None, [], None), (3, [], None, None, None)],
            "job long, required_skills array<string>, min_experience string, nice_to_have array<string>, edu_requirements string",
        )
    )
    people = [(1, "word1 of word2 of word399 of", 3.0), (2, "", None), (3, "rare thing word7 nothing", 1.0)]
    described = spark.createDataFrame(people, "id long, text string, years double").select(
        "id", "years", search_text(F.col("text")).alias("search_text"), F.array().cast("array<struct<degree:string>>").alias("education")
    )
    sent = spark.createDataFrame([(i, j) for i in (1, 2, 3) for j in (1, 2, 3)], "id long, job long")
    found = matching.found_terms(described, sent, jobs, "job", ("id",)).drop("found")
    pairs = described.join(sent, "id").join(found, ["id", "job"], "left")
    pairs = matching.with_found(matching.pair_candidates(pairs, matching.without_terms(jobs, "job"), "job"))
    few = matching.count_gaps(matching.collect_matches(matching.check_requirements(pairs, found="found")))
    every = matching.collect_matches(matching.check_requirements(matching.pair_candidates(described.join(sent, "id"), jobs, "job")))
    got = {(r["id"], r["job"]): (r["key_matches"], r["n_gaps"]) for r in few.collect()}
    assert got == {(r["id"], r["job"]): (r["key_matches"], len(r["key_gaps"])) for r in every.collect()}
    assert max(len(r["checks"]) for r in few.collect()) < 10
