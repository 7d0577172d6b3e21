"""Admission of fit requests, evaluation, ranking and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.functions.measures import experience_years
from candidata.operators import admission, matching, ranking
from candidata.operators.positions import position
from candidata.plans.fixture_sql import (
    APPLICATIONS,
    CAND_WITH,
    CANDIDATES,
    FIT_WITH,
    JOBS,
    RECORD_WORDS,
    SPACE,
    with_,
)
from candidata.plans.fixtures import (
    AS_OF_DAY,
    applications,
    clean_candidates,
    customers,
    fit_results,
    part_options,
    ranked_fit,
    table,
    valid_jobs,
)
from candidata.plans.registry import query
from candidata.sinks import exports


@query(
    "normalize_job_text",
    f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Job description is required' END AS error,
          CASE WHEN doc_id % 11 <> 0 THEN regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') END AS description
        FROM documents""",
)
def _(spark, d):
    given = F.when(F.col("doc_id") % 11 == 0, " \n").otherwise(F.concat(F.lit("\t "), "text", F.lit(" \n")))
    jobs = table(spark, d, "documents").select("doc_id", given.alias("description"))
    return admission.normalize_job_text(jobs)


@query(
    "validate_weights",
    """SELECT p_partkey, CASE k WHEN 1 THEN 40 WHEN 4 THEN NULL ELSE p_size END AS weight_skills,
         CASE k WHEN 1 THEN 40 ELSE 60 - p_size END AS weight_experience,
         CASE k WHEN 1 THEN 20 WHEN 2 THEN 39 ELSE 40 END AS weight_education,
         CASE k WHEN 2 THEN 'Total weight should be 100, currently it''s 99. Please adjust the weights.'
           WHEN 4 THEN 'Total weight should be 100, currently it''s NaN. Please adjust the weights.' END AS error
       FROM (SELECT *, p_partkey % 5 AS k FROM part)""",
)
def _(spark, d):
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    given = table(spark, d, "part").select(
        "p_partkey",
        F.when(k == 4, "many").when(k != 1, size.cast("string")).alias("weight_skills"),
        F.when(k != 1, (60 - size).cast("string")).otherwise("").alias("weight_experience"),
        F.when(k == 1, None).when(k == 2, " 39").otherwise("40.9 percent").alias("weight_education"),
    )
    return admission.validate_weights(given)


@query(
    "requirements",
    """SELECT p_partkey AS job_id, ord, kind, term FROM (
      SELECT p_partkey, 0 AS ord, 'priority_keywords' AS kind, p_brand AS term FROM part
      UNION ALL SELECT p_partkey, 1, 'priority_keywords', p_type FROM part
      UNION ALL SELECT p_partkey, 1 * 2147483648 + 0, 'required_skills', split_part(p_name, ' ', 1) FROM part
      UNION ALL SELECT p_partkey, 1 * 2147483648 + 1, 'required_skills', split_part(p_name, ' ', 2) FROM part
      UNION ALL SELECT p_partkey, 2 * 2147483648 + 0, 'min_experience', (p_size % 4)::VARCHAR FROM part WHERE p_size % 4 > 0
      UNION ALL SELECT p_partkey, 3 * 2147483648 + 0, 'edu_requirements', p_type FROM part WHERE p_size % 3 > 0
      UNION ALL SELECT p_partkey, 4 * 2147483648 + 0, 'deal_breakers', p_name FROM part
      UNION ALL SELECT p_partkey, 5 * 2147483648 + 0, 'nice_to_have', 'Node.js' FROM part
      UNION ALL SELECT p_partkey, 5 * 2147483648 + 1, 'nice_to_have', p_brand FROM part
      UNION ALL SELECT p_partkey, 8 * 2147483648 + 0, 'certifications', 'c' || p_size FROM part WHERE p_size % 2 = 0)""",
)
def _(spark, d):
    return matching.requirement_rows(matching.requirements(part_options(spark, d)), "job_id")


@query(
    "pair_candidates",
    with_(CANDIDATES, JOBS, APPLICATIONS)
    + """SELECT job_id, candidate_id, name, ws + we + wd AS total_weight, min_fit_percent
    FROM sent JOIN cand USING (candidate_id) JOIN jobs USING (job_id)""",
)
def _(spark, d):
    paired = matching.pair_candidates(
        applications(clean_candidates(spark, d)), valid_jobs(spark, d), "job_id"
    )
    total = F.col("weight_skills") + F.col("weight_experience") + F.col("weight_education")
    return paired.select(
        "job_id",
        "candidate_id",
        F.col("personal_info.name").alias("name"),
        total.alias("total_weight"),
        "min_fit_percent",
    )


@query(
    "record_text",
    with_(CANDIDATES, RECORD_WORDS) + "SELECT candidate_id, txt AS search_text FROM phrases",
)
def _(spark, d):
    people = clean_candidates(spark, d)
    text = matching.record_text(people, exclude=("candidate_id", "r_regionkey"))
    return people.select("candidate_id", text.alias("search_text"))


@query(
    "experience_years",
    CAND_WITH + "SELECT candidate_id, round(years, 6) AS years FROM cand",
)
def _(spark, d):
    years = experience_years(F.col("experience"), F.lit(AS_OF_DAY))
    return clean_candidates(spark, d).select("candidate_id", F.round(years, 6).alias("years"))


def _checked(spark, d):
    people = clean_candidates(spark, d).filter("success").drop("r_regionkey")
    described = matching.describe(people, F.lit(AS_OF_DAY), keep=("candidate_id",))
    sent = described.join(applications(customers(spark, d)), "candidate_id")
    return matching.check_requirements(
        matching.pair_candidates(sent, valid_jobs(spark, d), "job_id")
    )


def _check_rows(spark, d):
    return matching.match_requirements(_checked(spark, d), "job_id", "candidate_id")


@query(
    "match_requirements",
    FIT_WITH + "SELECT job_id, candidate_id, ord, kind, found, label FROM checks",
)
def _(spark, d):
    return _check_rows(spark, d)


@query(
    "match_many_requirements",
    with_(CANDIDATES, RECORD_WORDS)
    + """, places AS (SELECT o_orderstatus AS s, n_name AS n, strftime(o_orderdate, '%m/%Y') AS m, n_regionkey AS r
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    terms AS (SELECT DISTINCT r AS job_id, 'Company ' || s || ' ' || n || ' ' || m AS term FROM places
      UNION SELECT DISTINCT r, n || ' ' || m FROM places
      UNION SELECT n_regionkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    pairs AS (SELECT candidate_id, r_regionkey AS job_id, txt FROM cand JOIN phrases USING (candidate_id) WHERE success),
    hits AS (SELECT job_id, candidate_id, term, contains(txt, ' ' || lower(term) || ' ') AS found
      FROM pairs JOIN terms USING (job_id))
    SELECT job_id, candidate_id, count(*) FILTER (found) AS n_matches, count(*) FILTER (NOT found) AS n_gaps,
      coalesce(string_agg(term, '|' ORDER BY term) FILTER (found), '') AS key_matches FROM hits GROUP BY ALL""",
)
def _(spark, d):
    """Jobs with a term for every month, state and nation of an order, and for every customer, of their region."""
    places = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    places = places.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    where = F.concat_ws(" ", "n_name", F.date_format("o_orderdate", "MM/yyyy"))
    company = F.concat(F.lit("Company "), "o_orderstatus", F.lit(" "), where)
    terms = places.select(F.col("n_regionkey").cast("bigint").alias("job_id"), F.explode(F.array(company, where)).alias("term"))
    people = customers(spark, d).select(F.col("r_regionkey").cast("bigint").alias("job_id"), "candidate_id")
    names = table(spark, d, "customer").join(people, F.col("c_custkey") == F.col("candidate_id"))
    terms = terms.union(names.select("job_id", "c_name")).groupBy("job_id").agg(F.array_sort(F.collect_set("term")).alias("required_skills"))
    jobs = written(matching.requirements(terms), "jobs")
    able = clean_candidates(spark, d).filter("success").drop("r_regionkey")
    described = written(matching.describe(able, F.lit(AS_OF_DAY), keep=("candidate_id",)), "described")
    found = matching.found_terms(described, people, jobs, "job_id", ("candidate_id",))
    found = found.drop("found")
    pairs = described.join(people, "candidate_id").join(found, ["candidate_id", "job_id"], "left")
    # A pair holds what it found: a job has a term for every customer, and a list for each pair is their square.
    pairs = matching.with_found(matching.pair_candidates(pairs, matching.without_terms(jobs, "job_id"), "job_id"))
    listed = matching.count_gaps(matching.collect_matches(matching.check_requirements(pairs, found="found")))
    return listed.select(
        "job_id", "candidate_id", F.size("key_matches").cast("bigint").alias("n_matches"),
        "n_gaps", F.array_join("key_matches", "|").alias("key_matches"),
    )


@query(
    "min_experience_check",
    FIT_WITH
    + "SELECT job_id, candidate_id, found, label FROM checks WHERE kind = 'min_experience'",
)
def _(spark, d):
    rows = _check_rows(spark, d).filter("kind = 'min_experience'")
    return rows.select("job_id", "candidate_id", "found", "label")


@query(
    "education_check",
    FIT_WITH
    + "SELECT job_id, candidate_id, found, label FROM checks WHERE kind = 'edu_requirements'",
)
def _(spark, d):
    rows = _check_rows(spark, d).filter("kind = 'edu_requirements'")
    return rows.select("job_id", "candidate_id", "found", "label")


@query(
    "deal_breakers",
    FIT_WITH + "SELECT job_id, candidate_id, penalty FROM scored",
)
def _(spark, d):
    return matching.score_parts(_checked(spark, d)).select("job_id", "candidate_id", "penalty")


@query(
    "nice_to_have",
    FIT_WITH
    + """SELECT job_id, candidate_id, boost,
      coalesce(list_aggregate(list_filter(matches, lambda m: m LIKE '%(nice-to-have)'), 'string_agg', '|'), '') AS extras
    FROM scored""",
)
def _(spark, d):
    parts = matching.score_parts(matching.collect_matches(_checked(spark, d)))
    extras = F.filter("key_matches", lambda m: m.endswith(matching.EXTRA_MARK))
    return parts.select(
        "job_id", "candidate_id", "boost", F.array_join(extras, "|").alias("extras")
    )


@query(
    "collect_matches",
    FIT_WITH
    + """SELECT job_id, candidate_id, array_to_string(matches, '|') AS key_matches,
      array_to_string(gaps, '|') AS key_gaps FROM scored""",
)
def _(spark, d):
    return matching.collect_matches(_checked(spark, d)).select(
        "job_id",
        "candidate_id",
        F.array_join("key_matches", "|").alias("key_matches"),
        F.array_join("key_gaps", "|").alias("key_gaps"),
    )


@query(
    "fit_percentage",
    FIT_WITH
    + """SELECT job_id, candidate_id, round(skill_share, 6) AS skill_share,
      round(experience_share, 6) AS experience_share, education_share, fit_percentage FROM fit""",
)
def _(spark, d):
    scored = matching.fit_percentage(matching.score_parts(_checked(spark, d)))
    return scored.select(
        "job_id",
        "candidate_id",
        F.round("skill_share", 6).alias("skill_share"),
        F.round("experience_share", 6).alias("experience_share"),
        "education_share",
        "fit_percentage",
    )


@query(
    "fit_summary",
    FIT_WITH + "SELECT job_id, candidate_id, summary FROM fit",
)
def _(spark, d):
    return fit_results(spark, d).select("job_id", "candidate_id", "summary")


@query(
    "attach_candidate_name",
    CAND_WITH + "SELECT candidate_id, coalesce(name, 'Unknown') AS candidate_name FROM cand",
)
def _(spark, d):
    named = matching.attach_candidate_name(clean_candidates(spark, d))
    return named.select("candidate_id", "candidate_name")


@query(
    "location_preference",
    with_(CANDIDATES, JOBS, APPLICATIONS)
    + """SELECT job_id, candidate_id,
      contains(lower(location), nullif(lower(trim(location_preference)), '')) AS location_match, salary_range
    FROM sent JOIN cand USING (candidate_id) JOIN options USING (job_id) WHERE r <> 3""",
)
def _(spark, d):
    paired = matching.pair_candidates(
        applications(clean_candidates(spark, d)), valid_jobs(spark, d), "job_id"
    )
    return matching.location_preference(paired).select(
        "job_id", "candidate_id", "location_match", "salary_range"
    )


@query(
    "rank_candidates",
    FIT_WITH
    + """SELECT job_id, candidate_id, fit_percentage, row_number() OVER (PARTITION BY job_id
      ORDER BY fit_percentage DESC, candidate_id) AS place FROM fit""",
)
def _(spark, d):
    """The sorted results with the place in which they come."""
    # A sort samples its input before it reads it.
    fit = written(fit_results(spark, d), "fit").select("job_id", "candidate_id", "fit_percentage")
    ranked = ranking.rank_candidates(fit, "job_id", "candidate_id").withColumn(
        "_at", F.monotonically_increasing_id()
    )
    return position(written(ranked, "ranked"), ["job_id"], [F.col("_at")], "place").drop("_at")


@query(
    "rank_after_filter",
    FIT_WITH
    + """SELECT job_id, candidate_id, rank, fit_percentage,
      CASE WHEN candidate_name = 'Unknown' THEN 'Candidate ' || rank ELSE candidate_name END AS candidate_name
    FROM ranked""",
)
def _(spark, d):
    unnamed = fit_results(spark, d).withColumn(
        "candidate_name", F.nullif("candidate_name", F.lit("Unknown"))
    )
    unnamed = written(unnamed, "fit")
    ranked = ranking.rank_after_filter(
        unnamed, "job_id", "candidate_id", F.col("min_fit_percent")
    )
    return ranked.select("job_id", "candidate_id", "rank", "fit_percentage", "candidate_name")


@query(
    "top_candidates",
    FIT_WITH
    + """SELECT job_id, candidate_id, candidate_name, fit_percentage,
      row_number() OVER (PARTITION BY job_id ORDER BY fit_percentage DESC, candidate_id)::INT AS rank
    FROM fit QUALIFY rank <= 10""",
)
def _(spark, d):
    best = ranking.top_candidates(fit_results(spark, d), "job_id", "candidate_id", 10)
    return best.select("job_id", "candidate_id", "candidate_name", "fit_percentage", "rank")


@query(
    "compare_two",
    FIT_WITH
    + """SELECT a.job_id, a.candidate_name AS candidate_name_a, b.candidate_name AS candidate_name_b,
      a.fit_percentage AS fit_percentage_a, b.fit_percentage AS fit_percentage_b,
      a.summary AS summary_a, b.summary AS summary_b, a.matches_text AS key_matches_a,
      b.matches_text AS key_matches_b, a.gaps_text AS key_gaps_a, b.gaps_text AS key_gaps_b
    FROM ranked a JOIN ranked b ON a.job_id = b.job_id WHERE a.rank = 1 AND b.rank = 2""",
)
def _(spark, d):
    compared = ranking.compare_two(ranked_fit(spark, d), "job_id", "rank", 1, 2)
    lists = [c for c in compared.columns if c.startswith("key_")]
    return compared.withColumns({c: F.array_join(c, ", ") for c in lists})


@query(
    "compare_top",
    FIT_WITH
    + """, best AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY fit_percentage DESC, candidate_id)::INT AS rank
      FROM fit QUALIFY rank <= 4)
    SELECT a.job_id, a.rank AS rank_a, b.rank AS rank_b, a.candidate_name AS candidate_name_a, b.candidate_name AS candidate_name_b,
      a.fit_percentage AS fit_percentage_a, b.fit_percentage AS fit_percentage_b,
      a.summary AS summary_a, b.summary AS summary_b, a.matches_text AS key_matches_a,
      b.matches_text AS key_matches_b, a.gaps_text AS key_gaps_a, b.gaps_text AS key_gaps_b,
      (a.fit_percentage - b.fit_percentage)::DOUBLE AS lead
    FROM best a JOIN best b ON a.job_id = b.job_id AND a.rank < b.rank""",
)
def _(spark, d):
    compared = ranking.compare_top(fit_results(spark, d), "job_id", "candidate_id", 4)
    lists = [c for c in compared.columns if c.startswith("key_")]
    return compared.withColumns({c: F.array_join(c, ", ") for c in lists}).withColumn("lead", F.col("lead").cast("double"))


@query(
    "fit_band",
    FIT_WITH
    + """SELECT job_id, CASE WHEN fit_percentage <= 25 THEN 0 WHEN fit_percentage <= 50 THEN 25
      WHEN fit_percentage <= 75 THEN 50 ELSE 75 END AS band, count(*) AS n FROM fit GROUP BY ALL""",
)
def _(spark, d):
    return ranking.fit_histogram(fit_results(spark, d), "job_id")


FIT_SHEET = """SELECT job_id, rank AS "Rank", candidate_name AS "Candidate Name",
  fit_percentage::VARCHAR AS "Fit Percentage", summary AS "Summary", matches_text AS "Key Matches",
  gaps_text AS "Key Gaps" FROM ranked"""


@query("fit_sheet", FIT_WITH + FIT_SHEET)
def _(spark, d):
    return exports.fit_sheet(ranked_fit(spark, d), "job_id")


@query(
    "check_batch_caps",
    """SELECT c_custkey % 1000 AS request, count(o_orderkey) AS n_items,
         CASE WHEN count(o_orderkey) = 0 THEN 'No files uploaded'
           WHEN count(o_orderkey) > 20 THEN 'Too many files. Maximum 20 files per request.' END AS error
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
       UNION ALL SELECT -1 - c_custkey % 7, 0, 'No files uploaded' FROM customer GROUP BY c_custkey % 7""",
)
def _(spark, d):
    request = lambda c: (F.col(c) % 1000).alias("request")
    items = table(spark, d, "orders").select(request("o_custkey"))
    requests = table(spark, d, "customer").select(request("c_custkey"))
    # Requests that no item belongs to.
    empty = table(spark, d, "customer").select((-1 - F.col("c_custkey") % 7).alias("request"))
    return admission.check_batch_caps(requests.unionByName(empty), items, "request", cap=20)
