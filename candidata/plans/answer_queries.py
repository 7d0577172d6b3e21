"""Prompts, model answers and their way to validated records."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from candidata.functions import measures
from candidata.functions.text import display_terms, normalize_terms
from candidata.inference import prompts
from candidata.inference.client import OfflineClient, OfflineFitClient, infer
from candidata.operators import records
from candidata.operators.evaluation import evaluate_with_model
from candidata.operators.extraction import attempts_of
from candidata.operators.matching import requirements
from candidata.operators.ranking import drop_empty_results, min_fit_filter
from candidata.plans.fixture_sql import (
    APPLICATIONS,
    CAND_WITH,
    CANDIDATES,
    CLEANED,
    DOCS,
    JOBS,
    RESPONSES,
    quoted,
    with_,
)
from candidata.plans.fixtures import (
    CHAT_PROVIDERS,
    applications,
    candidates,
    clean_candidates,
    customers,
    docs,
    part_options,
    responses,
    table,
    valid_jobs,
)
from candidata.plans.registry import query
from candidata.schemas import FIT_ANSWER, FIT_REQUIRED

ANSWERS = with_(RESPONSES, CLEANED)


@query(
    "extraction_prompt",
    f"SELECT doc_id, {quoted(prompts.EXTRACTION_PROMPT)} || text AS prompt FROM documents",
)
def _(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", prompts.extraction_prompt(F.col("text")).alias("prompt")
    )


@query(
    "fit_instructions",
    """SELECT p_partkey AS job_id, 'EVALUATION GUIDELINES:' || chr(10) || list_aggregate(list_transform(list_filter([
      'Priority keywords: ' || pk,
      'Check every priority keyword [' || pk || ']: present goes to ''key_matches'', absent to ''key_gaps''.',
      'Skills that must be present: ' || rs,
      'Check every required skill [' || rs || ']: present goes to ''key_matches'', absent to ''key_gaps''.',
      'Required experience: ' || years || ' years or more. This counts strongly.',
      'With ' || years || ' years or more add ''Meets minimum experience requirement (' || years
        || '+ years)'' to ''key_matches'', otherwise ''Lacks minimum experience requirement (' || years || ' years)'' to ''key_gaps''.',
      'Required education: ' || edu,
      'Check the education requirement ''' || edu || ''': met goes to ''key_matches'', not met to ''key_gaps''.',
      'Weights for the percentage: Skills: ' || p_size || '%' || CASE WHEN p_size % 5 > 0 THEN ', Experience: ' || (60 - p_size) || '%' ELSE '' END,
      'Deal breakers, each strongly lowering the percentage if absent: ' || p_name,
      'Check every deal breaker [' || p_name || ']: present goes to ''key_matches'', absent to ''key_gaps''.',
      'Welcome extras that raise the percentage: Node.js, ' || p_brand,
      'Check every extra [Node.js, ' || p_brand || ']: present goes to ''key_matches'' marked ''(nice-to-have)''.',
      CASE WHEN p_size % 2 = 0 THEN 'Required or preferred certifications: c' || p_size END,
      CASE WHEN p_size % 2 = 0 THEN 'Check every certification [c' || p_size || ']: present goes to ''key_matches'', absent to ''key_gaps''.' END,
      CASE WHEN p_size % 7 = 0 THEN 'Preferred location: Berlin' END,
      CASE WHEN p_size % 9 = 0 THEN 'Pay offered: ' || p_size || 'k' END,
      'List every requirement once, in ''key_matches'' or in ''key_gaps''. Leave none out.'
    ], lambda x: x IS NOT NULL), lambda x: '- ' || x), 'string_agg', chr(10)) || chr(10) AS instructions
    FROM (SELECT *, p_brand || ', ' || p_type AS pk,
            split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) AS rs,
            nullif(p_size % 4, 0) AS years, CASE WHEN p_size % 3 > 0 THEN p_type END AS edu FROM part)
    UNION ALL SELECT -p_partkey - 1, '' FROM part""",
)
def _(spark, d):
    shown = {
        name: display_terms(normalize_terms(F.col(name)))
        for name in (
            "priority_keywords",
            "required_skills",
            "deal_breakers",
            "nice_to_have",
            "experience_areas",
            "technical_skills",
        )
    }
    plain = (
        "min_experience",
        "edu_requirements",
        "weight_skills",
        "weight_experience",
        "weight_education",
        "location_preference",
        "salary_range",
    )
    options = {**shown, **{n: F.col(n) for n in plain}, "certifications": F.col("cf_requirements")}
    instructions = part_options(spark, d).select(
        "job_id", prompts.fit_instructions(options).alias("instructions")
    )
    without = table(spark, d, "part").select(
        (-F.col("p_partkey") - 1).alias("job_id"),
        prompts.fit_instructions({"salary_range": F.lit("")}).alias("instructions"),
    )
    return instructions.unionByName(without)


@query(
    "fit_prompt",
    with_(CANDIDATES, JOBS, APPLICATIONS)
    + f"""SELECT job_id, candidate_id, {quoted(prompts.FIT_INTRODUCTION)} || chr(10) || 'EVALUATION GUIDELINES:' || chr(10)
      || '- Skills that must be present: Brand#' || (r + 6) || chr(10) || '- Check every required skill [Brand#' || (r + 6)
      || ']: present goes to ''key_matches'', absent to ''key_gaps''.' || chr(10)
      || '- List every requirement once, in ''key_matches'' or in ''key_gaps''. Leave none out.' || chr(10) || chr(10)
      || 'Job description:' || chr(10) || description || chr(10) AS task,
      email, skills[1] AS skill, experience[1].duration AS period, edu_year
    FROM sent JOIN cand USING (candidate_id) JOIN options USING (job_id) WHERE r <> 3""",
)
def _(spark, d):
    """The prompt, taken apart again: its text, and fields of the record it ends with."""
    jobs = valid_jobs(spark, d).select(
        "job_id",
        "description",
        prompts.fit_instructions({"required_skills": F.col("required_skills")}).alias("instructions"),
    )
    sent = applications(clean_candidates(spark, d)).join(jobs, "job_id")
    record = F.struct("personal_info", "skills", "experience", "education")
    prompt = prompts.fit_prompt(F.col("instructions"), F.col("description"), record)
    parts = sent.select("job_id", "candidate_id", F.split(prompt, "\nCandidate:\n", 2).alias("parts"))
    part = lambda path: F.get_json_object(F.col("parts")[1], path)
    return parts.select(
        "job_id",
        "candidate_id",
        F.col("parts")[0].alias("task"),
        part("$.personal_info.email").alias("email"),
        part("$.skills[0]").alias("skill"),
        part("$.experience[0].duration").alias("period"),
        part("$.education[0].year").alias("edu_year"),
    )


@query(
    "infer",
    """SELECT doc_id, length(text) % 4 <> 1 AS answered,
         CASE WHEN length(text) % 4 IN (0, 3) THEN 'm1 read ' || length(text) || ' characters' END AS summary,
         CASE WHEN length(text) % 4 = 2 THEN 'No record for ' || length(text) || ' characters' END AS prose,
         CASE WHEN length(text) % 4 = 1 THEN 'ConnectionError: no connection' END AS call_error
       FROM documents""",
)
def _(spark, d):
    requests = table(spark, d, "documents").select(
        "doc_id",
        prompts.extraction_prompt(F.col("text")).alias("prompt"),
        F.when(F.col("doc_id") % 2 == 0, "p1").otherwise("p2").alias("provider"),
        F.lit("m1").alias("model"),
    )
    answered = infer(requests, functools.partial(OfflineClient, frozenset(CHAT_PROVIDERS)))
    raw = records.unwrap_response(F.col("body"), F.col("provider"), CHAT_PROVIDERS)
    rows = answered.withColumn("raw", raw).withColumn("json", records.clean_json(F.col("raw")))
    return rows.select(
        "doc_id",
        F.col("body").isNotNull().alias("answered"),
        F.get_json_object("json", "$.summary").alias("summary"),
        F.when(F.col("raw").startswith("No record"), F.col("raw")).alias("prose"),
        "call_error",
    )


@query(
    "parse_candidate",
    """SELECT doc_id, 'Ann ' || lang AS name, CASE WHEN k = 0 THEN NULL ELSE 'a' || doc_id || '@x.org' END AS email,
      CASE k WHEN 1 THEN 'sql' ELSE 'go|sql' END AS skills,
      CASE k WHEN 0 THEN 'Clerk//' ELSE 'Clerk//|Lead/' || source || '/' END AS worked,
      CASE k WHEN 2 THEN 'P:Spark' ELSE 'P:Spark+SQL|Q:' END AS projects,
      CASE k WHEN 1 THEN 'de:' ELSE 'de:C1' END AS languages, true AS success
    FROM (SELECT *, doc_id % 3 AS k FROM documents)""",
)
def _(spark, d):
    """Whole records in loose shapes: texts for objects, values for lists, fields left out."""
    k = F.col("doc_id") % 3
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    lang, source, i = F.col("lang"), F.col("source"), F.col("doc_id").cast("string")
    info = F.when(k == 0, q('"Ann ', lang, '"')).otherwise(q('{"name": "Ann ', lang, '", "email": "a', i, '@x.org"}'))
    skills = F.when(k == 1, '"sql"').otherwise('["go", "sql"]')
    worked = F.when(k == 0, '"Clerk"').otherwise(q('["Clerk", {"title": "Lead", "company": "', source, '"}]'))
    projects = F.when(k == 2, '{"name": "P", "technologies": "Spark"}').otherwise(
        '[{"name": "P", "technologies": ["Spark", "SQL"]}, "Q"]'
    )
    languages = F.when(k == 1, '["de"]').otherwise('[{"language": "de", "proficiency": "C1"}]')
    json = q(
        '{"personal_info": ', info, ', "skills": ', skills, ', "experience": ', worked, ', "projects": ', projects,
        ', "languages": ', languages, "}",
    )
    parsed = records.parse_record(table(spark, d, "documents").withColumn("json", json), "json", "json")
    joined = lambda c, show: F.array_join(F.transform(c, show), "|")
    return parsed.select(
        "doc_id",
        F.col("record.personal_info.name").alias("name"),
        F.nullif(F.col("record.personal_info.email"), F.lit("")).alias("email"),
        F.array_join("record.skills", "|").alias("skills"),
        joined("record.experience", lambda e: F.concat_ws("/", e["title"], e["company"], e["location"])).alias("worked"),
        joined(
            "record.projects", lambda p: F.concat(p["name"], F.lit(":"), F.array_join(p["technologies"], "+"))
        ).alias("projects"),
        joined("record.languages", lambda x: F.concat(x["language"], F.lit(":"), x["proficiency"])).alias("languages"),
        "success",
    )


def _listed_options(spark, d):
    """The options of `part_options` as lists; terms may hold blanks."""
    options = part_options(spark, d)
    names = ("priority_keywords", "required_skills", "edu_requirements", "deal_breakers", "nice_to_have", "technical_skills", "cf_requirements")
    return options.withColumns({n: F.split(n, ",") for n in names})


@query(
    "listed_options",
    "SELECT p_partkey AS job_id, true AS same_requirements, true AS same_instructions FROM part",
)
def _(spark, d):
    """Options as lists give what their comma-separated twins give."""
    texts, lists = part_options(spark, d), _listed_options(spark, d)
    found = []
    # What is made of a row is far larger than the row, so the rows are dealt by the key of the join before.
    for options, name in ((texts, "texts"), (lists, "lists")):
        options = options.repartition("job_id")
        shown = prompts.option_texts(options.drop("job_id"))
        if name == "texts":
            terms = ("priority_keywords", "required_skills", "deal_breakers", "nice_to_have", "technical_skills")
            shown |= {n: display_terms(normalize_terms(F.col(n))) for n in terms}
        found.append(
            requirements(options).select(
                F.col("job_id"), F.struct("requirements", prompts.fit_instructions(shown).alias("text")).alias(name)
            )
        )
    # By their files both sides look small enough for a broadcast.
    both = found[0].join(found[1].hint("merge"), "job_id")
    return both.select(
        "job_id",
        F.col("texts.requirements").eqNullSafe(F.col("lists.requirements")).alias("same_requirements"),
        F.col("texts.text").eqNullSafe(F.col("lists.text")).alias("same_instructions"),
    )


@query(
    "evaluate_with_model",
    with_(CANDIDATES, JOBS, APPLICATIONS)
    + """SELECT job_id, candidate_id, coalesce(name, 'Unknown') AS candidate_name, n % 4 <> 2 AS success,
      CASE n % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 END::INT AS attempt,
      CASE WHEN n % 4 <> 2 THEN 'm' || CASE n % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END || ' judged ' || n END AS summary,
      CASE WHEN n % 4 <> 2 THEN (n % 101) || '%' END AS fit_percentage,
      CASE WHEN n % 4 <> 2 THEN 'reading|number ' || n % 9 END AS key_matches,
      CASE WHEN n % 4 = 2 THEN 'Failed to parse AI response as JSON' END AS error,
      CASE WHEN n % 4 = 2 THEN '{"summary": "m3 judged ' || n || '", ' END AS raw
    FROM (SELECT *, candidate_id % 10000 AS n FROM sent JOIN cand USING (candidate_id) JOIN jobs USING (job_id))""",
)
def _(spark, d):
    people = clean_candidates(spark, d).drop("r_regionkey")
    sent = people.join(applications(customers(spark, d)), "candidate_id")
    jobs = valid_jobs(spark, d).withColumn("description", F.struct("description", "salary_range"))
    judged = evaluate_with_model(
        sent,
        jobs.drop("requirements"),
        "job_id",
        functools.partial(OfflineFitClient, frozenset(CHAT_PROVIDERS)),
        attempts_of(("p1", "m1"), ("p2", "m2"), ("p1", "m3")),
        CHAT_PROVIDERS,
        keep=["candidate_id"],
    )
    return judged.select(
        "job_id", "candidate_id", "candidate_name", "success", "attempt", "summary", "fit_percentage",
        F.array_join("key_matches", "|").alias("key_matches"), "error",
        F.substring_index("raw_response", '"fit_percentage"', 1).alias("raw"),
    )


def _unwrapped(spark, d):
    answer = records.unwrap_response(F.col("body"), F.col("provider"), CHAT_PROVIDERS)
    return responses(spark, d).select("doc_id", "attempt", "provider", answer.alias("raw"))


def _cleaned(spark, d):
    return _unwrapped(spark, d).withColumn("json", records.clean_json(F.col("raw")))


@query("unwrap_response", with_(RESPONSES) + "SELECT doc_id, attempt, answer AS raw FROM resp")
def _(spark, d):
    return _unwrapped(spark, d).select("doc_id", "attempt", "raw")


@query("clean_json", ANSWERS + "SELECT doc_id, attempt, js AS json FROM cleaned")
def _(spark, d):
    return _cleaned(spark, d).select("doc_id", "attempt", "json")


@query(
    "clean_json_trimmed",
    ANSWERS + "SELECT doc_id, attempt, trim(js, ' ' || chr(10)) AS json FROM cleaned",
)
def _(spark, d):
    return _unwrapped(spark, d).select(
        "doc_id", "attempt", records.clean_json(F.col("raw"), trim=True).alias("json")
    )


@query(
    "parse_record",
    ANSWERS
    + """SELECT doc_id, attempt, ok AS success, CASE WHEN ok THEN js->>'summary' END AS summary,
      CASE WHEN ok THEN js->>'fit_percentage' END AS fit_percentage,
      CASE WHEN ok THEN array_to_string((js->'key_matches')::VARCHAR[], '|') END AS key_matches,
      CASE WHEN ok THEN array_to_string((js->'key_gaps')::VARCHAR[], '|') END AS key_gaps,
      CASE WHEN NOT ok THEN 'Failed to parse AI response as JSON' END AS error,
      CASE WHEN NOT ok THEN left(answer, 500) END AS raw_response
    FROM cleaned""",
)
def _(spark, d):
    parsed = records.parse_record(_cleaned(spark, d), "json", "raw", FIT_ANSWER)
    return parsed.select(
        "doc_id",
        "attempt",
        "success",
        F.col("record.summary").alias("summary"),
        F.col("record.fit_percentage").alias("fit_percentage"),
        F.array_join("record.key_matches", "|").alias("key_matches"),
        F.array_join("record.key_gaps", "|").alias("key_gaps"),
        "error",
        "raw_response",
    )


@query(
    "validate_required",
    ANSWERS
    + """SELECT doc_id, attempt, ok AND list_has_all(CASE WHEN ok THEN json_keys(js) ELSE [] END,
      ['summary', 'fit_percentage', 'key_matches', 'key_gaps']) AS complete FROM cleaned""",
)
def _(spark, d):
    complete = records.has_required(F.col("json"), FIT_REQUIRED)
    return _cleaned(spark, d).select("doc_id", "attempt", complete.alias("complete"))


def _resolved(spark, d):
    checked = _cleaned(spark, d).withColumn(
        "valid", records.has_required(F.col("json"), FIT_REQUIRED)
    )
    return records.resolve_attempts(checked, "doc_id", "attempt", "valid", "raw", ["json", "provider"])


@query(
    "resolve_attempts",
    ANSWERS
    + """, good AS (
      SELECT doc_id, arg_min(js, attempt) AS json, min(attempt) AS attempt, any_value(provider) AS provider
      FROM cleaned WHERE ok AND contains(js, '"key_gaps":') GROUP BY doc_id)
    SELECT doc_id, g.doc_id IS NOT NULL AS success, g.attempt, g.json, g.provider,
      CASE WHEN g.doc_id IS NULL THEN CASE WHEN answer IS NULL
        THEN 'Failed to extract resume data after multiple attempts.' ELSE 'Failed to parse AI response as JSON' END END AS error,
      CASE WHEN g.doc_id IS NULL THEN left(answer, 500) END AS raw_response
    FROM cleaned c LEFT JOIN good g USING (doc_id) WHERE c.attempt = 3""",
)
def _(spark, d):
    return _resolved(spark, d)


@query(
    "drop_empty_results",
    ANSWERS
    + """SELECT doc_id, min(attempt) AS attempt FROM cleaned WHERE ok AND contains(js, '"key_gaps":') GROUP BY doc_id""",
)
def _(spark, d):
    return drop_empty_results(_resolved(spark, d), "json").select("doc_id", "attempt")


@query(
    "parse_percent",
    ANSWERS
    + """SELECT doc_id, attempt, CASE doc_id % 5 WHEN 0 THEN (doc_id % 101)::DOUBLE WHEN 1 THEN (doc_id % 101)::DOUBLE
      WHEN 2 THEN doc_id % 101 + 0.5::DOUBLE ELSE 0 END AS fit FROM cleaned WHERE ok""",
)
def _(spark, d):
    parsed = records.parse_record(_cleaned(spark, d), "json", "raw", FIT_ANSWER)
    fit = measures.parse_percent(F.col("record.fit_percentage"))
    return parsed.filter("success").select("doc_id", "attempt", fit.alias("fit"))


@query(
    "min_fit_filter",
    ANSWERS
    + """SELECT doc_id, attempt, js->>'fit_percentage' AS fit_percentage FROM cleaned
    WHERE ok AND doc_id % 5 IN (0, 1, 2) AND doc_id % 101 + CASE WHEN doc_id % 5 = 2 THEN 0.5 ELSE 0 END >= 50.5""",
)
def _(spark, d):
    parsed = records.parse_record(_cleaned(spark, d), "json", "raw", FIT_ANSWER).filter("success")
    fit = parsed.select("doc_id", "attempt", "record.fit_percentage")
    return min_fit_filter(fit, F.lit("50.5 %"))


@query(
    "attach_metadata",
    with_(DOCS)
    + """SELECT doc_id, filename, true AS success, length(text)::INT AS text_length,
      CASE WHEN doc_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS provider, 'model ' || lang AS model FROM docs""",
)
def _(spark, d):
    called = docs(spark, d).withColumns(
        {
            "provider": F.when(F.col("doc_id") % 2 == 0, "p1").otherwise("p2"),
            "model": F.concat(F.lit("model "), "lang"),
        }
    )
    return records.attach_metadata(called, "filename", "text", "provider", "model").select(
        "doc_id", "filename", "success", "text_length", "provider", "model"
    )


@query(
    "ensure_defaults",
    CAND_WITH
    + """SELECT candidate_id, len(skills)::INT AS n_skills, len(experience)::INT AS n_experience, 0 AS n_certifications,
      0 AS n_projects, 0 AS n_languages, 0 AS n_awards,
      CASE WHEN candidate_id % 7 = 0 THEN '' ELSE name END AS name FROM cand""",
)
def _(spark, d):
    gaps = candidates(spark, d).withColumn(
        "personal_info", F.when(F.col("candidate_id") % 7 != 0, F.col("personal_info"))
    )
    counted = ("skills", "experience", "certifications", "projects", "languages", "awards")
    return records.ensure_defaults(gaps).select(
        "candidate_id",
        *[F.size(c).alias(f"n_{c}") for c in counted],
        F.col("personal_info.name").alias("name"),
    )


@query(
    "clean_record",
    CAND_WITH
    + """SELECT candidate_id, email, phone, array_to_string(skills, '|') AS skills FROM cand""",
)
def _(spark, d):
    return clean_candidates(spark, d).select(
        "candidate_id",
        F.col("personal_info.email").alias("email"),
        F.col("personal_info.phone").alias("phone"),
        F.array_join("skills", "|").alias("skills"),
    )
