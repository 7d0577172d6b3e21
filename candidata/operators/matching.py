"""Candidates against the requirements of jobs.

A candidate meets a job in one equi-join on the request they belong to. Everything
after it (requirement checks, percentage, lists of matches and gaps) reads only that
row, so it needs no further shuffle. The requirements of a job are a short list on
the job's row; the words of a candidate are never exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candidata.functions.binding import bind, explode_once, inline_once
from candidata.functions.measures import experience_years
from candidata.functions.text import (
    contains_phrase,
    display_terms,
    normalize_terms,
    search_text,
    search_words,
    strip,
    term_list,
)
from candidata.operators.phrases import longest_phrase, phrase_hits, phrase_index

# The order in which requirements are listed; term kinds hold comma-separated terms.
KINDS = (
    "priority_keywords",
    "required_skills",
    "min_experience",
    "edu_requirements",
    "deal_breakers",
    "nice_to_have",
    "experience_areas",
    "technical_skills",
    "certifications",
)
SINGLE_KINDS = ("min_experience", "edu_requirements")

# Labels of the experience check, the mark of extras, the missing name.
MEETS_EXPERIENCE = "Meets minimum experience requirement ({}+ years)"
LACKS_EXPERIENCE = "Lacks minimum experience requirement ({} years)"
EXTRA_MARK = " (nice-to-have)"
UNKNOWN = "Unknown"

# The score: ours. A missing deal breaker halves it, an extra adds two points.
DEAL_BREAKER_FACTOR = 0.5
EXTRA_POINTS = 2

METADATA = ("filename", "success", "text_length", "provider", "model", "error", "raw_response")

# `needle` is the term as it is looked for in a searchable text.
REQUIREMENT = "array<struct<ord:bigint,kind:string,term:string,needle:string>>"
# Places within one kind are below this, the length of a list.
KIND_STEP = 1 << 31


def requirements(options: DataFrame, out: str = "requirements") -> DataFrame:
    """Add the list of all requirements of a job: position, kind and term.

    An option is a comma-separated text or a list of terms. `cf_requirements` is another
    name for certifications. Single kinds take their text, or list, as one term.
    """
    nothing = F.array().cast("array<string>")

    def terms_of(name: str) -> Column:
        if name not in options.columns:
            return nothing
        column, listed = F.col(name), isinstance(options.schema[name].dataType, T.ArrayType)
        if name in SINGLE_KINDS:
            whole = display_terms(term_list(column)) if listed else strip(column.cast("string"))
            terms = F.filter(F.array(whole), lambda x: x != "")
        else:
            terms = term_list(column) if listed else normalize_terms(column.cast("string"))
        return F.coalesce(terms, nothing)

    def option(kind: str) -> Column:
        also = ["cf_requirements"] if kind == "certifications" else []
        return F.array_distinct(F.concat(*[terms_of(name) for name in (kind, *also)]))

    given = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.lit(kind).alias("kind"), option(kind).alias("terms"))
            for n, kind in enumerate(KINDS)
        ]
    )

    def listed(o: Column) -> Column:
        return F.transform(
            o["terms"],
            lambda x, i: F.struct(
                (o["n"] * F.lit(KIND_STEP).cast("bigint") + i).alias("ord"),
                o["kind"].alias("kind"),
                x.alias("term"),
                search_text(x).alias("needle"),
            ),
        )

    return options.withColumn(out, F.flatten(F.transform(given, listed)).cast(REQUIREMENT))


def requirement_rows(jobs: DataFrame, job: str) -> DataFrame:
    """One row per requirement."""
    return inline_once(jobs, [job], F.col("requirements"), "ord").drop("needle")


def pair_candidates(candidates: DataFrame, jobs: DataFrame, request: str) -> DataFrame:
    """Every candidate of a request with the job of the request.

    A plain equi-join: Spark broadcasts the jobs if their size allows it and else
    shuffles both sides, splitting a request that is much larger than the others.
    """
    return candidates.join(jobs, request)


def _leaves(c: Column, dtype) -> list[Column]:
    """All texts of a nested column, one expression for each path."""
    name = dtype.typeName()
    if name == "struct":
        return [x for f in dtype.fields for x in _leaves(c[f.name], f.dataType)]
    if name == "array":
        return [
            F.array_join(
                F.transform(c, lambda item: F.concat_ws(" ", *_leaves(item, dtype.elementType))),
                " ",
            )
        ]
    return [c.cast("string")]


def record_text(candidates: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """The whole record, without data about its extraction, as one searchable text."""
    fields = [f for f in candidates.schema.fields if f.name not in (*METADATA, *exclude)]
    return search_text(
        F.concat_ws(" ", *[x for f in fields for x in _leaves(F.col(f.name), f.dataType)])
    )


def candidate_terms(candidates: DataFrame, key: str, text: str) -> DataFrame:
    """One row per distinct word of a candidate's text."""
    words = F.array_distinct(search_words(F.col(text)))
    return explode_once(candidates, [key], words, "term")


def check_requirements(
    pairs: DataFrame,
    text: str = "search_text",
    years: str = "years",
    education: str = "education",
    out: str = "checks",
    found: str | None = None,
) -> DataFrame:
    """Add `checks`: every requirement once, with `found` and the label it is listed under.

    Terms are looked for in the text one after the other. found: a column with the places of those it
    holds, null for none (see `found_terms`); then no text is searched.
    """

    def check(r: Column, in_text: Column) -> Column:
        experience = r["kind"] == "min_experience"
        enough = F.coalesce(F.col(years), F.lit(0.0)) >= r["term"].try_cast("double")
        studied = F.exists(
            F.col(education), lambda e: F.contains(F.lower(e["degree"]), F.lower(r["term"]))
        )
        found = F.coalesce(
            F.when(experience, enough)
            .when(r["kind"] == "edu_requirements", studied)
            .otherwise(in_text),
            F.lit(False),
        )
        label = (
            F.when(experience & found, F.replace(F.lit(MEETS_EXPERIENCE), F.lit("{}"), r["term"]))
            .when(experience, F.replace(F.lit(LACKS_EXPERIENCE), F.lit("{}"), r["term"]))
            .when(r["kind"] == "nice_to_have", F.concat(r["term"], F.lit(EXTRA_MARK)))
            .otherwise(r["term"])
        )
        return F.struct(
            r["ord"].alias("ord"), r["kind"].alias("kind"), found.alias("found"), label.alias("label")
        )

    if found is None:
        searched = lambda words: F.transform(
            "requirements", lambda r: check(r, contains_phrase(words, r["needle"]))
        )
        return pairs.withColumn(out, bind(F.col(text), searched))

    def marked(held: Column) -> Column:
        every = F.sequence(F.lit(0), F.size("requirements") - 1)
        at = lambda places, value: F.transform(
            places, lambda i: check(F.get("requirements", i), F.lit(value))
        )
        # Sets are compared by hashing; the position comes first in a check and restores the order.
        return F.array_sort(F.concat(at(held, True), at(F.array_except(every, held), False)))

    held = F.coalesce(F.col(found), F.array().cast("array<int>"))
    checks = F.when(F.size("requirements") > 0, bind(held, marked))
    return pairs.withColumn(out, F.coalesce(checks, F.transform("requirements", lambda r: check(r, F.lit(False)))))


def found_terms(
    described: DataFrame, applications: DataFrame, jobs: DataFrame, request: str, keep: tuple[str, ...]
) -> DataFrame:
    """(keep, request, found, listed): the places in `requirements` of the terms that a candidate's text holds,
    and these requirements.

    For jobs with thousands of terms. All terms of all jobs make one index by first word, which the text of a
    candidate meets once, however many jobs and terms there are; its hits then meet the terms of the jobs applied for
    in equi-joins. Pairs without a hit have no row.
    """
    places = jobs.select(request, F.posexplode("requirements").alias("_at", "_r"))
    terms = places.filter(~F.col("_r.kind").isin(*SINGLE_KINDS)).select(
        request, "_at", "_r", F.trim("_r.needle").alias("_term")
    )
    terms = terms.filter("_term <> ''")
    index = phrase_index(terms, F.split("_term", " "))
    words = F.array_remove(F.split("search_text", " "), "")
    hits = phrase_hits(described, list(keep), words, index, longest_phrase(index)).distinct()
    met = applications.select(*keep, request).join(hits, list(keep))
    met = met.join(terms.withColumnRenamed("_term", "_phrase"), [request, "_phrase"])
    return met.groupBy(*keep, request).agg(
        F.array_sort(F.collect_set("_at")).alias("found"), F.array_sort(F.collect_set("_r")).alias("listed")
    )


def without_terms(jobs: DataFrame, *keep: str) -> DataFrame:
    """(keep, requirements, n_required): of the requirements only those that are no terms of a text, and how many
    of all are gaps where they are not found.

    For jobs with thousands of terms: a pair then holds what it found, not every term of its job.
    """
    singles = F.filter("requirements", lambda r: r["kind"].isin(*SINGLE_KINDS))
    required = F.size(F.filter("requirements", lambda r: r["kind"] != "nice_to_have")).cast("bigint")
    return jobs.select(*keep, singles.alias("requirements"), required.alias("n_required"))


def with_found(pairs: DataFrame, listed: str = "listed", out: str = "found") -> DataFrame:
    """Add the requirements that `found_terms` has listed to those of `without_terms`, and their places, for
    `check_requirements`."""
    both = F.concat("requirements", F.coalesce(F.col(listed), F.array().cast(REQUIREMENT)))
    # The position comes first in a requirement.
    merged = pairs.withColumn("requirements", F.array_sort(both))
    is_term = lambda i: ~F.get("requirements", i)["kind"].isin(*SINGLE_KINDS)
    every = F.when(F.size("requirements") > 0, F.sequence(F.lit(0), F.size("requirements") - 1))
    return merged.withColumn(out, F.filter(every, is_term))


def count_gaps(checked: DataFrame, checks: str = "checks", out: str = "n_gaps") -> DataFrame:
    """Add the number of gaps from `n_required` of `without_terms`: the length `key_gaps` has over all checks."""
    met = F.size(F.filter(checks, lambda c: c["found"] & (c["kind"] != "nice_to_have")))
    return checked.withColumn(out, F.col("n_required") - met)


def match_requirements(checked: DataFrame, *keys: str) -> DataFrame:
    """One row per candidate, job and requirement: found or missing."""
    return inline_once(checked, list(keys), F.col("checks"), "ord")


def collect_matches(checked: DataFrame, checks: str = "checks") -> DataFrame:
    """Add `key_matches` and `key_gaps` in requirement order; a missing extra is no gap."""
    labels = lambda keep: F.transform(F.filter(checks, keep), lambda c: c["label"])
    return checked.withColumns(
        {
            "key_matches": labels(lambda c: c["found"]),
            "key_gaps": labels(lambda c: ~c["found"] & (c["kind"] != "nice_to_have")),
        }
    )


def _count(checks: Column, keep) -> Column:
    return F.size(F.filter(checks, keep)).cast("double")


def score_parts(checked: DataFrame, years: str = "years", checks: str = "checks") -> DataFrame:
    """Add the shares of skills, experience and education, the penalty and the boost."""
    c = F.col(checks)
    is_term = lambda x: ~x["kind"].isin(*SINGLE_KINDS, "nice_to_have")
    terms = _count(c, is_term)
    minimum = F.col("min_experience").try_cast("double")
    unmet_degree = F.exists(c, lambda x: (x["kind"] == "edu_requirements") & ~x["found"])
    broken = F.exists(c, lambda x: (x["kind"] == "deal_breakers") & ~x["found"])
    share = _count(c, lambda x: is_term(x) & x["found"]) / terms
    worked = F.least(F.lit(1.0), F.coalesce(F.col(years), F.lit(0.0)) / minimum)
    return checked.withColumns(
        {
            "skill_share": F.when(terms > 0, share).otherwise(1.0),
            "experience_share": F.when(minimum > 0, worked).otherwise(1.0),
            "education_share": F.when(unmet_degree, 0.0).otherwise(1.0),
            "penalty": F.when(broken, DEAL_BREAKER_FACTOR).otherwise(1.0),
            "boost": EXTRA_POINTS
            * _count(c, lambda x: (x["kind"] == "nice_to_have") & x["found"]),
        }
    )


def fit_percentage(scored: DataFrame) -> DataFrame:
    """Add `fit_percentage`, a whole number from 0 to 100."""
    weighted = (
        F.col("weight_skills") * F.col("skill_share")
        + F.col("weight_experience") * F.col("experience_share")
        + F.col("weight_education") * F.col("education_share")
    )
    score = F.round(weighted * F.col("penalty") + F.col("boost"))
    return scored.withColumn(
        "fit_percentage", F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)).cast("int")
    )


def fit_summary(scored: DataFrame) -> DataFrame:
    """Add a summary of two to four sentences."""
    listed = lambda c: F.array_join(c, ", ")
    met, gaps = F.size("key_matches"), F.size("key_gaps")
    verdict = F.when(F.col("fit_percentage") >= 75, "a strong").when(
        F.col("fit_percentage") >= 50, "a fair"
    )
    sentences = F.array_compact(
        F.array(
            F.format_string(
                "The candidate is %s fit at %d percent.",
                F.coalesce(verdict, F.lit("a weak")),
                F.col("fit_percentage"),
            ),
            F.format_string("%d of %d requirements are met.", met, met + gaps),
            F.when(met > 0, F.concat(F.lit("Main matches: "), listed("key_matches"), F.lit("."))),
            F.when(gaps > 0, F.concat(F.lit("Main gaps: "), listed("key_gaps"), F.lit("."))),
        )
    )
    return scored.withColumn("summary", F.array_join(sentences, " "))


def attach_candidate_name(df: DataFrame) -> DataFrame:
    return df.withColumn("candidate_name", F.coalesce(F.col("personal_info.name"), F.lit(UNKNOWN)))


def location_preference(pairs: DataFrame) -> DataFrame:
    """Add `location_match`, for information only; null without a preference."""
    wanted = F.nullif(F.trim("location_preference"), F.lit(""))
    return pairs.withColumn(
        "location_match",
        F.contains(F.lower(F.col("personal_info.location")), F.lower(wanted)),
    )


def describe(candidates: DataFrame, as_of: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """What the checks read of a candidate: made once per record, before it meets jobs."""
    return candidates.select(
        *keep,
        F.col("personal_info"),
        F.col("education"),
        experience_years(F.col("experience"), as_of).alias("years"),
        record_text(candidates, exclude=keep).alias("search_text"),
    )


def evaluate_fit(
    described: DataFrame, applications: DataFrame, jobs: DataFrame, request: str, keep: tuple[str, ...]
) -> DataFrame:
    """All applications with percentage, matches, gaps and summary.

    `described` comes from `describe`; `applications` has the columns `keep` and the request;
    `jobs` holds validated weights and `requirements`.
    """
    sent = described.join(applications.select(*keep, request), list(keep))
    checked = check_requirements(pair_candidates(sent, jobs, request))
    scored = fit_percentage(score_parts(collect_matches(checked)))
    return attach_candidate_name(fit_summary(scored)).select(
        request,
        *keep,
        "candidate_name",
        "fit_percentage",
        "summary",
        "key_matches",
        "key_gaps",
        "min_fit_percent",
    )
