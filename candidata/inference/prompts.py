"""Texts that are sent to a model. The wording is ours; models may be given another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candidata.functions.text import display_terms, term_list

EXTRACTION_PROMPT = """\
Read the document below and answer with one JSON object describing the candidate.

Keys and value shapes:
  personal_info: object with name, email, phone, location, linkedin, portfolio
  summary: text
  skills: list of texts
  experience: list of objects with title, company, location, duration, description
  education: list of objects with degree, institution, location, year, gpa
  certifications: list of objects with name, issuer, date, expiry
  projects: list of objects with name, description, technologies (list), duration
  languages: list of objects with language, proficiency
  awards: list of texts

Rules: use only what the document says; write "" for anything it does not say; keep
country codes in phone numbers; write dates as MM/YYYY or YYYY; collapse white space;
take skills from the whole document. Send the JSON object and nothing else.

Document:
"""

FIT_INTRODUCTION = """\
Judge how well the candidate fits the job and answer with one JSON object:
  summary: two to four sentences on the main matches and gaps
  fit_percentage: a number from 0 to 100
  key_matches: list of the requirements that are met
  key_gaps: list of the requirements that are not met
Send the JSON object and nothing else.
"""

# Option, headline, how to check it; `{}` is the value of the option.
_OPTION_LINES = (
    (
        "priority_keywords",
        "Priority keywords: {}",
        "Check every priority keyword [{}]: present goes to 'key_matches', absent to 'key_gaps'.",
    ),
    (
        "required_skills",
        "Skills that must be present: {}",
        "Check every required skill [{}]: present goes to 'key_matches', absent to 'key_gaps'.",
    ),
    (
        "min_experience",
        "Required experience: {} years or more. This counts strongly.",
        "With {0} years or more add 'Meets minimum experience requirement ({0}+ years)' to "
        "'key_matches', otherwise 'Lacks minimum experience requirement ({0} years)' to 'key_gaps'.",
    ),
    (
        "edu_requirements",
        "Required education: {}",
        "Check the education requirement '{}': met goes to 'key_matches', not met to 'key_gaps'.",
    ),
    (
        "deal_breakers",
        "Deal breakers, each strongly lowering the percentage if absent: {}",
        "Check every deal breaker [{}]: present goes to 'key_matches', absent to 'key_gaps'.",
    ),
    (
        "nice_to_have",
        "Welcome extras that raise the percentage: {}",
        "Check every extra [{}]: present goes to 'key_matches' marked '(nice-to-have)'.",
    ),
    (
        "experience_areas",
        "Required areas of experience: {}",
        "Check every area [{}]: present goes to 'key_matches', absent to 'key_gaps'.",
    ),
    (
        "technical_skills",
        "Technical skills asked for: {}",
        "Check every technical skill [{}]: present goes to 'key_matches', absent to 'key_gaps'.",
    ),
    (
        "certifications",
        "Required or preferred certifications: {}",
        "Check every certification [{}]: present goes to 'key_matches', absent to 'key_gaps'.",
    ),
    ("location_preference", "Preferred location: {}", None),
    ("salary_range", "Pay offered: {}", None),
)
_WEIGHTS = (
    ("weight_skills", "Skills"),
    ("weight_experience", "Experience"),
    ("weight_education", "Education"),
)
_WEIGHTS_AFTER = "edu_requirements"
_EXHAUSTIVE = "List every requirement once, in 'key_matches' or in 'key_gaps'. Leave none out."
# Fixed value: the title of the guidelines.
GUIDELINE_TITLE = "EVALUATION GUIDELINES:"


def extraction_prompt(text: Column) -> Column:
    return F.concat(F.lit(EXTRACTION_PROMPT), text)


def _filled(template: str, value: Column) -> Column:
    """The template with `{}` and `{0}` replaced by the value."""
    pieces = template.replace("{0}", "{}").split("{}")
    parts = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def option_texts(options: DataFrame) -> dict[str, Column]:
    """Option columns as display texts; lists are joined, texts stay as they are."""
    return {
        f.name: display_terms(term_list(F.col(f.name)))
        if isinstance(f.dataType, T.ArrayType)
        else F.col(f.name).cast("string")
        for f in options.schema.fields
    }


def job_text(jobs: DataFrame, description: str) -> Column:
    """A job description as text; an object becomes its JSON."""
    if isinstance(jobs.schema[description].dataType, (T.StructType, T.MapType)):
        return F.to_json(description, {"pretty": "true", "ignoreNullFields": "false"})
    return F.col(description).cast("string")


def fit_instructions(options: dict[str, Column]) -> Column:
    """Bullets for the options that are set, or an empty text if none is.

    `options` maps option names to text columns, as `option_texts` makes them, so that
    the options of many jobs become their instructions in one projection.
    """
    given = {name: F.nullif(c.cast("string"), F.lit("")) for name, c in options.items()}
    absent = F.lit(None).cast("string")
    bullets = []
    for name, headline, check in _OPTION_LINES:
        value = given.get(name, absent)
        bullets += [_filled(line, value) for line in (headline, check) if line]
        if name == _WEIGHTS_AFTER:
            shares = F.array_compact(
                F.array(*[_filled(label + ": {}%", given.get(w, absent)) for w, label in _WEIGHTS])
            )
            bullets.append(
                F.when(
                    F.size(shares) > 0,
                    F.concat(F.lit("Weights for the percentage: "), F.array_join(shares, ", ")),
                )
            )
    lines = F.array_compact(F.array(*bullets))
    listed = F.transform(
        F.concat(lines, F.array(F.lit(_EXHAUSTIVE))), lambda x: F.concat(F.lit("- "), x)
    )
    return F.when(
        F.size(lines) > 0,
        F.concat(F.lit(GUIDELINE_TITLE + "\n"), F.array_join(listed, "\n"), F.lit("\n")),
    ).otherwise("")


def fit_prompt(instructions: Column, job: Column, candidate: Column) -> Column:
    """Introduction, guidelines, job text and the candidate record as JSON."""
    return F.concat(
        F.lit(FIT_INTRODUCTION + "\n"),
        instructions,
        F.lit("\nJob description:\n"),
        job,
        F.lit("\n\nCandidate:\n"),
        F.to_json(candidate, {"pretty": "true", "ignoreNullFields": "false"}),
        F.lit("\n"),
    )
