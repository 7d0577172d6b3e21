"""Checks a request has to pass before any work is done for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidata.functions.text import is_blank, strip

# Limits, defaults and messages.
MAX_FILES = 500
MAX_CANDIDATES = 100
WEIGHT_DEFAULTS = {"weight_skills": 40, "weight_experience": 40, "weight_education": 20}
NO_FILES = "No files uploaded"
NO_CANDIDATES = "No resume data provided"
TOO_MANY_FILES = "Too many files. Maximum {} files per request."
TOO_MANY_CANDIDATES = "Too many resumes. Maximum {} resumes per request."
NO_JOB_TEXT = "Job description is required"


def check_batch_caps(
    requests: DataFrame,
    items: DataFrame,
    key: str,
    cap: int = MAX_FILES,
    empty: str = NO_FILES,
    too_many: str = TOO_MANY_FILES,
) -> DataFrame:
    """Number of items per request, and why a request is rejected, if it is.

    `requests` lists every request, so that one without items shows up.
    """
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"))
    n = F.coalesce(F.col("n_items"), F.lit(0))
    return (
        requests.select(key)
        .distinct()
        .join(counts, key, "left")
        .select(
            key,
            n.alias("n_items"),
            F.when(n == 0, F.lit(empty)).when(n > cap, F.lit(too_many.format(cap))).alias("error"),
        )
    )


def normalize_job_text(df: DataFrame, text: str = "description") -> DataFrame:
    """Trim the job text; add `error` where nothing is left."""
    blank = is_blank(F.col(text))
    return df.withColumns(
        {"error": F.when(blank, F.lit(NO_JOB_TEXT)), text: F.when(~blank, strip(F.col(text)))}
    )


def validate_weights(df: DataFrame) -> DataFrame:
    """Whole-number weights with defaults; add `error` unless they sum to 100."""
    weights = {
        name: F.coalesce(
            F.regexp_extract(F.col(name).cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("int"),
            F.when(F.coalesce(F.col(name).cast("string"), F.lit("")) == "", F.lit(default)),
        )
        for name, default in WEIGHT_DEFAULTS.items()
    }
    total = sum(weights.values(), F.lit(0))
    shown = F.coalesce(total.cast("string"), F.lit("NaN"))
    message = F.concat(
        F.lit("Total weight should be 100, currently it's "),
        shown,
        F.lit(". Please adjust the weights."),
    )
    return df.withColumns(
        {**weights, "error": F.when(~F.coalesce(total == 100, F.lit(False)), message)}
    )
