"""Candidates judged by a model, instead of by the rules of `matching`."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidata.inference.client import Client, infer_attempts
from candidata.inference.prompts import fit_instructions, fit_prompt, job_text, option_texts
from candidata.operators.matching import attach_candidate_name, pair_candidates
from candidata.operators.records import has_required, parse_loosely, resolve_answers
from candidata.schemas import FIT_ANSWER, FIT_REQUIRED


def evaluate_with_model(
    candidates: DataFrame,
    jobs: DataFrame,
    request: str,
    client_factory: Callable[[], Client],
    attempts: Column,
    chat_providers: Sequence[str],
    keep: Sequence[str] = (),
    description: str = "description",
    concurrency: int | None = None,
    in_flight: int = 8,
) -> DataFrame:
    """One row per candidate and job: the model's judgement with the candidate's name, or an error.

    `jobs` has options (texts or lists) and a description (text or object); guidelines and job
    text are made once per job. Candidates carry the request. An answer counts if it has all
    required keys; `attempts` lists the models to try.
    """
    tasks = jobs.select(
        request,
        fit_instructions(option_texts(jobs.drop(request, description))).alias("_guidelines"),
        job_text(jobs, description).alias("_job"),
    )
    record = F.struct(*[c for c in candidates.columns if c not in (request, *keep)])
    pairs = attach_candidate_name(pair_candidates(candidates, tasks, request))
    requests = pairs.select(
        request,
        *keep,
        "candidate_name",
        fit_prompt(F.col("_guidelines"), F.col("_job"), record).alias("prompt"),
        attempts.alias("attempts"),
    )
    answered = infer_attempts(
        requests, client_factory, chat_providers, required=FIT_REQUIRED, concurrency=concurrency, in_flight=in_flight
    ).drop("prompt", "attempts")
    complete = lambda json: has_required(json, FIT_REQUIRED)
    resolved = answered.withColumn("r", resolve_answers(F.col("answers"), chat_providers, complete, trim=True))
    answer = F.when(F.col("r.success"), parse_loosely(F.col("r.json"), FIT_ANSWER))
    shown = resolved.withColumn("a", answer)
    return shown.select(
        request,
        *keep,
        "candidate_name",
        *[F.col(f"r.{c}").alias(c) for c in ("success", "attempt", "provider", "model")],
        *[F.col(f"a.{f.name}").alias(f.name) for f in FIT_ANSWER.fields],
        *[F.col(f"r.{c}").alias(c) for c in ("error", "raw_response", "cause")],
    )
