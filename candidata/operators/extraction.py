"""Files to candidate records, for a batch or a stream."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidata.functions.text import is_blank
from candidata.inference.client import Client, infer_attempts
from candidata.inference.prompts import extraction_prompt
from candidata.operators.records import clean_record, is_json_object, parse_loosely, resolve_answers
from candidata.schemas import ANSWER, CANDIDATE
from candidata.sources.documents import NO_TEXT, decode_text, route_by_format

NO_PARSED_TEXT = "No parsed text for {} file"


def attempts_of(*models: tuple[str, str]) -> Column:
    """The same (provider, model) attempts for every row, as a stream needs them."""
    return F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m in models])


def extract_documents(
    files: DataFrame,
    client_factory: Callable[[], Client],
    attempts: Column,
    chat_providers: Sequence[str],
    concurrency: int | None = None,
    in_flight: int = 8,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One record per file of `scan_documents` or `stream_documents`, `cause`, and `calls`.

    Plain text is decoded here. Other formats need a `text` column with what a parser made of
    them; without it they become error records, as do files that are rejected or blank. These
    are not sent to a model. All others are sent to the (provider, model) pairs in `attempts`
    (see `attempts_of` and `operators.usage.route_attempts`) until one answers with a record;
    `cause` keeps why the last call failed, `calls` the (provider, model) pairs that were asked.
    keep: columns of the files to pass on.
    """
    for name in ("mime_type", "text"):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast("string"))
    routed = route_by_format(files.withColumn("attempts", attempts))
    plain = F.col("reader") == "plain"
    text = F.coalesce("text", F.when(plain, decode_text(F.col("content")))) if "content" in files.columns else F.col("text")
    rows = routed.withColumn("text", text)
    unparsed = F.replace(F.lit(NO_PARSED_TEXT), F.lit("{}"), F.coalesce("extension", F.lit("unknown")))
    refused = F.coalesce(
        F.col("error"),
        F.when(F.col("text").isNull() & ~F.coalesce(plain, F.lit(False)), unparsed),
        F.when(is_blank(F.col("text")), F.lit(NO_TEXT)),
    )
    requests = rows.select(
        *keep,
        "filename",
        refused.alias("refused"),
        "attempts",
        F.char_length("text").alias("text_length"),
        F.when(refused.isNull(), extraction_prompt(F.col("text"))).alias("prompt"),
    )
    answered = infer_attempts(
        requests, client_factory, chat_providers, concurrency=concurrency, in_flight=in_flight
    )
    resolved = answered.drop("prompt", "attempts").withColumn(
        "r", resolve_answers(F.col("answers"), chat_providers, is_json_object)
    )
    known = lambda c: F.when(F.col("r.success"), F.col(c))
    records = resolved.select(
        F.when(F.col("r.success"), parse_loosely(F.col("r.json"), ANSWER)).alias("record"),
        *keep,
        F.transform("answers", lambda a: F.struct(a["provider"], a["model"])).alias("calls"),
        "filename",
        F.col("r.success").alias("success"),
        known("text_length").alias("text_length"),
        known("r.provider").alias("provider"),
        known("r.model").alias("model"),
        F.coalesce("refused", "r.error").alias("error"),
        F.when(F.col("refused").isNull(), F.col("r.raw_response")).alias("raw_response"),
        F.when(F.col("refused").isNull(), F.col("r.cause")).alias("cause"),
    ).select("record.*", "*")
    return clean_record(records).select(*CANDIDATE.fieldNames(), "cause", "calls", *keep)
