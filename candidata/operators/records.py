"""From a model's answer to a validated candidate record."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candidata.functions.binding import bind
from candidata.functions.text import (
    UNICODE,
    EMAIL,
    PHONE,
    clean_skills,
    normalize_email,
    normalize_phone,
    search_words,
    strip,
)
from candidata.operators.phrases import longest_phrase, phrase_hits, phrase_index
from candidata.schemas import ANSWER, ARRAY_FIELDS, PERSONAL_INFO

# Messages of error records and how much of a bad answer they keep.
PARSE_FAILED = "Failed to parse AI response as JSON"
NO_ATTEMPT_WORKED = "Failed to extract resume data after multiple attempts."
ALL_EXHAUSTED = "All API providers have reached their daily limits."
RAW_LENGTH = 500
MAX_ATTEMPTS = 3

LINKEDIN = r"(?i)(?:https?://)?(?:[a-z]{2,3}\.)?linkedin\.com/[A-Za-z0-9_/%.-]*[A-Za-z0-9_/%-]"
WEB_PAGE = r"(?i)https?://[^\s<>\"')]*[^\s<>\"').,;:]"


def unwrap_response(body: Column, provider: Column, chat_providers: Sequence[str]) -> Column:
    """The text of an answer, out of the envelope its provider uses; null if there is none."""
    chat = F.get_json_object(body, "$.choices[0].message.content")
    generated = F.get_json_object(body, "$.candidates[0].content.parts[0].text")
    return F.when(provider.isin(*chat_providers), chat).otherwise(generated)


def clean_json(text: Column, trim: bool = False) -> Column:
    """The span from the first `{` to the last `}` once code fences are gone.

    Without such a span the text is left as it is, or trimmed if `trim` is set.
    """
    unfenced = F.regexp_replace(F.regexp_replace(text, r"```json\s*", ""), r"```\s*$", "")

    def span(bare: Column) -> Column:
        found = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
        return F.coalesce(found, strip(bare) if trim else bare)

    return bind(unfenced, span)


def is_json_object(json: Column) -> Column:
    """True for exactly one well-formed JSON object.

    `from_json` reads the first object and ignores what follows, so the text is also
    read as the only element of an array, by one strict parse.
    """

    def strict(j: Column) -> Column:
        array = F.try_parse_json(F.concat(F.lit("["), j, F.lit("]")))
        alone = bind(
            array, lambda v: v.isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull()
        )
        return j.startswith("{") & j.endswith("}") & alone

    return F.coalesce(bind(json, strict), F.lit(False))


def _default(dtype: T.DataType) -> Column:
    return F.lit("") if dtype == T.StringType() else F.array().cast(dtype)


def loose_schema(schema: T.StructType) -> T.StructType:
    """The schema with every list and object as text, so that one of another shape is still read."""
    as_text = lambda t: T.StringType() if isinstance(t, (T.ArrayType, T.StructType)) else t
    return T.StructType([T.StructField(f.name, as_text(f.dataType)) for f in schema.fields])


def tight_columns(schema: T.StructType, value: Callable[[str], Column]) -> list[Column]:
    """The columns of `schema` out of what was read with its loose schema.

    A text in place of an object becomes the first field of one whose other fields are empty,
    and a value in place of a list becomes a list of that value, at any depth. Objects in a
    list get empty values for fields they lack.
    """

    def record(e: Column, dtype: T.StructType, lacking: Callable[[T.DataType], Column]) -> Column:
        first, *others = dtype.fields
        plain = F.struct(
            e.alias(first.name), *[_default(f.dataType).alias(f.name) for f in others]
        ).cast(dtype)

        def filled(o: Column) -> Column:
            fields = tight_columns(dtype, lambda name: o[name])
            return F.struct(
                *[F.coalesce(c, lacking(f.dataType)).alias(f.name) for c, f in zip(fields, dtype.fields)]
            ).cast(dtype)

        whole = bind(F.from_json(e, loose_schema(dtype)), filled)
        return F.when(e.startswith("{"), whole).when(e.isNotNull(), plain)

    def listed(text: Column, dtype: T.DataType) -> Column:
        items = F.coalesce(
            F.when(text.startswith("["), F.from_json(text, T.ArrayType(T.StringType()))),
            F.when(text.isNotNull(), F.array(text)),
        )
        if not isinstance(dtype, T.StructType):
            return items
        return F.transform(items, lambda e: record(e, dtype, _default))

    def shaped(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return listed(value(f.name), f.dataType.elementType)
        if isinstance(f.dataType, T.StructType):
            return record(value(f.name), f.dataType, lambda t: F.lit(None).cast(t))
        return value(f.name)

    return [shaped(f).alias(f.name) for f in schema.fields]


def parse_loosely(json: Column, schema: T.StructType) -> Column:
    """The record in a JSON object; lists need not look as asked for."""
    return bind(
        F.from_json(json, loose_schema(schema)),
        lambda record: F.struct(*tight_columns(schema, lambda name: record[name])),
    )


def parse_record(
    df: DataFrame, json: str, raw: str, schema: T.StructType = ANSWER, out: str = "record"
) -> DataFrame:
    """Add the parsed record, `success`, and for bad answers `error` and `raw_response`."""
    valid = F.col("success")
    return df.withColumn("success", is_json_object(F.col(json))).withColumns(
        {
            out: F.when(valid, parse_loosely(F.col(json), schema)),
            "error": F.when(~valid, F.lit(PARSE_FAILED)),
            "raw_response": F.when(~valid, F.left(F.col(raw), F.lit(RAW_LENGTH))),
        }
    )


def has_required(json: Column, fields: Sequence[str]) -> Column:
    """True if the answer is an object with all the keys, whatever their values."""
    wanted = F.array(*[F.lit(f) for f in fields])
    missing = F.array_except(wanted, F.json_object_keys(json))
    return F.when(is_json_object(json), F.size(missing) == 0).otherwise(F.lit(False))


def resolve_attempts(
    attempts: DataFrame,
    key: str,
    attempt: str,
    valid: str,
    response: str,
    payload: Sequence[str],
    max_attempts: int = MAX_ATTEMPTS,
) -> DataFrame:
    """One row per document: the first valid attempt, or why there is none.

    The last allowed attempt decides the error: an answer that could not be read is
    kept in part, a call without an answer is not. Attempts are reduced before the
    shuffle, so repeated keys do not pile up in one task.
    """
    number = F.col(attempt)
    # The aggregate sorts its input, so only what it may keep goes into it.
    narrow = attempts.filter(number <= max_attempts).select(
        key,
        number.alias("_number"),
        F.when(F.col(valid), number).alias("_valid"),
        F.when(F.col(valid), F.struct(number.alias("attempt"), *payload)).alias("_payload"),
        F.when(~F.col(valid), F.left(F.col(response), F.lit(RAW_LENGTH))).alias("_raw"),
    )
    resolved = narrow.groupBy(key).agg(
        F.min_by("_payload", "_valid").alias("_chosen"),
        F.max_by(F.struct("_number", "_raw"), "_number").alias("_last"),
    )
    success = F.col("_chosen").isNotNull()
    unread = (F.col("_last._number") == max_attempts) & F.col("_last._raw").isNotNull()
    return resolved.select(
        key,
        success.alias("success"),
        F.col("_chosen.attempt").alias("attempt"),
        *[F.col(f"_chosen.{c}").alias(c) for c in payload],
        F.when(~success & unread, F.lit(PARSE_FAILED))
        .when(~success, F.lit(NO_ATTEMPT_WORKED))
        .alias("error"),
        F.when(~success & unread, F.col("_last._raw")).alias("raw_response"),
    )


def resolve_answers(
    answers: Column, chat_providers: Sequence[str], valid: Callable[[Column], Column], trim: bool = False
) -> Column:
    """The outcome of a list of answers, as `resolve_attempts` has it for a table of attempts.

    A struct of success, attempt, provider, model and json of the first valid answer, else
    error, raw_response, and the cause if the last call failed.
    """

    def read(a: Column) -> Column:
        def cleaned(raw: Column) -> Column:
            def judged(json: Column) -> Column:
                return F.struct(
                    *[a[n].alias(n) for n in ("attempt", "provider", "model")],
                    a["error"].alias("cause"),
                    raw.alias("raw"),
                    json.alias("json"),
                    valid(json).alias("valid"),
                )

            return bind(clean_json(raw, trim), judged)

        return bind(unwrap_response(a["body"], a["provider"], chat_providers), cleaned)

    def outcome(read_answers: Column) -> Column:
        chosen = F.get(F.filter(read_answers, lambda a: a["valid"]), F.lit(0))
        last = F.try_element_at(read_answers, F.lit(-1))
        success = chosen.isNotNull()
        unread = last["raw"].isNotNull()
        return F.struct(
            success.alias("success"),
            *[chosen[n].alias(n) for n in ("attempt", "provider", "model", "json")],
            F.when(~success & unread, F.lit(PARSE_FAILED))
            .when(~success & (F.size(read_answers) == 0), F.lit(ALL_EXHAUSTED))
            .when(~success, F.lit(NO_ATTEMPT_WORKED))
            .alias("error"),
            F.when(~success & unread, F.left(last["raw"], F.lit(RAW_LENGTH))).alias("raw_response"),
            F.when(~success, last["cause"]).alias("cause"),
        )

    return bind(F.transform(answers, read), outcome)


def attach_metadata(df: DataFrame, filename: str, text: str, provider: str, model: str) -> DataFrame:
    """Say where a successful record comes from; the text length is in characters."""
    return df.withColumns(
        {
            "filename": F.col(filename),
            "success": F.lit(True),
            "text_length": F.char_length(F.col(text)),
            "provider": F.col(provider),
            "model": F.col(model),
        }
    )


def ensure_defaults(df: DataFrame) -> DataFrame:
    """Missing lists become empty lists, missing personal data an empty object."""
    nothing = F.struct(*[F.lit("").alias(f.name) for f in PERSONAL_INFO])
    return df.withColumns(
        {
            **{
                name: F.coalesce(F.col(name), F.array().cast(dtype))
                for name, dtype in ARRAY_FIELDS.items()
            },
            "personal_info": F.coalesce(F.col("personal_info"), nothing),
        }
    )


def clean_record(df: DataFrame, skills_mode: str = "compat") -> DataFrame:
    """Normalise e-mail, phone and skills, then fill in missing lists."""
    info = F.col("personal_info")
    cleaned = info.withField("email", normalize_email(info["email"])).withField(
        "phone", normalize_phone(info["phone"])
    )
    return ensure_defaults(
        df.withColumns(
            {
                "personal_info": F.when(info.isNotNull(), cleaned),
                "skills": clean_skills(F.col("skills"), skills_mode),
            }
        )
    )


def rule_extract(
    docs: DataFrame, key: str, text: str, dictionary: DataFrame, skill: str
) -> DataFrame:
    """Contact data by pattern and skills by dictionary, without a model.

    `dictionary` is a table of skills of any number of words. Words of the text carry the key only
    and meet the first words of the skills (`operators.phrases`); skills found are gathered per
    key and joined with the narrow contact row.
    """
    page = F.regexp_extract(F.col(text), WEB_PAGE, 0)
    fields = {
        "email": F.regexp_extract(F.col(text), UNICODE + EMAIL, 0),
        "phone": F.regexp_replace(
            F.regexp_extract(F.col(text), UNICODE + PHONE, 0), UNICODE + r"[^\d\+\-\(\)]", ""
        ),
        "linkedin": F.regexp_extract(F.col(text), LINKEDIN, 0),
        "portfolio": F.when(F.lower(page).contains("linkedin.com"), "").otherwise(page),
    }
    known = dictionary.select(F.col(skill).alias("_skill"), F.array_join(search_words(F.col(skill)), " ").alias("_phrase"))
    index = phrase_index(dictionary, search_words(F.col(skill)))
    words = search_words(F.col(text))
    hits = phrase_hits(docs.withColumn("_key", F.col(key)), ["_key"], words, index, longest_phrase(index))
    found = hits.join(known.distinct(), "_phrase").groupBy("_key").agg(F.collect_set("_skill").alias("_skills"))
    contacts = docs.select(key, *[c.alias(n) for n, c in fields.items()])
    skills = F.coalesce(F.array_sort("_skills"), F.array().cast("array<string>"))
    rows = contacts.join(found, F.col(key) == F.col("_key"), "left")
    return rows.withColumn("skills", skills).drop("_key", "_skills")
