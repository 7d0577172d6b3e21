"""Candidate and fit records as tables, texts and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candidata.operators.jobs import latest_experience
from candidata.operators.positions import position
from candidata.schemas import EDUCATION, EXPERIENCE, PERSONAL_INFO

# The headings of reports and the text for a missing value.
REPORT_TITLE = "Resume Extraction Report"
REPORT_TOTAL = "Total Resumes Processed: "
MISSING = "N/A"
CSV_OPTIONS = {"header": True, "escape": '"', "emptyValue": "", "encoding": "UTF-8"}


def _text(c: Column | str, default: str = "") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(default))


def _listed(items: str, show, between: str) -> Column:
    return F.coalesce(F.array_join(F.transform(items, show), between), F.lit(""))


def longest_lists(records: DataFrame) -> tuple[int, int]:
    """Length of the longest experience and education lists; reads only their lengths."""
    longest = records.agg(F.max(F.size("experience")), F.max(F.size("education"))).first()
    return tuple(max(n or 0, 0) for n in longest)


def flatten_csv(records: DataFrame) -> DataFrame:
    """One flat row per record, with numbered columns for the entries of lists.

    The columns are those the longest lists need, found by one aggregate that reads the
    lengths only. No entry is left out, so one very long list makes a very wide table.
    """
    n_experience, n_education = longest_lists(records)

    def entries(items: str, n: int, dtype: T.StructType) -> list[Column]:
        return [
            _text(F.get(items, F.lit(i))[f.name]).alias(f"{items}_{i + 1}_{f.name}")
            for i in range(n)
            for f in dtype.fields
        ]

    return records.select(
        _text("filename").alias("filename"),
        *[_text(f"personal_info.{f.name}").alias(f"personal_{f.name}") for f in PERSONAL_INFO],
        _listed("skills", lambda s: s, ", ").alias("skills"),
        *entries("experience", n_experience, EXPERIENCE),
        *entries("education", n_education, EDUCATION),
    )


def summary_sheet(records: DataFrame) -> DataFrame:
    info = lambda field: _text(f"personal_info.{field}")
    at = lambda e: F.concat(_text(e["title"]), F.lit(" at "), _text(e["company"]))
    of = lambda e: F.concat(_text(e["degree"]), F.lit(" from "), _text(e["institution"]))
    return latest_experience(records).select(
        info("name").alias("Name"),
        info("email").alias("Email"),
        info("phone").alias("Phone"),
        _listed("skills", lambda s: s, ", ").alias("Skills"),
        _listed("experience", at, "; ").alias("Experience"),
        _listed("education", of, "; ").alias("Education"),
        F.col("designation").alias("Designation"),
        F.col("description").alias("Description"),
    )


def detailed_sheet(records: DataFrame) -> DataFrame:
    """File name and the whole record as JSON."""
    whole = F.to_json(F.struct(*records.columns), {"pretty": "true", "ignoreNullFields": "false"})
    return records.select(_text("filename").alias("filename"), whole.alias("full_data"))


def fit_sheet(ranked: DataFrame, *keys: str) -> DataFrame:
    return ranked.select(
        *keys,
        F.col("rank").alias("Rank"),
        F.col("candidate_name").alias("Candidate Name"),
        _text(F.col("fit_percentage").cast("string")).alias("Fit Percentage"),
        _text("summary").alias("Summary"),
        _listed("key_matches", lambda s: s, ", ").alias("Key Matches"),
        _listed("key_gaps", lambda s: s, ", ").alias("Key Gaps"),
    )


def report_text(records: DataFrame, request: str, ordinal: str) -> DataFrame:
    """Report of a request as numbered texts: its heading is number 0, then one per record."""
    numbered = position(records, [request], [F.col(ordinal)], "number")

    def section(title: str, items: str, *lines: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat_ws("\n", F.lit(title), *lines))

    known = lambda c: _text(c, MISSING)
    info = F.concat_ws(
        "\n",
        *[
            F.concat(F.lit(f.capitalize() + ": "), known(f"personal_info.{f}"))
            for f in ("name", "email", "phone", "location")
        ],
    )
    worked = lambda e: F.concat(
        known(e["title"]), F.lit(" at "), known(e["company"]), F.lit(" ("), known(e["duration"]), F.lit(")")
    )
    studied = lambda e: F.concat(
        known(e["degree"]), F.lit(" from "), known(e["institution"]), F.lit(" ("), known(e["year"]), F.lit(")")
    )
    heading = F.concat(F.lit("Resume "), F.col("number"), F.lit(": "), _text("filename", "Unknown"))
    body = F.concat_ws(
        "\n",
        heading,
        F.when(F.col("personal_info").isNotNull(), info),
        section("Skills:", "skills", F.array_join("skills", ", ")),
        section("Experience:", "experience", F.array_join(F.transform("experience", worked), "\n")),
        section("Education:", "education", F.array_join(F.transform("education", studied), "\n")),
    )
    total = F.concat(F.lit(f"{REPORT_TITLE}\n{REPORT_TOTAL}"), F.count(F.lit(1)))
    titles = records.groupBy(request).agg(total.alias("text"))
    return numbered.select(request, "number", body.alias("text")).unionByName(
        titles.withColumn("number", F.lit(0).cast("bigint"))
    )


def grid(records: DataFrame, request: str, ordinal: str) -> DataFrame:
    """The result grid: one row per record, entries of lists separated by ` | `."""

    def entry(dtype: T.StructType):
        return lambda e: F.array_join(
            F.filter(F.array(*[e[f.name] for f in dtype.fields]), lambda v: v != ""), ", "
        )

    info = lambda field: _text(f"personal_info.{field}")
    numbered = position(latest_experience(records), [request], [F.col(ordinal)], "number")
    return numbered.select(
        request,
        F.col("number").alias("#"),
        info("name").alias("Name"),
        info("email").alias("Email"),
        info("phone").alias("Phone"),
        info("location").alias("Location"),
        F.col("designation").alias("Designation"),
        _listed("skills", lambda s: s, ", ").alias("Skills"),
        _listed("education", entry(EDUCATION), " | ").alias("Education"),
        _listed("experience", entry(EXPERIENCE), " | ").alias("Experience"),
    )


def write_json(records: DataFrame, path: str) -> None:
    records.write.option("ignoreNullFields", "false").json(path)


def write_csv(records: DataFrame, path: str) -> None:
    flatten_csv(records).write.options(**CSV_OPTIONS).csv(path)


def write_report(records: DataFrame, path: str, request: str, ordinal: str) -> None:
    """The report as text files that follow each other in reading order."""
    report_text(records, request, ordinal).orderBy(request, "number").select(
        "text"
    ).write.text(path)


def export(
    records: DataFrame,
    format: str,
    path: str,
    request: str | None = None,
    ordinal: str | None = None,
) -> None:
    """Write records as json, csv, parquet, a workbook of two tables, or a text report.

    A report needs the request and order columns of `report_text`.
    """
    kind = format.lower()
    if kind == "json":
        write_json(records, path)
    elif kind == "csv":
        write_csv(records, path)
    elif kind == "parquet":
        records.write.parquet(path)
    elif kind in ("excel", "xlsx"):
        summary_sheet(records).write.options(**CSV_OPTIONS).csv(f"{path}/Summary")
        detailed_sheet(records).write.options(**CSV_OPTIONS).csv(f"{path}/Detailed")
    elif kind in ("pdf", "text"):
        write_report(records, path, request, ordinal)
    else:
        raise ValueError("Unsupported format")
