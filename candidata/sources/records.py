"""Stored records and ledgers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candidata.operators.records import loose_schema, tight_columns
from candidata.operators.usage import ledger_rows
from candidata.schemas import CANDIDATE, USAGE


def scan_candidates(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Extracted records from JSON lines, or from files holding one array each."""
    reader = spark.read.schema(loose_schema(CANDIDATE)).option("multiLine", multi_line)
    return reader.json(path).select(*tight_columns(CANDIDATE, F.col))


def scan_usage_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The counts of ledger files, each one JSON object; missing or unreadable ones have none."""
    try:
        files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], USAGE)
    return ledger_rows(files, "value")
