"""From raw documents to the shards of a training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.llm import decontamination, mixing, quality_rules, sharding, simhash_index


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that too many documents share.

    Null, empty and blank texts are rejected, as all texts under 50 words are. Equal rows stay or go together; null
    ids and sources are values. All columns are passed on, `text` and `n_chars` anew.
    """
    judged = quality_rules.judge(docs).filter("kept")
    text = F.col("clean_text").alias("text")
    n_chars = F.char_length("clean_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return judged.select(*[{"text": text, "n_chars": n_chars}.get(c, F.col(c)) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, one of equal rows.

    A null id stays only where its group has no other. All columns are passed on.
    """
    return simhash_index.keep_one(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts and items hold nothing; equal rows stay or go together. An empty benchmark keeps all.
    All columns are passed on.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_benchmark(docs, benchmark, least=60)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares; a document may stand in the mix twice.

    A null source is a source. Documents without words are not in the mix. All columns are passed on.
    """
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, copies and equal rows included; columns of these names are replaced.

    Very long texts go through all stages whole; an empty table gives an empty one after each.
    """
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The fingerprints and hash draws have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
