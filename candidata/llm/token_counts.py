"""Token counts: an exact histogram of encoded lengths with suffix sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidata.llm.token_output import WordEncoder, read_tokenizer
from candidata.operators.positions import running_total


def encoded_lengths(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., n_tokens) for every document: ids of the whole text, without an end id.

    Null and empty texts have no ids. Every row counts, equal ones each. Texts are encoded whole, however
    long. A kept column called n_tokens gives way to the result; other columns are not read. An empty
    table gives an empty result.
    """
    tokenizer = read_tokenizer(tokenizer_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(*tokenizer)
        for batch in batches:
            if batch.num_rows:
                sizes = encoder.encode(batch.column(batch.num_columns - 1), 0)[1] - 1
                columns = [*batch.columns[:-1], pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_tokens"])

    rows = docs.select(*[F.col(k) for k in keep if k != "n_tokens"], F.col(text).alias("__text"))
    schema = rows.select(*rows.columns[:-1], F.lit(0).cast("bigint").alias("n_tokens")).schema
    return rows.mapInArrow(count, schema)


def length_histogram(lengths: DataFrame, group: str, n_tokens: str = "n_tokens") -> DataFrame:
    """One row per group and length that occurs, with what answers every context limit.

    n_docs: documents of that length. docs_at_least, tokens_at_least: suffix sums over lengths
    from this one up. truncated_total: tokens that remain if documents are cut to this length;
    between two lengths it rises by docs_at_least of the upper one for each token of the limit.
    docs, tokens: totals of the group.

    Lengths are counted before the shuffle, so a hot group costs a row per length and task.
    Suffix sums go over ranges of lengths first, then within a range. Rows of null length
    are left out; a null group is a group.
    """
    hist = lengths.filter(F.col(n_tokens).isNotNull()).groupBy(
        F.col(group).alias(group), F.col(n_tokens).cast("bigint").alias("n_tokens")
    ).agg(F.count("*").alias("n_docs"))
    order, each = [F.col("n_tokens")], F.col("n_docs") * F.col("n_tokens")
    hist = running_total(hist, [group], order, F.col("n_docs"), "__docs", total="docs")
    hist = running_total(hist, [group], order, each, "__tokens", total="tokens")
    at_least = {"docs_at_least": F.col("docs") - F.col("__docs") + F.col("n_docs")}
    at_least["tokens_at_least"] = F.col("tokens") - F.col("__tokens") + each
    hist = hist.withColumns(at_least)
    cut = F.col("tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")
    return hist.withColumn("truncated_total", cut).drop("__docs", "__tokens")


def truncated_totals(hist: DataFrame, group: str, limits: Sequence[int]) -> DataFrame:
    """(group, limit, docs_cut, tokens): for each limit, documents above it and tokens that remain."""
    each = [
        F.struct(
            F.lit(limit).cast("bigint").alias("limit"),
            F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs")).otherwise(0)).alias("docs_cut"),
            F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")).alias("tokens"),
        )
        for limit in limits
    ]
    return hist.groupBy(group).agg(F.array(*each).alias("answers")).select(group, F.inline("answers"))


def quantiles(hist: DataFrame, group: str, shares: Sequence[float]) -> DataFrame:
    """(group, share, n_tokens): the least length that at least this share of documents do not exceed."""
    up_to = F.col("docs") - F.col("docs_at_least") + F.col("n_docs")
    each = [
        F.struct(
            F.lit(float(share)).alias("share"),
            F.min(F.when(up_to >= F.lit(float(share)) * F.col("docs"), F.col("n_tokens"))).alias("n_tokens"),
        )
        for share in shares
    ]
    return hist.groupBy(group).agg(F.array(*each).alias("answers")).select(group, F.inline("answers"))
