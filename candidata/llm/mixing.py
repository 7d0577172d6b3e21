"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks.

Native: built-in functions, aggregates, joins and windows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.llm.common import unit_draw, words


def apportion(parties: DataFrame, group: Sequence[str], weight: str, seats: Column, order: str, out: str) -> DataFrame:
    """Add `out`: seats of each party by the highest quotients weight / (2 * seat - 1) of its group.

    `seats` is the same for all parties of a group. Rounding the exact shares gives all seats
    but at most one per two parties; only quotients beside the rounded shares are listed and
    ranked to give or take back the rest, so the work follows the number of parties, not of
    seats. Ties go to the smaller `order`. Without any weight nobody gets a seat.
    """
    of = Window.partitionBy(*[F.col(g) for g in group])
    share = F.coalesce(
        F.when(F.sum(weight).over(of) > 0, F.col("__seats") * F.col(weight) / F.sum(weight).over(of)), F.lit(0.0)
    )
    rows = parties.withColumn("__seats", seats.cast("bigint"))
    rows = rows.withColumn("__share", share).withColumn("__base", F.floor(F.col("__share") + 0.5))
    rows = rows.withColumn(
        "__short", F.when(F.sum(weight).over(of) > 0, F.col("__seats") - F.sum("__base").over(of)).otherwise(0)
    ).withColumn("__parties", F.count("*").over(of))
    rows = rows.withColumn("__number", F.row_number().over(of.orderBy(F.col(order).asc_nulls_last())))
    # A change of the divisor that moves `short` seats moves a party by no more than this.
    reach = F.floor(F.col("__share") * (F.abs("__short") + F.col("__parties")) / F.greatest("__seats", F.lit(1))) + 2
    step = F.sequence(F.lit(1).cast("bigint"), reach.cast("bigint"))
    rows = rows.withColumn("__step", F.explode_outer(F.when((F.col("__short") != 0) & (F.col(weight) > 0), step)))
    gives = F.col("__short") > 0
    seat = F.when(gives, F.col("__base") + F.col("__step")).otherwise(F.col("__base") + 1 - F.col("__step"))
    quotient = F.when(F.col("__step").isNotNull() & (seat >= 1), F.col(weight) / (2 * seat - 1))
    rows = rows.withColumn("__quotient", quotient)
    best = F.when(gives, -F.col("__quotient")).otherwise(F.col("__quotient"))
    # Of equal quotients the last is taken back first.
    tie = F.when(gives, F.col("__number")).otherwise(-F.col("__number"))
    rank = F.row_number().over(of.orderBy(best.asc_nulls_last(), tie, "__step"))
    rows = rows.withColumn("__moved", (rank <= F.abs("__short")) & F.col("__quotient").isNotNull())
    return (
        rows.groupBy(*parties.columns, "__base", "__short")
        .agg(F.count_if("__moved").alias("__n"))
        .withColumn(out, F.col("__base") + F.signum("__short").cast("bigint") * F.col("__n"))
        .drop("__base", "__short", "__n")
    )


def targets(sources: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """Add `target` to (source, source_size): words of each source in the mix.

    Sources in order of code point, null last, weigh `weights`, repeated. They share `total`
    times all sizes by weight; no target exceeds `most` times its source, and what is over is
    shared by weight among the others. Sources that stop are the first in the order of size by
    weight, so running sums find them. The table has a row per source.
    """
    everything = Window.partitionBy()
    number = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(number - 1, F.lit(len(weights))) + 1)
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    words_all = F.sum("source_size").over(everything) * F.lit(float(total))
    words_left = words_all - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("stops", words_left * F.col("weight") >= F.col("cap") * weight_left)
    words_free = words_all - F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0.0)).over(everything)
    weight_free = F.sum(F.when(~F.col("stops"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("stops"), F.col("cap")).otherwise(words_free * F.col("weight") / weight_free)
    return rows.withColumn("target", target).drop("stops", "cap", "weight")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    total: float = 1.5,
    most: float = 2.0,
    block_words: int = 64,
    shard_docs: int = 256,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, source, __text, size, source_size, target, taken), one row per document.

    Blocks of equal length, `block_words` words or fewer where a source has small parts, go
    to sources by the highest quotients of their targets, and in the same way from a source to
    groups of shards and to shards, by their words. A shard is a seeded random part of a source, on
    average `shard_docs` documents. Its documents lie in seeded order, as a ring of words; the quota
    is so many blocks of words from a seeded block on, round the ring as often as it takes. `taken` counts the
    words of a document among them. No shard gives more than `most` times its words; a block is at most a
    64th of the mean shard of any source, so what a source that stops there loses by whole blocks is below one
    in a hundred of its target.

    A hot source is spread over its shards. Texts are read once, whatever their length; the narrow sizes are
    written, shuffled once by shard, and meet only in windows over one shard.

    Null or empty texts and texts without words have size 0 and taken 0. A null source is a
    source. Among rows of one id and text it is not fixed which row gets which of their values,
    but the values are. `__text` is a hash of the text. Other columns are not read. An empty table gives an
    empty result.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.xxhash64(text).alias("__text"),
        F.size(words(F.col(text))).cast("bigint").alias("size"),
    )
    rows = written(rows, "sizes")
    everything = Window.partitionBy()
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__docs"))
    sources = targets(sources, weights, total, most).withColumn("__shards", F.floor(F.col("__docs") / shard_docs) + 1)
    # Of the sources that have words; by one that has none nothing is shared.
    mean_part = F.min(F.when(F.col("source_size") > 0, F.col("source_size") / F.col("__shards"))).over(everything)
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.coalesce(mean_part, F.lit(1.0)) / 64))).cast("bigint")
    seats = F.floor(F.sum("target").over(everything) / F.col("__block") + 0.5)
    sources = sources.withColumn("__block", block).withColumn("__all_seats", seats)
    sources = apportion(sources, [], "target", F.col("__all_seats"), "source", "__source_seats")
    sources = written(sources.drop("__all_seats", "__docs"), "sources")

    of = sources.select(F.col("source").alias("__s"), "__shards")
    draw = unit_draw(F.lit(seed), F.col("doc_id"), F.col("__text"))
    rows = rows.withColumn("__draw", draw).join(of, rows["source"].eqNullSafe(of["__s"]))
    rows = rows.withColumn("__shard", F.floor(F.col("__draw") * F.col("__shards"))).drop("__s", "__shards")

    parts = rows.groupBy("source", "__shard").agg(F.sum("size").alias("__words")).filter("__words > 0")
    of = sources.withColumnRenamed("source", "__s")
    parts = parts.join(of, parts["source"].eqNullSafe(of["__s"])).drop("__s")
    parts = parts.withColumn("__group", F.floor(F.col("__shard") / 1024))
    groups = parts.groupBy("source", "__group", "__source_seats").agg(F.sum("__words").alias("__group_words"))
    groups = apportion(groups, ["source"], "__group_words", F.col("__source_seats"), "__group", "__group_seats")
    groups = groups.drop("__source_seats", "__group_words").withColumnsRenamed({"source": "__s", "__group": "__g"})
    parts = parts.join(groups, parts["source"].eqNullSafe(groups["__s"]) & (F.col("__group") == F.col("__g"))).drop(
        "__s", "__g", "__source_seats", "target", "source_size", "__shards"
    )
    parts = apportion(parts, ["source", "__group"], "__words", F.col("__group_seats"), "__shard", "__seats_won")
    quota = F.least(F.col("__seats_won") * F.col("__block"), F.floor(F.lit(most) * F.col("__words")))
    n_blocks = F.ceil(F.col("__words") / F.col("__block"))
    first = F.pmod(F.xxhash64(F.lit(seed), F.lit("run"), "source", "__shard"), n_blocks) * F.col("__block")
    parts = parts.withColumn("__quota", quota.cast("bigint")).select(
        F.col("source").alias("__s"),
        F.col("__shard").alias("__p"),
        "__words",
        F.floor(F.col("__quota") / F.col("__words")).alias("__passes"),
        F.pmod("__quota", "__words").alias("__run"),
        first.alias("__first"),
    )

    rows = rows.join(parts, rows["source"].eqNullSafe(parts["__s"]) & (F.col("__shard") == F.col("__p")), "left")
    laid = Window.partitionBy("source", "__shard").orderBy("__draw", "doc_id", "__text", "size")
    rows = rows.withColumn("__end", F.sum("size").over(laid.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__begin", F.col("__end") - F.col("size"))
    last = F.col("__first") + F.col("__run")

    def within(low: Column, high: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("__end"), high) - F.greatest(F.col("__begin"), low))

    run = within(F.col("__first"), F.least(last, F.col("__words"))) + within(F.lit(0), last - F.col("__words"))
    taken = F.coalesce(F.col("__passes") * F.col("size") + run, F.lit(0)).cast("bigint")
    wide = sources.select(F.col("source").alias("__w"), "source_size", "target")
    rows = rows.withColumn("taken", taken).select("doc_id", "source", "__text", "size", "taken")
    return rows.join(wide, rows["source"].eqNullSafe(wide["__w"])).drop("__w")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **kwargs) -> DataFrame:
    """The documents of the mix, whole: each as often as the words taken from it make it, rounded.

    Rows of one id and text share the copies that their words make together. Documents without words (null, empty
    or blank texts) are not in the mix. All columns are passed on; an empty table gives an empty result.
    """
    found = mix(docs, doc_id, text, source, **kwargs)
    found = found.filter("size > 0").groupBy("doc_id", "source", "__text").agg(
        F.floor(F.sum("taken") / F.max("size") + 0.5).alias("__copies"), F.count("*").alias("__rows")
    )
    found = found.withColumnsRenamed({"doc_id": "__id", "source": "__s", "__text": "__hash"}).filter("__copies > 0")
    rows = docs.join(
        found,
        docs[doc_id].eqNullSafe(found["__id"])
        & docs[source].eqNullSafe(found["__s"])
        & (F.xxhash64(docs[text]) == found["__hash"]),
    )
    # Equal rows deal the copies among them.
    turn = F.row_number().over(Window.partitionBy(doc_id, "__s", "__hash").orderBy("__hash"))
    several = rows.withColumn("__turn", F.when(F.col("__rows") > 1, turn).otherwise(1))
    each = F.floor((F.col("__copies") + F.col("__rows") - F.col("__turn")) / F.col("__rows")).cast("int")
    copies = F.explode(F.when(each > 0, F.sequence(F.lit(1), each)).otherwise(F.array().cast("array<int>")))
    return several.withColumn("__copy", copies).select(*docs.columns)
