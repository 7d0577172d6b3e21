"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Native: built-in functions, an aggregate, a join and windows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidata.llm.common import unit_draw, without

#: A tree: (name, weight) for a shard, (name, children) above.
Tree = Sequence[tuple]

SLOT_PARTS = 4096


def tree_of(shards: int, racks: int = 2, shards_per_rack: int = 2) -> list:
    """A tree of equal shards 0, 1, ...: regions of `racks` racks of `shards_per_rack` shards.

    With one more shard, the shard opens a region or a rack of its own wherever the last is full.
    """
    def racked(first: int, last: int) -> list:
        starts = range(first, last, shards_per_rack)
        return [(f"rack{r // shards_per_rack}", [(s, 1.0) for s in range(r, min(r + shards_per_rack, last))]) for r in starts]

    size = racks * shards_per_rack
    return [(f"region{r // size}", racked(r, min(r + size, shards))) for r in range(0, shards, size)]


def weight_of(node: tuple) -> float:
    return sum(map(weight_of, node[1])) if isinstance(node[1], list) else float(node[1])


def place(key: Sequence[Column], tree: Tree, seed: int = 11) -> Column:
    """The shard of a key: from the top, the child with the least draw divided by its weight.

    A child's draw depends on the key and the child's name alone, so when weights change, rows
    leave or enter only the subtrees whose weights change. A row that enters such a subtree is
    placed anew in it; if the subtree is a single new shard, nothing else moves. Children
    without weight get nothing.
    """
    def descend(children: Tree, path: str) -> Column:
        nodes = [n for n in children if weight_of(n) > 0]
        if not nodes:
            raise ValueError("a tree needs a shard with weight")
        draws = [
            F.struct(
                (-F.log(unit_draw(*key, F.lit(f"{seed}:{path}/{n[0]}"))) / F.lit(weight_of(n))).alias("draw"),
                F.lit(i).alias("child"),
            )
            for i, n in enumerate(nodes)
        ]
        best = F.array_min(F.array(*draws))["child"] if len(draws) > 1 else F.lit(0)
        below = [
            descend(n[1], f"{path}/{n[0]}") if isinstance(n[1], list) else F.lit(int(n[0])) for n in nodes
        ]
        if len(nodes) == 1:
            return below[0]
        chosen = F.when(best == 0, below[0])
        for i in range(1, len(nodes) - 1):
            chosen = chosen.when(best == i, below[i])
        return chosen.otherwise(below[-1])

    return descend(tree, "")


def shard(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = 8,
    seed: int = 11,
) -> DataFrame:
    """Add size, text_crc32, law, shard, slot and grown_shard to every document.

    The law is `key`: the id and the number of shards decide. `grown_shard` is the place with
    one more shard. `size` is the text's UTF-8 bytes and one. `slot` counts from 0 without gaps
    in each shard: a shard's rows are dealt by hash of id, checksum and size to many parts, part totals give
    offsets, and only the rows of a part meet in a window, so neither a large shard nor an id with many
    texts lands in one task. Rows that are equal in all three share a part, however many there are: they are
    numbered in one task, as a sort that spills.

    Null text: size 1, the checksum of no bytes. A null id is a key like others. Very long texts are read
    once for their size and checksum. Rows of one id share a shard; equal rows get slots of their own.
    Columns with the name of a result are replaced, others passed on. An empty table gives an empty result.
    """
    rows = without(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    utf8 = F.coalesce(F.col(text), F.lit("")).cast("binary")
    key = [F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))]
    rows = (
        rows.withColumn("size", F.octet_length(utf8).cast("bigint") + 1)
        .withColumn("text_crc32", F.crc32(utf8))
        .withColumn("law", F.lit("key"))
        .withColumn("shard", place(key, tree_of(shards), seed).cast("int"))
        .withColumn("grown_shard", place(key, tree_of(shards + 1), seed).cast("int"))
    )
    part = F.pmod(F.xxhash64(F.lit(seed), *key, "text_crc32", "size"), F.lit(SLOT_PARTS)).cast("int")
    rows = rows.withColumn("__part", part)
    totals = rows.groupBy(F.col("shard").alias("__shard"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    rows = rows.join(offsets, (F.col("shard") == F.col("__shard")) & (F.col("__part") == F.col("__p")))
    inside = F.row_number().over(Window.partitionBy("shard", "__part").orderBy(doc_id, "text_crc32", "size"))
    return rows.withColumn("slot", (F.col("__before") + inside - 1).cast("bigint")).drop("__shard", "__part", "__p", "__before")
