"""Lines that several documents hold, found with a sharded minimal perfect hash.

Every distinct line gets 128 bits of hash. Shards of some thousands of hashes are each laid out
as a minimal perfect hash: a cascade of bit vectors, in which a hash takes the first level where
no other falls on its bit. The rank of that bit is the slot of the line in plain arrays:
fingerprint, number of documents, smallest document. Documents send the hashes of their lines to
the shards and read the slots; no line text is joined or shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidata.cluster import written

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX_SCHEMA = (
    "shard bigint, n_lines bigint, level_bits binary, bits binary, "
    "fingerprints binary, counts binary, owners binary, owned binary"
)
RESULTS = ("n_lines", "n_dropped", "kept_text")


def line_hashes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(__doc, __text, __place, h1, h2) of every line whose key has at least `least` code points.

    The key is the line without white space at both ends, A-Z in lower case. `__text` is a hash
    of the whole text: with the id it names the document, and equal rows are the same document.
    """
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("__doc"),
        F.xxhash64(text).alias("__text"),
        F.posexplode_outer(F.split(F.col(text), "\n")).alias("__place", "__line"),
    )
    key = F.translate(F.btrim("__line", F.lit(WHITE)), UPPER, LOWER)
    rows = rows.withColumn("__key", key).filter(F.char_length("__key") >= least)
    return rows.select(
        "__doc", "__text", "__place",
        F.xxhash64("__key").alias("h1"), F.xxhash64(F.lit(11), "__key").alias("h2"),
    )


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash of a 128-bit one for each level."""
    x = h1 + np.uint64((level * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    for add, factor in ((h2, 0xBF58476D1CE4E5B9), (np.uint64(level), 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(30)) ^ add) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _bit(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit below `size` (under 2^32) that a hash falls on."""
    return ((_mixed(h1, h2, level) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


class PerfectHash:
    """Slots 0 to n-1 of n different hashes, one each."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        """`sizes`: bits of every level, multiples of 64; `words`: all levels as 64-bit words."""
        self.sizes, self.words = sizes, words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(h1):
            size = -(-2 * len(h1) // 64) * 64
            at = _bit(h1, h2, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            again = ~alone[at]
            h1, h2 = h1[again], h2[again]
        return cls(np.array(sizes, np.int64), np.concatenate([*words, np.empty(0, np.uint64)]))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of every hash; any slot or -1 for one that was not there when it was built."""
        out = np.full(len(h1), -1, np.int64)
        left, start = np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = _bit(h1[left], h2[left], level, size).astype(np.int64) + start
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[at >> 6] + lower)[hit]
            left, start = left[~hit], start + size
        return out


def _hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))


def _fingerprints(h2: np.ndarray) -> np.ndarray:
    return (h2 >> np.uint64(32)).astype(np.uint32)


def build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    """The index row of one shard, from its different hashes (h1, h2, n_docs, owner)."""
    h1, h2 = _hashes(rows)
    found = PerfectHash.of(h1, h2)
    slot = found.slots(h1, h2)
    fingerprints, counts = np.empty(len(h1), np.uint32), np.empty(len(h1), np.uint32)
    owners, owned = np.empty(len(h1), np.int64), np.empty(len(h1), np.uint8)
    fingerprints[slot] = _fingerprints(h2)
    counts[slot] = np.minimum(rows.column("n_docs").to_numpy(), 2**32 - 1)
    owners[slot] = rows.column("owner").fill_null(0).to_numpy()
    owned[slot] = rows.column("owner").is_valid().to_numpy()
    arrays = [found.sizes, found.words, fingerprints, counts, owners, owned]
    names = ["level_bits", "bits", "fingerprints", "counts", "owners", "owned"]
    columns = {"shard": pa.array([key[0].as_py()], pa.int64()), "n_lines": pa.array([len(h1)], pa.int64())}
    return pa.table(columns | {n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(names, arrays)})


def probe_shard(rows: pa.Table, index: pa.Table, min_docs: int) -> np.ndarray:
    """Which of the probing lines (h1, h2, __doc) go: their line is in the index with at least
    `min_docs` documents, and belongs to a smaller document."""
    if not index.num_rows or not rows.num_rows:
        return np.zeros(rows.num_rows, bool)
    read = lambda name, kind: np.frombuffer(index.column(name)[0].as_buffer(), kind)
    h1, h2 = _hashes(rows)
    slot = PerfectHash(read("level_bits", np.int64), read("bits", np.uint64)).slots(h1, h2)
    inside = (slot >= 0) & (read("fingerprints", np.uint32)[slot] == _fingerprints(h2))
    doc = rows.column("__doc")
    is_owner = np.where(
        doc.is_valid().to_numpy(),
        (read("owned", np.uint8)[slot] == 1) & (read("owners", np.int64)[slot] == doc.fill_null(0).to_numpy()),
        read("owned", np.uint8)[slot] == 0,
    )
    return inside & (read("counts", np.uint32)[slot] >= min_docs) & ~is_owner


def _shard(n_shards: int) -> Column:
    return F.pmod("h1", F.lit(n_shards).cast("bigint")).alias("shard")


def build_index(lines: DataFrame, shard_lines: int = 4096) -> DataFrame:
    """The stored index of `line_hashes`: a row per shard of about `shard_lines` different lines.

    Documents of a line are counted by id, nulls as one; the smallest id owns the line, a null
    one only if it is alone. Counts combine before the shuffle, so a line that a third of all
    documents hold is a row per task. Fingerprints have 32 bits, counts stop at 2^32 - 1.
    """
    no_id = F.max(F.col("__doc").isNull().cast("bigint"))
    distinct = lines.groupBy("h1", "h2").agg(
        (F.count_distinct("__doc") + no_id).alias("n_docs"), F.min("__doc").alias("owner")
    )
    distinct = written(distinct, "distinct-lines")
    n_shards = max(1, math.ceil(distinct.count() / shard_lines))
    shards = distinct.withColumn("shard", _shard(n_shards)).groupBy("shard")
    return written(shards.applyInArrow(build_shard, INDEX_SCHEMA), "line-index")


def repeated_places(lines: DataFrame, index: DataFrame, min_docs: int = 2, probe_lines: int = 16384) -> DataFrame:
    """(__doc, __text, __place) of the lines that go, by probing the index.

    A shard that many lines probe, because one of its lines is in very many documents, is
    probed in slices of about `probe_lines` lines, each with a copy of the shard's arrays; the
    copies together stay below the size of the lines.
    """
    last = index.agg(F.max("shard")).first()[0]
    if last is None:
        return lines.select("__doc", "__text", "__place").limit(0)
    probes = lines.withColumn("shard", _shard(last + 1))
    slices = probes.groupBy("shard").agg(F.ceil(F.count("*") / probe_lines).alias("slices"))
    slice_of = F.pmod(F.xxhash64("__doc", "__text", "__place"), F.col("slices")).alias("slice")
    left = probes.join(slices, "shard").select(*lines.columns, "shard", slice_of)
    right = index.join(slices, "shard").select(
        *index.columns, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice")
    )

    def probe(rows: pa.Table, arrays: pa.Table) -> pa.Table:
        goes = probe_shard(rows, arrays, min_docs)
        return rows.select(["__doc", "__text", "__place"]).filter(pa.array(goes))

    grouped = left.groupBy("shard", "slice").cogroup(right.groupBy("shard", "slice"))
    return grouped.applyInArrow(probe, "__doc bigint, __text bigint, __place int")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """Add n_lines, n_dropped and kept_text: the text without lines that a smaller document holds.

    A line goes if its key (see `line_hashes`) has at least `least` code points and stands in at
    least two documents, unless this is the smallest of them. All lines of equal key in a
    document share its fate. Ids are numbers; documents of equal id are one document.

    A null or empty text is one empty line, kept as an empty text. A null id ranks after all
    others. Equal rows get equal results. Very long texts are rows of lines like any other. Other
    columns are passed on; those with the name of a result are replaced. An empty table gives
    an empty result. Lines are stored as hashes once and read twice; the text is shuffled
    once at most, to meet the places of its lines.
    """
    docs = docs.drop(*RESULTS)
    lines = written(line_hashes(docs, doc_id, text, least), "lines")
    places = repeated_places(lines, build_index(lines))
    places = places.groupBy("__doc", "__text").agg(F.collect_set("__place").alias("__places"))
    rows = docs.withColumn("__hash", F.xxhash64(text))
    rows = rows.join(
        places, rows[doc_id].eqNullSafe(places["__doc"]) & (F.col("__hash") == places["__text"]), "left"
    ).drop("__doc", "__text", "__hash")
    value = F.coalesce(F.col(text), F.lit(""))
    n_lines = F.char_length(value) - F.char_length(F.replace(value, F.lit("\n"), F.lit(""))) + 1
    all_lines = F.split(value, "\n")
    rest = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "__places")
    kept = F.get(
        F.transform(F.array(all_lines), lambda xs: F.array_join(F.transform(rest, lambda i: F.get(xs, i)), "\n")), 0
    )
    return rows.select(
        *docs.columns,
        n_lines.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__places"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("__places").isNull(), value).otherwise(kept).alias("kept_text"),
    )
