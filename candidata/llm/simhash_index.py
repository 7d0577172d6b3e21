"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are made in Arrow batches; equal ones are merged before any search. An upper
index node is a masked bit pattern that its fingerprints share. Beneath it they are sorted
by Gray rank, so that neighbours differ in few bits, and split into nodes whose shared bits
are factored out again. Two nodes are compared only while the differences between their
shared bits stay within the limit; a pair of nodes beyond it is pruned with all it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.llm.components import components

LEAF, FANOUT = 32, 8


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest bit first."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)]).view(np.uint8)
        votes += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return votes


def fingerprint(text: bytes | None, width: int, seed: int = 42) -> int:
    """64-bit SimHash of UTF-8 text: its words in ASCII lower case, in shingles of `width`."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n
    )
    ones = 2 * bit_votes(hashes) > n
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, __text, code): id, a hash of the text, and the fingerprint as a signed number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time: a batch of texts is never doubled as Python objects.
            codes = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(codes, np.uint64).view(np.int64))],
                names=["doc_id", "__text", "code"],
            )

    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("__text"), F.col(text).cast("binary").alias("t")
    )
    schema = rows.select("doc_id", "__text", F.lit(0).cast("bigint").alias("code")).schema
    return rows.mapInArrow(make, schema)


def gray_rank(code: Column) -> Column:
    """Place of a code in the Gray sequence, shifted so that signed order is the order of ranks."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def upper_masks(max_bits: int) -> list[int]:
    """Masks of the upper nodes: of max_bits + 2 blocks, two stay equal in any linked pair."""
    edges = np.linspace(0, 64, max_bits + 3).round().astype(int)
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    masks = [x | y for x, y in combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class Forest:
    """Sets of linked codes."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def unite(self, xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist()):
            a, b = self.root(x), self.root(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.parent.setdefault(min(a, b), min(a, b))

    def roots(self, xs: np.ndarray) -> np.ndarray:
        known = self.parent
        return np.array([self.root(x) if x in known else x for x in xs.tolist()], dtype=np.int64)


def near(xs: np.ndarray, ys: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count((xs ^ ys).view(np.uint64)) <= max_bits


class GrayTree:
    """Nodes over codes in Gray order: first LEAF codes each, then FANOUT nodes each."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        size, common, either = LEAF, codes, codes
        step = LEAF
        self.sizes, self.masks, self.values = [], [], []
        while True:
            at = np.arange(0, len(common), step)
            common, either = np.bitwise_and.reduceat(common, at), np.bitwise_or.reduceat(either, at)
            mask = ~(common ^ either)
            self.sizes.append(size)
            self.masks.append(mask)
            self.values.append(common & mask)
            if len(common) == 1:
                return
            step, size = FANOUT, size * FANOUT

    def link(self, forest: Forest, max_bits: int) -> None:
        """Unite all codes that a chain of links within the limit connects."""
        codes, n = self.codes, len(self.codes)
        for step in range(1, LEAF):
            hit = near(codes[:-step], codes[step:], max_bits)
            forest.unite(codes[:-step][hit], codes[step:][hit])
        roots = forest.roots(codes)
        top = len(self.sizes) - 1
        work = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while work:
            level, a, b = work.pop()
            if len(a) > 4096:
                work += [(level, a[4096:], b[4096:])]
                a, b = a[:4096], b[:4096]
            mask, value = self.masks[level], self.values[level]
            # A node's pattern holds its parents' patterns, so this is the accumulated difference.
            differs = np.bitwise_count((mask[a] & mask[b] & (value[a] ^ value[b])).view(np.uint64))
            at = np.arange(0, n, self.sizes[level])
            low, high = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
            settled = (low[a] == high[a]) & (low[a] == low[b]) & (high[a] == high[b])
            go = (differs <= max_bits) & ~settled
            a, b = a[go], b[go]
            if not len(a):
                continue
            if level:
                below = len(self.masks[level - 1])
                i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
                a, b = ((x[:, None] * FANOUT + k).ravel() for x, k in ((a, i), (b, j)))
                fits = (a <= b) & (b < below)
                work.append((level - 1, a[fits], b[fits]))
                continue
            places = np.arange(LEAF)
            for at in range(0, len(a), 256):
                left, right = (x[at : at + 256, None] * LEAF + places for x in (a, b))
                xs, ys = np.broadcast_arrays(left[:, :, None], right[:, None, :])
                fits = (xs < ys) & (ys < n)
                xs, ys = xs[fits], ys[fits]
                hit = near(codes[xs], codes[ys], max_bits) & (roots[xs] != roots[ys])
                forest.unite(codes[xs[hit]], codes[ys[hit]])
            roots = forest.roots(codes)


def link_nodes(nodes: np.ndarray, codes: np.ndarray, forest: Forest, max_bits: int) -> None:
    """Link the codes beneath each upper node; rows are sorted by node and Gray rank."""
    new = np.flatnonzero(np.any(nodes[1:] != nodes[:-1], axis=1)) + 1
    starts = np.concatenate(([0], new))
    sizes = np.diff(np.concatenate((starts, [len(codes)])))
    group = np.repeat(np.arange(len(starts)), sizes)
    small = (sizes <= LEAF)[group]
    most = int(sizes[sizes <= LEAF].max(initial=1))
    for step in range(1, most):
        hit = small[:-step] & (group[:-step] == group[step:]) & near(codes[:-step], codes[step:], max_bits)
        forest.unite(codes[:-step][hit], codes[step:][hit])
    for k in np.flatnonzero(sizes > LEAF):
        GrayTree(codes[starts[k] : starts[k] + sizes[k]]).link(forest, max_bits)


def code_links(codes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct codes -> (a, b) with the same components as all pairs within `max_bits` bits.

    Each code goes beneath every upper node that matches it, fifteen for four bits; any two
    linked codes meet beneath one of them. A task reads nodes one after the other and gives,
    for every set it has linked, the set's codes with the smallest one: at most a row per code
    and task, however many pairs there are. Beneath one node stand only different codes, never documents, but all
    that agree in two of six blocks of bits, about 21: of codes that spread evenly one in two million, of
    a template with many different fingerprints all that share them. A node is linked in one task, which holds
    its codes, eight bytes each; its tree of Gray ranks keeps the work below all pairs.
    """
    masks = F.array(*[F.lit(m).cast("bigint") for m in upper_masks(max_bits)])
    rows = codes.select("code", F.posexplode(masks).alias("mask_id", "mask")).select(
        "mask_id", F.col("code").bitwiseAND(F.col("mask")).alias("bits"), "code"
    )
    rows = rows.repartition("mask_id", "bits").sortWithinPartitions("mask_id", "bits", gray_rank(F.col("code")))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        open_: list[np.ndarray] = []

        def close() -> None:
            rows = np.concatenate(open_)
            link_nodes(rows[:, :2], rows[:, 2], forest, max_bits)
            open_.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)], axis=1)
            # The last node may go on in the next batch; what comes before it is whole.
            last = int(np.flatnonzero(np.append(True, np.any(rows[1:, :2] != rows[:-1, :2], axis=1)))[-1])
            if open_ and (last or np.any(open_[-1][-1, :2] != rows[0, :2])):
                first = np.flatnonzero(np.any(rows[:, :2] != open_[-1][-1, :2], axis=1))[0]
                open_.append(rows[:first])
                close()
                rows, last = rows[first:], last - int(first)
            if last:
                open_.append(rows[:last])
                close()
            open_.append(rows[last:])
        if open_:
            close()
        linked = np.array(list(forest.parent), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(linked), pa.array(forest.roots(linked))], names=["a", "b"])

    return rows.mapInArrow(link, "a bigint, b bigint").filter("a != b")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4
) -> DataFrame:
    """(doc_id, __text, __root, fingerprint, component_id) for every document.

    Fingerprints link at `max_bits` or fewer differing bits; `component_id` is the smallest
    id that chains of links reach. For callers that look for one row of a component where ids
    repeat, `__text` is a hash of the text and `__root` the component itself. Fingerprints are written once, and only codes, never
    texts or documents, meet in the search.

    Texts shorter than a shingle are one shingle; null and empty texts and texts without
    words have fingerprint zero and link like others. A null id is never the smallest unless
    all ids of a component are null. Equal rows get equal results. No other column is read.
    """
    docs_codes = written(fingerprints(docs, doc_id, text, width), "fingerprints")
    codes = docs_codes.groupBy("code").agg(F.min("doc_id").alias("first"))
    codes = written(codes, "codes")
    roots = components(code_links(codes.select("code"), max_bits))
    labels = codes.join(roots, codes["code"] == roots["node"], "left").select(
        "code", "first", F.coalesce("root", "code").alias("root")
    )
    labels = written(labels, "labels")
    smallest = written(labels.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    labels = labels.join(smallest, "root").select(F.col("code").alias("__code"), F.col("root").alias("__root"), "component_id")
    return docs_codes.join(labels, F.col("code") == F.col("__code")).select(
        "doc_id", "__text", "__root", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = 4) -> DataFrame:
    """The documents without near-duplicates: of each component the one of the smallest id stays.

    Among rows of that id the text of smallest hash stays, once.
    """
    found = near_duplicates(docs, doc_id, text, width, max_bits)
    # Ids first, nulls last, so that a null id stays only where there is no other.
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__text")
    stay = found.groupBy("__root").agg(F.min(row).alias("row"))
    stay = stay.select(F.col("row.doc_id").alias("__id"), F.col("row.__text").alias("__hash"))
    rows = docs.join(stay, docs[doc_id].eqNullSafe(stay["__id"]) & (F.xxhash64(docs[text]) == stay["__hash"]))
    return rows.dropDuplicates([doc_id, "__hash"]).drop("__id", "__hash")
