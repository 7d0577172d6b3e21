"""Benchmark passages in documents: q-gram lemma filter and banded alignment.

A window of m characters that occurs with at most k edits shares at least
m - q + 1 - k * q of its q-grams with its place in the text, and these lie on diagonals at
most k apart. Three steps use this: places dense in benchmark q-grams, counts per window in
overlapping bands of diagonals, and an alignment within the band for those that reach the count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_BITS = 22
PIECE = 1 << 20
END = np.uint32(0xFFFFFFFF)


def normalised(text: str | None) -> np.ndarray:
    """Code points in lower case with single blanks between words."""
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le"), np.uint32)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram; q is a power of two."""
    h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    span, base = 1, np.uint64(0xD6E8FEB86659FD93)
    while span < q:
        if len(h) <= span:
            return np.empty(0, np.uint64)
        h = h[:-span] * base + h[span:]
        h ^= h >> np.uint64(29)
        span *= 2
    return h


def starts(points: np.ndarray) -> list[int]:
    """Every word start, and every eighth character of a longer word (scripts without blanks)."""
    begins = np.concatenate(([0], np.flatnonzero(points == ord(" ")) + 1))
    ends = np.concatenate((begins[1:] - 1, [len(points)]))
    return [at for b, e in zip(begins.tolist(), ends.tolist()) for at in range(b, max(e, b + 1), 8)]


class Windows:
    """The windows of some benchmark items, with an index of their q-grams."""

    def __init__(self, texts: list[str | None], q: int, window: int, edit_rate: float, least: int | None = None):
        self.q = q
        points, keys, place, start, item, number, length = [], [], [], [], [], [], []
        base = 0
        for i, text in enumerate(texts):
            whole = normalised(text)
            size = min(window, len(whole))
            if size < q:
                continue
            last = len(whole) - size
            taken = {(at, size) for at in (*range(0, last, max(1, window // 2)), last)}
            if least is not None and q <= least < len(whole):
                taken |= {(at, least) for at in starts(whole) if at + least <= len(whole)}
                taken.add((len(whole) - least, least))
            for n, (at, size) in enumerate(sorted(taken)):
                start.append(base + at)
                item.append(i)
                number.append(n)
                length.append(size)
            points.append(whole)
            keys.append(grams(whole, q))
            place.append(base + np.arange(len(keys[-1])))
            base += len(whole)
        # The items end to end; windows and q-grams are places there.
        self.points = np.concatenate([*points, np.empty(0, np.uint32)])
        self.start = np.array(start, np.int64)
        self.item, self.number = np.array(item, np.int64), np.array(number, np.int64)
        self.length = np.array(length, np.int64)
        # A budget that leaves at least one q-gram to share.
        self.budget = np.minimum((edit_rate * self.length).astype(np.int64), (self.length - q) // q)
        self.least = self.length - q + 1 - self.budget * q
        keys = np.concatenate([*keys, np.empty(0, np.uint64)])
        place = np.concatenate([*place, np.empty(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], place[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[keys >> np.uint64(64 - TABLE_BITS)] = True

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, band) pairs whose count of shared q-grams reaches the window's least."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        hit = self.table[h >> np.uint64(64 - TABLE_BITS)]
        at = np.flatnonzero(hit)
        if not len(at):
            return none
        # Dense places: the q-grams that lie where any window's region has enough hits.
        reach = int((self.length + self.budget).max()) - self.q + 1
        least = int(self.least.min())
        first = np.searchsorted(at, at - reach, side="right")
        dense = np.arange(len(at)) - first + 1 >= least  # regions that end at a hit
        ends = np.concatenate(([0], np.cumsum(dense)))
        last = np.searchsorted(at, at + reach, side="left")
        at = at[ends[last] > ends[np.arange(len(at))]]
        if not len(at):
            return none
        low = np.searchsorted(self.keys, h[at], side="left")
        n = np.searchsorted(self.keys, h[at], side="right") - low
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        place, at = self.place[entry], np.repeat(at, n)
        order = np.argsort(place, kind="stable")
        place, at = place[order], at[order]
        low = np.searchsorted(place, self.start, side="left")
        n = np.searchsorted(place, self.start + self.length - self.q, side="right") - low
        live = np.flatnonzero(n >= self.least)
        # Windows are counted apart from each other, so many at a time as share about PIECE q-grams.
        group = np.cumsum(n[live]) // PIECE
        found = [none]
        for rows in np.split(live, np.flatnonzero(np.diff(group)) + 1):
            entry = np.repeat(low[rows] - (np.cumsum(n[rows]) - n[rows]), n[rows]) + np.arange(n[rows].sum())
            found.append(self.counted(np.repeat(rows, n[rows]), place[entry], at[entry]))
        owner, band = zip(*found)
        return np.concatenate(owner), np.concatenate(band)

    def counted(self, owner: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of shared q-grams (window, place in the items, place in the text): the (window, band) pairs with enough."""
        if not len(owner):
            return owner, owner
        diagonal = at - (place - self.start[owner])
        band = diagonal // (self.budget[owner] + 1)
        # Bands of two strides overlap by one: a range of k + 1 diagonals lies in one of them.
        keys = np.sort((owner << 40) + (band + (1 << 30)))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
        # With the next band; a band before that is empty has this one's count.
        follows = np.diff(keys, append=-1) == 1
        alone = ~np.concatenate(([False], follows[:-1]))
        total = np.concatenate((counts + np.where(follows, np.append(counts[1:], 0), 0), counts[alone]))
        starts = np.concatenate((keys, keys[alone] - 1))
        owner, band = starts >> 40, (starts & ((1 << 40) - 1)) - (1 << 30)
        enough = total >= self.least[owner]
        return owner[enough], band[enough]

    def matches(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, end, edits) of the windows that occur within their edit budget."""
        owner, band = self.candidates(grams(points, self.q)) if len(points) >= self.q else (np.empty(0, int),) * 2
        found = []
        sizes = self.length[owner] * 4096 + self.budget[owner]
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for at in range(0, len(rows), 512):
                found.append(self.align(points, owner[rows[at : at + 512]], band[rows[at : at + 512]]))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))

    def align(self, points: np.ndarray, owner: np.ndarray, band: np.ndarray):
        """Alignment of windows of one length and budget within their bands, ends free in the text."""
        m, k = int(self.length[owner[0]]), int(self.budget[owner[0]])
        pattern = self.points[self.start[owner, None] + np.arange(m)]
        start = band * (k + 1) - k
        width = 2 * (k + 1) + 2 * k
        across = np.arange(width)
        cost = np.zeros((len(owner), width), np.int32)
        for i in range(m):
            at = start[:, None] + i + across
            inside = (at >= 0) & (at < len(points))
            char = np.where(inside, points[np.clip(at, 0, len(points) - 1)], END)
            step = cost + (char != pattern[:, i : i + 1])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - across, axis=1) + across
        best = cost.argmin(axis=1)
        edits = cost[np.arange(len(owner)), best]
        good = edits <= k
        return owner[good], (start + m + best)[good], edits[good].astype(np.int64)


def pieces(texts: Iterator[str | None], overlap: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int]]]]:
    """Texts laid end to end, about PIECE code points at a time: the points, and for each part
    where it begins, the number of its text, and its place there. Long texts are cut into
    parts that overlap.
    """
    held, parts, size = [], [], 0
    for row, text in enumerate(texts):
        whole = normalised(text)
        for at in range(0, max(1, len(whole)), PIECE):
            part = whole[at : at + PIECE + overlap]
            parts.append((size, row, at))
            held += [part, np.array([END])]
            size += len(part) + 1
            if size >= PIECE:
                yield np.concatenate(held), parts
                held, parts, size = [], [], 0
    if held:
        yield np.concatenate(held), parts


def _scan(
    docs: DataFrame, items: list, q: int, window: int, edit_rate: float, least: int | None, doc_id: str, text: str
) -> DataFrame:
    ids, passages = [x[0] for x in items], [x[1] for x in items]
    shared = docs.sparkSession.sparkContext.broadcast((ids, passages))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, passages = shared.value
        index = Windows(passages, q, window, edit_rate, least)
        overlap = int((index.length + 2 * index.budget).max(initial=0)) + 1
        for batch in batches:
            texts = (t.as_py() for t in batch.column(2))
            for points, parts in pieces(texts, overlap):
                owner, end, edits = index.matches(points)
                if not len(owner):
                    continue
                begins = np.array([p[0] for p in parts])
                part = np.searchsorted(begins, end, side="left") - 1
                rows = np.array([p[1] for p in parts])[part]
                end = end - begins[part] + np.array([p[2] for p in parts])[part]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        batch.column(1).take(pa.array(rows)),
                        pa.array([ids[i] for i in index.item[owner].tolist()], item_type),
                        pa.array(index.number[owner]),
                        pa.array(np.maximum(0, end - index.length[owner])),
                        pa.array(end),
                        pa.array(edits),
                    ],
                    names=names,
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("__text"), F.col(text).alias("t"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    item_type = pa.string() if isinstance(next((x[0] for x in items if x[0] is not None), 0), str) else pa.int64()
    schema = f"doc_id {id_type}, __text bigint, item_id {'string' if item_type == pa.string() else 'bigint'}, __window bigint, start bigint, end bigint, edits bigint"
    names = ["doc_id", "__text", "item_id", "__window", "start", "end", "edits"]
    return rows.mapInArrow(search, schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = 8,
    window: int = 80,
    edit_rate: float = 0.08,
    block_chars: int = 2_000_000,
    least: int | None = 60,
) -> DataFrame:
    """(doc_id, __text, item_id, n_windows, start, end, edits) of documents that hold benchmark passages.

    Items are cut into windows of `window` characters that overlap by half; shorter items are
    one window. Alone, as with a `least` of None, this grid is sure to meet only passages of 1.5 windows or more. With
    a `least`, windows of so many characters are added at every word start and every eighth
    character of longer words: a passage of `least` characters that begins with a word holds
    one, and one of `least` + 8 characters wherever it begins. A window is found where the text holds it with at most `edit_rate` times its
    length edits, in lower case and with single blanks. One row per document and item: windows
    found, the places (in code points of the normalised text; a start is an end less the
    window's length) and the fewest edits.

    The benchmark is the query set. It goes to the tasks in blocks of about `block_chars`
    characters, by a hash of the id, each block in a scan of its own, so what a task holds is
    bounded for any benchmark. Texts are read whole, about a million characters at a time.

    Null and empty texts hold nothing; items of fewer than `q` characters, or null, are never
    found. Null ids are ids. Equal rows give one result. Other columns are not read.
    """
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    scans = []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block).collect()
        if rows or not scans:
            scans.append(_scan(docs, rows, q, window, edit_rate, least, doc_id, text))
    found = reduce(DataFrame.union, scans)
    return found.groupBy("doc_id", "__text", "item_id").agg(
        F.count_distinct("__window").alias("n_windows"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("edits").alias("edits"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **kwargs) -> DataFrame:
    """The documents in which no benchmark passage is found; see `contamination` for the cases.

    Null and empty texts stay, equal rows stay or go together, null ids are ids, all columns are passed on.
    """
    found = contamination(docs, benchmark, doc_id, text, **kwargs)
    found = found.select(F.col("doc_id").alias("__id"), F.col("__text").alias("__hash")).distinct()
    return docs.join(
        found, docs[doc_id].eqNullSafe(found["__id"]) & (F.xxhash64(docs[text]) == found["__hash"]), "left_anti"
    )
