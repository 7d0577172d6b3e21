"""A grid kept on disk in its order, for pages and searches that read only what they show.

The rows lie in parts by ranges of the order, one folder each. A small table has the number of rows
before every part, so a page knows its parts. The search index holds every run of three
characters with the places it has in the rows; it tells which rows contain a term without
reading them. The places of a run are kept as lists, so that there is a row per run and some
`CHARS` characters, not one per character. Spark's reader holds some rows of a file at once, and those
of a frequent run lie side by side, so a list has at most `LIST` places and `READ` rows are held.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.operators.positions import ROW_BITS

GRAM = 3
#: Stands behind the last character of a row, so that every character begins a run.
END = "\x00"
#: Folders of the search index, by the first character of the run.
BUCKETS = 64
#: A row per run and some of the characters: the rows it is in, and where it begins in each.
PLACES = "gram string, _part bigint, _place array<bigint>, at array<int>"
GRAMS = PLACES + ", bucket int"
#: Characters of one part of the rows that a task indexes at a time, or those of one row.
CHARS = 1 << 20
#: Places in a list; a run that has more in these characters has several rows.
LIST = 1 << 11
#: Rows of the index that a task holds at a time when it reads them.
READ = 1 << 7
# Fixed name: the setting for the rows of a Parquet file that are read at a time.
READING = "spark.sql.parquet.columnarReaderBatchSize"


@contextlib.contextmanager
def _few_rows_read(spark: SparkSession) -> Iterator[None]:
    """Parquet files that are read by jobs in this block are read by `READ` rows."""
    before = spark.conf.get(READING)
    spark.conf.set(READING, READ)
    try:
        yield
    finally:
        spark.conf.set(READING, before)


def row_text(grid: DataFrame) -> Column:
    """What a search looks at: all columns in lower case, a blank between them."""
    return F.lower(F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in grid.columns]))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.ascii(gram), F.lit(BUCKETS)).alias("bucket")


def store_grid(grid: DataFrame, order: Sequence[Column], path: str, parts: int | None = None, search: bool = True) -> None:
    """Store a grid in `parts` parts (Spark's choice by default) with its page table and search index.

    `order` should tell rows apart. Rows keep their columns; `_part` and `_place` are added.
    """
    by = [parts, *order] if parts else order
    placed = grid.repartitionByRange(*by).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", ROW_BITS), F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)
    rows = written(placed, "grid").withColumns({"_part": part, "_place": place}).drop("_id")
    rows.write.partitionBy("_part").parquet(f"{path}/rows")
    # Without rows there is no file that has the columns.
    rows.limit(0).write.parquet(f"{path}/shape")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # A row per part, whatever the number of rows.
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    sizes.withColumn("_before", before).coalesce(1).write.parquet(f"{path}/parts")
    if search:
        text = row_text(rows.drop("_part", "_place"))
        index = search_index(rows, text)
        by_gram = [F.col("bucket"), F.col("gram"), F.col("_part")]
        # Stored first: the borders of the ranges are found in a sample, which reads all of it.
        index = written(index, "runs").repartitionByRange(*by_gram).sortWithinPartitions(*by_gram)
        with _few_rows_read(grid.sparkSession):
            index.write.partitionBy("bucket").parquet(f"{path}/grams")


def search_index(rows: DataFrame, text: Column) -> DataFrame:
    """(bucket, gram, _part, _place, at): each run of three characters, and where it begins.

    `_place` and `at` are lists of the same length, in order. A run has a row for each `CHARS`
    characters of a part that it stands in, and for each `LIST` places in these.
    """
    read = rows.select("_part", "_place", text.alias("text")).filter(F.char_length("text") > 0)
    return read.mapInArrow(_postings, PLACES).select(_bucket(F.col("gram")), "gram", "_part", "_place", "at")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each batch, by slices of its rows within one part."""
    for batch in batches:
        part = np.asarray(batch.column("_part"))
        filled = np.cumsum(np.asarray(pc.utf8_length(batch.column("text")), np.int64))
        first = 0
        while first < len(part):
            room = (filled[first - 1] if first else 0) + CHARS
            last = max(first + 1, int(np.searchsorted(filled, room, side="right")))
            other = np.flatnonzero(part[first:last] != part[first])
            last = first + int(other[0]) if len(other) else last
            yield _posted(int(part[first]), batch.slice(first, last - first))
            first = last


def _posted(part: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    """The runs of some rows of a part, sorted, with their places."""
    ended = [t + END * (GRAM - 1) for t in rows.column("text").to_pylist()]
    sizes = np.array([len(t) for t in ended])
    chars = np.frombuffer("".join(ended).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    # A run begins at every character of a row but those after its end. A character has 21 bits.
    runs = sizes - (GRAM - 1)
    at = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = at + np.repeat(starts, runs)
    code = (chars[begin] << 42) | (chars[begin + 1] << 21) | chars[begin + 2]
    order = np.argsort(code, kind="stable")
    code = code[order]
    new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    lists = -(-np.diff(np.append(new, len(code))) // LIST)
    nth = np.arange(lists.sum()) - np.repeat(np.cumsum(lists) - lists, lists)
    new = np.repeat(new, lists) + LIST * nth
    grams = ["".join(map(chr, (c >> 42, (c >> 21) & 0x1FFFFF, c & 0x1FFFFF))) for c in code[new].tolist()]
    ends = pa.array(np.append(new, len(code)).astype(np.int32))
    place = np.repeat(np.asarray(rows.column("_place")), runs)[order]
    values = {
        "gram": pa.array(grams, pa.string()),
        "_part": pa.array(np.full(len(new), part, np.int64)),
        "_place": pa.ListArray.from_arrays(ends, pa.array(place, pa.int64())),
        "at": pa.ListArray.from_arrays(ends, pa.array(at[order].astype(np.int32))),
    }
    return pa.RecordBatch.from_pydict(values)


def _holding(index: DataFrame, term: str) -> DataFrame:
    """(_part, _place) of the rows that contain a term: its runs, each at its distance from the first."""
    last = max(len(term) - GRAM, 0)
    places = sorted({*range(0, last + 1, GRAM), last})
    wanted = [(term[p : p + GRAM], p) for p in places]
    is_gram = lambda g: F.col("gram") == g if len(g) == GRAM else F.col("gram").startswith(g)
    # The bucket of a constant is a constant, by which folders are left out.
    hits = [((F.col("bucket") == _bucket(F.lit(g))) & is_gram(g), p) for g, p in wanted]
    lists = index.filter(reduce(lambda a, b: a | b, [h for h, _ in hits]))
    offsets = F.array_compact(F.array(*[F.when(h, F.lit(p)) for h, p in hits]))
    # A run that stands twice in the term is there at each of its distances.
    lists = lists.select("_part", "_place", "at", F.explode(offsets).alias("offset"))
    starts = lists.select("_part", "offset", F.inline(F.arrays_zip("_place", "at")))
    full = starts.groupBy("_part", "_place", (F.col("at") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= len(wanted))
    return full.select("_part", "_place").distinct()


def read_page(spark: SparkSession, path: str, terms: Sequence[str] = (), offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows `offset` to `offset + limit` of those that contain all terms, in the order of the grid.

    Without terms the page table says which parts hold them. With terms the index gives the places of
    all rows that contain them; their number per part says which parts hold the page. Only these
    parts of the grid are read; the driver gets the numbers of the first and the last.
    """
    rows = spark.read.schema(spark.read.parquet(f"{path}/shape").schema).parquet(f"{path}/rows")
    terms = [t.lower() for t in terms if t]
    if terms:
        index = spark.read.schema(GRAMS).parquet(f"{path}/grams")
        found = [_holding(index, t) for t in terms]
        with _few_rows_read(spark):
            places = written(reduce(lambda a, b: a.join(b, ["_part", "_place"], "left_semi"), found), "hits")
        sizes = places.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
        # A row per part that has hits.
        before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
        parts = written(sizes.withColumn("_before", before), "hit-parts")
    else:
        places, parts = None, spark.read.parquet(f"{path}/parts")
    on_page = F.col("_before") + F.col("_size") > offset
    if limit is not None:
        on_page &= F.col("_before") < offset + limit
    first, last = parts.filter(on_page).agg(F.min("_part"), F.max("_part")).first()
    in_parts = F.col("_part").between(first, last) if first is not None else F.lit(False)
    shown, parts = rows.filter(in_parts), parts.filter(in_parts).select("_part", "_before")
    if terms:
        # Numbered within the part, among the hits only.
        by_place = Window.partitionBy("_part").orderBy("_place")
        numbered = places.filter(in_parts).withColumn("_n", F.row_number().over(by_place))
        shown = shown.join(numbered, ["_part", "_place"])
    else:
        shown = shown.withColumn("_n", F.col("_place") + 1)
    number = F.col("_before") + F.col("_n")
    page = shown.join(parts, "_part").withColumn("_row", number).filter(F.col("_row") > offset)
    page = page if limit is None else page.filter(F.col("_row") <= offset + limit)
    return page.orderBy("_row").drop("_part", "_place", "_n", "_before", "_row")
