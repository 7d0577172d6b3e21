"""Documents: reading files, decoding, choosing a reader, putting parts together."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candidata.functions.binding import bind
from candidata.functions.text import is_blank
from candidata.schemas import BINARY_FILE

# Accepted types, readers by extension, messages.
ACCEPTED_MIME_TYPES = (
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "text/plain",
)
READERS = {
    ".pdf": "pages",
    ".doc": "paragraphs",
    ".docx": "paragraphs",
    ".xls": "sheets",
    ".xlsx": "sheets",
    ".txt": "plain",
}
NO_TEXT = "No text content could be extracted from the file"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(name: Column) -> Column:
    """Lower-cased extension with its dot; a leading dot does not start one."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?(\.[^./]*)$", 1))


def _named(files: DataFrame) -> DataFrame:
    name = file_name(F.col("path"))
    return files.withColumns({"filename": name, "extension": extension(name)})


def scan_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All files below a folder, one row each; Spark skips names that start with `.` or `_`."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return _named(reader.load(path))


def stream_documents(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files as they arrive in a folder; a batch takes all there are, or at most so many."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _named(reader.load(path))


def as_one_stream(streams: Sequence[DataFrame]) -> DataFrame:
    """The files of several streams as one; a batch takes from each what a batch of its own would take.

    Planning and committing a batch takes about as long for many folders as for one. Spark makes a task of every few
    files, which would be many short tasks here; a batch has at most two tasks per core instead.
    """
    cores = streams[0].sparkSession.sparkContext.defaultParallelism
    return functools.reduce(DataFrame.unionByName, streams).coalesce(2 * cores)


def drop_repeated_uploads(files: DataFrame | Sequence[DataFrame], delay: str) -> DataFrame:
    """Of files with the same bytes in a stream only the first, as long as they come within `delay`.

    files: a stream, or one for each of several folders. Their files meet in one state, which waits for the folder
    that is furthest behind: no file is late because other folders have newer ones.
    """
    streams = [files] if isinstance(files, DataFrame) else files
    timed = [s.withWatermark("modificationTime", delay) for s in streams]
    marked = (timed[0] if isinstance(files, DataFrame) else as_one_stream(timed)).withColumn("_digest", F.sha2("content", 256))
    return marked.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def decode_text(content: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not UTF-8; line ends become `\\n`."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.regexp_replace(text, "\r\n?", "\n")


def route_by_format(df: DataFrame, name: str = "filename", mime: str = "mime_type") -> DataFrame:
    """Add `accepted`, `extension`, `reader` and `error`.

    A file is accepted for its declared type or its extension; the reader depends on
    the extension alone, so a file accepted for its type may still have none.
    """
    ext = extension(F.col(name))
    by_name = F.lower(F.col(name)).rlike(r"\.(pdf|doc|docx|xls|xlsx|txt)$")
    accepted = F.coalesce(F.col(mime).isin(*ACCEPTED_MIME_TYPES), F.lit(False)) | by_name
    reader = F.lit(None).cast("string")
    for suffix, kind in READERS.items():
        reader = F.when(ext == suffix, kind).otherwise(reader)
    rejected = F.concat(
        F.lit('File "'),
        F.col(name),
        F.lit('" is not supported. Please upload PDF, DOC, DOCX, XLS, XLSX, or TXT files.'),
    )
    unreadable = F.concat(
        F.lit("Error processing file: Error extracting text from "),
        ext,
        F.lit(" file: Unsupported file type: "),
        ext,
    )
    return df.withColumns(
        {
            "accepted": accepted,
            "extension": ext,
            "reader": reader,
            "error": F.when(~accepted, rejected).when(reader.isNull(), unreadable),
        }
    )


def reject_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `success` and `error`: documents without visible text are error records."""
    blank = is_blank(F.col(text))
    return df.withColumns({"success": ~blank, "error": F.when(blank, F.lit(NO_TEXT))})


def append_batch(chosen: DataFrame, added: DataFrame) -> DataFrame:
    """Newly chosen files after those already chosen; repeats are kept."""
    return chosen.unionByName(added, allowMissingColumns=True)


def _joined(items: Column, text: str, end: str) -> Column:
    """Texts of structs in the order of the structs, each followed by `end`."""
    return F.array_join(
        F.transform(F.array_sort(items), lambda x: F.concat(x[text], F.lit(end))), ""
    )


def assemble_text(
    parts: DataFrame, key: str, pos: str, text: str, end: str = "\n", block: int = 1000
) -> DataFrame:
    """One text per document from its numbered parts, each followed by `end`.

    Parts are joined in blocks first, so a document with very many parts is put
    together by many tasks and only its finished blocks meet.
    """
    piece = F.coalesce(F.col(text), F.lit("")).alias("text")
    blocks = parts.groupBy(key, F.floor(F.col(pos) / block).alias("_block")).agg(
        _joined(F.collect_list(F.struct(F.col(pos).alias("pos"), piece)), "text", end).alias("_text")
    )
    return blocks.groupBy(key).agg(
        _joined(F.collect_list(F.struct("_block", F.col("_text").alias("text"))), "text", "").alias(
            "text"
        )
    )


def _cells_text(cells: Column, inside: str, row_end: str, last: str) -> Column:
    """Texts of (row, col, text) cells in order; what follows a cell depends on its row."""

    def laid_out(ordered: Column) -> Column:
        def with_end(cell: Column, i: Column) -> Column:
            following = F.get(ordered, i + 1)
            end = F.when(following.isNull(), last).when(
                following["row"] == cell["row"], inside
            )
            return F.concat(cell["text"], F.coalesce(end, F.lit(row_end)))

        return F.array_join(F.transform(ordered, with_end), "")

    return bind(F.array_sort(cells), laid_out)


def assemble_table_text(
    cells: DataFrame, doc: str, table: str, row: str, col: str, text: str, block: int = 1000
) -> DataFrame:
    """One text per document from table cells: a blank after each cell, `\n` after each row.

    Cells meet in blocks of rows, so a very long table is laid out by many tasks.
    """
    cell = F.struct(
        F.col(row).alias("row"), F.col(col).alias("col"), F.coalesce(text, F.lit("")).alias("text")
    )
    blocks = cells.groupBy(doc, table, F.floor(F.col(row) / block).alias("_block")).agg(
        _cells_text(F.collect_list(cell), " ", " \n", " \n").alias("_text")
    )
    return blocks.groupBy(doc).agg(
        _joined(F.collect_list(F.struct(table, "_block", "_text")), "_text", "").alias("text")
    )


def assemble_sheet_text(
    cells: DataFrame,
    doc: str,
    sheet_pos: str,
    sheet: str,
    row: str,
    col: str,
    text: str,
    block: int = 1000,
) -> DataFrame:
    """One text per workbook: `Sheet: <name>`, then its rows as aligned columns.

    The first row of a sheet is its header. Cells are right-aligned to the widest of
    their column and empty cells stay blank. Widths are a separate aggregate that the
    cells are joined with, so no sheet has to fit into one task.
    """
    page_key = [doc, sheet_pos, sheet]
    cell = F.coalesce(F.col(text), F.lit(""))
    for raw, escaped in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        cell = F.replace(cell, F.lit(raw), F.lit(escaped))
    shown = cells.select(*page_key, row, col, cell.alias("_cell"))
    widths = shown.groupBy(*page_key, col).agg(F.max(F.length("_cell")).alias("_width"))
    padded = F.lpad("_cell", F.col("_width"), F.lit(" "))
    placed = F.struct(F.col(row).alias("row"), F.col(col).alias("col"), padded.alias("text"))
    blocks = (
        shown.join(widths, [*page_key, col])
        .groupBy(*page_key, F.floor(F.col(row) / block).alias("_block"))
        .agg(_cells_text(F.collect_list(placed), " ", "\n", "").alias("_text"))
    )
    # The name of a sheet stands before its first block, an empty line after its last.
    whole = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_text"))), lambda b: b["_text"])
    pages = blocks.groupBy(*page_key).agg(F.array_join(whole, "\n").alias("_text"))
    page = F.concat(F.lit("Sheet: "), F.col(sheet), F.lit("\n"), F.col("_text"))
    return pages.groupBy(doc).agg(
        _joined(F.collect_list(F.struct(sheet_pos, page.alias("text"))), "text", "\n\n").alias("text")
    )
