"""Reading documents from files, and exports to files."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.inference.client import SLICE, OfflineClient, answered
from candidata.operators.extraction import attempts_of, extract_documents
from candidata.operators.records import ALL_EXHAUSTED, NO_ATTEMPT_WORKED
from candidata.plans import fixtures
from candidata.sinks import exports
from candidata.sources import documents
from candidata.sources.records import scan_candidates
from conftest import SMALL

FILES = {
    "Zürich.TXT": "Grüße\r\naus Zürich\rEnde".encode(),
    "latin.txt": "café".encode("latin-1"),
    "blank.txt": b" \n\t",
    "archive.tar.gz": b"x",
    ".hidden": b"x",
    "sub/deep.pdf": b"%PDF",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(content)
    return str(root)


def test_scan_and_decode(spark, folder):
    rows = documents.scan_documents(spark, folder).withColumn("text", documents.decode_text(F.col("content"))).collect()
    got = {r["filename"]: (r["extension"], r["text"]) for r in rows}
    assert got["Zürich.TXT"] == (".txt", "Grüße\naus Zürich\nEnde")
    assert got["latin.txt"] == (".txt", "café")
    assert got["archive.tar.gz"][0] == ".gz" and got["deep.pdf"][0] == ".pdf"
    assert ".hidden" not in got


def test_extension(spark):
    names = ["a.PDF", ".hidden", "x", "a.b.txt", "a.", ".x.doc"]
    df = spark.createDataFrame([(n,) for n in names], "n string").coalesce(1)
    got = [r[0] for r in df.select(documents.extension(F.col("n"))).collect()]
    assert got == [".pdf", "", "", ".txt", ".", ".doc"]


def test_extraction_gives_a_record_or_a_reason(spark, folder):
    files = documents.scan_documents(spark, folder)
    records = extract_documents(files, OfflineClient, attempts_of(("p2", "m1"), ("p1", "m2")), ["p2"]).collect()
    got = {r["filename"]: r for r in records}
    assert got["latin.txt"]["summary"] == "m1 read 4 characters" and got["latin.txt"]["text_length"] == 4
    assert got["latin.txt"]["personal_info"]["email"] == "r4@mail.example.org"
    assert got["deep.pdf"]["error"] == "No parsed text for .pdf file" and not got["deep.pdf"]["success"]
    assert got["blank.txt"]["error"] == documents.NO_TEXT and not got["blank.txt"]["success"]
    assert got["archive.tar.gz"]["error"].startswith('File "archive.tar.gz" is not supported.')
    assert all(r["skills"] == [] for r in records if not r["success"])
    nobody = extract_documents(files, OfflineClient, attempts_of().cast("array<struct<provider:string,model:string>>"), ["p2"])
    assert {r["filename"]: r["error"] for r in nobody.collect()}["latin.txt"] == ALL_EXHAUSTED


def test_a_client_that_always_fails_says_why(spark, folder):
    class NoKey:
        def __call__(self, prompt, provider, model):
            raise PermissionError("no key")

    files = documents.scan_documents(spark, folder).filter("filename = 'latin.txt'")
    row = extract_documents(files, NoKey, attempts_of(("p2", "m1"), ("p1", "m2")), ["p2"]).first()
    assert (row["error"], row["cause"]) == (NO_ATTEMPT_WORKED, "PermissionError: no key")


def test_a_type_may_be_accepted_without_a_reader(spark):
    df = spark.createDataFrame([("a.bin", "text/plain"), ("b.bin", None), ("c.XLSX", None)], "filename string, mime_type string")
    rows = {r["filename"]: r for r in documents.route_by_format(df).collect()}
    assert rows["a.bin"]["accepted"] and rows["a.bin"]["error"].endswith("Unsupported file type: .bin")
    assert not rows["b.bin"]["accepted"]
    assert rows["c.XLSX"]["reader"] == "sheets" and rows["c.XLSX"]["error"] is None


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_sheets_are_aligned(spark, block):
    sheets = {"One": [["name", "n"], ["x", "10"], ["longer", None]], "Two": [["only\ttab"], ["y"]]}
    cells = [
        ("d", p, name, r, c, v)
        for p, (name, rows) in enumerate(sheets.items())
        for r, row in enumerate(rows)
        for c, v in enumerate(row)
    ]
    df = spark.createDataFrame(cells, "doc string, p int, sheet string, r int, c int, v string").repartition(3)
    got = documents.assemble_sheet_text(df, "doc", "p", "sheet", "r", "c", "v", block).first()["text"]
    expected = ""
    for name, rows in sheets.items():
        shown = pd.DataFrame(rows[1:], columns=rows[0]).fillna("").to_string(index=False)
        expected += f"Sheet: {name}\n{shown}\n\n"
    assert got == expected


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_parts_and_tables(spark, block):
    parts = spark.createDataFrame([("d", i, f"p{i}") for i in range(12)], "doc string, i int, t string").repartition(4)
    text = documents.assemble_text(parts, "doc", "i", "t", block=block).first()["text"]
    assert text == "".join(f"p{i}\n" for i in range(12))
    cells = spark.createDataFrame(
        [("d", t, r, c, None if (r, c) == (1, 1) else f"{t}{r}{c}") for t in range(2) for r in range(3) for c in range(2)],
        "doc string, t int, r int, c int, v string",
    ).repartition(4)
    got = documents.assemble_table_text(cells, "doc", "t", "r", "c", "v", block).first()["text"]
    assert got == "000 001 \n010  \n020 021 \n100 101 \n110  \n120 121 \n"


def test_exports(spark):
    records = fixtures.stored_candidates(spark, SMALL)
    with pytest.raises(ValueError, match="Unsupported format"):
        exports.export(records, "docx", "/nowhere")
    path = fresh_path(spark, "export")
    exports.export(records, "Xlsx", path)
    for sheet in ("Summary", "Detailed"):
        back = spark.read.options(header=True, escape='"', multiLine=True).csv(f"{path}/{sheet}")
        assert back.count() == records.count()
    path = fresh_path(spark, "export")
    exports.export(records, "parquet", path)
    assert spark.read.parquet(path).count() == records.count()
    path = fresh_path(spark, "export")
    exports.write_json(records, path)
    assert scan_candidates(spark, path).count() == records.count()


def test_csv_has_the_columns_of_the_longest_record(spark):
    people = fixtures.stored_candidates(spark, SMALL)
    uneven = people.withColumn("experience", F.slice("experience", 1, F.when(F.col("candidate_id") == 5, 3).otherwise(1)))
    flat = exports.flatten_csv(uneven)
    assert "experience_3_title" in flat.columns and "experience_4_title" not in flat.columns
    assert flat.filter("experience_2_title <> ''").count() == 1
    assert exports.flatten_csv(uneven.limit(0)).columns[-1] == "skills"


def test_records_from_arrays_and_of_other_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"skills": "x", "experience": ["did y"]},\n {"filename": "b", "success": true}]')
    first, second = scan_candidates(spark, str(tmp_path), multi_line=True).collect()
    assert first["skills"] == ["x"] and first["experience"][0]["title"] == "did y"
    assert second["filename"] == "b" and second["success"] and second["skills"] is None


def test_answers_are_passed_on_in_parts():
    """A batch of many requests is answered part by part; an empty one is passed on."""
    rows = pd.DataFrame({"prompt": [f"{n}" for n in range(1000)], "other": range(1000)})
    parts = answered(iter([rows, rows[:0]]), lambda: None, lambda client, row: {"body": row["prompt"] + "!"}, ["body"], ["prompt"], 4)
    sizes, got = [], []
    for part in parts:
        sizes.append(len(part))
        got += list(part.itertuples(index=False, name=None))
    assert max(sizes) <= SLICE and sizes[-1] == 0
    assert got == [(f"{n}", n, f"{n}!") for n in range(1000)]
