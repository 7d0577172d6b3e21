"""The stored grid against plain sorting and searching."""

import random

import pytest
from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.operators.grid import LIST, READING, read_page, store_grid
from candidata.operators.ranking import grid_query

def order():
    return [F.col("name"), F.desc("id")]


def people(n=600):
    draw = random.Random(5)
    some = ["Ann", "bob", "Größe", "日本語 x", "", None, "aaaa", "aaa a", "o'Neil %_", "tab\there", "x😀y z"]
    return [(i, draw.choice(some), draw.choice(some), draw.random() if i % 3 else None) for i in range(n)]


@pytest.fixture(scope="module")
def grid(spark):
    rows = spark.createDataFrame(people(), "id long, name string, `two words` string, x double").repartition(3)
    path = fresh_path(spark, "grid")
    store_grid(rows, order(), path, parts=7)
    return rows, path


@pytest.mark.parametrize(
    "terms, offset, limit",
    [
        ([], 0, 10), ([], 595, 20), ([], 100, None), ([], 700, 5), ([], 0, 0), (["ANN"], 0, 7), (["ann", "bob"], 3, 5), (["größe"], 0, None),
        (["本語 x"], 2, 9), (["aaa"], 0, None), (["aaaa"], 1, 3), (["a a"], 0, 4), (["a"], 10, 10), (["l "], 0, None), (["%_"], 0, 3),
        (["no such"], 0, 5), (["0.1"], 0, 5), (["", "bob"], 0, 3), (["ann ann"], 0, 9), (["\there"], 0, 2), (["7"], 5, 5),
        (["😀y"], 1, 4), (["😀"], 0, None), (["x😀y z"], 0, 3),
    ],
)
def test_pages(spark, grid, terms, offset, limit):
    rows, path = grid
    expected = grid_query(rows, [t for t in terms if t], order(), offset, limit).collect()
    assert read_page(spark, path, terms, offset, limit).collect() == expected


def test_empty_grid(spark):
    rows = spark.createDataFrame([], "id long, name string")
    path = fresh_path(spark, "grid")
    store_grid(rows, [F.col("id")], path)
    assert read_page(spark, path).collect() == [] == read_page(spark, path, ["a"]).collect()


def test_a_run_has_a_row_for_many_characters(spark):
    """The index has a row per run and part, not one per character; a long row is indexed whole."""
    rows = spark.createDataFrame([(i, "aaaa " * 50) for i in range(200)] + [(999, "xyz" * 400_000)], "id long, name string")
    path = fresh_path(spark, "grid")
    store_grid(rows, [F.col("id")], path, parts=2)
    assert spark.read.parquet(f"{path}/grams").count() < 1000
    assert [r["id"] for r in read_page(spark, path, ["aaaa a"], 150, 3).collect()] == [150, 151, 152]
    assert [r["id"] for r in read_page(spark, path, ["yzxyzx"]).collect()] == [999]


def test_lists_of_places_are_bounded(spark):
    """A frequent run has many lists, as readers hold some rows of the index at once; pages join them again."""
    rows = spark.createDataFrame([(i, "ab ab " * (i % 7)) for i in range(3000)], "id long, name string")
    path, before = fresh_path(spark, "grid"), spark.conf.get(READING)
    store_grid(rows, [F.col("id")], path, parts=2)
    longest, n = spark.read.parquet(f"{path}/grams").filter("gram = 'ab '").agg(F.max(F.size("at")), F.sum(F.size("at"))).first()
    assert longest == LIST and n == sum(2 * (i % 7) for i in range(3000))
    shown = [r["id"] for r in read_page(spark, path, ["b ab a"], 100, 1000).collect()]
    assert shown == [i for i in range(3000) if i % 7 > 1][100:1100]
    assert spark.conf.get(READING) == before
