import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from candidata.llm import line_dedup
from candidata.llm.queries import QUERIES, SQL
from odd_data import SMALL, documents, empty, odd  # noqa: F401

NAME = "op11_line_dedup"
AZ = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def expected(rows):
    """(doc_id, n_lines, n_dropped, kept text) by brute force."""
    key = lambda line: line.strip(line_dedup.WHITE).translate(AZ)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        owner = lambda k: min(holders[k], key=lambda x: (x is None, x))
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or owner(key(x)) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()), key=repr)


def test_query_equals_sql(spark):
    assert compare.differences(spark, compare.connect(SMALL), SMALL, QUERIES[NAME], SQL[NAME]) == []


def test_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = line_dedup.dedup_lines(odd)
    assert got(found) == expected(rows)
    assert set(odd.columns) <= set(found.columns)


def test_empty(empty):
    assert line_dedup.dedup_lines(empty).collect() == []


def test_keys_owners_and_ids(spark):
    rows = [
        (5, "A shared line here\nown line number five"), (3, "  a SHARED line here\t\nshort\n"), (9, "a shared line here"),
        (9, "x\na shared line here\nx"), (None, "a shared line here\nonly null one"), (None, "only null one"),
        (7, "own twice 123\nown twice 123"), (8, "short\nÀ shared line here"), (2, "à shared line here"),
        (1, "a shared line"), (4, " a shared line"), (6, "\r\n\na shared line here\r"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(line_dedup.dedup_lines(df)) == expected(rows)


def test_hot_line_is_probed_in_slices(spark):
    rows = [(i, f"the same line in all documents\nline of {i % 50} and others\nalone {i} alone") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    lines = line_dedup.line_hashes(df)
    index = line_dedup.build_index(lines, shard_lines=64)
    assert index.count() == -(-2051 // 64)
    assert index.agg(F.sum("n_lines")).first()[0] == 2051
    places = line_dedup.repeated_places(lines, index, probe_lines=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    per_task = [len(x) for x in places.rdd.glom().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(per_task) == 1999 + 1950 and max(per_task) < 1000
    assert got(line_dedup.dedup_lines(df)) == expected(rows)


def test_a_line_that_is_not_in_the_index_stays(spark):
    old = spark.createDataFrame([(1, "known line one\nknown line two"), (2, "known line one")], "doc_id long, text string")
    new = spark.createDataFrame([(3, "known line one\nknown line two\nnever seen before")], "doc_id long, text string")
    index = line_dedup.build_index(line_dedup.line_hashes(old))
    places = line_dedup.repeated_places(line_dedup.line_hashes(new), index)
    assert [r["__place"] for r in places.collect()] == [0]
    assert line_dedup.repeated_places(line_dedup.line_hashes(new), index.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000])
def test_perfect_hash(n):
    draw = np.random.default_rng(n)
    h1, h2 = draw.integers(0, 2**63, (2, n)).astype(np.uint64)
    if n > 10:
        h1[: n // 2] = h1[0]  # the same first half, told apart by the second
    found = line_dedup.PerfectHash.of(h1, h2)
    assert sorted(found.slots(h1, h2).tolist()) == list(range(n))
    assert n < 1000 or found.sizes.sum() / n < 4.2
    others = found.slots(*draw.integers(0, 2**63, (2, 100)).astype(np.uint64))
    assert ((others >= -1) & (others < max(n, 1))).all()


def test_digest_of_the_query(spark):
    digests = {r["doc_id"]: r["kept_sha256"] for r in QUERIES[NAME](spark, SMALL).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in expected(rows)}
    assert all(re.fullmatch("[0-9a-f]{64}", d) for d in digests.values())
