import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import compare
from candidata.llm import quality_rules
from candidata.llm.queries import QUERIES, SQL
from odd_data import SMALL, documents, empty, odd  # noqa: F401


def base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


def test_query_equals_sql(spark):
    con = compare.connect(SMALL)
    name = "op1_quality_rules"
    assert compare.differences(spark, con, SMALL, QUERIES[name], SQL[name]) == []


def test_base_statistics_of_odd_rows(odd):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert tuple(r[c] for c in quality_rules.BASE) == base(r["text"])
        assert r["kept"] in (True, False) and (r["kept"] is False or not r["base_failed"])


def test_empty(empty):
    assert quality_rules.judge(empty).collect() == []


@pytest.fixture(scope="module")
def hosts(spark):
    """A line in 30 of 40 documents of one host and 3 of another, and 40 copies of one text."""
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    shared = "All  the NEWS that fits"
    rows = [(i, body(i) + (f"\n {shared} \n" if i < 30 else "\n") + body(i + 1000), "h") for i in range(40)]
    rows += [(100 + i, body(100 + i) + ("\n" + shared if i < 3 else ""), "g") for i in range(40)]
    rows += [(200 + i, body(999), "h") for i in range(40)]
    rows += [(300, "\n".join([shared] * 20 + [" ".join(f"v{k}" for k in range(60))]), "h")]
    rows += [(400 + i, body(400 + i), None) for i in range(2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_shared_lines(hosts):
    rows = {r["doc_id"]: r for r in quality_rules.judge(hosts).collect()}
    for i in range(30):
        assert (rows[i]["n_shared_lines"], rows[i]["n_shared_words"], rows[i]["kept"]) == (1, 5, True)
        assert rows[i]["clean_text"].split("\n") == [x for x in rows[i]["text"].split("\n") if "NEWS" not in x]
    assert all(rows[i]["n_shared_lines"] == 0 and rows[i]["clean_text"] == rows[i]["text"] for i in range(30, 40))
    # Few documents of the other host have the line; copies of one text count once.
    assert all(rows[i]["n_shared_lines"] == 0 and rows[i]["kept"] for i in [*range(100, 140), *range(200, 240), 400, 401])
    # A document that is mostly shared lines is depleted.
    assert rows[300]["n_shared_lines"] == 20 and not rows[300]["kept"]


def test_no_python_and_no_text_in_shuffles(documents):
    df = quality_rules.judge(documents).drop("text", "clean_text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert df.agg(F.count("*")).first()[0] == documents.count()


def test_limits_do_not_depend_on_the_size_of_a_host(spark):
    """A line in 26 of 60 and in 26 of 900 texts of a host goes; one in 6 stays, and one that near copies share."""
    word = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    body = lambda i: [word(10 * i + k) for k in range(6)]
    rows = []
    for host, n in (("small", 60), ("large", 900)):
        for i in range(n):
            lines = body(len(rows)) + (["a line of many texts"] if i < 26 else []) + (["a line of six texts"] if i % (n // 6) == 0 else [])
            rows.append((len(rows), "\n".join(lines), host))
    base = body(5000)
    # Near copies: one of their lines is another in each.
    for i in range(200):
        rows.append((len(rows), "\n".join(base[: i % 6] + [word(90_000 + i)] + base[i % 6 + 1 :]), "small"))
    long = " ".join(f"long{k}" for k in range(55))
    for i in range(12):
        rows.append((len(rows), "\n".join(body(7000 + i) + [long, f"short line {i % 2}"]), f"host{i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    lost = {r["doc_id"]: set((r["text"]).split("\n")) - set(r["clean_text"].split("\n")) for r in quality_rules.judge(df).collect()}
    for i, (_, text, host) in enumerate(rows):
        expected = {x for x in text.split("\n") if x in ("a line of many texts", long)}
        assert lost[i] == expected, (i, host, lost[i])
