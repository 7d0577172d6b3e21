"""Functions on text, against plain Python on the same texts."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candidata.functions import measures, text

SAMPLES = [
    "",
    " ",
    "python",
    "node.js",
    "o'neil mc-donald",
    "straße ßa ÉCOLE éa",
    "c++ c# 3d 4TH",
    "中a b中C",
    "ǆungla ΟΔΟΣ",
    "  x \x1c",
    "mail me: joe.x+y@mail.example.co.uk, or ann@x.org",
    "no address: a@b",
    "call +1 (415) 555-0100 now",
    "tel 030 1234567",
    "+91-98765-43210",
    "12345",
    "٣٤٥٦٧٨٩",
    "a@b.c|d end",
]


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_title_case_is_pythons_title(spark):
    assert column(spark, SAMPLES, text.title_case) == [s.title() for s in SAMPLES]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("aB1 .'-éÉñß中Ως", max_size=12), min_size=20, max_size=40))
def test_title_case_on_made_up_words(spark, words):
    assert column(spark, words, text.title_case) == [w.title() for w in words]


def test_strip_and_blank(spark):
    assert column(spark, SAMPLES, text.strip) == [s.strip() for s in SAMPLES]
    assert column(spark, [*SAMPLES, None], text.is_blank) == [not s.strip() for s in SAMPLES] + [True]


def test_email_and_phone(spark):
    def email(s):
        found = re.search(text.EMAIL, s)
        return found.group(0) if found else s

    def phone(s):
        found = re.search(text.PHONE, s)
        return re.sub(r"[^\d\+\-\(\)]", "", found.group(0)) if found else s

    assert column(spark, SAMPLES, text.normalize_email) == [email(s) for s in SAMPLES]
    assert column(spark, SAMPLES, text.normalize_phone) == [phone(s) for s in SAMPLES]
    assert column(spark, [None], text.normalize_email) == [None]


@pytest.mark.parametrize(
    "given_, compat, strict",
    [
        (["python", "python"], ["Python", "Python"], ["Python"]),
        (["Python", "Python"], ["Python"], ["Python"]),
        (["python", "Python"], ["Python"], ["Python"]),
        ([" sql ", "", "  ", None, "SQL", "Sql"], ["Sql", "Sql"], ["Sql"]),
        ([], [], []),
    ],
)
def test_clean_skills(spark, given_, compat, strict):
    rows = spark.createDataFrame([(given_,)], "s array<string>")
    row = rows.select(text.clean_skills(F.col("s")), text.clean_skills(F.col("s"), "strict")).first()
    assert (row[0], row[1]) == (compat, strict)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "A", "b ", "B", " ", "c d", "C D"]), max_size=8), min_size=10, max_size=30))
def test_clean_skills_keeps_what_a_running_list_keeps(spark, lists):
    def kept(skills):
        out = []
        for s in (s.strip() for s in skills):
            if s and s not in out:
                out.append(s.title())
        return out

    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, s array<string>")
    got = rows.select("i", text.clean_skills(F.col("s")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [kept(v) for v in lists]


def test_terms_and_phrases(spark):
    assert column(spark, [" a , b,, c d ,"], text.normalize_terms) == [["a", "b", "c d"]]
    words = "Brand#11, Node.js. C++ (SQL); new  york: x."
    assert column(spark, [words], text.search_words) == [
        ["brand#11", "node.js", "c++", "sql", "new", "york", "x"]
    ]
    found = {
        phrase: column(spark, [words], lambda c, p=phrase: text.contains_phrase(text.search_text(c), text.search_text(F.lit(p))))[0]
        for phrase in ("brand#1", "brand#11", "NEW york", "york x", "c++", ".", "sql new york")
    }
    assert found == {
        "brand#1": False,
        "brand#11": True,
        "NEW york": True,
        "york x": True,
        "c++": True,
        ".": False,
        "sql new york": True,
    }


def test_parse_percent(spark):
    values = ["85", "85%", " 85.5 %", "n/a", "", None, ".5x", "-3", "1e2", "Infinity", "5.", "+7"]
    expected = [85.0, 85.0, 85.5, 0.0, 0.0, 0.0, 0.5, -3.0, 100.0, float("inf"), 5.0, 7.0]
    assert column(spark, values, measures.parse_percent) == expected


def test_human_bytes(spark):
    sizes = [0, 1, 1023, 1024, 1536, 1048575, 1048576, 1234567890, 5 * 1024**4]
    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").coalesce(1)
    shown = [r[0] for r in rows.select(measures.human_bytes(F.col("n"))).collect()]
    assert shown == ["0 Bytes", "1 Bytes", "1023 Bytes", "1 KB", "1.5 KB", "1024 KB", "1 MB", "1.15 GB", "5120 GB"]


def test_fit_band(spark):
    rows = spark.createDataFrame([(float(n),) for n in (0, 25, 26, 50, 75, 75.5, 100)], "n double").coalesce(1)
    assert [r[0] for r in rows.select(measures.fit_band(F.col("n"))).collect()] == [0, 0, 25, 25, 50, 75, 75]


@pytest.mark.parametrize(
    "period, start, end",
    [
        ("03/2019 - 11/2021", "2019-03-01", "2021-11-01"),
        ("2019 - 2021", "2019-01-01", "2021-12-01"),
        ("05/2020 - Present", "2020-05-01", "2024-07-01"),
        ("06/2018", "2018-06-01", "2018-06-01"),
        ("2018", "2018-01-01", "2018-12-01"),
        ("13/2018 - 01/2019", None, "2019-01-01"),
        ("soon", None, None),
    ],
)
def test_parse_period(spark, period, start, end):
    as_of = F.lit("2024-07-19").cast("date")
    got = spark.range(1).select(measures.parse_period(F.lit(period), as_of).alias("p")).first()["p"]
    assert (got["start"] and str(got["start"]), got["end"] and str(got["end"])) == (start, end)
