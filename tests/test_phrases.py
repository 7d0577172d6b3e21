"""Phrases in texts, against a plain search."""

import random

from pyspark.sql import functions as F

from candidata.operators import matching, records
from candidata.operators.phrases import longest_phrase, phrase_hits, phrase_index

WORDS = "a b c d e ff g".split()


def held(text, phrase):
    return f" {' '.join(phrase.split())} " in f" {' '.join((text or '').split())} "


def test_hits_equal_a_plain_search(spark):
    draw = random.Random(2)
    prose = lambda n: " ".join(draw.choice(WORDS) for _ in range(n))
    texts = [(i, prose(draw.choice([0, 1, 3, 40]))) for i in range(120)] + [(500, None), (501, "  "), (501, prose(9)), (None, prose(30))]
    phrases = {prose(draw.randint(1, 12)) for _ in range(300)} | {"zz a", "a"}
    rows = spark.createDataFrame(texts, "id long, text string").repartition(4)
    split = lambda c: F.array_remove(F.split(F.trim(c), " +"), "")
    index = phrase_index(spark.createDataFrame([(p,) for p in phrases] * 2 + [(None,), ("",)], "p string"), split("p"))
    assert index.count() == len(phrases) and longest_phrase(index) == max(len(p.split()) for p in phrases)
    hits = phrase_hits(rows, ["id"], split("text"), index, longest_phrase(index))
    assert {tuple(r) for r in hits.collect()} == {(i, p) for i, t in texts for p in phrases if held(t, p)}
    nothing = phrase_index(spark.createDataFrame([], "p string"), split("p"))
    assert longest_phrase(nothing) == 1 and phrase_hits(rows, ["id"], split("text"), nothing, 1).collect() == []


def test_skills_of_twelve_words(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"Knows {long.upper()}, and one two."), (2, long[4:]), (3, None)], "id long, text string")
    skills = spark.createDataFrame([(long.title(),), ("one two",), ("Twelve",), (None,)], "skill string")
    found = {r["id"]: r["skills"] for r in records.rule_extract(docs, "id", "text", skills, "skill").collect()}
    assert found == {1: [long.title(), "Twelve", "one two"], 2: ["Twelve"], 3: []}


def test_ten_thousand_terms_a_job(spark):
    """The index finds what the search of one term after the other finds."""
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["c++", "node.js"]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    terms = ", ".join(prose(draw.randint(1, 4)) for _ in range(10_000)) + ", Node.js, c++, none"
    options = spark.createDataFrame([(1, terms, "3", "x y"), (2, "w1 w2", None, ""), (3, None, None, None)], "job long, required_skills string, min_experience string, nice_to_have string")
    jobs = matching.requirements(options)
    texts = [(i, f" {prose(80)} ", 5.0 if i % 2 else None) for i in range(40)] + [(99, " ", 1.0)]
    described = spark.createDataFrame(texts, "id long, search_text string, years double").withColumn(
        "education", F.array().cast("array<struct<degree:string>>")
    )
    sent = spark.createDataFrame([(i, j) for i, *_ in texts for j in (1, 2, 3)], "id long, job long")
    pairs = matching.pair_candidates(described.join(sent, "id"), jobs, "job")
    found = matching.found_terms(described, sent, jobs, "job", ("id",))
    indexed = matching.check_requirements(pairs.join(found, ["id", "job"], "left"), found="found")
    shown = lambda df: {(r["id"], r["job"]): r["checks"] for r in df.select("id", "job", "checks").collect()}
    assert shown(indexed) == shown(matching.check_requirements(pairs))
