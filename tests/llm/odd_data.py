import random

import pytest

SMALL = "/root/testdata/sf0.001"

#: Columns that carry names of results or of keys elsewhere.
EXTRA = ("size", "kept", "n_words", "shard", "slot", "component_id", "fingerprint", "taken", "verdict", "item_id", "license", "from_dir", "similarity")


def odd_rows():
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(draw.choice(vocabulary) for _ in range(n))

    copy = prose(90)
    texts = [
        (1, prose(80), "a"),
        (2, None, "a"),
        (3, "", "b"),
        (4, " \n\t \x0b", None),
        (None, prose(70), None),
        (None, None, None),
        (5, prose(60_000), "a"),
        (6, copy, "b"),
        (6, copy, "b"),
        (6, prose(55), "c"),
        (7, copy, "a"),
        (8, copy.upper(), "c"),
        (9, copy + " end", "d"),
        (10, "one two\nthree\n\nthree", "d"),
        (11, "x" * 20_000, "e"),
        (12, "a b c " * 50, "e"),
        (13, "Größe naïve é́ ÉCOLE   über 日本語 <|endoftext|> don't İstanbul", "é"),
        (-14, "\n".join(prose(9) for _ in range(30)), "é"),
    ]
    return [(i, t, "en", s, len(t or "")) for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit("other") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
