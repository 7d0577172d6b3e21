import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from candidata.llm import collocations
from candidata.llm.queries import QUERIES, SQL
from odd_data import SMALL, documents, empty, odd  # noqa: F401

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string"


def brute(rows, min_count=100, top=2000):
    """All counts of all phrases, scored and dropped as the definition says."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(AZ)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for m in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        phrases = [g for g, c in f.items() if len(g) > 1 and c >= min_count]
        inside = defaultdict(int)
        for g in phrases:
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inside[g[i : i + m]] = max(inside[g[i : i + m]], f[g])
        found = []
        for g in phrases:
            score, k = min((1000 * f[g] * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            if inside[g] < f[g]:
                found.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]], n))
        for rank, (s, a, p, left, right, n) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_query_equals_sql(spark):
    name = "op13_collocations"
    assert compare.differences(spark, compare.connect(SMALL), SMALL, QUERIES[name], SQL[name]) == []


def corpus(seed, n=500):
    """Frequent words at random, some fixed phrases of rare and of frequent words, and pieces of their own."""
    draw = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    fixed = ["ra rb", "ra rb rc", "the rd", "the re rf", "rg the rh ri rj", "rg the rh ri rj", "c1 c2 c3", "rk rk rk", "ñandú é"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(1, 5)):
            words = [draw.choice(common) if draw.random() < 0.7 else "the" for _ in range(draw.randint(0, 6))]
            words.insert(draw.randint(0, len(words)), draw.choice(fixed).upper() if draw.random() < 0.3 else draw.choice(fixed))
            parts.append((" " if draw.random() < 0.8 else " \t ").join(words))
        text = draw.choice([". ", ",", "\n", " ;; "]).join(parts)
        rows.append((text if i % 50 else None, ["en", "de", None][i % 3] if i % 7 else "en"))
    return rows


@pytest.mark.parametrize("seed, top, min_count, steps", [(1, 3, 5, 4), (3, 400, 5, 6)])
def test_growth_and_bounds(spark, monkeypatch, seed, top, min_count, steps):
    monkeypatch.setattr(collocations, "CLASS", steps)
    # Many slices and blocks per batch.
    monkeypatch.setattr(collocations, "SLICE_BYTES", 3000)
    monkeypatch.setattr(collocations, "BLOCK", 400)
    monkeypatch.setattr(collocations, "PLACES", 70)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(collocations.collocations(df, min_count=min_count, top=top)) == brute(rows, min_count, top)


def test_frequent_words_are_never_expanded(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CLASS", 3)
    rows = corpus(4)
    df = spark.createDataFrame(rows, SCHEMA)
    blocks, words = collocations.read_corpus(df, "text", "lang", collocations.hashed_words)
    search = collocations.Search(blocks, words, 5, 3)
    search.run()
    left = {r["word"] for r in search.words.join(search.unexpanded(), ["lang", "h"], "left_semi").collect()}
    every = {r["word"] for r in search.words.collect()}
    assert "the" in left and left < every


def test_words_with_one_hash_are_hashed_anew(spark):
    good = collocations.hashed_words

    def weak_hash(words, lang, seed):
        """Collides at the first seed only."""
        return [h % 7 if seed == 1 else h for h in good(words, lang, seed)]

    rows = [("one two three. one two", "en")] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(collocations.collocations(df, min_count=20, top=9, hash_words=weak_hash)) == brute(rows, 20, 9)


def test_false_hits_of_the_maps_change_nothing(spark, monkeypatch):
    inside = collocations._inside

    def often(bits, keys):
        return inside(bits, keys) | ((keys >> np.uint64(40)) % np.uint64(3) == 0)

    rows = corpus(5, 300)
    monkeypatch.setattr(collocations, "CLASS", 5)
    monkeypatch.setattr(collocations, "_inside", often)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(collocations.collocations(df, min_count=5, top=4)) == brute(rows, 5, 4)


def test_odd_rows_ties_and_empty(spark, odd, empty):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert got(collocations.collocations(odd, min_count=2, top=5)) == brute(rows, 2, 5)
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(odd.limit(1).withColumn("text", F.lit(None).cast("string"))).collect() == []
    # Ten phrases of equal score; the order by bytes takes the first four.
    ties = [(f"x{c} y{c}", "en") for c in "jihgfedcbaé" for _ in range(5)]
    df = spark.createDataFrame(ties, SCHEMA)
    assert [r["phrase"] for r in collocations.collocations(df, min_count=5, top=4).orderBy("rank").collect()] == ["xa ya", "xb yb", "xc yc", "xd yd"]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**15
    phrases = spark.createDataFrame([("en", [1, 2], big)], "lang string, gram array<bigint>, f bigint")
    counts = spark.createDataFrame([("en", [1], big + 7), ("en", [2], big + 11)], "lang string, gram array<bigint>, f bigint")
    totals = spark.createDataFrame([("en", 10**16)], "lang string, n bigint")
    row = collocations.scored(phrases, counts, totals).first()
    assert row["bound"] == 1000 * big * 10**16 // ((big + 7) * (big + 11)) and row["exact"]


def test_blocks_of_many_words(spark, monkeypatch):
    """Places of four bytes where a block has more different words than two bytes can tell."""
    rows = [(" ".join(f"v{i}x{k}" for k in range(400)) + ". ra rb, rc", "en") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    blocks, _ = collocations.read_corpus(df, "text", "lang", collocations.hashed_words)
    assert {r["width"] for r in blocks.select("width").collect()} == {4}
    assert got(collocations.collocations(df, min_count=100, top=9)) == brute(rows, 100, 9)


def test_blocks_end_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 4)
    ids = np.array([1, 2, 3, -1, 4, -1, 5, 6, 7, 8, 9, 10, -1, -1, 2, -1])
    found = list(collocations._blocks(ids))
    assert np.concatenate(found).tolist() == ids.tolist() and all(b[-1] == -1 for b in found) and len(found) == 3
    assert [s.stop - s.start for s in collocations._slices(np.full(5, 1 << 21))] == [1, 2, 2]
