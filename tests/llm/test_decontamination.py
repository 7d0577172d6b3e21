import random

import numpy as np
import pytest

from candidata.llm import decontamination as dec
from odd_data import documents, empty, odd  # noqa: F401


def edits_within(pattern, text):
    """Fewest edits of the pattern anywhere in the text."""
    before = np.zeros(len(text) + 1, int)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(pattern):
        now = np.empty_like(before)
        now[0] = i + 1
        step = np.minimum(before[:-1] + (codes != ord(c)), before[1:] + 1)
        for j in range(len(text)):
            now[j + 1] = min(step[j], now[j] + 1)
        before = now
    return int(before.min())


def normal(text):
    return " ".join((text or "").lower().split())


def brute(docs, items, window=80, rate=0.08, q=8):
    found = {}
    for doc_id, text in docs:
        t = normal(text)
        for item_id, item in items:
            whole = normal(item)
            size = min(window, len(whole))
            if size < q:
                continue
            last = len(whole) - size
            starts = sorted({*range(0, last, window // 2), last})
            best = [edits_within(whole[s : s + size], t) for s in starts]
            good = [b for b in best if b <= min(int(rate * size), (size - q) // q)]
            if good:
                found[doc_id, item_id] = (len(good), min(good))
    return found


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(60)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(k, prose(40)) for k in range(4)] + [(4, prose(9)), (5, "short"), (6, None), (7, ""), (None, prose(30))]

    def edited(text, n):
        text = list(text)
        for _ in range(n):
            at = draw.randrange(len(text))
            text[at : at + draw.choice((0, 1, 2))] = draw.choice(("", "x", "yz"))
        return "".join(text)

    docs = [(k, prose(30) + " " + edited(items[k % 5][1], k % 12) + " " + prose(20)) for k in range(40)]
    docs += [(100 + k, prose(80)) for k in range(10)]
    docs += [(200, None), (201, ""), (202, "a"), (203, items[0][1].upper().replace(" ", "\n ")), (None, items[1][1])]
    docs += [(0, docs[0][1]), (204, items[2][1][:60])]
    return docs, items


def test_equals_brute_force(spark, planted):
    docs, items = planted
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    for blocks in (2_000_000, 300):
        rows = dec.contamination(df, bench, block_chars=blocks, least=None).collect()
        got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["edits"]) for r in rows}
        assert len(rows) == len(got) and got == expected
    gone = {d for d, _ in expected}
    kept = sorted(repr(r["doc_id"]) for r in dec.without_benchmark(df, bench, least=None).collect())
    assert kept == sorted(repr(d) for d, _ in docs if d not in gone)


def test_long_texts_are_read_whole(spark, planted, monkeypatch):
    docs, items = planted
    filler = "lorem " * 3000
    points = dec.normalised(filler * 3 + items[0][1] + " " + filler)
    index = dec.Windows([x[1] for x in items], 8, 80, 0.08)
    monkeypatch.setattr(dec, "PIECE", 5000)
    text = filler * 3 + items[0][1] + " " + filler
    overlap = int((index.length + 2 * index.budget).max()) + 1
    windows = set()
    for part, _ in dec.pieces(iter([None, text, ""]), overlap):
        windows |= set(index.matches(part)[0].tolist())
    assert windows == set(index.matches(points)[0].tolist()) and len(windows) > 2


def test_leaks_in_documents(spark, documents):
    from odd_data import SMALL

    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [normal(r["text"]) for r in bench.collect()]
    exact = {r["doc_id"] for r in documents.collect() if any(i in normal(r["text"]) for i in items)}
    got = {r["doc_id"] for r in dec.contamination(documents, bench).collect()}
    assert got == exact


def test_odd_and_empty(spark, odd, empty):
    bench = spark.createDataFrame([(1, "nothing like any of these texts")], "item_id long, text string")
    assert dec.contamination(odd, bench).collect() == []
    assert dec.without_benchmark(odd, bench).count() == odd.count()
    assert dec.without_benchmark(odd, bench.limit(0)).columns == odd.columns
    assert dec.contamination(empty, bench).collect() == []


def test_every_start(spark):
    """Passages of 60 characters off the grid, from every word and every character of long words."""
    draw = random.Random(9)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    item, unbroken = " ".join(word(draw.randint(2, 8)) for _ in range(60)), word(300)
    begins = [0] + [i + 1 for i, c in enumerate(item) if c == " "]
    passages = [item[b : b + 60] for b in begins if b + 60 <= len(item)]
    passages += [item[b : b + 68] for b in range(0, len(item) - 68, 5)] + [unbroken[b : b + 68] for b in range(0, 232, 3)]
    passages += [p[:20] + "#" + p[21:50] + p[51:] + "?" for p in passages[:20]]
    short = [item[b : b + 45] for b in begins[:5]]
    docs = [(i, f"{word(70)} {p} {word(70)}") for i, p in enumerate(passages + short)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, item), (2, unbroken), (3, "tiny"), (4, None)], "item_id long, text string")
    rows = dec.contamination(df, bench, least=60).collect()
    assert {r["doc_id"] for r in rows} == set(range(len(passages)))
    assert [r["doc_id"] for r in dec.without_benchmark(df, bench, least=60).orderBy("doc_id").collect()] == [
        len(passages) + i for i in range(5)
    ]
    grid = {r["doc_id"] for r in dec.contamination(df, bench, least=None).collect()}
    assert len(grid) < len(passages) / 2


def brute_least(docs, items, window=80, least=60, rate=0.08, q=8):
    """Windows of both lengths, each at its starts, by edit distance alone."""
    found = {}
    for doc_id, text in docs:
        t = normal(text)
        for item_id, item in items:
            whole = normal(item)
            size = min(window, len(whole))
            if size < q:
                continue
            taken = {(s, size) for s in (*range(0, len(whole) - size, window // 2), len(whole) - size)}
            if len(whole) > least:
                at = 0
                for word in whole.split(" "):
                    taken |= {(s, least) for s in range(at, at + len(word), 8) if s + least <= len(whole)}
                    at += len(word) + 1
                taken.add((len(whole) - least, least))
            best = [edits_within(whole[s : s + n], t) for s, n in taken]
            good = [b for b, (_, n) in zip(best, taken) if b <= min(int(rate * n), (n - q) // q)]
            if good:
                found[doc_id, item_id] = (len(good), min(good))
    return found


def test_every_start_equals_brute_force(spark, planted):
    docs, items = planted
    docs = [*docs[:12], *docs[-5:]]
    expected = brute_least(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dec.contamination(df, bench, least=60, block_chars=300).collect()
    assert {(r["doc_id"], r["item_id"]): (r["n_windows"], r["edits"]) for r in rows} == expected


def test_query_takes_every_start(spark, tmp_path):
    import corpus_pipeline

    from candidata.llm.queries import QUERIES

    draw = random.Random(4)
    item = " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "before " + item[18:84] + " after"), (2, "clean")], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r["doc_id"] for r in QUERIES["op9_decontaminate"](spark, str(tmp_path)).collect()] == [1]
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [2]
