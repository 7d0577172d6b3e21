import heapq
import random

from pyspark.sql import functions as F

from candidata.llm import mixing
from odd_data import documents, empty, odd  # noqa: F401


def brute_seats(weights, seats):
    """Seat after seat to the highest quotient; ties to the first."""
    got = [0] * len(weights)
    queue = [(-w, i) for i, w in enumerate(weights) if w > 0]
    heapq.heapify(queue)
    for _ in range(seats if queue else 0):
        _, i = heapq.heappop(queue)
        got[i] += 1
        heapq.heappush(queue, (-weights[i] / (2 * got[i] + 1), i))
    return got


def test_apportion_equals_seat_by_seat(spark):
    draw = random.Random(2)
    rows, expected = [], {}
    for g in range(30):
        n = draw.randint(1, 12)
        weights = [draw.choice((0, 1, 2, 3, 50, 1000, 7919)) * draw.choice((1, 1, 13)) for _ in range(n)]
        seats = draw.choice((0, 1, 5, 37, 400, 3001))
        for i, w in enumerate(weights):
            rows.append((g, i, float(w), seats))
        expected |= {(g, i): s for i, s in enumerate(brute_seats(weights, seats))}
    df = spark.createDataFrame(rows, "g int, i int, w double, s long")
    got = mixing.apportion(df, ["g"], "w", F.col("s"), "i", "seats").collect()
    assert {(r["g"], r["i"]): r["seats"] for r in got} == expected


def brute_targets(sizes, weights=(5, 2, 1), total=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    words, stopped = total * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = words - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in over}


def brute_taken(df, block_words=64, shard_docs=256, seed=7):
    """Words taken of every row: quotas seat by seat, then word by word round each shard's ring."""
    draw = mixing.unit_draw(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    rows = df.select("doc_id", "source", "text", F.xxhash64("text").alias("h"), draw.alias("draw")).collect()
    size = lambda t: len((t or "").encode().split())
    sizes, counts = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    goal = brute_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    shards = {s: counts[s] // shard_docs + 1 for s in names}
    block = max(1, min([block_words, *[int(sizes[s] / shards[s] / 64) for s in names if sizes[s]]]))
    seats = dict(zip(names, brute_seats([goal[s] for s in names], int(sum(goal.values()) / block + 0.5))))
    starts = {
        (r["s"], r["p"]): r["x"]
        for r in df.sparkSession.createDataFrame([(s, p) for s in names for p in range(shards[s])], "s string, p long")
        .select("s", "p", F.xxhash64(F.lit(seed), F.lit("run"), "s", "p").alias("x")).collect()
    }
    out = []
    for s in names:
        parts = [[] for _ in range(shards[s])]
        for r in rows:
            if r["source"] == s:
                parts[int(r["draw"] * shards[s])].append((r["draw"], r["doc_id"], r["h"], size(r["text"])))
        words = [sum(x[3] for x in p) for p in parts]
        for p, n, won in zip(range(shards[s]), words, brute_seats(words, seats[s])):
            parts[p].sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3]))
            owner = [i for i, x in enumerate(parts[p]) for _ in range(x[3])]
            got = [0] * len(parts[p])
            if n:
                first = starts[s, p] % -(-n // block) * block
                for k in range(min(won * block, 2 * n)):
                    got[owner[(first + k) % n]] += 1
            out += [(x[1], s, x[3], g) for x, g in zip(parts[p], got)]
    return sorted(out, key=repr)


def check(df):
    first = sorted(mixing.mix(df).collect(), key=repr)
    again = sorted(mixing.mix(df.repartition(7, "lang", "doc_id")).collect(), key=repr)
    assert first == again and len(first) == df.count()
    sizes = {}
    for r in df.select("source", "text").collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
    targets, taken = brute_targets(sizes), {}
    for r in first:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, targets[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t), (s, taken[s], t)
    assert sorted(((r["doc_id"], r["source"], r["size"], r["taken"]) for r in first), key=repr) == brute_taken(df)
    return first


def test_documents(documents):
    rows = check(documents)
    mixed = mixing.mixed_documents(documents)
    assert mixed.columns == documents.columns
    words = sum(len(r["text"].split()) for r in mixed.select("text").collect())
    assert abs(words - sum(r["taken"] for r in rows)) < 0.1 * words


def test_rare_source_of_short_documents(spark):
    """Parts far smaller than a block of the large source."""
    rows = [(i, " ".join(["w"] * 40), "big") for i in range(3000)] + [(5000 + i, "a b c d", "rare") for i in range(150)]
    rows += [(6000 + i, "x", "tiny") for i in range(3)] + [(7000, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    taken = {}
    for r in check(df):
        taken.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert taken["rare"] == [1200.0, 1200] and taken["tiny"] == [6.0, 6] and taken["none"] == [0.0, 0]


def test_many_shards(documents):
    small = mixing.mix(documents, shard_docs=4, block_words=16).collect()
    assert sorted(((r["doc_id"], r["source"], r["size"], r["taken"]) for r in small), key=repr) == brute_taken(documents, 16, 4)
    assert sum(r["taken"] for r in small) > 0
    by = {}
    for r in small:
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(got - t) <= 0.05 * t for t, got in by.values())


def test_odd_rows(odd):
    check(odd)
    copies = {}
    for r in mixing.mixed_documents(odd).collect():
        copies[r["doc_id"], r["text"]] = copies.get((r["doc_id"], r["text"]), 0) + 1
    assert copies and all(t and t.split() for _, t in copies)


def test_empty(empty):
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
