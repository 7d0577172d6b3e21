import random
import re
import string

import numpy as np
import xxhash

from candidata.llm import components as cc
from candidata.llm import simhash_index as sim
from odd_data import documents, empty, odd  # noqa: F401

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(codes, near):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if near(codes[i], codes[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def close(a, b):
    return (a ^ b).bit_count() <= 4


def check(df, rows):
    codes = {}
    for r in rows:
        codes.setdefault(r["text"], brute_fingerprint(r["text"]))
    prints = [codes[r["text"]] for r in rows]
    roots = brute_roots(prints, close)
    members = {}
    for r, root in zip(rows, roots):
        members.setdefault(root, []).append(r["doc_id"])
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    expected = sorted((repr(r["doc_id"]), f"{p:016x}", repr(smallest[k])) for r, p, k in zip(rows, prints, roots))
    got = sorted((repr(r["doc_id"]), r["fingerprint"], repr(r["component_id"])) for r in sim.near_duplicates(df).collect())
    assert got == expected
    return members


def test_documents(documents):
    rows = documents.collect()
    members = check(documents, rows)
    kept = sim.keep_one(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(v) for v in members.values())


def test_odd_rows(odd):
    members = check(odd, odd.collect())
    assert sim.keep_one(odd).count() == len(members)


def test_empty(empty):
    assert sim.near_duplicates(empty).collect() == [] and sim.keep_one(empty).collect() == []


def clustered(n, seed):
    """Codes around few centres, so that chains and groups beyond a leaf appear."""
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    codes = set()
    for _ in range(n):
        c = draw.choice(centres)
        for _ in range(draw.choice((1, 2, 3, 4, 5, 6, 8))):
            c ^= 1 << draw.randrange(64)
        codes.add(c)
    return list(codes | {draw.getrandbits(64) for _ in range(n // 4)})


def gray(code):
    for step in (1, 2, 4, 8, 16, 32):
        code ^= code >> step
    return code


def test_tree_links_all_components():
    for seed in range(4):
        codes = sorted(clustered(700, seed), key=gray)
        forest = sim.Forest()
        values = np.array(codes, np.uint64).view(np.int64)
        sim.GrayTree(values).link(forest, 4)
        got = forest.roots(values).tolist()
        expected = brute_roots(codes, close)
        pairs = set(zip(got, expected))
        assert len(pairs) == len(set(got)) == len(set(expected))


def test_codes_link_across_partitions(spark):
    codes = clustered(600, 9)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    roots = {r["node"]: r["root"] for r in cc.components(sim.code_links(df)).collect()}
    got = [roots.get(c - (1 << 64) if c >> 63 else c, c - (1 << 64) if c >> 63 else c) for c in codes]
    expected = brute_roots(codes, close)
    assert len(set(zip(got, expected))) == len(set(got)) == len(set(expected))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5, 5)]
    random.Random(1).shuffle(links)
    roots = {r["node"]: r["root"] for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 50)}
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []
