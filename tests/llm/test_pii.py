import random
import re

import pytest

from candidata.llm import pii
from odd_data import documents, empty, odd  # noqa: F401

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    """The patterns as they are given."""
    only = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only(m[0])) <= 15]
    return found


def test_exact_spans_equal_the_patterns(documents):
    draw = random.Random(1)
    texts = [r["text"] for r in documents.collect()]
    texts += ["".join(draw.choice("0123456 .@+-()a.@1%\n٣") for _ in range(draw.randint(0, 70))) for _ in range(20_000)]
    texts += ["a@b.c@d.e", "x@y.z.@a.b", "4111 1111 1111 1111", "12 4111111111111111", "+1 (555) 123-4567", "1.2.3.4.5.6.7.8", "256.1.1.1"]
    for t in texts:
        assert pii.exact_spans(t) == plain(t), t


def test_exact_spans_in_linear_time():
    for t in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "a@" * 100_000, "+1" + "(" * 200_000, "1 " * 100_000):
        pii.exact_spans(t)
        list(pii.passages(t, []))


def test_passages_cover_triggers_and_spare_taken_spans():
    draw = random.Random(6)
    for _ in range(5000):
        text = "".join(draw.choice("abc  \n1@") for _ in range(draw.randint(0, 200)))
        edges = sorted(draw.sample(range(201), 6))
        taken = [("ip", min(a, len(text)), min(b, len(text))) for a, b in zip(edges[::2], edges[1::2]) if a < len(text)]
        found = list(pii.passages(text, taken))
        free = {m.start() for m in pii.TRIGGER.finditer(text)} - {k for _, a, b in taken for k in range(a, b)}
        covered = [k for a, b in found for k in range(a, min(b, len(text)))]
        assert free <= set(covered)
        assert not any(k in range(a, b) for k in covered for _, a, b in taken)


@pytest.fixture(scope="module")
def halves(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")


def test_held_out_accuracy(halves):
    """Exact spans and rewritten ones of documents that were not seen, and passages without any."""
    field = pii.train(halves[0])
    right = wrong = quiet = noisy = 0
    for r in halves[1].select("text").collect():
        for passage, span in pii.samples(r["text"])[:4]:
            for text, spans in pii.example(passage, span):
                got = field.decode(text)
                if spans:
                    right += got == spans
                    wrong += got != spans
                else:
                    quiet += not got
                    noisy += bool(got)
    assert right > 200 and right / (right + wrong) > 0.9, (right, wrong)
    assert quiet > 20 and noisy / (quiet + noisy) < 0.05, (quiet, noisy)
    for text in ("on 12/05/2021 we paid 3.50", "version 2.1.4 of 10", 'token = "24be64439e3e49cf46b2d7c90f3602"'):
        assert field.decode(text) == []


def test_field_is_a_distribution_and_decodes_the_best():
    """Sums over labellings, and the best one, against all labellings of short passages."""
    from itertools import product

    import numpy as np

    text = "id 12 34 @ x"
    field = pii.Field()
    tokens, segments = field.segments(text)
    draw = np.random.default_rng(0)
    field.weights = {f: draw.normal(size=4) for _, _, fs in segments for f in fs}
    scores = np.array([field.score(fs) for _, _, fs in segments])
    total, share, best = 0.0, np.zeros_like(scores), (0.0, ())

    def walk(at, score, used):
        nonlocal total, best
        if at == len(tokens):
            w = np.exp(score)
            total += w
            for s, k in used:
                share[s, k] += w
            best = max(best, (score, used))
            return
        walk(at + 1, score, used)
        for (s, (i, j, _)), k in product(enumerate(segments), range(4)):
            if i == at:
                walk(j + 1, score + scores[s, k], (*used, (s, k)))

    walk(0, 0.0, ())
    assert np.allclose(pii.marginals(len(tokens), segments, scores), share / total)
    spans = [(pii.KINDS[k], tokens[segments[s][0]][0], tokens[segments[s][1]][1]) for s, k in best[1]]
    assert field.decode(text) == spans


def test_query_rows(spark, odd, empty, documents):
    import hashlib

    for df in (odd, documents):
        rows = pii.personal_data(df).collect()
        texts = {}
        for r in df.collect():
            texts.setdefault(r["doc_id"], []).append(plain(r["text"] or ""))
        assert len(rows) == df.count()
        for r in rows:
            spelt = [pii.spell(s) for s in texts[r["doc_id"]]]
            k = [hashlib.sha256(s.encode()).hexdigest() for s in spelt].index(r["base_sha256"])
            base = texts[r["doc_id"]][k]
            assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(x[0] == kind for x in base) for kind in pii.KINDS]
            assert {f"{a}:{b}:{c}" for a, b, c in base} <= set(r["spans"].split(",")) or not base
            assert (len(r["spans"].split(",")) if r["spans"] else 0) == len(base) + r["n_added"]
    assert pii.personal_data(empty).collect() == []
