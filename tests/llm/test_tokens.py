import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from candidata.llm import token_counts, token_output
from odd_data import documents, empty, odd  # noqa: F401

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


HARD = [
    "don't can't I'll THEY'RE you've i'm he'd", "a.b,c;d: e! f? g... h!?", "<|endoftext|>x <|startoftext|>", "<|ENDOFTEXT|>",
    "\u00c5ngstr\u00f6m A\u030angstrom \u212b", "\u0130stanbul I\u0307 \u1e9e stra\u00dfe \u00d7 \u00f7", "x\u00a0y\u2003z\u3000w\x1cq\x85r", "\u03a3\u03bf\u03c6\u03cc\u03c2 \u03a3",
    "1234 12a3b \u00bd \u2167 \u0661", "\U0001f600 emoji\u200djoin \ufeffbom", " \t\n\x0b\x0c\r ", "", None, "'s 's't", "caf\u00e9. caf\u00e9, CAF\u00c9!", "\ud7a3\u1112\u1161\u11ab", "_under_score_ a_b", "\u00aa\u00ba\u00b5",
]


def test_distinct_words_encode_like_whole_texts(tokenizer):
    import pyarrow as pa

    draw = random.Random(4)
    alphabet = "abcXYZ\u00e9\u00c9\u00df\u0130\u0301'.,<|>09 \n\t\u00a0\u2009\u65e5"
    texts = HARD + ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 80))) for _ in range(1500)]
    encoder = token_output.WordEncoder(open(PATH).read())
    for part in (texts, [t for t in texts if "<|" not in (t or "")]):
        ids, sizes = encoder.encode(pa.array(part, pa.string()), 1)
        expected = [ids_of(tokenizer, t) + [1] for t in part]
        assert sizes.tolist() == list(map(len, expected))
        assert ids.tolist() == sum(expected, [])


def test_words_are_encoded_once_per_worker(tokenizer, monkeypatch):
    """Signs after a word do not make it an odd one, and a later batch asks only for what is new to the process."""
    import pyarrow as pa

    long = "abcdefg" * 20
    batches = [
        ["Alpha### beta$$$ \u00c9t\u00e9%%% (no) x'' y\"}] alpha", None, f"beta {long} gamma"],
        ["gamma GAMMA*** \u00e9t\u00e9 beta,### alpha~ `alpha", f"{long} delta's don't x' epsilon", ""],
        ["alpha <b> a<|b c<|", "beta|> gamma&&& \u00e9T\u00c9 delta epsilon zeta"],
    ]
    text, ends = token_output.read_tokenizer(PATH)
    token_output._encoders.clear()
    encoder = token_output.worker_encoder(text, ends)
    assert token_output.worker_encoder(text, ends) is encoder
    asked = []
    for name in ("_plain", "_one_by_one"):
        real = getattr(encoder, name)
        words_of = lambda words: words if isinstance(words, list) else words.to_pylist()
        monkeypatch.setattr(encoder, name, lambda words, name=name, real=real: (asked.append((name, words_of(words))), real(words))[1])

    def plain_words(part):
        asked.clear()
        ids, sizes = encoder.encode(pa.array(part, pa.string()), 1)
        expected = [ids_of(tokenizer, t) + [1] for t in part]
        assert (sizes.tolist(), ids.tolist()) == (list(map(len, expected)), sum(expected, []))
        return sorted(w for name, words in asked if name == "_plain" for w in words)

    assert plain_words(batches[0]) == sorted(["alpha", "beta", "\u00e9t\u00e9", "x", "y", "gamma", long])
    assert [w for name, words in asked[1:2] for w in words if w] == ["(no)"]
    assert plain_words(batches[1]) == sorted([long, "epsilon"])
    # Beyond the bound words are encoded again, with the same ids.
    monkeypatch.setattr(token_output, "KEPT", len(encoder.kept) + 1)
    first, again = plain_words(batches[2]), plain_words(batches[2])
    assert len(encoder.kept) == token_output.KEPT and len(again) == len(first) - 1 > 0 and set(again) < set(first)
    token_output._encoders.clear()


@pytest.mark.parametrize("pairs,rounds", [(1, 40), (7, 5), (2048, 4)])
def test_repair_round_trip(pairs, rounds):
    draw = np.random.default_rng(pairs)
    for ids in (
        draw.integers(0, 5, 4000), draw.integers(0, 50_000, 3000), np.zeros(1000, int), np.tile([1, 2, 3], 500), np.array([7]), np.array([], int)
    ):
        ids = ids.astype(np.uint32)
        rules, lengths, sequence = token_output.compress(ids, 50_000, rounds, pairs, 2)
        assert all(max(rule) < 50_000 + r for r, rule in enumerate(rules.tolist()))
        block = token_output.Block(50_000, rules.astype(np.uint32).tobytes(), lengths.astype(np.uint32).tobytes(), sequence.astype(np.uint32).tobytes(), 4)
        assert block.ids().tolist() == ids.tolist()
        for _ in range(20 if len(ids) else 0):
            first = int(draw.integers(0, len(ids)))
            n = int(draw.integers(1, len(ids) - first + 1))
            assert block.range(first, n).tolist() == ids[first : first + n].tolist()
    rules, _, sequence = token_output.compress(np.tile([1, 2, 3, 4], 500).astype(np.uint32), 50_000, 40, 1, 2)
    assert len(sequence) < 60 and len(rules) < 20


def most_frequent(sequence):
    """The highest number of places without overlap of any pair."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(sequence, sequence[1:])):
        if last.get(pair) != i - 1:
            counts[pair], last[pair] = counts.get(pair, 0) + 1, i
    return max(counts.values(), default=0)


def test_repair_goes_on_until_no_pair_occurs_twice():
    draw = np.random.default_rng(8)
    document = draw.integers(0, 40_000, 700)
    copies = np.concatenate([x for k in range(9) for x in (document, [50_000 - 1 - k])])
    text = np.minimum(draw.zipf(1.3, 20_000), 40_000)
    for ids in (copies, text, np.zeros(999, int), np.array([1, 1, 1]), draw.integers(0, 3, 5000), np.tile(document, 64), np.array([5]), np.array([], int)):
        ids = ids.astype(np.uint32)
        for defaults in ({}, {"pairs": 50}):
            rules, lengths, sequence = token_output.compress(ids, 50_000, **defaults)
            assert most_frequent(sequence.tolist()) < 2
            assert len(sequence) + 2 * len(rules) <= len(ids)
            block = token_output.Block(50_000, rules.astype(np.uint32).tobytes(), lengths.astype(np.uint32).tobytes(), sequence.astype(np.uint32).tobytes(), 4)
            assert block.ids().tolist() == ids.tolist()
    # Nine copies of a document are one symbol each.
    assert len(token_output.compress(copies.astype(np.uint32), 50_000)[2]) == 18


def test_a_range_reads_only_what_it_needs():
    """A few ids of a long block: the symbols between two marks, and the way down the rules over the range."""
    draw = np.random.default_rng(3)
    for ids in (np.minimum(draw.zipf(1.2, 300_000), 40_000), np.tile(draw.integers(0, 40_000, 5000), 60), np.zeros(200_000, int)):
        ids = ids.astype(np.uint32)
        rules, lengths, sequence = token_output.compress(ids, 50_000)
        marks = token_output.marks_of(sequence, lengths, 50_000)
        parts = [x.astype(np.uint32).tobytes() for x in (rules, lengths, sequence)]
        block = token_output.Block(50_000, *parts, 4, marks.tobytes())
        assert block.looked_at == 0 and len(marks) == -(-len(sequence) // token_output.MARK)
        for first, n in [(0, 1), (len(ids) - 1, 1), (len(ids) // 2, 10), (12_345, 100), (0, 0), (len(ids), 0)]:
            before = block.looked_at
            assert block.range(first, n).tolist() == ids[first : first + n].tolist()
            # Two stretches between marks at most, then two children a level at each end, and the range.
            assert block.looked_at - before <= 2 * token_output.MARK + 60 * (n + 8)


def test_blocks_fold_a_few_copies(spark):
    text = " ".join(f"word{k}" for k in range(300))
    df = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string").coalesce(1)
    blocks = [r for r in token_output.encode_blocks(df, PATH).collect() if r["n_ids"] > 1000]
    assert all(len(r["sequence"]) // r["width"] <= 2 * len(r["doc_ids"]) for r in blocks)


def check(spark, df, tokenizer, path, **kwargs):
    token_output.write_tokens(df, path, PATH, **kwargs)
    got = sorted(token_output.read_tokens(spark, path).collect(), key=lambda r: (r["start"], r["n_tokens"]))
    rows = df.select("doc_id", "text").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted([r["doc_id"] for r in rows], key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"] and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
    expected = sorted((repr(r["doc_id"]), ids_of(tokenizer, r["text"]) + [1]) for r in rows)
    assert sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == expected


def test_blocks_of_documents(spark, documents, tokenizer, tmp_path):
    check(spark, documents, tokenizer, f"{tmp_path}/a")
    check(spark, documents, tokenizer, f"{tmp_path}/b", block_ids=3000, pairs=16, least=3)


def test_blocks_of_odd_rows(spark, odd, empty, tokenizer, tmp_path):
    check(spark, odd, tokenizer, f"{tmp_path}/a", block_ids=500)
    token_output.write_tokens(empty, f"{tmp_path}/b", PATH)
    assert token_output.read_tokens(spark, f"{tmp_path}/b").collect() == []


def test_histogram_answers_every_limit(odd, documents, tokenizer):
    for df in (documents, odd):
        rows = df.select("source", "text").collect()
        lengths = {}
        for r in rows:
            lengths.setdefault(r["source"], []).append(len(ids_of(tokenizer, r["text"])))
        found = token_counts.encoded_lengths(df, PATH, keep=["source"])
        assert sorted(map(repr, found.collect())) == sorted(f"Row(source={s!r}, n_tokens={n})" for s, ns in lengths.items() for n in ns)
        hist = token_counts.length_histogram(found, "source")
        got = hist.collect()
        assert len(got) == sum(len(set(ns)) for ns in lengths.values())
        for r in got:
            ns, n = lengths[r["source"]], r["n_tokens"]
            assert (r["n_docs"], r["docs"], r["tokens"]) == (ns.count(n), len(ns), sum(ns))
            assert r["docs_at_least"] == sum(x >= n for x in ns)
            assert r["tokens_at_least"] == sum(x for x in ns if x >= n)
            assert r["truncated_total"] == sum(min(x, n) for x in ns)
        limits = [0, 1, 100, 512, 10**9]
        for r in token_counts.truncated_totals(hist, "source", limits).collect():
            ns = lengths[r["source"]]
            assert (r["docs_cut"], r["tokens"]) == (sum(x > r["limit"] for x in ns), sum(min(x, r["limit"]) for x in ns))
        for r in token_counts.quantiles(hist, "source", [0.0, 0.5, 0.99, 1.0]).collect():
            ns = sorted(lengths[r["source"]])
            assert r["n_tokens"] == next(n for k, n in enumerate(ns, 1) if k >= r["share"] * len(ns))


def test_empty_histogram(empty):
    hist = token_counts.length_histogram(token_counts.encoded_lengths(empty, PATH, keep=["source"]), "source")
    assert hist.collect() == [] and token_counts.quantiles(hist, "source", [0.5]).collect() == []
