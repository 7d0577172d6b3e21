"""Phrases whose words belong together, found by best-first growth with score bounds.

A phrase is grown word by word from its first one. The score of a phrase is at most
floor(1000 * n / f(prefix)) for every prefix it has, as no part of it is rarer than the phrase
itself; the first word gives the tightest of these bounds. First words are therefore expanded
from rare to frequent, a class of frequencies at a time. After each class the phrases found are
settled, which gives each language the least score that can still enter its list; first words
whose bound is below it are never expanded. With them goes most of a large corpus, as the frequent
words are the ones that are left out.

The corpus is read once and stored as blocks of word numbers. Each step of the growth is a pass
over the blocks: numpy counts per block, Spark adds up. Words and phrases are named by exact lists
of word hashes (whose uniqueness is checked), and found again in the blocks through bit maps of
fixed size, whose false hits only cost time: sums are joined with the true lists afterwards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candidata.cluster import written

#: Bits of every map that travels to the tasks: 2 MB each, whatever the corpus.
MAP_BITS = 1 << 24
BUCKET = 1 << 15
LONGEST = 5
#: Text bytes that are split at once, and word numbers in a block; a longer piece stays whole.
SLICE_BYTES, BLOCK = 1 << 22, 1 << 18
#: Places of a block that are looked at together.
PLACES = 1 << 18
#: The end of a piece, where places in the list of words have 16 bits.
STOP = (1 << 16) - 1
#: Frequencies of first words in one class differ by at most this factor.
CLASS = 256
GRAMS = "lang string, gram array<bigint>, kind int, key bigint, f bigint"


def hashed_words(words: list[str], lang: str, seed: int) -> list[int]:
    """A 64-bit number per word, different in every language."""
    import xxhash

    of_lang = xxhash.xxh64_intdigest(lang, seed)
    return [xxhash.xxh64_intdigest(w, of_lang) for w in words]


# ---- blocks


def _slices(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows of about SLICE_BYTES."""
    run = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    return (slice(i, j) for i, j in zip(cuts, cuts[1:]) if j > i)


def _word_numbers(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each word or -1 at the end of a piece, the words, how many each text has)."""
    text = pc.ascii_lower(text.cast(pa.large_string()))
    tokens = pc.ascii_split_whitespace(pc.replace_substring_regex(text, "[.,;:!?\n-\r]+", " . "))
    flat = tokens.flatten().dictionary_encode()
    ids, words = flat.indices.to_numpy(), flat.dictionary
    row = np.repeat(np.arange(len(tokens)), pc.list_value_length(tokens).to_numpy())
    empty, stop = (pc.index(words, x).as_py() for x in ("", "."))
    if empty >= 0:
        ids, row = ids[ids != empty], row[ids != empty]
    return np.where(ids == stop, -1, ids), words, row


def _blocks(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Cuts of the numbers at ends of pieces."""
    ends = np.flatnonzero(ids < 0)
    start = 0
    while start < len(ids):
        k = np.searchsorted(ends, start + BLOCK)
        stop = int(ends[k]) + 1 if k < len(ends) else len(ids)
        yield ids[start:stop]
        start = stop


def corpus_blocks(docs: DataFrame, text: str, lang: str, seed: int, hash_words: Callable) -> DataFrame:
    """(lang, words, hashes, counts, width, ids): runs of pieces of one language.

    `ids` holds places in the lists of different words, of `width` bytes, and an end of every piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy()
            for part in _slices(sizes):
                # A copy, as some text functions misread arrays that begin within a buffer.
                rows = batch.take(pa.array(np.arange(part.start, part.stop)))
                langs = rows.column(0).dictionary_encode()
                ids, words, row = _word_numbers(rows.column(1))
                of_token = langs.indices.to_numpy()[row]
                for code, name in enumerate(langs.dictionary.to_pylist()):
                    for block in _blocks(ids[of_token == code]):
                        found = np.bincount(block[block >= 0], minlength=len(words))
                        used = np.flatnonzero(found)
                        if not len(used):
                            continue
                        kind, stop = (np.uint16, STOP) if len(used) < STOP else (np.int32, -1)
                        place = np.full(len(words) + 1, stop, kind)
                        place[used] = np.arange(len(used))
                        mine = words.take(pa.array(used)).cast(pa.string())
                        hashes = np.array(hash_words(mine.to_pylist(), name, seed), np.uint64).view(np.int64)
                        one = pa.array([0, len(used)], pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name]),
                                pa.ListArray.from_arrays(one, mine),
                                pa.ListArray.from_arrays(one, pa.array(hashes)),
                                pa.ListArray.from_arrays(one, pa.array(found[used].astype(np.int64))),
                                pa.array([place.itemsize], pa.int32()),
                                pa.array([place[block].tobytes()], pa.binary()),
                            ],
                            names=["lang", "words", "hashes", "counts", "width", "ids"],
                        )
                pa.default_memory_pool().release_unused()

    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("__lang"),
        F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).alias("__text"),
    )
    schema = "lang string, words array<string>, hashes array<bigint>, counts array<bigint>, width int, ids binary"
    return written(rows.mapInArrow(cut, schema), "blocks")


def read_corpus(docs: DataFrame, text: str, lang: str, hash_words: Callable) -> tuple[DataFrame, DataFrame]:
    """Blocks, and (lang, h, word, f) of every word; hashed anew if two words share a hash."""
    for seed in count(1):
        blocks = corpus_blocks(docs, text, lang, seed, hash_words)
        each = blocks.select("lang", F.inline(F.arrays_zip("hashes", "words", "counts")))
        words = each.groupBy("lang", F.col("hashes").alias("h"), F.col("words").alias("word"))
        words = written(words.agg(F.sum("counts").alias("f")), "words")
        if words.groupBy("lang", "h").count().filter("count > 1").isEmpty():
            return blocks, words


def read_places(ids: pa.Scalar, width: int) -> np.ndarray:
    """The places of a block, -1 at the end of a piece."""
    if width == 4:
        return np.frombuffer(ids.as_buffer(), np.int32)
    places = np.frombuffer(ids.as_buffer(), np.uint16).astype(np.int32)
    places[places == STOP] = -1
    return places


# ---- bit maps


def _chain(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a phrase and one more word."""
    x = (key * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def bit_maps(rows: DataFrame, key: str, role: str | None = None) -> dict[int, np.ndarray]:
    """For every role (0 without roles) the bits at its keys, as MAP_BITS / 8 bytes; built by Spark in buckets."""
    place = F.pmod(F.col(key), F.lit(MAP_BITS)).cast("bigint")
    rows = rows.select((F.col(role) if role else F.lit(0)).alias("role"), place.alias("p"))
    buckets = rows.groupBy("role", F.floor(F.col("p") / BUCKET).alias("b"))
    out = defaultdict(lambda: np.zeros(MAP_BITS // 8, np.uint8))
    for r in buckets.agg(F.bitmap_construct_agg(F.col("p") % BUCKET).alias("bits")).collect():
        out[r["role"]][r["b"] * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def bit_map(rows: DataFrame, key: str) -> np.ndarray:
    return bit_maps(rows, key)[0]


def _inside(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(MAP_BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


# ---- passes over the blocks


class Block:
    """Numbers and hashes of one block; place -1 of a list is the end of a piece."""

    def __init__(self, lang: str, hashes: np.ndarray, ids: np.ndarray):
        self.lang, self.ids = lang, np.append(ids, np.int32(-1))
        self.hash = np.append(hashes.view(np.uint64), np.uint64(0))
        self.found: list[pa.RecordBatch] = []

    def places(self, first: np.ndarray) -> Iterator[np.ndarray]:
        """The places whose word has the flag `first`, some at a time, so that what is made of them stays small."""
        at = np.flatnonzero(first[self.ids])
        return (at[i : i + PLACES] for i in range(0, len(at), PLACES))

    def flags(self, bits: np.ndarray) -> np.ndarray:
        """Per word, whether its hash is in the map; never at the end of a piece."""
        return np.append(_inside(bits, self.hash[:-1]), False)

    def extend(self, at: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
        return _chain(key, self.hash[self.ids[at + step]])

    def keys(self, at: np.ndarray, length: int) -> np.ndarray:
        key = self.hash[self.ids[at]]
        for step in range(1, length):
            key = self.extend(at, key, step)
        return key

    def tally(self, at: np.ndarray, length: int, kind: int, key: np.ndarray) -> None:
        """Count the different phrases of this length that begin at these places."""
        if not len(at):
            return
        size, code, bound = len(self.hash), self.ids[at].astype(np.int64), len(self.hash)
        for step in range(1, length):
            if bound * size >= 2**62:
                code = np.unique(code, return_inverse=True)[1]
                bound = len(at)
            code, bound = code * size + self.ids[at + step], bound * size
        _, first, n = np.unique(code, return_index=True, return_counts=True)
        grams = self.hash[self.ids[at[first][:, None] + np.arange(length)]].view(np.int64)
        ends = pa.array(np.arange(len(first) + 1, dtype=np.int32) * length)
        self.found.append(
            pa.RecordBatch.from_arrays(
                [
                    pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(first), np.int8)), [self.lang]).cast(pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(grams.ravel())),
                    pa.array(np.full(len(first), kind, np.int32)),
                    pa.array(key[first].view(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                names=["lang", "gram", "kind", "key", "f"],
            )
        )


def _pass(blocks: DataFrame, maps: dict[str, np.ndarray], use: Callable[[Block, dict], None], least: int = 1) -> DataFrame:
    """(lang, gram, kind, key, f): what `use` tallies over all blocks, stored, from `least` occurrences on."""
    sent = blocks.sparkSession.sparkContext.broadcast(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes, widths, ids = batch.columns
            for i in range(batch.num_rows):
                block = Block(langs[i].as_py(), hashes[i].values.to_numpy(), read_places(ids[i], widths[i].as_py()))
                use(block, sent.value)
                yield from block.found
                del block
                pa.default_memory_pool().release_unused()

    rows = blocks.select("lang", "hashes", "width", "ids").mapInArrow(run, GRAMS)
    rows = rows.groupBy("lang", "gram", "kind").agg(F.min("key").alias("key"), F.sum("f").alias("f"))
    found = written(rows.filter(F.col("f") >= least), "grams")
    # The result is stored, so nobody will ask for the maps again.
    sent.destroy()
    return found


def grow(length: int) -> Callable[[Block, dict], None]:
    """Count the phrases of length + 1 whose first `length` words are a known phrase of a root.

    If the phrases that begin with the second word are known too, the last `length` words
    must be among them, as a phrase is never more frequent than its parts.
    """

    def use(block: Block, maps: dict) -> None:
        frequent, open_ = block.flags(maps["frequent"]), block.flags(maps["unexpanded"])
        ids = block.ids
        for at in block.places(block.flags(maps["roots"]) & frequent):
            key = block.hash[ids[at]]
            for step in range(1, length + 1):
                on = frequent[ids[at + step]]
                at, key = at[on], block.extend(at[on], key[on], step)
                if step < length:
                    on = _inside(maps["phrases"], key)
                    at, key = at[on], key[on]
            if length > 1:
                on = open_[ids[at + 1]] | _inside(maps["phrases"], block.keys(at + 1, length))
                at, key = at[on], key[on]
            block.tally(at, length + 1, 0, key)

    return use


def look(block: Block, maps: dict) -> None:
    """Count the wanted phrases (kind 0), and with each word before them those that contend (kind 1)."""
    ids, frequent = block.ids, block.flags(maps["frequent"])
    for at in block.places(block.flags(maps["first"])):
        key = block.hash[ids[at]]
        for length in range(2, LONGEST):
            on = frequent[ids[at + length - 1]]
            at, key = at[on], block.extend(at[on], key[on], length - 1)
            on = _inside(maps["path"], key)
            at, key = at[on], key[on]
            on = _inside(maps["wanted"], key)
            block.tally(at[on], length, 0, key[on])
            # Place -1 before the first word is the end of a piece, too.
            on = _inside(maps["contend"], key) & frequent[ids[at - 1]]
            block.tally(at[on] - 1, length + 1, 1, key[on])


# ---- scores


def _exact(*values: str) -> str:
    return " * ".join(f"CAST({v} AS DECIMAL(19, 0))" for v in values)


#: Exact in 38 digits: a product of any two counts and 1000 below 10^38.
SCORE = f"({_exact('f', 'n')} * 1000) div ({_exact('l', 'r')})"
BOUND = f"({_exact('n')} * 1000) div {_exact('l')}"


def scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, gram, f, n, bound, exact, l, r) of phrases of two words or more.

    The lowest-scoring cut decides, the first of them at a tie. Where the count of the rest of a
    cut is not known, its score is bounded by that of a rest as rare as the phrase.
    """
    cuts = phrases.select(
        "lang", "gram", "f", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)).alias("k")
    )
    cuts = cuts.withColumn("front", F.slice("gram", 1, F.col("k")))
    cuts = cuts.withColumn("rest", F.slice("gram", F.col("k") + 1, F.size("gram") - F.col("k")))
    known = counts.select("lang", F.col("gram").alias("part"), F.col("f").alias("of_part"))
    fronts, rests = known.toDF("lang", "front", "l"), known.toDF("lang", "rest", "r")
    rows = cuts.join(fronts, ["lang", "front"]).join(rests, ["lang", "rest"], "left").join(totals, "lang")
    value = F.when(F.col("r").isNotNull(), F.expr(SCORE)).otherwise(F.expr(BOUND))
    least = F.min(F.struct(value.alias("bound"), "k", "l", "r")).alias("least")
    rows = rows.groupBy("lang", "gram").agg(
        F.max("f").alias("f"), F.max("n").alias("n"), least, F.min(F.col("r").isNotNull()).alias("exact")
    )
    return rows.select("lang", "gram", "f", "n", "least.bound", "exact", "least.l", "least.r")


def _within(phrases: DataFrame) -> DataFrame:
    """(lang, gram, longer): for phrases inside a known one with a word more, its count."""
    parts = [F.slice("gram", 1, F.size("gram") - 1), F.slice("gram", 2, F.size("gram") - 1)]
    rows = phrases.filter(F.size("gram") > 2).select("lang", F.explode(F.array(*parts)).alias("gram"), "f")
    return rows.groupBy("lang", "gram").agg(F.max("f").alias("longer"))


def _roles(rows: DataFrame) -> DataFrame:
    """(role, key) for the maps of `look`, from (lang, gram, role) with role 0 wanted, 1 contends.

    Role 2 are the phrases on the way to one, 3 the first words.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, role = batch.column(0), batch.column(1).to_numpy()
            sizes = pc.list_value_length(grams).to_numpy()
            words = np.zeros((batch.num_rows, LONGEST), np.uint64)
            words[np.arange(LONGEST) < sizes[:, None]] = grams.flatten().to_numpy().view(np.uint64)
            key = words[:, 0]
            out = [(np.full(len(key), 3), key)]
            for k in range(1, LONGEST):
                key = _chain(key, words[:, k])
                on, whole = sizes > k, sizes == k + 1
                out += [(np.full(on.sum(), 2), key[on]), (role[whole], key[whole])]
            roles, found = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(roles.astype(np.int32)), pa.array(found.view(np.int64))], names=["role", "key"]
            )

    return rows.select("gram", "role").mapInArrow(keys, "role int, key bigint")


# ---- the search


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


class Search:
    """State of the growth. All tables are stored; the driver holds bit maps and class limits."""

    def __init__(self, blocks: DataFrame, words: DataFrame, min_count: int, top: int):
        self.spark: SparkSession = blocks.sparkSession
        self.blocks, self.min_count, self.top = blocks, min_count, top
        self.totals = written(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        words = words.filter(F.col("f") >= min_count).join(self.totals, "lang")
        bound = F.expr(f"({_exact('n')} * 1000) div {_exact('f')}").alias("bound")
        self.words = written(words.select("lang", "h", "word", "f", bound), "frequent-words")
        empty = self.spark.createDataFrame([], "lang string, gram array<bigint>, f bigint")
        self.phrases: list[DataFrame] = [empty]
        self.extra: list[DataFrame] = [empty]
        self.roots: list[DataFrame] = []
        self.least = self.spark.createDataFrame([], "lang string, least bigint")
        self.settled: list[DataFrame] = []
        self.maps: dict[str, np.ndarray] = {"phrases": np.zeros(MAP_BITS // 8, np.uint8)}

    def run(self) -> DataFrame:
        """(lang, gram, f, n, bound, exact, l, r) of the phrases that may be in a list."""
        most = self.words.agg(F.max("f")).first()[0]
        if most is None:
            return scored(self.phrases[0], self.counts(), self.totals)
        self.maps["frequent"] = bit_map(self.words, "h")
        low = self.min_count
        while low <= most:
            in_class = (F.col("f") >= low) & (F.col("f") < low * CLASS)
            self.expand(self.worth_it(self.words.filter(in_class)))
            low *= CLASS
            if low <= most:
                self.settle()
        return self.finish()

    def worth_it(self, rows: DataFrame) -> DataFrame:
        """Rows whose bound reaches the least score of their language's list, ties included."""
        rows = rows.join(self.least, "lang", "left")
        return rows.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("least")

    def counts(self) -> DataFrame:
        """(lang, gram, f) of all words and phrases counted so far, each once."""
        words = self.words.select("lang", F.array("h").alias("gram"), "f")
        return written(_union([words, *self.phrases, *self.extra]).distinct(), "counts")

    def unexpanded(self) -> DataFrame:
        return self.words.join(_union(self.roots), ["lang", "h"], "left_anti")

    def expand(self, roots: DataFrame) -> None:
        """Grow all phrases of these first words."""
        roots = written(roots.select("lang", "h"), "roots")
        if roots.isEmpty():
            return
        self.roots.append(roots)
        self.maps |= {"roots": bit_map(roots, "h"), "unexpanded": bit_map(self.unexpanded(), "h")}
        for length in range(1, LONGEST):
            # False hits of the map of roots are phrases of other words, counted in full as well.
            found = _pass(self.blocks, self.maps, grow(length), self.min_count)
            if found.isEmpty():
                return
            self.phrases.append(found.select("lang", "gram", "f"))
            self.maps["phrases"] = self.maps["phrases"] | bit_map(found, "key")

    def contenders(self, counts: DataFrame) -> DataFrame:
        """Phrases not settled that may be in a list, without those known to be inside another; stored."""
        rows = self.worth_it(scored(_union(self.phrases).distinct(), counts, self.totals))
        if self.settled:
            rows = rows.join(_union(self.settled).select("lang", "gram"), ["lang", "gram"], "left_anti")
        rows = rows.join(_within(counts), ["lang", "gram"], "left")
        rows = rows.filter(F.col("longer").isNull() | (F.col("longer") < F.col("f")))
        return written(rows.drop("longer"), "contenders")

    def settle(self) -> None:
        """Settle the contenders with the best bounds, about twice as many as a list holds, then
        those that can still enter a list."""
        counts = self.counts()
        rows = self.contenders(counts)
        by_bound = Window.partitionBy("lang").orderBy(F.desc("bound"))
        best = rows.select("lang", "bound", F.row_number().over(by_bound).alias("__i"))
        best = best.filter(F.col("__i") <= 2 * self.top).groupBy("lang").agg(F.min("bound").alias("__cut"))
        rows = rows.join(written(best, "cut"), "lang")
        self.settle_all(rows.filter("bound >= __cut").drop("__cut"), counts)
        self.settle_all(self.worth_it(rows.filter("bound < __cut").drop("__cut")), counts)

    def settle_all(self, rows: DataFrame, counts: DataFrame) -> None:
        """Count what is missing for these contenders, drop those inside a longer phrase, and find
        the least score of each list anew."""
        if rows.isEmpty():
            return
        tails = F.transform(F.sequence(F.lit(2), F.size("gram") - 1), lambda k: F.slice("gram", k, LONGEST))
        wanted = rows.filter(~F.col("exact")).select("lang", F.explode(tails).alias("gram")).distinct()
        wanted = written(wanted.join(counts, ["lang", "gram"], "left_anti"), "wanted")
        # A phrase of the greatest length is inside no other.
        open_ = rows.filter(F.size("gram") < LONGEST).select("lang", "gram")
        roles = _roles(wanted.withColumn("role", F.lit(0)).union(open_.withColumn("role", F.lit(1))))
        of_role = bit_maps(roles, "key", "role")
        maps = {name: of_role[i] for i, name in enumerate(("wanted", "contend", "path", "first"))}
        seen = _pass(self.blocks, maps | {"frequent": self.maps["frequent"]}, look)
        before = seen.filter("kind = 1").select("lang", F.slice("gram", 2, LONGEST).alias("gram"), "f")
        before = before.groupBy("lang", "gram").agg(F.max("f").alias("longer"))
        new = rows
        if not wanted.isEmpty():
            of_rest = seen.filter("kind = 0").select("lang", "gram", "f")
            rests = written(of_rest.join(wanted, ["lang", "gram"], "left_semi"), "rests")
            self.extra.append(rests)
            exact = scored(rows.filter(~F.col("exact")).select("lang", "gram", "f"), counts.union(rests), self.totals)
            new = rows.filter("exact").unionByName(exact)
        new = new.join(before, ["lang", "gram"], "left")
        kept = F.col("longer").isNull() | (F.col("longer") < F.col("f"))
        self.settled.append(written(new.withColumn("kept", kept).drop("longer"), "settled"))
        best = Window.partitionBy("lang").orderBy(F.desc("bound"))
        ranked = _union(self.settled).filter("kept").withColumn("__i", F.row_number().over(best))
        ranked = ranked.filter(F.col("__i") <= self.top).groupBy("lang").agg(
            F.count("*").alias("__n"), F.min("bound").alias("least")
        )
        self.least = written(ranked.filter(F.col("__n") == self.top).select("lang", "least"), "least")

    def finish(self) -> DataFrame:
        """The settled phrases and the contenders of the last class, which need no further count if
        all first words were expanded."""
        if not self.unexpanded().isEmpty():
            self.settle()
            return self.worth_it(_union(self.settled).filter("kept").drop("kept"))
        rows = self.contenders(self.counts())
        if self.settled:
            rows = rows.unionByName(_union(self.settled).filter("kept").drop("kept"))
        return self.worth_it(rows)


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = 100,
    top: int = 2000,
    hash_words: Callable = hashed_words,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of every language.

    Texts are lower-cased (A-Z), split into pieces at `[.,;:!?]` and line ends, and into words at blanks
    and tabs. A phrase of 2 to 5 words that occurs at least `min_count` times is scored by
    floor(1000 * a * n / (l * r)) of its lowest cut, and left out if a longer phrase with as many
    occurrences holds it. Order: score, occurrences, then the phrase by its bytes.

    A null text has no words, a null language is `und`. Equal rows count each. Very long texts are
    split in the same slices as others and never cut. All ties at the last place are settled before
    the order by bytes decides. Other columns are ignored. A table without a phrase that
    frequent gives an empty result.
    """
    blocks, words = read_corpus(docs, text, lang, hash_words)
    search = Search(blocks, words, min_count, top)
    rows = written(search.run(), "found")
    each = rows.select("lang", "gram", F.posexplode("gram").alias("i", "h"))
    named = each.join(search.words.select("lang", "h", "word"), ["lang", "h"])
    named = named.groupBy("lang", "gram").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words"))
    rows = rows.join(named, ["lang", "gram"]).withColumn("phrase", F.array_join(F.col("words.word"), " "))
    order = [F.desc("bound"), F.desc("f"), F.asc("phrase")]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= top)
    return rows.select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("f").alias("a"),
        "l", "r", "n", F.col("bound").alias("score"),
    )

