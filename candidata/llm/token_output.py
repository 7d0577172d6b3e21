"""Token ids in Re-Pair compressed blocks, for exact and random-access reading.

Documents are dealt by ranges of their id, encoded, and laid end to end in blocks of whole
documents. In each block frequent pairs of symbols are replaced by new symbols, round by round.
A block stores the pairs (its rules), the length each rule expands to, the remaining sequence,
the number of ids before every so many symbols of it, and its documents with their lengths. Blocks are rows of a Parquet table, so writing commits and
repeats like any Spark write.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words whose tokens do not depend on how they are split off: Latin letters, then ASCII signs other than those
#: special tokens begin with.
PLAIN = r"^(?P<core>[a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<tail>[!-/:;=-@\[-`{-~]*)$"
#: Plain words whose ids an encoder keeps for later batches and tasks, at most; others are encoded again.
KEPT = 1 << 20
#: Longer words are not kept.
KEPT_BYTES = 64


class WordEncoder:
    """Encodes batches of texts by their distinct words.

    For tokenizers that drop white space and mark word ends, as `word_bpe_49k.json`: the ids of
    a text are those of its blank-separated words in a row. Plain words are encoded many in one
    call and told apart by the word-end mark, and up to `KEPT` of them are kept with their ids for
    the next batch; all others are encoded one by one.
    """

    def __init__(self, tokenizer_json: str, ends: np.ndarray | None = None):
        """`ends`: `word_ends` of the tokenizer, if it is known."""
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # No word comes twice in a batch, and those of earlier batches are kept here: the model's own cache only costs.
        self.tokenizer.model._resize_cache(0)
        # The same model for plain words, which need no normalising and are split at blanks.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends = word_ends(self.tokenizer) if ends is None else ends
        self.size = len(self.ends)
        #: Plain words met before, their ids in a row, and how many each has.
        self.kept, self.kept_ids, self.kept_sizes = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def _one_by_one(self, words: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        offsets = pa.array([*range(0, len(words), 64), len(words)], pa.int32())
        rows = pc.binary_join(pa.ListArray.from_arrays(offsets, words), " ").to_pylist()
        found = self.plain.encode_batch_fast(rows, add_special_tokens=False)
        ids = np.concatenate([*(np.array(x.ids, np.uint32) for x in found), np.empty(0, np.uint32)])
        counts = np.diff(np.concatenate(([0], np.flatnonzero(self.ends[ids]) + 1)))
        if len(counts) != len(words):
            raise ValueError("the tokenizer does not mark word ends")
        return ids, counts

    def _pooled(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each distinct plain word in a pool, ids of the pool in a row, and how many each of its words has.

        The pool is what is kept of earlier words, then the new ones, of which as many are kept as there is room for.
        """
        kept = self.kept.cast(words.type)
        numbers = np.asarray(pc.fill_null(pc.index_in(words, value_set=kept), -1)).astype(np.int64)
        new = np.flatnonzero(numbers < 0)
        if not len(new):
            return numbers, self.kept_ids, self.kept_sizes
        # Those that may be kept come first.
        is_long = np.asarray(pc.binary_length(words)) > KEPT_BYTES
        new = np.concatenate((new[~is_long[new]], new[is_long[new]]))
        numbers[new] = np.arange(len(new)) + len(kept)
        found = words.take(pa.array(new))
        ids, sizes = self._plain(found)
        ids, sizes = np.concatenate((self.kept_ids, ids)), np.concatenate((self.kept_sizes, sizes))
        room = min(KEPT - len(kept), len(new) - np.count_nonzero(is_long[new]))
        if room > 0:
            self.kept = pa.concat_arrays([kept, found.slice(0, room)])
            self.kept_sizes = sizes[: len(self.kept)].copy()
            self.kept_ids = ids[: self.kept_sizes.sum()].copy()
        return numbers, ids, sizes

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and how many each has."""
        match = pc.extract_regex(words, PLAIN)
        plain = np.asarray(match.is_valid())
        core, tail = match.filter(match.is_valid()).flatten()
        core, tail = pc.utf8_lower(core).dictionary_encode(), tail.dictionary_encode()
        core_number, core_ids, core_n = self._pooled(core.dictionary)
        others = self._one_by_one(words.filter(pa.array(~plain)).to_pylist())
        tails = self._one_by_one(tail.dictionary.to_pylist())
        # All pieces in one pool; a word is one piece, or a core and a tail.
        pool = np.concatenate([core_ids, *tails, *others])
        sizes = np.concatenate([core_n, [len(x) for x in tails], [len(x) for x in others]]).astype(np.int64)
        first = np.full((len(words), 2), -1, np.int64)
        first[plain, 0] = core_number[np.asarray(core.indices)]
        first[plain, 1] = np.asarray(tail.indices) + len(core_n)
        first[~plain, 0] = np.arange(len(others)) + len(core_n) + len(tails)
        used = first.ravel()
        counts = np.where(used < 0, 0, sizes[used]).reshape(-1, 2).sum(axis=1)
        used = used[used >= 0]
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return pool[ragged(starts[used], sizes[used])], counts

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with `end_id`, and how many each has."""
        texts = pc.fill_null(texts, "")
        # Case is dropped anyway; where a special token might be spelt, letters stay as they are.
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        ids, counts = self._distinct(words.dictionary)
        starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int32 if len(ids) < 1 << 31 else np.int64)
        ids, counts = np.append(ids, np.uint32(end_id)), np.append(counts, 1).astype(np.int32)
        per_text = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        ends = np.cumsum(per_text) + np.arange(len(per_text))
        used = np.empty(len(words) + len(per_text), np.int32)
        is_end = np.zeros(len(used), bool)
        is_end[ends] = True
        used[is_end] = len(counts) - 1
        used[~is_end] = np.asarray(words.indices)
        sizes = counts[used]
        total = np.cumsum(sizes, dtype=np.int64)[ends]
        return ids[ragged(starts[used], sizes)], np.diff(np.concatenate(([0], total)))


_encoders: dict[str, WordEncoder] = {}


def worker_encoder(tokenizer_json: str, ends: np.ndarray) -> WordEncoder:
    """The encoder of this Python process. A worker that runs many tasks makes it once, and its words stay known."""
    if tokenizer_json not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_json] = WordEncoder(tokenizer_json, ends)
    return _encoders[tokenizer_json]


def word_ends(tokenizer) -> np.ndarray:
    """For every id, whether it ends a word."""
    vocab = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocab.values()) + 1, bool)
    ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
    return ends


def read_tokenizer(path: str) -> tuple[str, np.ndarray]:
    """What tasks need of a tokenizer file, so that they neither open it nor list its vocabulary."""
    from tokenizers import Tokenizer

    text = Path(path).read_text()
    return text, word_ends(Tokenizer.from_str(text))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] times, then the same for the next."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 30 and (not len(starts) or starts.max() < 1 << 30) else np.int64
    places = np.repeat((starts - ends + sizes).astype(kind), sizes)
    places += np.arange(total, dtype=kind)
    return places


def compress(
    ids: np.ndarray, terminals: int, rounds: int | None = None, pairs: int = 1 << 16, least: int = 2
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (rules, lengths, sequence). Rule r has symbol terminals + r and is a pair of
    earlier symbols; lengths has the number of ids it stands for.

    Each round counts neighbouring pairs and replaces a batch of at most `pairs`, the most
    frequent; of places that overlap the more frequent pair's goes first. It ends when no pair
    occurs `least` times without overlap, or after `rounds`, if given. Later rounds read only
    places with a new symbol or a pair that was frequent the round before, as old pairs only
    get rarer.
    """
    sequence = ids.astype(np.int32)
    rules, sizes = [], np.ones(terminals, np.int64)
    place = np.arange(max(0, len(sequence) - 1))
    least = max(2, least)
    while len(place) and (rounds is None or len(rules) < rounds):
        keys = pairs_at(sequence, place)
        # Of overlapping places of one pair (a run of one symbol) every second one counts, from the left.
        joined = np.flatnonzero(keys[1:] == keys[:-1]) + 1
        joined = joined[place[joined] - place[joined - 1] == 1]
        opens = np.concatenate(([True], np.diff(joined) != 1))[: len(joined)]
        nth = np.arange(len(joined))
        odd = joined[(nth - np.maximum.accumulate(np.where(opens, nth, 0))) % 2 == 0]
        ordered = np.delete(keys, odd) if len(odd) else keys.copy()
        ordered.sort()
        at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(at, len(ordered)))
        good = np.flatnonzero(counts >= least)
        if not len(good):
            break
        frequent, counts, slots = ordered[at[good]], counts[good], slot(keys)
        frequent_slots = slot(frequent)
        top = by_falling(counts)[:pairs]
        # Of pairs that share a slot of the hash table the most frequent goes first, others wait for a later round.
        number_of = np.full(SLOTS, -1, np.int32)
        number_of[frequent_slots[top[::-1]]] = np.arange(len(top))[::-1]
        filled = np.flatnonzero(number_of >= 0)
        top = top[number_of[filled]]
        chosen, rank = frequent[top], counts[top] * len(top) + np.arange(len(top))
        number_of[filled] = np.arange(len(top))
        key_of = np.full(SLOTS, -1, np.int64)
        key_of[filled] = chosen
        is_chosen = key_of[slots] == keys
        is_chosen[odd] = False
        hit = np.flatnonzero(is_chosen)
        at, number = place[hit], number_of[slots[hit]]
        beside, rises = np.diff(at) == 1, np.diff(rank[number]) > 0
        wins = np.ones(len(at), bool)
        wins[1:] &= ~beside | rises
        wins[:-1] &= ~beside | ~rises
        wins = np.flatnonzero(wins)
        at, number = at[wins], number[wins]
        # The first of the ranks wins all its places, so each round makes a rule.
        used = np.bincount(number, minlength=len(chosen)) >= least
        if not used.all():
            stays = np.flatnonzero(used[number])
            at, number = at[stays], number[stays]
        symbol = (len(sizes) + np.cumsum(used) - 1).astype(np.int32)
        rules.append(np.stack((chosen[used] >> 32, chosen[used] & 0xFFFFFFFF), axis=1))
        sizes = np.concatenate((sizes, sizes[rules[-1]].sum(axis=1)))
        sequence[at] = symbol[number]
        # Places of rare pairs are read no more.
        again = np.zeros(SLOTS, bool)
        again[frequent_slots] = True
        place, gone = next_places(len(sequence), place[np.flatnonzero(again[slots])], at), at + 1
        # A place moves to the left by the symbols that go before it.
        if 8 * len(place) < len(sequence):
            place -= np.searchsorted(gone, place)
            sequence = np.delete(sequence, gone)
        else:
            keep = np.ones(len(sequence), bool)
            keep[gone] = False
            place = (np.cumsum(keep, dtype=np.int32) - 1)[place].astype(np.int64)
            sequence = sequence[np.flatnonzero(keep)]
        if len(place) and place[-1] == len(sequence) - 1:
            place = place[:-1]
    return np.concatenate([*rules, np.empty((0, 2), np.int64)]), sizes[terminals:], sequence


#: Slots of the hash tables of pairs.
SLOTS = 1 << 18


def slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).view(np.int64)


def pairs_at(sequence: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The symbol at each place in the upper half of a number, the one after it in the lower half."""
    if len(place) == len(sequence) - 1:
        left, right = sequence[:-1], sequence[1:]
    else:
        left, right = sequence[place], sequence[place + 1]
    keys = left.astype(np.int64)
    keys <<= 32
    keys |= right
    return keys


def by_falling(counts: np.ndarray) -> np.ndarray:
    """Places by falling count, those of one count in their order."""
    # Sixteen bits are sorted by radix; the few counts beyond them after that.
    short = (0xFFFF - np.minimum(counts, 0xFFFF)).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    high = order[: np.count_nonzero(short == 0)]
    order[: len(high)] = high[np.argsort(-counts[high], kind="stable")]
    return order


def next_places(n: int, place: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of `n` places those read before, those of new symbols and those before them, without what was joined to a symbol."""
    reads = np.zeros(n, bool)
    reads[place] = True
    reads[at] = True
    reads[at[at > 0] - 1] = True
    reads[at + 1] = False
    return np.flatnonzero(reads)


class Block:
    """Reads ids of a block, all or a range."""

    def __init__(self, terminals: int, rules: bytes, lengths: bytes, sequence: bytes, width: int, marks: bytes = b""):
        """The buffers are read where they are; nothing is expanded here."""
        self.terminals = terminals
        self.rules = np.frombuffer(rules, np.uint32).reshape(-1, 2)
        self.lengths = np.frombuffer(lengths, np.uint32)
        self.sequence = np.frombuffer(sequence, np.uint16 if width == 2 else np.uint32)
        self.marks = np.frombuffer(marks, np.int64) if marks else marks_of(self.sequence, self.lengths, terminals)
        #: Symbols that `range` has looked at.
        self.looked_at = 0

    def ids(self) -> np.ndarray:
        """All ids: the rules are laid out once, each from its two parts, then the sequence."""
        lengths = self.lengths.astype(np.int64)
        own = np.cumsum(lengths) - lengths
        # Terminals stand before the rules' expansions in one pool of ids.
        pool = np.concatenate((np.arange(self.terminals, dtype=np.uint32), np.empty(int(lengths.sum()), np.uint32)))

        def begins(symbols: np.ndarray) -> np.ndarray:
            at, deep = symbols.copy(), symbols >= self.terminals
            at[deep] = self.terminals + own[symbols[deep] - self.terminals]
            return at

        first, rules = 0, self.rules.astype(np.int64)
        # Rules whose symbols are all known by then are laid out together.
        whole = np.maximum.accumulate(rules.max(axis=1, initial=0)) - self.terminals
        while first < len(rules):
            last = int(np.searchsorted(whole, first, side="left"))
            symbols = rules[first:last].ravel()
            to = self.terminals + int(own[first])
            part = pool[ragged(begins(symbols), sizes_of(symbols, self.lengths, self.terminals))]
            pool[to : to + len(part)] = part
            first = last
        symbols = self.sequence.astype(np.int64)
        return pool[ragged(begins(symbols), sizes_of(symbols, self.lengths, self.terminals))]

    def range(self, first: int, n: int) -> np.ndarray:
        """`n` ids from place `first`.

        The marks lead to the symbols over them; these are replaced by their two parts, level by
        level, and a part that ends before the range or begins after it is left out. So as many rules are read as the
        range has ids, and the way down to its two ends.
        """
        low = max(0, int(np.searchsorted(self.marks, first, side="right")) - 1)
        high = int(np.searchsorted(self.marks, first + n, side="left"))
        symbols = self.sequence[low * MARK : high * MARK].astype(np.int64)
        at = int(self.marks[low]) if len(self.marks) else 0
        while True:
            self.looked_at += len(symbols)
            sizes = sizes_of(symbols, self.lengths, self.terminals)
            ends = at + np.cumsum(sizes)
            over = (ends > first) & (ends - sizes < first + n)
            if over.any():
                at = int((ends - sizes)[over][0])
            symbols = symbols[over]
            deep = symbols >= self.terminals
            if not deep.any():
                return symbols.astype(np.uint32)
            parts = np.full((len(symbols), 2), -1, np.int64)
            parts[:, 0] = symbols
            parts[deep] = self.rules[symbols[deep] - self.terminals]
            symbols = parts[parts >= 0]


#: Symbols of a sequence between two marks.
MARK = 2048


def sizes_of(symbols: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    sizes = np.ones(len(symbols), np.int64)
    rule = symbols >= terminals
    sizes[rule] = lengths[symbols[rule] - terminals]
    return sizes


def marks_of(sequence: np.ndarray, lengths: np.ndarray, terminals: int) -> np.ndarray:
    """The number of ids before every `MARK`-th symbol."""
    sizes = sizes_of(sequence.astype(np.int64), lengths, terminals)
    return (np.cumsum(sizes) - sizes)[::MARK]


def block_schema(id_type: str) -> str:
    return (
        "part int, block int, n_ids bigint, terminals int, doc_ids array<" + id_type + ">, doc_lengths array<bigint>, "
        "rules binary, lengths binary, width int, sequence binary, marks binary"
    )


def encode_blocks(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    block_ids: int = 1 << 20,
    rounds: int | None = None,
    pairs: int = 1 << 16,
    least: int = 2,
) -> DataFrame:
    """One row per block, in the order of (part, block); documents in ascending order of id.

    A block is closed by the document that fills it to `block_ids`, so a task holds one block and
    one batch of texts, however large its part is. A document of more ids than that is a block of its own. The tokenizer is read by the driver and goes
    to the tasks.

    Null and empty texts have `end_id` only. Null ids come first. Rows of one id are in the order
    of a hash of the text; equal rows follow each other. An empty table gives no block.
    """
    tokenizer = read_tokenizer(tokenizer_path)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("__hash"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("__hash").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    rows = rows.select("doc_id", "text")
    schema = block_schema(rows.schema["doc_id"].dataType.simpleString())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(*tokenizer)
        part, block = TaskContext.get().partitionId(), 0
        doc_type = None
        held_ids, held_docs, held_sizes = [], [], []

        def close() -> pa.RecordBatch:
            ids, sizes = np.concatenate(held_ids), np.concatenate(held_sizes)
            rules, lengths, sequence = compress(ids, encoder.size, rounds, pairs, least)
            width = 2 if encoder.size + len(rules) <= 1 << 16 else 4
            values = {
                "part": pa.array([part], pa.int32()),
                "block": pa.array([block], pa.int32()),
                "n_ids": pa.array([len(ids)], pa.int64()),
                "terminals": pa.array([encoder.size], pa.int32()),
                "doc_ids": pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.concat_arrays(held_docs)),
                "doc_lengths": pa.array([sizes.tolist()], pa.list_(pa.int64())),
                "rules": pa.array([rules.astype(np.uint32).tobytes()], pa.binary()),
                "lengths": pa.array([lengths.astype(np.uint32).tobytes()], pa.binary()),
                "width": pa.array([width], pa.int32()),
                "sequence": pa.array([sequence.astype(np.uint16 if width == 2 else np.uint32).tobytes()], pa.binary()),
                "marks": pa.array([marks_of(sequence, lengths, encoder.size).tobytes()], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(values)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = encoder.encode(batch.column(1), end_id)
            ends, at, id_at = np.cumsum(sizes), 0, 0
            while at < len(sizes):
                room = block_ids - sum(map(len, held_ids))
                cut = min(len(sizes), int(np.searchsorted(ends, id_at + room, side="left")) + 1)
                held_ids.append(ids[id_at : ends[cut - 1]])
                held_sizes.append(sizes[at:cut])
                held_docs.append(batch.column(0).slice(at, cut - at))
                at, id_at = cut, int(ends[cut - 1])
                if sum(map(len, held_ids)) >= block_ids:
                    yield close()
                    block += 1
                    held_ids, held_docs, held_sizes = [], [], []
        if held_sizes:
            yield close()

    return rows.mapInArrow(encode, schema)


def decode_documents(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, part, block, within, n_tokens, ids_crc32, ids) of all documents, from the blocks.

    `within` is the number of ids before the document in its block; `ids` are little-endian
    unsigned 32-bit numbers, ids_crc32 their checksum. `with_ids`: false leaves `ids` out.
    """
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, part int, block int, within bigint, n_tokens bigint, ids_crc32 bigint" + (
        ", ids binary" if with_ids else ""
    )

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                one = {k: row.column(k)[0].as_py() for k in ("part", "block", "terminals", "rules", "lengths", "sequence", "width")}
                block = Block(one["terminals"], one["rules"], one["lengths"], one["sequence"], one["width"])
                data = block.ids().astype("<u4").tobytes()
                sizes = np.asarray(row.column("doc_lengths").flatten()).astype(np.int64)
                ends = np.cumsum(sizes)
                spans = list(zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist()))
                view = memoryview(data)
                columns = {
                    "doc_id": row.column("doc_ids").flatten(),
                    "part": pa.array(np.full(len(sizes), one["part"], np.int32)),
                    "block": pa.array(np.full(len(sizes), one["block"], np.int32)),
                    "within": pa.array(ends - sizes),
                    "n_tokens": pa.array(sizes),
                    "ids_crc32": pa.array([zlib.crc32(view[a:b]) for a, b in spans], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([data[a:b] for a, b in spans], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return blocks.mapInArrow(decode, schema)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, **kwargs) -> None:
    """Write the blocks of all documents to a Parquet table."""
    encode_blocks(docs, tokenizer_path, **kwargs).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """`decode_documents` with `start`: the number of ids in all documents before.

    Offsets are running sums over parts, then over the blocks of a part; both tables have a row
    per part or block. They meet the documents' rows on (part, block).
    """
    blocks = spark.read.parquet(path)
    sizes = blocks.select("part", "block", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy(F.col("part").alias("p")).agg(F.sum("n_ids").alias("n"))
    parts = parts.select("p", F.coalesce(F.sum("n").over(before.orderBy("p")), F.lit(0)).alias("of_part"))
    offsets = sizes.join(parts, F.col("part") == F.col("p"))
    inside = F.coalesce(F.sum("n_ids").over(before.partitionBy("part").orderBy("block")), F.lit(0))
    offsets = offsets.select(F.col("part").alias("p"), F.col("block").alias("b"), (F.col("of_part") + inside).alias("offset"))
    docs = decode_documents(blocks, with_ids)
    rows = docs.join(offsets, (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    return rows.withColumn("start", F.col("offset") + F.col("within")).drop("p", "b", "offset", "part", "block", "within")
