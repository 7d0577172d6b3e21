"""Phrases of any length found in texts, by an index on their first words.

The phrases are a table; it may be longer than any broadcast. A text is read once: its words meet the
first words of the phrases in an equi-join, and only where one begins a phrase are runs of the
lengths in question put together and met with the whole phrases in a second one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidata.functions.binding import explode_once


def phrase_index(phrases: DataFrame, words: Column) -> DataFrame:
    """(_phrase, _first, _size) of the different phrases, given as lists of words.

    Null phrases and those without words are left out.
    """
    rows = phrases.select(words.alias("_words")).filter(F.size("_words") > 0)
    return rows.select(
        F.array_join("_words", " ").alias("_phrase"), F.get("_words", F.lit(0)).alias("_first"), F.size("_words").alias("_size")
    ).distinct()


def phrase_hits(texts: DataFrame, keys: Sequence[str], words: Column, index: DataFrame, longest: int) -> DataFrame:
    """(keys, _phrase): each phrase of the index that a text holds; once or more.

    `words` are the text's words, `longest` is the greatest `_size` of the index. A word travels
    with the `longest` words from it on, never with the whole text, and only if it begins a phrase.
    """
    sizes = index.groupBy("_first").agg(F.sort_array(F.collect_set("_size")).alias("_sizes"))
    read = texts.select(*keys, words.alias("_words"))
    places = read.select(*keys, "_words", F.posexplode_outer("_words").alias("_at", "_first"))
    starts = places.select(*keys, "_first", F.slice("_words", F.col("_at") + 1, longest).alias("_run"))
    # Null keeps rows of texts without words out of the join.
    starts = starts.join(sizes, "_first")
    long_enough = F.filter("_sizes", lambda n: n <= F.size("_run"))
    runs = F.transform(long_enough, lambda n: F.array_join(F.slice("_run", 1, n), " "))
    found = explode_once(starts, list(keys), runs, "_phrase")
    return found.join(index.select("_phrase"), "_phrase", "left_semi").select(*keys, "_phrase")


def longest_phrase(index: DataFrame) -> int:
    return index.agg(F.max("_size")).first()[0] or 1
