"""Quality rules: statistics of a text, and lines that too many documents of a host share.

Native: built-in functions, aggregates and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.functions.binding import bind
from candidata.llm.common import computed, same, without, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Seeds of the sketch that tells near copies from texts that share a line only.
SEEDS = (1, 2, 3)
LINES = ("n_shared_lines", "n_shared_words", "clean_text", "kept")


def base_statistics(docs: DataFrame, text: str = "text", min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Add counts of words, symbols, repeated lines and repeated word windows.

    A repeated word lies in a window of three words that the text holds twice or more.
    Windows are compared by a 64-bit hash. All work is linear in the text, but for one
    sort of the windows of texts that repeat any. Null and empty texts have no words and
    fail. Input columns with the name of a result are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    filled = F.filter(F.split(value, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = computed(
        without(docs, *BASE),
        __words=words(F.col(text)),
        __lines=F.transform(filled, lambda line: F.xxhash64(line)),
        n_symbols=F.length(F.regexp_replace(value, r"[^#*$%&|<>]+", "")).cast("bigint"),
    )
    rows = computed(
        rows,
        n_words=F.size("__words").cast("bigint"),
        word_chars=F.length(F.array_join("__words", "")).cast("bigint"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        __windows=F.when(
            F.size("__words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("__words") - 3),
                lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(3)]),
            ),
        ),
    ).drop("__words", "__lines")
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    rows = computed(
        rows,
        __sorted=F.when(
            repeats,
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("__windows")

    def beside(k: Column, step: int) -> Column:
        """Hash of a neighbour; null past the ends."""
        return F.get("__sorted", k + step)["h"]

    twice = F.filter(
        "__sorted",
        lambda x, k: F.coalesce(x["h"] == beside(k, -1), F.lit(False))
        | F.coalesce(x["h"] == beside(k, 1), F.lit(False)),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    rows = computed(rows, n_repeat_words=F.coalesce(F.size(covered), F.lit(0)).cast("bigint")).drop("__sorted")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def normalised_lines(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """One row per non-blank line: keys of its document, place, hash, number of words, and the
    document's sketch (see `sketch`).

    Lines are compared in lower case with single blanks.
    """
    flat = F.lower(F.regexp_replace(F.col(text), r"[\x20\x09\x0B-\x0D]+", " "))
    lines = F.transform(F.split(flat, "\n"), lambda x: F.trim(x))
    rows = docs.select(
        F.col(doc_id).alias("__doc"), F.col(host).alias("__host"), F.xxhash64(text).alias("__text"), lines.alias("__lines")
    )
    rows = computed(rows, __sketch=sketch(F.filter("__lines", lambda x: x != "")))
    rows = rows.select("__doc", "__host", "__text", "__sketch", F.posexplode("__lines").alias("__place", "__line"))
    n_words = F.length("__line") - F.length(F.replace("__line", F.lit(" "), F.lit(""))) + 1
    return rows.filter("__line != ''").select(
        "__doc", "__host", "__text", "__place", F.xxhash64("__line").alias("__line"), n_words.alias("__n"), "__sketch"
    )


def sketch(lines: Column) -> Column:
    """For each seed, the line of least hash (`first`, its hash `h`) and the hash of the next one (`next`).

    Texts that share most of their lines mostly have the same, others hardly ever.
    """

    def hashed(seed: int) -> Column:
        return F.transform(
            lines, lambda x: F.struct(F.substring(F.md5(F.concat(x, F.lit(f"#{seed}"))), 1, 15).alias("h"), F.xxhash64(x).alias("id"))
        )

    def least(each: Column) -> Column:
        def two(first: Column) -> Column:
            others = F.filter(each, lambda x: x["h"] != first["h"])
            return F.struct(first["id"].alias("first"), first["h"].alias("h"), F.array_min(others)["h"].alias("next"))

        return bind(F.array_min(each), two)

    return F.array(*[bind(hashed(seed), least) for seed in SEEDS])


def shared_lines(lines: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """`keys` of the lines that stand in at least `min_docs` different texts, near copies being one.

    Texts are grouped by the line of least hash that they have beside this one: near copies fall into
    one group, texts with nothing else in common into groups of their own. With n texts in groups of c, the
    line stands in n * n / sum(c * c) independent texts, which has to reach the limit for most seeds. So neither
    a group of copies nor one of near copies condemns its own lines, and the limit is the same for a host of any size.
    """
    found = lines.groupBy(*keys).agg(F.count_distinct("__text").alias("__in")).filter(F.col("__in") >= min_docs)
    found = written(found.select(keys), "found")
    holders = lines.join(found, same(lines, found, *keys), "left_semi").select(
        *keys, "__line", "__text", F.posexplode("__sketch").alias("__seed", "__s")
    )
    kin = F.when(F.col("__s.first") == F.col("__line"), F.col("__s.next")).otherwise(F.col("__s.h"))
    holders = holders.select(*[F.col(k) for k in keys], "__seed", "__text", kin.alias("__kin")).distinct()
    groups = holders.groupBy(*keys, "__seed", "__kin").agg(F.count(F.lit(1)).alias("__c"))
    spread = groups.groupBy(*keys, "__seed").agg(
        (F.sum("__c") * F.sum("__c") >= min_docs * F.sum(F.col("__c") * F.col("__c"))).alias("__wide")
    )
    wide = spread.groupBy(*keys).agg(F.count_if("__wide").alias("__n_wide"))
    return written(wide.filter(2 * F.col("__n_wide") > len(SEEDS)).select(keys), "shared")


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = 10,
    long_line: int = 50,
    depleted_percent: int = 50,
) -> DataFrame:
    """Add the base statistics, what the shared lines take away, the text without them, and `kept`.

    A line goes if it stands in at least `min_docs` independent texts (see `shared_lines`) of its host, or,
    with `long_line` words or more, of all hosts. A document is rejected if it fails the base rules, or if
    such lines hold more than `depleted_percent` of its words.

    Line hashes are written once. Documents are counted per host and line with a count
    that combines before the shuffle; a line that a third of all documents have only meets
    its few removal rows in a join that Spark splits.

    Null text: no words, not kept, clean text null. A null host is a host of its own, a
    null id an id. Equal rows get equal results. Other columns are passed on; those with the
    name of a result are replaced. An empty table gives an empty result.
    """
    docs = without(docs, *LINES)
    lines = written(normalised_lines(docs, doc_id, text, host), "lines")
    shared = shared_lines(lines, ["__host", "__line"], min_docs)
    everywhere = shared_lines(lines.filter(F.col("__n") >= long_line), ["__line"], min_docs)
    narrow = lines.drop("__sketch")
    hits = narrow.join(shared, same(narrow, shared, "__host", "__line"), "left_semi").unionByName(
        narrow.join(everywhere, same(narrow, everywhere, "__line"), "left_semi")
    )
    # Sets, as equal rows bring the same lines again.
    removed = hits.groupBy("__doc", "__host", "__text").agg(
        F.collect_set(F.struct("__place", "__n")).alias("__removed")
    )
    # The hash is a column before the join, so that the text is shuffled only for `clean_text`.
    rows = base_statistics(docs, text).withColumn("__hash", F.xxhash64(text))
    rows = rows.join(
        removed,
        rows[doc_id].eqNullSafe(removed["__doc"])
        & rows[host].eqNullSafe(removed["__host"])
        & (F.col("__hash") == removed["__text"]),
        "left",
    ).drop("__doc", "__host", "__text", "__hash")
    n_shared = F.coalesce(
        F.aggregate("__removed", F.lit(0).cast("bigint"), lambda total, x: total + x["__n"]),
        F.lit(0).cast("bigint"),
    )
    depleted = 100 * F.col("n_shared_words") > depleted_percent * F.col("n_words")
    return (
        rows.withColumn("n_shared_lines", F.coalesce(F.size("__removed"), F.lit(0)).cast("bigint"))
        .withColumn("n_shared_words", n_shared)
        .withColumn("clean_text", without_lines(F.col(text), F.col("__removed")))
        .withColumn("kept", ~(F.col("base_failed") | depleted))
        .drop("__removed")
    )


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines at the removed places."""
    lines = F.split(text, "\n")
    places = F.array_except(
        F.sequence(F.lit(0), F.size(lines) - 1), F.transform(removed, lambda x: x["__place"])
    )
    rest = F.get(
        F.transform(
            F.array(lines),
            lambda all_lines: F.array_join(F.transform(places, lambda i: F.get(all_lines, i)), "\n"),
        ),
        F.lit(0),
    )
    return F.when(removed.isNull(), text).otherwise(rest)
