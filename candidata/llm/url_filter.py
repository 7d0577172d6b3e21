"""URL filters: given prefix rules, and association rules of URL tokens mined from labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.llm.common import without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
VERDICTS = ("allow", "block")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, labels of the host, words of the path, names of the
    query, fragment. Numbers are one token.
    """
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, PARTS, 3)
    number = F.regexp_replace(path_of(url), "[0-9]+", "#")

    def named(prefix: str, items: Column) -> Column:
        return F.transform(F.array_remove(items, ""), lambda x: F.concat(F.lit(prefix), x))

    scheme = F.array(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    keys = F.regexp_extract_all(rest, F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    fragment = F.array(F.when(rest.contains("#"), "#").otherwise(""))
    return F.array_distinct(
        F.concat(
            named("scheme:", scheme),
            named("host:", F.split(host_of(url), r"\.")),
            named("path:", F.split(number, "[/._-]+")),
            named("query:", keys),
            named("fragment:", fragment),
        )
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits, else null. Rules are (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def token_classes(labelled: DataFrame, least: int) -> DataFrame:
    """(token, class): tokens that stand on at least `least` pages, and what they are mined as.

    Tokens that stand on the same pages are one class, named by its first token: whatever one of them
    says, all say, and together they say no more. Page sets are compared by their size and 128 bits of hash.
    `labelled` has the columns page and tokens.
    """
    each = labelled.select("page", F.explode(F.array_distinct("tokens")).alias("token"))
    pages = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("page")).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(1), "page")).alias("b"),
    )
    pages = written(pages.filter(F.col("n") >= least), "tokens")
    names = pages.groupBy("n", "a", "b").agg(F.min("token").alias("class"))
    return written(pages.join(names, ["n", "a", "b"]).select("token", "class"), "classes")


def in_classes(tokens: DataFrame, key: str, classes: DataFrame) -> DataFrame:
    """(key, classes): the classes of which a row has a token; rows without any are left out."""
    each = tokens.select(key, F.explode("tokens").alias("token")).join(classes, "token")
    return each.groupBy(key).agg(F.sort_array(F.collect_set("class")).alias("classes"))


def mine(labelled: DataFrame, classes: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """(items, verdict, confidence, support) rules over classes of tokens, of labelled pages (page, tokens, verdict).

    FP-growth finds the frequent combinations; a rule stays if its confidence is at least
    `min_confidence` and no rule of fewer classes says the same as surely. Tokens that always come together
    make one item, not two to the power of their number; a page with k different items on enough
    pages still has two to the power of k combinations.
    """
    said = labelled.select("page", F.concat(F.lit("label:"), "verdict").alias("label"))
    baskets = said.join(in_classes(labelled, "page", classes), "page", "left")
    items = F.concat(F.coalesce("classes", F.array().cast("array<string>")), F.array("label"))
    baskets = written(baskets.select(items.alias("items")), "baskets")
    support = min(1.0, least / max(1, baskets.count()))
    # Half a page less, as the product of a fraction and a number may round up.
    support = max(0.0, support - 0.5 / max(1, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(F.get("consequent", F.lit(0)).startswith("label:"))
    rules = rules.select(
        F.sort_array("antecedent").alias("items"),
        F.substring(F.get("consequent", F.lit(0)), 7, 100).alias("verdict"),
        "confidence",
        "support",
    )
    rules = written(rules, "rules")
    # A smaller rule has one item less; chains of them lead to every subset that is a rule.
    parents = rules.select("verdict", F.col("items").alias("part"), F.col("confidence").alias("of_part"))
    shorter = rules.select(
        "items", "verdict", "confidence",
        F.explode(F.transform("items", lambda x: F.array_except("items", F.array(x)))).alias("part"),
    )
    redundant = shorter.join(parents, ["verdict", "part"]).filter(F.col("of_part") >= F.col("confidence"))
    return rules.join(redundant.select("items", "verdict").distinct(), ["items", "verdict"], "left_anti")


def match(urls: DataFrame, classes: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, verdict) of distinct URLs that an association rule matches, by the surest one.

    A class is matched by any of its tokens. An inverted index holds each rule under its rarest class, so that a
    common one leads to those rules only that have no other. Ties: higher support, then block.
    """
    tokens = in_classes(urls.select("url", tokens_of(F.col("url")).alias("tokens")), "url", classes)
    tokens = written(tokens, "url-classes")
    postings = tokens.select("url", "classes", F.explode("classes").alias("class"))
    counts = postings.groupBy("class").agg(F.count("*").alias("n"))
    each = rules.select("*", F.explode("items").alias("class")).join(counts, "class")
    index = each.groupBy("items", "verdict", "confidence", "support").agg(
        F.min(F.struct("n", "class"))["class"].alias("class")
    )
    index = index.groupBy("class").agg(F.collect_list(F.struct("confidence", "support", "verdict", "items")).alias("rules"))
    found = postings.join(index, "class").select(
        "url", F.filter("rules", lambda r: F.size(F.array_except(r["items"], F.col("classes"))) == 0).alias("rules")
    )
    best = F.array_max(F.transform("rules", lambda r: F.struct(r["confidence"], r["support"], r["verdict"])))
    return found.withColumn("best", best).groupBy("url").agg(F.max("best").alias("best")).filter("best IS NOT NULL").select(
        "url", F.col("best")["verdict"].alias("verdict")
    )


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]],
    url: str = "url",
    page_id: str = "page_id",
    label_id: str = "doc_id",
    bad: Column | None = None,
    min_pages: int = 10,
    min_confidence: float = 0.6,
) -> DataFrame:
    """Add host, path, rule and verdict to every page.

    A given rule decides where one fits. Else the association rules decide: they are mined from
    all pages that have a label (`bad`: by default quality 0 or toxic 1; a row of labels that is
    neither good nor bad for nulls counts as good). A rule needs the support of `min_pages` pages and the square
    root of their number, at every size: 20 pages of a hundred, 110 of ten thousand, 1010 of a
    million. A URL that no rule matches is allowed.

    Association rules see distinct URLs only, so a URL that many pages share is matched once, and
    joined back on the URL, a join Spark splits. The driver gets the tokens that have the support, at most as
    many as a page has tokens times the root of the number of pages. Null URLs and URLs without `://` have an empty
    host and path and no tokens, and are allowed. Very long URLs are read whole. Null ids match no label. Equal rows
    get equal results. Columns with the name of a result are replaced, others passed on. With few
    labelled pages there are no association rules.
    """
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1) if bad is None else bad
    pages = without(pages, *({"host", "path", "rule", "verdict"} - {url, page_id}))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    given = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    given = given.withColumn("rule", rule).withColumn("__given", verdict)

    said = labels.groupBy(F.col(label_id).alias("__id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("__bad"))
    labelled = pages.select(F.col(page_id).alias("__page"), tokens_of(F.col(url)).alias("tokens"))
    labelled = labelled.join(said, F.col("__page") == F.col("__id")).select(
        F.monotonically_increasing_id().alias("page"),
        "tokens", F.when(F.col("__bad"), "block").otherwise("allow").alias("verdict"),
    )
    labelled = written(labelled, "labelled")
    least = min_pages + math.ceil(math.sqrt(labelled.count()))
    classes = token_classes(labelled, least)
    mined = written(mine(labelled, classes, least, min_confidence), "rules")
    open_urls = given.filter("__given IS NULL").select(F.col(url).alias("url")).filter("url IS NOT NULL").distinct()
    found = match(open_urls, classes, mined).select(F.col("url").alias("__url"), F.col("verdict").alias("__mined"))
    rows = given.join(found, F.col(url) == F.col("__url"), "left")
    return rows.withColumn("verdict", F.coalesce("__given", "__mined", F.lit("allow"))).drop("__given", "__url", "__mined")
