"""Ordering, thresholds and comparison of fit results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidata.functions.binding import explode_once
from candidata.functions.measures import fit_band, parse_percent
from candidata.operators.grid import row_text
from candidata.operators.positions import position

# What a comparison shows of a result.
SHOWN = ("candidate_name", "fit_percentage", "summary", "key_matches", "key_gaps")


def drop_empty_results(results: DataFrame, result: str) -> DataFrame:
    """Evaluations without a result vanish; error records stay."""
    return results.filter(F.col(result).isNotNull())


def min_fit_filter(fit: DataFrame, minimum: Column, score: str = "fit_percentage") -> DataFrame:
    """Results at or above the minimum; a missing or unreadable number counts as 0."""
    return fit.filter(parse_percent(F.col(score)) >= parse_percent(minimum))


def rank_candidates(
    fit: DataFrame, request: str, ordinal: str, score: str = "fit_percentage"
) -> DataFrame:
    """Best first within each request; equals keep their input order.

    A range-partitioned sort: also one large request is spread over many tasks.
    """
    return fit.orderBy(request, parse_percent(F.col(score)).desc(), ordinal)


def rank_after_filter(
    fit: DataFrame,
    request: str,
    ordinal: str,
    minimum: Column,
    score: str = "fit_percentage",
) -> DataFrame:
    """Add `rank`, 1 for the best, counted after the threshold.

    A missing name becomes `Candidate <rank>`. A large request is shared by many tasks.
    """
    kept = min_fit_filter(fit, minimum, score)
    best_first = [parse_percent(F.col(score)).desc(), F.col(ordinal)]
    ranked = position(kept, [request], best_first, "rank")
    fallback = F.concat(F.lit("Candidate "), F.col("rank"))
    return ranked.withColumn("candidate_name", F.coalesce("candidate_name", fallback))


def top_candidates(
    fit: DataFrame, request: str, ordinal: str, k: int, score: str = "fit_percentage"
) -> DataFrame:
    """The best `k` of every request; each task passes on at most `k` per request."""
    best = Window.partitionBy(request).orderBy(parse_percent(F.col(score)).desc(), ordinal)
    return fit.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def compare_two(ranked: DataFrame, request: str, by: str, first, second) -> DataFrame:
    """Two results of a request side by side, chosen by the values of column `by`.

    `by` has to be unique within a request, as a rank is.

    Only the two rows are kept and brought together by an aggregate. Requests that
    lack one of them are left out.
    """
    side = F.struct(*SHOWN)
    both = (
        ranked.filter(F.col(by).isin(first, second))
        .groupBy(request)
        .agg(
            F.first(F.when(F.col(by) == first, side), ignorenulls=True).alias("_a"),
            F.first(F.when(F.col(by) == second, side), ignorenulls=True).alias("_b"),
        )
        .filter(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    )
    return both.select(
        request, *[F.col(f"{s}.{c}").alias(f"{c}{s}") for s in ("_a", "_b") for c in SHOWN]
    )


def compare_top(fit: DataFrame, request: str, ordinal: str, k: int, score: str = "fit_percentage") -> DataFrame:
    """All pairs of the best `k` results of every request side by side, the better one first.

    Each task passes on at most `k` results of a request, and a request gathers `k`, so its
    k * (k - 1) / 2 pairs are made within one row. `lead` is how many points the better one is ahead; `rank_a` and `rank_b`
    are the ranks. A request with one result has no pair.
    """
    side = F.struct("rank", *SHOWN, parse_percent(F.col(score)).alias("points"))
    best = top_candidates(fit, request, ordinal, k, score).groupBy(request).agg(
        F.array_sort(F.collect_list(side)).alias("_top")
    )

    def with_worse(a: Column, i: Column) -> Column:
        return F.transform(F.slice("_top", i + 2, F.lit(k)), lambda b: F.struct(a.alias("a"), b.alias("b")))

    pairs = explode_once(best, [request], F.flatten(F.transform("_top", with_worse)), "_pair")
    sides = [F.col(f"_pair.{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("rank", *SHOWN)]
    lead = (F.col("_pair.a.points") - F.col("_pair.b.points")).alias("lead")
    return pairs.select(request, *sides, lead)


def fit_histogram(fit: DataFrame, request: str, score: str = "fit_percentage") -> DataFrame:
    """Number of results per request and quarter."""
    band = fit_band(parse_percent(F.col(score))).alias("band")
    return fit.groupBy(request, band).agg(F.count(F.lit(1)).alias("n"))


def grid_query(
    grid: DataFrame,
    terms: list[str],
    order: list[Column],
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Rows that contain all terms in any of their columns, sorted, one page of them.

    Pages are cut by position, so a deep one is not gathered in one task. `order` has to
    tell rows apart for pages that do not overlap.
    """
    text = row_text(grid)
    hits = reduce(lambda a, b: a & b, [F.contains(text, F.lit(t.lower())) for t in terms], F.lit(True))
    found = grid.filter(hits)
    if not offset and limit is None:
        return found.orderBy(*order)
    place = F.col("_row")
    page = position(found, [], order, "_row").filter(place > offset)
    page = page if limit is None else page.filter(place <= offset + limit)
    return page.orderBy("_row").drop("_row")
