"""Calls per provider, model and day, against daily limits.

A catalog has the columns provider, provider_ord, model, model_ord, daily_limit and
enabled; it is as long as the list of models. Usage has provider, model, day, calls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.functions.binding import explode_once
from candidata.functions.measures import day_key
from candidata.operators.positions import position, running_total
from candidata.operators.records import ALL_EXHAUSTED, MAX_ATTEMPTS
from candidata.schemas import LEDGER

# Messages and states.
AVAILABLE, EXHAUSTED, LIMIT_REACHED = "Available", "Exhausted", "Daily limit reached"
USED, UNUSED = "Today", "Not used today"
WINDOW_SECONDS = 60
WINDOW_REQUESTS = 15
# Request numbers in one block of the routing join.
BLOCK = 1024


def ledger_rows(df: DataFrame, text: str) -> DataFrame:
    """Ledger texts (provider -> model -> day -> calls) as rows; unreadable ones give none."""
    ledger = F.from_json(F.col(text), LEDGER)
    models = explode_once(df, [], ledger, "provider", "_models")
    days = explode_once(models, ["provider"], F.col("_models"), "model", "_days")
    return explode_once(days, ["provider", "model"], F.col("_days"), "day", "calls")


def ledger_text(usage: DataFrame) -> DataFrame:
    """Usage as ledger texts, one per provider, with sorted keys."""
    days = usage.groupBy("provider", "model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", "calls")))).alias("_days")
    )
    models = F.transform(
        F.array_sort(
            F.collect_list(F.struct("model", F.map_entries("_days").alias("days"))),
        ),
        lambda m: F.struct(m["model"], F.map_from_entries(m["days"])),
    )
    return (
        days.groupBy("provider")
        .agg(F.map_from_entries(models).alias("_models"))
        .select("provider", F.to_json(F.create_map("provider", "_models")).alias("ledger"))
    )


def write_usage_ledger(usage: DataFrame, path: str) -> None:
    """One ledger file per provider, in a folder of its own."""
    ledger_text(usage).write.partitionBy("provider").text(path)


def usage_counts(log: DataFrame, ts: str = "ts") -> DataFrame:
    """Calls per provider, model and day."""
    return log.groupBy("provider", "model", day_key(F.col(ts)).alias("day")).agg(
        F.count(F.lit(1)).alias("calls")
    )


def merge_usage(ledger: DataFrame, added: DataFrame) -> DataFrame:
    """Add new counts to existing ones."""
    return (
        ledger.unionByName(added).groupBy("provider", "model", "day").agg(F.sum("calls").alias("calls"))
    )


def usage_on(usage: DataFrame, day: str | None = None) -> DataFrame:
    """Usage of one day (or of every day) per model, and per provider with a null model."""
    chosen = usage if day is None else usage.filter(F.col("day") == day)
    return chosen.groupingSets(
        [["provider", "model", "day"], ["provider", "day"]], "provider", "model", "day"
    ).agg(F.sum("calls").alias("calls"))


def catalog_by_day(catalog: DataFrame, first: Column, last: Column) -> DataFrame:
    """The catalog once for every day from `first` to `last`."""
    days = F.explode(F.sequence(first.cast("date"), last.cast("date")))
    return catalog.withColumn("day", days).withColumn("day", day_key(F.col("day")))


def usage_vs_limits(catalog: DataFrame, usage: DataFrame) -> DataFrame:
    """Every model of the catalog with its usage and what is left; no usage counts as 0.

    A catalog with a `day` column is compared day by day, else usage is of one day.
    """
    on = ["provider", "model"] + (["day"] if "day" in catalog.columns else [])
    used = usage.groupBy(*on).agg(F.sum("calls").alias("_calls"))
    return (
        catalog.join(used, on, "left")
        .withColumn("used", F.coalesce("_calls", F.lit(0)))
        .withColumn("remaining", F.col("daily_limit") - F.col("used"))
        .withColumn("available", F.col("used") + 1 <= F.col("daily_limit"))
        .drop("_calls")
    )


def usage_summary(catalog: DataFrame, usage: DataFrame) -> DataFrame:
    """Per enabled provider: totals, limit, share used, state and its models.

    The limit of a provider is the sum of the limits of its models; its total also
    counts calls of models that are no longer in the catalog.
    """
    on = ["provider"] + (["day"] if "day" in catalog.columns else [])
    totals = usage.groupBy(*on).agg(F.sum("calls").alias("_total"))
    model = F.struct(
        "model_ord",
        "model",
        F.struct(
            F.col("used").alias("usage"),
            F.when(F.col("used") > 0, USED).otherwise(UNUSED).alias("last_used"),
        ).alias("details"),
    )
    limits = (
        usage_vs_limits(catalog.filter("enabled"), usage)
        .groupBy(*on)
        .agg(
            F.sum("daily_limit").alias("daily_limit"),
            F.map_from_entries(
                F.transform(
                    F.array_sort(F.collect_list(model)),
                    lambda m: F.struct(m["model"], m["details"]),
                )
            ).alias("models"),
        )
    )
    total = F.coalesce(F.col("_total"), F.lit(0))
    return limits.join(totals, on, "left").select(
        *on,
        total.alias("total_usage"),
        "daily_limit",
        (F.col("daily_limit") - total).alias("remaining"),
        (total / F.col("daily_limit") * 100).alias("usage_percentage"),
        F.when(total < F.col("daily_limit"), AVAILABLE).otherwise(EXHAUSTED).alias("status"),
        "models",
    )


def provider_availability(catalog: DataFrame, usage: DataFrame) -> DataFrame:
    """Enabled providers, their models in order, and whether any can take one more call."""
    on = ["provider"] + (["day"] if "day" in catalog.columns else [])
    names = F.transform(
        F.array_sort(F.collect_list(F.struct("model_ord", "model"))), lambda m: m["model"]
    )
    return (
        usage_vs_limits(catalog.filter("enabled"), usage)
        .groupBy(*on)
        .agg(
            names.alias("models"),
            F.when(F.bool_or("available"), AVAILABLE).otherwise(LIMIT_REACHED).alias("status"),
        )
    )


def capacity_intervals(catalog: DataFrame, usage: DataFrame) -> DataFrame:
    """Per day the request numbers each model takes, in catalog order: (lo, hi]."""
    left = F.greatest(F.col("remaining"), F.lit(0))
    in_order = Window.partitionBy("day").orderBy("provider_ord", "model_ord")
    up_to = F.sum("_left").over(in_order)
    return (
        usage_vs_limits(catalog.filter("enabled"), usage)
        .withColumn("_left", left)
        .select("day", (up_to - F.col("_left")).alias("lo"), up_to.alias("hi"), "provider", "model")
    )


def interval_blocks(intervals: DataFrame, asked: DataFrame, day: str = "day") -> DataFrame:
    """The intervals cut at every `BLOCK` request numbers: (day, _block, lo, hi, provider, model).

    `asked` has the number of requests of each day; what lies beyond it is left out. A block
    of numbers holds at most `BLOCK` pieces, so a request meets few of them however many models a day has.
    """
    asked = asked.withColumnRenamed(day, "_day")
    rows = intervals.join(asked, F.col(day) == F.col("_day")).filter("lo < hi AND lo < _asked")
    last = F.floor((F.least("hi", "_asked") - 1) / BLOCK)
    blocks = F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), last)).alias("_block")
    return rows.select(day, blocks, "lo", "hi", "provider", "model")


def route_models(
    requests: DataFrame,
    intervals: DataFrame,
    order: Sequence[str],
    day: str = "day",
) -> DataFrame:
    """Give each request of a day the first model with calls left, else an error.

    Requests are numbered within their day part by part, so a busy day is shared by many
    tasks. Numbers and intervals meet in an equi-join on blocks of numbers, each as long as the
    others, within which the few pieces of a block are compared.
    """
    numbered = position(requests, [day], [F.col(c) for c in order], "request_no")
    asked = requests.groupBy(day).agg(F.count(F.lit(1)).alias("_asked"))
    pieces = interval_blocks(intervals, asked, day).select(
        F.col(day).alias("_day"), F.col("_block").alias("_of"), "lo", "hi",
        F.col("provider").alias("routed_provider"), F.col("model").alias("routed_model"),
    )
    # Stored first, so that its size is known when the join is planned.
    pieces = written(pieces, "pieces")
    number = F.col("request_no")
    met = (F.col(day) == F.col("_day")) & (F.floor((number - 1) / BLOCK) == F.col("_of"))
    routed = numbered.join(pieces, met & (F.col("lo") < number) & (number <= F.col("hi")), "left")
    error = F.when(F.col("_day").isNull(), F.lit(ALL_EXHAUSTED))
    return routed.withColumn("error", error).drop("_day", "_of", "lo", "hi")


def route_attempts(
    files: DataFrame,
    intervals: DataFrame,
    order: Sequence[str],
    attempts: int = MAX_ATTEMPTS,
    day: str = "day",
    wave: str | None = None,
) -> DataFrame:
    """Add `attempts`: the models a file may ask, one after the other, as the limits allow.

    The first attempts of all files of a day are routed before the second ones. A file that
    finds no capacity gets fewer attempts, or none. `order` has to tell files apart. wave: a
    column by which files come one group after the other; all attempts of a wave are routed before the next
    wave, as a stream has to do it.
    """
    waves = [wave] if wave else []
    steps = files.select(
        *waves, *order, day, F.explode(F.sequence(F.lit(1), F.lit(attempts))).alias("_step")
    )
    routed = route_models(steps, intervals, [*waves, "_step", *order], day).filter("error IS NULL")
    step = F.struct("_step", F.col("routed_provider").alias("provider"), F.col("routed_model").alias("model"))
    planned = routed.groupBy(*order, day).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    rows = files.join(planned, [*order, day], "left")
    listed = F.transform("_steps", lambda s: F.struct(s["provider"], s["model"]))
    nothing = F.array().cast("array<struct<provider:string,model:string>>")
    return rows.withColumn("attempts", F.coalesce(listed, nothing)).drop("_steps")


def remaining_intervals(intervals: DataFrame, asked: DataFrame, day: str = "day") -> DataFrame:
    """The intervals that are left once `_asked` requests of each day are routed, numbered from 0 again."""
    taken = asked.withColumnRenamed(day, "_day")
    rows = intervals.join(taken, F.col(day) == F.col("_day"), "left").withColumn("_asked", F.coalesce("_asked", F.lit(0)))
    shifted = {"lo": F.greatest(F.col("lo") - F.col("_asked"), F.lit(0)), "hi": F.col("hi") - F.col("_asked")}
    return rows.withColumns(shifted).filter("lo < hi").select(intervals.columns)


def requests_in_window(
    log: DataFrame,
    key: str,
    ts: str = "ts",
    seconds: float = WINDOW_SECONDS,
    max_requests: int = WINDOW_REQUESTS,
) -> DataFrame:
    """Add the number of requests in the trailing window and whether it is over the limit.

    A request counts from its time until just before `seconds` later. The requests of a key
    and instant are counted first, before the shuffle; a running total over the instants, at
    which the count rises and falls, then meets the requests in one join. So neither a busy key
    nor a busy instant nor a long window has to fit into one task: the instant is one row on one
    side of a join that Spark splits. A request without a time is in no window; its count is 0.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    moves = F.array(
        F.struct(at.alias("_at"), F.lit(1).cast("bigint").alias("_change")),
        F.struct((at + int(seconds * 1_000_000)).alias("_at"), F.lit(-1).cast("bigint").alias("_change")),
    )
    changes = log.select(F.col(key).alias("_key"), F.inline(moves))
    changes = changes.groupBy("_key", "_at").agg(F.sum("_change").alias("_change"))
    counted = running_total(changes, ["_key"], [F.col("_at")], F.col("_change"), "in_window")
    # Inside a struct, null equals null.
    counted = counted.select(F.struct("_key", "_at").alias("_when"), "in_window")
    rows = log.withColumn("_when", F.struct(F.col(key).alias("_key"), at.alias("_at")))
    return (
        rows.join(counted, "_when")
        .drop("_when")
        .withColumn("over_limit", F.col("in_window") > max_requests)
    )
