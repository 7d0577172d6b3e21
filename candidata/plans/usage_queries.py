"""Usage, limits and the request window."""

from __future__ import annotations

from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.operators import usage
from candidata.plans.fixture_sql import CALLS, with_
from candidata.plans.fixtures import call_log, first_and_last_day, model_catalog
from candidata.plans.registry import query
from candidata.sources.records import scan_usage_ledger

LIMITS = """limits AS (
  SELECT c.*, d.day, coalesce(u.calls, 0) AS used FROM catalog c CROSS JOIN days d
  LEFT JOIN used u ON u.provider = c.provider AND u.model = c.model AND u.day = d.day)"""


def _counts(spark, d):
    return usage.usage_counts(call_log(spark, d))


def _daily_catalog(spark, d):
    return usage.catalog_by_day(model_catalog(spark, d), *first_and_last_day(call_log(spark, d)))


@query("usage_counts", with_(CALLS) + "SELECT provider, model, day, calls FROM used")
def _(spark, d):
    return _counts(spark, d)


@query("scan_usage_ledger", with_(CALLS) + "SELECT provider, model, day, calls FROM used")
def _(spark, d):
    path = fresh_path(spark, "ledger")
    usage.write_usage_ledger(_counts(spark, d), path)
    return scan_usage_ledger(spark, path)


@query(
    "write_usage_ledger",
    with_(CALLS)
    + """, models AS (SELECT provider, model, '"' || model || '":{' || string_agg('"' || day || '":' || calls, ',' ORDER BY day) || '}' AS js
      FROM used GROUP BY provider, model)
    SELECT provider, '{"' || provider || '":{' || string_agg(js, ',' ORDER BY model) || '}}' AS ledger
    FROM models GROUP BY provider""",
)
def _(spark, d):
    return usage.ledger_text(_counts(spark, d))


@query(
    "merge_usage",
    with_(CALLS)
    + """SELECT provider, model, day, (calls * 2 + CASE WHEN model = 'view' THEN 1 ELSE 0 END)::BIGINT AS calls FROM used""",
)
def _(spark, d):
    counts = _counts(spark, d)
    viewed = counts.filter("model = 'view'").withColumn("calls", F.lit(1).cast("bigint"))
    return usage.merge_usage(counts, counts.unionByName(viewed))


@query(
    "usage_on",
    with_(CALLS)
    + """SELECT provider, model, day, calls FROM used
    UNION ALL SELECT provider, NULL, day, sum(calls)::BIGINT FROM used GROUP BY provider, day""",
)
def _(spark, d):
    return usage.usage_on(_counts(spark, d))


@query(
    "usage_on_day",
    with_(CALLS)
    + """, last AS (SELECT max(day) AS day FROM used)
    SELECT provider, model, day, calls FROM used JOIN last USING (day)
    UNION ALL SELECT provider, NULL, day, sum(calls)::BIGINT FROM used JOIN last USING (day) GROUP BY provider, day""",
)
def _(spark, d):
    last = call_log(spark, d).agg(F.max("day")).first()[0]
    return usage.usage_on(_counts(spark, d), day=last)


@query(
    "usage_vs_limits",
    with_(CALLS, LIMITS)
    + """SELECT provider, model, day, daily_limit, used, daily_limit - used AS remaining,
      used + 1 <= daily_limit AS available FROM limits""",
)
def _(spark, d):
    return usage.usage_vs_limits(_daily_catalog(spark, d), _counts(spark, d)).select(
        "provider", "model", "day", "daily_limit", "used", "remaining", "available"
    )


@query(
    "usage_summary",
    with_(CALLS, LIMITS)
    + """SELECT provider, day, sum(used)::BIGINT AS total_usage, sum(daily_limit)::BIGINT AS daily_limit,
      (sum(daily_limit) - sum(used))::BIGINT AS remaining,
      round(sum(used)::DOUBLE / sum(daily_limit)::DOUBLE * 100, 6) AS usage_percentage,
      CASE WHEN sum(used) < sum(daily_limit) THEN 'Available' ELSE 'Exhausted' END AS status,
      string_agg(model || ': ' || used || ', ' || CASE WHEN used > 0 THEN 'Today' ELSE 'Not used today' END, '; ' ORDER BY model_ord) AS models
    FROM limits WHERE enabled GROUP BY provider, day""",
)
def _(spark, d):
    entry = lambda m: F.concat(
        m["key"], F.lit(": "), m["value"]["usage"], F.lit(", "), m["value"]["last_used"]
    )
    models = F.array_join(F.transform(F.map_entries("models"), entry), "; ")
    summary = usage.usage_summary(_daily_catalog(spark, d), _counts(spark, d))
    return summary.withColumns(
        {"models": models, "usage_percentage": F.round("usage_percentage", 6)}
    )


@query(
    "provider_availability",
    with_(CALLS, LIMITS)
    + """SELECT provider, day, string_agg(model, ', ' ORDER BY model_ord) AS models,
      CASE WHEN bool_or(used < daily_limit) THEN 'Available' ELSE 'Daily limit reached' END AS status
    FROM limits WHERE enabled GROUP BY provider, day""",
)
def _(spark, d):
    available = usage.provider_availability(_daily_catalog(spark, d), _counts(spark, d))
    return available.withColumn("models", F.array_join("models", ", "))


@query(
    "route_models",
    with_(CALLS, LIMITS)
    + """, spans AS (
      SELECT *, sum(greatest(daily_limit - CASE WHEN model = 'error' THEN used ELSE 0 END, 0))
        OVER (PARTITION BY day ORDER BY provider_ord, model_ord) AS hi,
        hi - greatest(daily_limit - CASE WHEN model = 'error' THEN used ELSE 0 END, 0) AS lo
      FROM limits WHERE enabled),
    numbered AS (
      SELECT event_id, day, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS request_no
      FROM calls WHERE model <> 'error')
    SELECT event_id, n.day, request_no, s.provider AS routed_provider, s.model AS routed_model,
      CASE WHEN s.model IS NULL THEN 'All API providers have reached their daily limits.' END AS error
    FROM numbered n LEFT JOIN spans s ON s.day = n.day AND lo < request_no AND request_no <= hi""",
)
def _(spark, d):
    """Calls that ended in an error are already in the ledger; all others ask for a model."""
    log = call_log(spark, d)
    spent = usage.usage_counts(log.filter("model = 'error'"))
    intervals = usage.capacity_intervals(_daily_catalog(spark, d), spent)
    requests = log.filter("model <> 'error'").select("event_id", "ts", "day")
    return usage.route_models(requests, intervals, ["ts", "event_id"]).drop("ts")


@query(
    "requests_in_window",
    """SELECT event_id, user_id, in_window, in_window > 5 AS over_limit FROM (
         SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
           RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events)""",
)
def _(spark, d):
    counted = usage.requests_in_window(
        call_log(spark, d).select("event_id", "user_id", "ts"),
        "user_id",
        seconds=86_400,
        max_requests=5,
    )
    return counted.drop("ts")
