"""Jobs: state, progress, batches, expiry; also as streams."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from candidata.cluster import fresh_path
from candidata.inference.client import OfflineBrokenClient, OfflineClient
from candidata.functions.measures import day_key
from candidata.operators import jobs
from candidata.operators.extraction import attempts_of, extract_documents
from candidata.operators.usage import capacity_intervals, catalog_by_day, route_attempts, usage_counts
from candidata.plans.fixture_sql import CALLS, CAND_WITH, DOCS, STATES, with_
from candidata.plans.fixtures import (
    CHAT_PROVIDERS,
    as_job_events,
    call_log,
    clean_candidates,
    docs,
    first_and_last_day,
    job_events,
    model_catalog,
    table,
)
from candidata.plans.registry import SQL, query
from candidata.plans.usage_queries import LIMITS
from candidata.sources.documents import NO_TEXT, as_one_stream, drop_repeated_uploads, stream_documents
from candidata.streaming.jobs import current_states, follow_jobs, newest_states
from candidata.streaming.quota import USAGE, extract_stream, ledger_stream, open_ledger, open_quota, route_stream
from candidata.streaming.rates import rates_of_ticks, rocksdb_state, stream_request_ticks, stream_requests_in_window
from candidata.streaming.runs import append_side_by_side, append_to, latest, listed_in, snapshot_log, state_per_core, update_log

TTL = 29.9 * 86_400
ORDER = ("ts", "event_id")


def _text_times(df):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return df.select(*[shown(c) if t == "timestamp" else c for c, t in df.dtypes])


STATE_SQL = (
    with_(STATES)
    + """SELECT job_id, status, type, progress, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at,
      strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM states"""
)


def _states(spark, d):
    return jobs.job_state(job_events(spark, d), order=ORDER)


@query("job_state", STATE_SQL)
def _(spark, d):
    return _text_times(_states(spark, d))


@query(
    "job_overview",
    with_(STATES)
    + """SELECT status, type, count(*) AS n_jobs,
      count(*) FILTER (status IN ('pending', 'processing')) AS n_active FROM states GROUP BY ALL""",
)
def _(spark, d):
    return jobs.job_overview(_states(spark, d))


@query(
    "expire_jobs",
    with_(STATES)
    + """SELECT job_id, status FROM states
    WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(created_at) <= 2583360000000""",
)
def _(spark, d):
    now = job_events(spark, d).agg(F.max("ts").alias("now")).scalar()
    return jobs.expire_jobs(_states(spark, d), now, TTL).select("job_id", "status")


@query(
    "progress",
    with_(STATES)
    + """SELECT event_id, job_id, (row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) * 100
      // count(*) OVER (PARTITION BY job_id))::INT AS progress FROM job_events""",
)
def _(spark, d):
    items = job_events(spark, d).select("event_id", "job_id", "ts")
    return jobs.progress(items, "job_id", [F.col(c) for c in ORDER]).drop("ts")


@query(
    "assign_batches",
    """SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS batch
       FROM documents""",
)
def _(spark, d):
    items = table(spark, d, "documents").select("doc_id", "source")
    return jobs.assign_batches(
        items, "source", [F.col("doc_id")], jobs.FILES_PER_BATCH
    )


@query(
    "estimate_minutes",
    "SELECT source, count(*) AS n_files, count(*) // 15 + 1 AS minutes FROM documents GROUP BY source",
)
def _(spark, d):
    counted = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_files"))
    return counted.withColumn("minutes", jobs.estimate_minutes(F.col("n_files")))


@query(
    "batch_summary",
    CAND_WITH
    + """SELECT r_regionkey, count(*) FILTER (success) AS successful, count(*) AS total
    FROM cand GROUP BY r_regionkey""",
)
def _(spark, d):
    return jobs.batch_summary(clean_candidates(spark, d), "r_regionkey")


QUARTERS = 4


def _quarter(spark, events):
    """The quarter of the time in which an event arrives: its own, or the next for every eighth event."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(us), F.max(us)).first()
    quarter = F.least(F.lit(QUARTERS - 1), F.floor(QUARTERS * (us - first) / (last - first)))
    late = (F.col("event_id") % 8 == 0) & (quarter < QUARTERS - 1)
    return quarter + late.cast("int")


def _fed(spark, d, run):
    """The result of `run` on the event stream, after the last of four runs.

    Each run finds the files of a quarter more and goes on from the same checkpoint.
    """
    events = table(spark, d, "events")
    staged = fresh_path(spark, "staged")
    events.withColumn("_quarter", _quarter(spark, events)).write.partitionBy("_quarter").parquet(staged)
    folder, out = fresh_path(spark, "events"), None
    for n in range(QUARTERS):
        arrived = spark.read.parquet(staged).filter(F.col("_quarter") == n).drop("_quarter")
        arrived.write.parquet(f"{folder}/{n}")
        source = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true")
        out = run(source.parquet(folder))
    return out


def _updated(spark, d, build, keys):
    """The newest rows of a stream that is built on the events and runs in update mode."""
    folder = fresh_path(spark, "stream")
    log = _fed(spark, d, lambda s: update_log(build(s), f"{folder}/updates", f"{folder}/checkpoint"))
    return latest(log, keys)


def _followed(spark, d, ttl):
    """The log of all job states, as a snapshot and the batches after it."""
    folder = fresh_path(spark, "stream")
    follow = lambda s: follow_jobs(as_job_events(s), "8 days", ttl)
    run = lambda s: snapshot_log(follow(s), f"{folder}/log", f"{folder}/checkpoint", newest_states, every=3)
    return _fed(spark, d, run)


@query("job_state_stream", STATE_SQL)
def _(spark, d):
    """States of all jobs; none is old enough to be forgotten."""
    return _text_times(current_states(_followed(spark, d, 60 * 86_400)).drop("expired"))


def _calls(stream):
    kind = F.col("event_type")
    provider = F.when(kind.isin("click", "view"), "p1").otherwise("p2")
    return stream.select("ts", provider.alias("provider"), kind.alias("model"))


@query("usage_counts_stream", with_(CALLS) + "SELECT provider, model, day, calls FROM used")
def _(spark, d):
    return _updated(spark, d, lambda s: usage_counts(_calls(s)), ["provider", "model", "day"])


@query("usage_ledger_stream", with_(CALLS) + "SELECT provider, model, day, calls FROM used")
def _(spark, d):
    """The ledger that a stream of calls keeps up to date."""
    folder = fresh_path(spark, "ledger")
    open_ledger(spark.createDataFrame([], USAGE), f"{folder}/ledger")
    return _fed(spark, d, lambda s: ledger_stream(_calls(s), f"{folder}/ledger", f"{folder}/checkpoint"))


@query(
    "expire_jobs_stream",
    with_(STATES)
    + """SELECT job_id, status, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM states
    WHERE epoch_ms(created_at) + 15 * 86400000 < (SELECT epoch_ms(max(ts)) FROM events) - 8 * 86400000""",
)
def _(spark, d):
    """Jobs live for 15 days, and events may come 8 days late."""
    expired = current_states(_followed(spark, d, 15 * 86_400)).filter("expired")
    return _text_times(expired.select("job_id", "status", "created_at"))


@query(
    "stream_request_rate",
    """WITH ticks AS (SELECT user_id, date_trunc('hour', ts) AS tick, count(*) AS n FROM events GROUP BY ALL),
    spread AS (SELECT user_id, tick - to_hours(k) AS start, n FROM ticks, (SELECT unnest(range(24)) AS k)),
    wins AS (SELECT user_id, start, sum(n)::BIGINT AS requests FROM spread GROUP BY ALL)
    SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS window_start,
      strftime(start + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S.%f') AS window_end, requests, requests > 5 AS over_limit
    FROM wins""",
)
def _(spark, d):
    log = lambda s: s.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    build = lambda s: stream_request_ticks(log(s), "user_id", slide="1 hour", delay="8 days")
    ticks = _updated(spark, d, build, ["user_id", "tick"])
    return _text_times(rates_of_ticks(ticks, "user_id", window="1 day", slide="1 hour", max_requests=5))


@query("requests_in_window_stream", SQL["requests_in_window"])
def _(spark, d):
    """Every request's trailing count, though every eighth request comes up to a quarter late."""

    def build(stream):
        log = stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
        return stream_requests_in_window(log, "user_id", "event_id", seconds=86_400, max_requests=5, delay="8 days")

    with rocksdb_state(spark):
        return _updated(spark, d, build, ["event_id"]).drop("at")


BUNDLE = 20
#: Folders of files that one stream follows.
FOLDERS = 16


def _appended(spark, stream):
    folder = fresh_path(spark, "stream")
    return append_to(stream, f"{folder}/rows", f"{folder}/checkpoint")


def _bundle_folders(spark, d, n, copies=1):
    """The documents in text files of `BUNDLE` documents each, in at most `n` folders of about as many files a copy."""
    folder = fresh_path(spark, "files")
    bundle = F.floor(F.col("doc_id") / BUNDLE)
    dealt = F.coalesce(F.pmod(bundle, F.lit(n)), F.lit(0)).alias("part")
    texts = table(spark, d, "documents").select(dealt, bundle.alias("bundle"), "doc_id", F.col("text").alias("value"))
    ordered = texts.repartition("bundle").sortWithinPartitions("part", "bundle", "doc_id").drop("doc_id")
    for copy in range(copies):
        ordered.write.partitionBy("part", "bundle").text(f"{folder}/{copy}")
    parts = [r["part"] for r in texts.select("part").distinct().orderBy("part").collect()]
    return [f"{folder}/{copy}/part={p}" for copy in range(copies) for p in parts] or [folder]


MODELS = (("p2", "m1"), ("p1", "m2"), ("p2", "m3"))


def _extracted(files):
    client = functools.partial(OfflineClient, frozenset(CHAT_PROVIDERS))
    records = extract_documents(files, client, attempts_of(*MODELS), CHAT_PROVIDERS)
    joined = lambda c, show: F.array_join(F.transform(c, show), "|")
    return records.select(
        F.regexp_extract("filename", r"\d+", 0).cast("bigint").alias("id"),
        "success",
        "text_length",
        "provider",
        "model",
        "summary",
        *[F.col(f"personal_info.{f}").alias(f) for f in ("name", "email", "phone")],
        F.array_join("skills", "|").alias("skills"),
        joined("experience", lambda e: F.concat_ws("/", e["title"], e["company"])).alias("worked"),
        joined("projects", lambda p: F.concat(p["name"], F.lit(":"), F.array_join(p["technologies"], "+"))).alias("projects"),
        F.size("awards").alias("n_awards"),
        "error",
        "raw_response",
        "cause",
    )


def _extracted_sql(files: str) -> str:
    """Expected records of files with id, n characters, and an error for those not asked for."""
    ok, m = "refused IS NULL AND n % 8 <> 2", "CASE WHEN n % 4 IN (1, 2) THEN 'm2' ELSE 'm1' END"
    record = {
        "text_length": "n::INT",
        "provider": "CASE WHEN n % 4 IN (1, 2) THEN 'p1' ELSE 'p2' END",
        "model": m,
        "summary": f"{m} || ' read ' || n || ' characters'",
        "email": "'r' || n || '@mail.example.org'",
        "phone": "'+49(30)555-' || lpad((n % 10000)::VARCHAR, 4, '0')",
        "skills": "'Python|Sql|Skill ' || n % 7",
        "worked": "'Reader/|Author/Company ' || n % 5",
        "projects": "'P:Spark'",
    }
    columns = [f"CASE WHEN {ok} THEN {e} END AS {c}" for c, e in record.items() if c not in ("skills", "worked", "projects")]
    columns += [f"CASE WHEN {ok} THEN {record[c]} ELSE '' END AS {c}" for c in ("skills", "worked", "projects")]
    return (
        f"SELECT id, {ok} AS success, CASE WHEN {ok} THEN 'Reader of ' || n ELSE '' END AS name, "
        + ", ".join(columns).replace("END AS email", "ELSE '' END AS email").replace("END AS phone", "ELSE '' END AS phone")
        + """, 0 AS n_awards, CASE WHEN refused IS NOT NULL THEN refused
        WHEN n % 8 = 2 THEN 'Failed to parse AI response as JSON' END AS error,
      CASE WHEN refused IS NULL AND n % 8 = 2 THEN 'No record for ' || n || ' characters' END AS raw_response,
      NULL::VARCHAR AS cause FROM ("""
        + files
        + ")"
    )


@query(
    "extract_documents",
    with_(DOCS)
    + _extracted_sql(
        """SELECT doc_id AS id, length(text) AS n, CASE
        WHEN ends_with(filename, '.pdf') THEN 'No parsed text for .pdf file'
        WHEN NOT ends_with(filename, '.zip') THEN NULL
        WHEN mime_type IN ('text/plain', 'application/pdf')
          THEN 'Error processing file: Error extracting text from .zip file: Unsupported file type: .zip'
        ELSE 'File "' || filename || '" is not supported. Please upload PDF, DOC, DOCX, XLS, XLSX, or TXT files.'
        END AS refused FROM docs"""
    ),
)
def _(spark, d):
    """Text files come as bytes, documents and sheets as parsed text, PDF files as bytes nobody parsed."""
    name = F.lower("filename")
    plain = F.encode("text", "UTF-8")
    content = F.when(name.endswith(".txt") | name.endswith(".zip"), plain).when(
        name.endswith(".pdf"), F.unhex(F.lit("255044462D312E34FFFE00"))
    )
    text = F.when(~name.rlike(r"\.(txt|zip|pdf)$"), F.col("text"))
    return _extracted(docs(spark, d).withColumn("content", content).withColumn("text", text))


@query(
    "extract_despite_bad_json",
    """SELECT doc_id AS id, first OR n % 5 <> 0 OR third AS success,
      CASE WHEN first THEN 'm1' WHEN n % 5 <> 0 THEN 'm2' ELSE 'm3' END AS model,
      CASE WHEN first THEN 1 WHEN n % 5 <> 0 THEN 2 ELSE 3 END AS n_calls,
      CASE WHEN first THEN 'm1' WHEN n % 5 <> 0 THEN 'm2' ELSE 'm3' END || ' read ' || n || ' characters' AS summary
    FROM (SELECT doc_id, length(text) AS n, length(text) % 4 = 3 AS first, true AS third FROM documents
      WHERE regexp_matches(text, '[^\\s]'))""",
)
def _(spark, d):
    """First answers with NaN or repeated keys, second ones in the wrong envelope: the next model is asked."""
    client = functools.partial(OfflineBrokenClient, frozenset(CHAT_PROVIDERS))
    files = table(spark, d, "documents").select(
        F.concat("doc_id", F.lit(".docx")).alias("filename"), "text", F.lit(None).cast("string").alias("mime_type")
    )
    records = extract_documents(files, client, attempts_of(*MODELS), CHAT_PROVIDERS)
    return records.filter(~F.coalesce(F.col("error") == NO_TEXT, F.lit(False))).select(
        F.regexp_extract("filename", r"\d+", 0).cast("bigint").alias("id"),
        "success", "model", F.size("calls").alias("n_calls"), "summary",
    )


@query(
    "stream_documents",
    _extracted_sql(
        f"""SELECT doc_id // {BUNDLE} AS id, sum(length(text) + 1)::BIGINT AS n, NULL::VARCHAR AS refused
        FROM documents GROUP BY ALL"""
    ),
)
def _(spark, d):
    """Files that arrive in several folders; several streams go on at the same time and follow some folders each."""
    # Two cores to a stream; more than eight would only wait for the driver.
    n_streams = max(1, min(8, spark.sparkContext.defaultParallelism // 2))
    folders = _bundle_folders(spark, d, FOLDERS * n_streams)
    # The files are all called part-...; their folders tell them apart.
    named = F.concat(F.regexp_extract("path", r"bundle=(\d+)/", 1), F.lit(".txt"))
    out = fresh_path(spark, "stream")
    with listed_in(spark, 2 * spark.sparkContext.defaultParallelism):
        files = [stream_documents(spark, folder, files_per_batch=20) for folder in folders]
        files = [as_one_stream(files[n::n_streams]) for n in range(min(n_streams, len(files)))]
        records = [_extracted(f.withColumn("filename", named)) for f in files]
        return append_side_by_side(records, f"{out}/rows", f"{out}/checkpoint")


@query(
    "repeated_uploads",
    f"""SELECT id, any_value(md5(t)) AS digest FROM (SELECT doc_id // {BUNDLE} AS id,
      string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY ALL) GROUP BY ALL""",
)
def _(spark, d):
    """Every file is uploaded twice, into one of several folders each time, and taken once."""
    folders = _bundle_folders(spark, d, FOLDERS // 2, copies=2)
    with listed_in(spark, 2 * spark.sparkContext.defaultParallelism), state_per_core(spark):
        files = drop_repeated_uploads([stream_documents(spark, folder, 30) for folder in folders], "1 day")
        number = F.regexp_extract("path", r"bundle=(\d+)/", 1).cast("bigint").alias("id")
        return _appended(spark, files.select(number, F.md5("content").alias("digest")))


def _routed_sql(order: str) -> str:
    return (
        with_(CALLS, LIMITS)
        + f""", spans AS (
      SELECT *, sum(greatest(daily_limit - used, 0)) OVER (PARTITION BY day ORDER BY provider_ord, model_ord) AS hi,
        hi - greatest(daily_limit - used, 0) AS lo
      FROM (SELECT * REPLACE (CASE WHEN model = 'error' THEN used ELSE 0 END AS used) FROM limits WHERE enabled)),
    times AS (SELECT min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events),
    quarters AS (SELECT event_id, least(3, floor(4 * (epoch_us(ts) - first) / (last - first))) AS q FROM events, times),
    waves AS (SELECT event_id, q + CASE WHEN event_id % 8 = 0 AND q < 3 THEN 1 ELSE 0 END AS wave FROM quarters),
    numbered AS (
      SELECT event_id, day, step, row_number() OVER (PARTITION BY day ORDER BY {order}) AS n
      FROM calls JOIN waves USING (event_id), (SELECT unnest([1, 2, 3]) AS step) WHERE model <> 'error')
    SELECT event_id, n.day, coalesce(string_agg(s.provider || '/' || s.model, ' ' ORDER BY step), '') AS attempts
    FROM numbered n LEFT JOIN spans s ON s.day = n.day AND lo < n AND n <= hi GROUP BY event_id, n.day"""
    )


def _asking(spark, d):
    """Calls that did not end in an error, and the request numbers that each model takes after the others."""
    log = call_log(spark, d)
    catalog = catalog_by_day(model_catalog(spark, d), *first_and_last_day(log))
    intervals = capacity_intervals(catalog, usage_counts(log.filter("model = 'error'")))
    return log.filter("model <> 'error'").select("event_id", "ts", "day"), intervals


def _shown(routed):
    shown = F.transform("attempts", lambda a: F.concat_ws("/", a["provider"], a["model"]))
    return routed.select("event_id", "day", F.array_join(shown, " ").alias("attempts"))


@query("route_attempts", _routed_sql("step, ts, event_id"))
def _(spark, d):
    """Three attempts for every call that did not end in an error, within the day's limits."""
    return _shown(route_attempts(*_asking(spark, d), ["ts", "event_id"]))


@query("route_attempts_stream", _routed_sql("wave, step, ts, event_id"))
def _(spark, d):
    """The same on a stream: each quarter is routed with what the quarters before it left."""
    folder = fresh_path(spark, "quota")
    open_quota(_asking(spark, d)[1], folder)

    def run(stream):
        kind, at = F.col("event_type"), F.col("ts").cast("timestamp")
        files = stream.filter(kind != "error").select("event_id", at.alias("ts"), day_key(at).alias("day"))
        return route_stream(files, ["ts", "event_id"], folder, f"{folder}/checkpoint")

    return _shown(_fed(spark, d, run))


SETS, DAY = 4, "2024-01-01"
LIMITED = (("p2", "m1"), ("p1", "m2"), ("p2", "m3"))


def _limited_sql() -> str:
    """Four sets of files, one after the other: plan, calls made, and what they leave."""
    limits = ", ".join(f"('{p}', '{m}', {i})" for i, (p, m) in enumerate(LIMITED))
    parts = [
        f"""files AS (SELECT doc_id // {BUNDLE} AS id, sum(length(text) + 1)::BIGINT AS n FROM documents GROUP BY ALL),
      catalog AS (SELECT provider, model, ord, (SELECT count(*) FROM files) * (ord + 3) // 10 AS daily_limit
        FROM (VALUES {limits}) AS v(provider, model, ord)),
      used_0 AS (SELECT provider, model, 0::BIGINT AS calls FROM catalog)"""
    ]
    for s in range(SETS):
        parts.append(f"""spans_{s} AS (SELECT provider, model, sum(greatest(daily_limit - calls, 0)) OVER (ORDER BY ord) AS hi,
        hi - greatest(daily_limit - calls, 0) AS lo FROM catalog JOIN used_{s} USING (provider, model)),
      steps_{s} AS (SELECT id, n, step, row_number() OVER (ORDER BY step, id) AS number
        FROM files, (SELECT unnest([1, 2, 3]) AS step) WHERE id % {SETS} = {s}),
      plan_{s} AS (SELECT id, n, provider, model, row_number() OVER (PARTITION BY id ORDER BY step) AS attempt,
        n % 4 = 1 AND model = 'm1' AS silent, n % 4 = 2 AND (model = 'm1' OR n % 8 = 2) AS empty
        FROM steps_{s} JOIN spans_{s} ON lo < number AND number <= hi),
      good_{s} AS (SELECT id, min(attempt) AS first FROM plan_{s} WHERE NOT silent AND NOT empty GROUP BY id),
      made_{s} AS (SELECT p.*, first FROM plan_{s} p LEFT JOIN good_{s} USING (id) WHERE first IS NULL OR attempt <= first),
      used_{s + 1} AS (SELECT provider, model, calls + count(id) AS calls FROM used_{s}
        LEFT JOIN made_{s} USING (provider, model) GROUP BY provider, model, calls)""")
    made = " UNION ALL ".join(f"SELECT * FROM made_{s}" for s in range(SETS))
    return (
        with_(*parts)
        + f"""SELECT f.id, coalesce(bool_or(attempt = first), false) AS success, count(attempt) AS n_calls,
      max(CASE WHEN attempt = first THEN model END) AS model,
      CASE WHEN bool_or(attempt = first) THEN NULL WHEN count(attempt) = 0 THEN 'All API providers have reached their daily limits.'
        WHEN arg_max(silent, attempt) THEN 'Failed to extract resume data after multiple attempts.'
        ELSE 'Failed to parse AI response as JSON' END AS error
      FROM files f LEFT JOIN ({made}) m ON f.id = m.id GROUP BY f.id"""
    )


@query("extract_within_limits", _limited_sql())
def _(spark, d):
    """Files that come in four sets, while the models' daily limits run out."""
    texts = table(spark, d, "documents").select(F.floor(F.col("doc_id") / BUNDLE).alias("bundle"), "doc_id", F.col("text").alias("value"))
    n_files = texts.select("bundle").distinct().count()
    rows = [(p, 1, m, i, n_files * (i + 3) // 10, True) for i, (p, m) in enumerate(LIMITED)]
    # The order of the models is that of the list, whatever their provider.
    catalog = spark.createDataFrame(rows, "provider string, provider_ord int, model string, model_ord int, daily_limit bigint, enabled boolean")
    folder, client = fresh_path(spark, "limited"), functools.partial(OfflineClient, frozenset(CHAT_PROVIDERS))
    open_ledger(spark.createDataFrame([], USAGE), f"{folder}/ledger")
    for s in range(SETS):
        some = texts.filter(F.col("bundle") % SETS == s).repartition("bundle").sortWithinPartitions("bundle", "doc_id")
        some.drop("doc_id").write.partitionBy("bundle").text(f"{folder}/files/{s}")
        number = F.regexp_extract("path", r"bundle=(\d+)/", 1)
        # A file has a folder of its own.
        with listed_in(spark):
            files = stream_documents(spark, f"{folder}/files", n_files)
            files = files.withColumn("filename", F.concat(number, F.lit(".txt"))).withColumn("id", number.cast("bigint"))
            records = extract_stream(files, client, catalog, F.lit(DAY), ["id"], folder, f"{folder}/checkpoint", CHAT_PROVIDERS)
    return records.select(
        F.regexp_extract("filename", r"\d+", 0).cast("bigint").alias("id"),
        "success", F.size("calls").cast("bigint").alias("n_calls"), "model", "error",
    )
