"""Journal queries (M), batch and streaming, over the events table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bindings as B
from ..sources.scratch import scratch_path
from ..streaming import journal as N
from .metric_queries import rounded
from .registry import query

# Which event types stand for which journal events.
EVENT_NAMES = {"signup": "stage_started", "purchase": "stage_finished", "error": "stage_failed", "click": "fit_started", "view": "monitor_sample"}
ALLOWED = ["stage_started", "stage_finished", "stage_failed", "fit_started"]
STAGES = ["data", "splits", "experiment", "report"]
EDGES = [("splits", "data"), ("experiment", "splits"), ("report", "experiment"), ("report", "data")]

NAMED = "n AS (SELECT timestamp, run, event_id, metric, CASE event " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAMES.items()) + \
    " END AS event, ['data', 'splits', 'experiment', 'report'][event_id % 4 + 1] AS stage FROM journal)"
EVENT_LIST = ", ".join(f"'{e}'" for e in ALLOWED)


def named(df):
    mapping = F.create_map(*[F.lit(v) for pair in EVENT_NAMES.items() for v in pair])
    return df.withColumn("event", mapping[F.col("event")]).withColumn("stage", F.array(*[F.lit(s) for s in STAGES])[(F.col("event_id") % 4).cast("int")])


def journal(spark, d):
    return named(B.journal(spark, d))


def journal_stream(spark, d):
    """The events table as a stream of files."""
    rows = spark.readStream.schema(B.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(d)
    return named(rows.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("run"), F.col("event_type").alias("event"), F.col("value").alias("metric"), "event_id"))


@query("M01_journal_ingest", f"""WITH {NAMED} SELECT run, event, stage, count(*) AS rows FROM n WHERE event_id % 50 <> 0 GROUP BY ALL UNION ALL SELECT NULL, 'invalid_json_line', NULL, count(*) FROM n WHERE event_id % 50 = 0""")
def journal_ingest(spark, d):
    """Writes the journal as JSON lines with every fiftieth cut short, and streams it back in."""
    folder = scratch_path(spark, "journal")
    line = F.to_json(F.struct("run", "event", "stage", "metric"))
    journal(spark, d).select(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"run": '), "run")).otherwise(line).alias("value")).write.mode("errorifexists").text(folder)
    schema = "run bigint, event string, stage string, metric double"
    good, bad = N.split_journal(N.read_journal(spark, folder, schema), schema)
    ok = N.run_available(good, "journal-rows").groupBy("run", "event", "stage").agg(F.count(F.lit(1)).alias("rows"))
    issues = N.run_available(bad, "journal-issues").agg(F.count(F.lit(1)).alias("rows"))
    return ok.unionByName(issues.select(F.lit(None).cast("bigint").alias("run"), F.lit("invalid_json_line").alias("event"), F.lit(None).cast("string").alias("stage"), "rows"))


COUNTED = f"WITH {NAMED} SELECT event, stage, count(*) AS count FROM n WHERE event IN ({EVENT_LIST}) GROUP BY ALL"


@query("M02_event_counts", COUNTED)
def event_counts(spark, d):
    return N.event_counts(journal(spark, d), ALLOWED)


@query("M02_event_counts_stream", COUNTED)
def event_counts_stream(spark, d):
    return N.run_available(N.event_counts(journal_stream(spark, d), ALLOWED), "event-counts", "complete")


WINDOWED = """w AS (SELECT time_bucket(INTERVAL '5 minutes', timestamp) AS window_start, time_bucket(INTERVAL '5 minutes', timestamp) + INTERVAL '5 minutes' AS window_end, count(metric) AS samples, round(avg(metric), 6) AS mean, min(metric) AS minimum, max(metric) AS maximum FROM journal GROUP BY ALL)"""
AS_TEXT = "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, samples, mean, minimum, maximum"


def as_text(df):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rounded(df.select(text("window_start"), text("window_end"), "samples", "mean", "minimum", "maximum"), "mean")


@query("M03_resource_windows", f"WITH {WINDOWED} SELECT {AS_TEXT} FROM w")
def resource_windows(spark, d):
    return as_text(N.resource_windows(journal(spark, d)))


@query("M03_resource_windows_stream", f"WITH {WINDOWED} SELECT {AS_TEXT} FROM w WHERE window_end <= (SELECT max(timestamp) - INTERVAL '10 minutes' FROM journal)")
def resource_windows_stream(spark, d):
    """Append mode: only windows behind the watermark have been emitted."""
    return as_text(N.run_available(N.resource_windows(journal_stream(spark, d), watermark="10 minutes"), "resource-windows"))


@query("M03_late_rows", """WITH p AS (SELECT max(timestamp) - INTERVAL '10 minutes' AS lim FROM journal WHERE event <> 'error') SELECT count(*) AS rows, count(*) FILTER (WHERE timestamp < lim) AS late_rows FROM journal CROSS JOIN p WHERE event = 'error'""")
def late_rows(spark, d):
    """Failures reported after everything else: how many come behind the watermark."""
    rows = B.journal(spark, d)
    return N.late_rows(rows.where(F.col("event") == "error"), "10 minutes", rows.where(F.col("event") != "error"))


COUNTER = """c AS (SELECT run AS source, event_id AS sample, epoch_us(timestamp) / 1000000::DOUBLE AS seconds, CAST(event_id * 3 + run AS DOUBLE) AS counter FROM journal),
r AS (SELECT source, sample, round(100 * (counter - lag(counter) OVER w) / nullif(seconds - lag(seconds) OVER w, 0), 6) AS rate FROM c WINDOW w AS (PARTITION BY source ORDER BY seconds, sample))"""


def counters(df):
    return df.select(F.col("run").alias("source"), F.col("event_id").alias("sample"), (F.unix_micros("timestamp") / 1e6).alias("seconds"), (F.col("event_id") * 3 + F.col("run")).cast("double").alias("counter"))


@query("M04_counter_rate", f"WITH {COUNTER} SELECT * FROM r")
def counter_rate(spark, d):
    rates = N.counter_rate(counters(journal(spark, d)), "source", ["seconds", "sample"], "counter", "seconds", memo=(d, "events", "user_id"))
    return rounded(rates.select("source", "sample", "rate"), "rate")


@query("M05_stage_durations", f"""WITH {NAMED}, s AS (SELECT run, stage, min(timestamp) FILTER (WHERE event = 'stage_started') AS a, max(timestamp) FILTER (WHERE event IN ('stage_finished', 'stage_failed')) AS b,
 count(*) FILTER (WHERE event = 'stage_failed') AS f, count(*) FILTER (WHERE event = 'stage_finished') AS g FROM n GROUP BY ALL)
SELECT run, stage, CASE WHEN b >= a THEN (epoch_us(b) - epoch_us(a)) / 1000000::DOUBLE END AS seconds, CASE WHEN f > 0 THEN 'failed' WHEN g > 0 THEN 'complete' WHEN a IS NOT NULL THEN 'running' ELSE 'uncollected' END AS status FROM s""")
def stage_durations(spark, d):
    return N.stage_durations(journal(spark, d))


@query("M06_issue_status", """SELECT run, count(*) FILTER (WHERE event = 'error' AND metric > 60) AS failed_units, CASE WHEN count(*) FILTER (WHERE event = 'error' AND metric > 60) > 0 THEN 'complete_with_issues' ELSE 'complete' END AS status FROM journal GROUP BY run""")
def issue_status(spark, d):
    rows = B.journal(spark, d).select("run", F.col("event_id").alias("unit"), ((F.col("event") == "error") & (F.col("metric") > 60)).alias("failed"))
    return N.issue_status(rows)


@query("M06_blocked_stages", f"""WITH {NAMED}, o AS (SELECT run, stage, max(CASE WHEN event = 'stage_finished' AND metric > 60 THEN 1 ELSE 0 END) AS ok FROM n GROUP BY ALL),
p AS (SELECT run, coalesce(max(ok) FILTER (WHERE stage = 'data'), 0) AS d, coalesce(max(ok) FILTER (WHERE stage = 'splits'), 0) AS s, coalesce(max(ok) FILTER (WHERE stage = 'experiment'), 0) AS e FROM o GROUP BY run)
SELECT run, unnest(['data', 'splits', 'experiment', 'report']) AS stage, unnest([false, d = 0, s = 0 OR d = 0, e = 0 OR s = 0 OR d = 0]) AS blocked FROM p""")
def blocked_stages(spark, d):
    done = (F.col("event") == "stage_finished") & (F.col("metric") > 60)
    stages = journal(spark, d).groupBy("run", "stage").agg(F.when(F.max(done.cast("int")) == 1, "complete").otherwise("failed").alias("status"))
    return N.blocked_stages(stages, spark.createDataFrame(EDGES, "stage string, needs string"))


@query("M07_resource_summary", """SELECT run, count(*) AS samples, max(m) AS peak, min(m) AS minimum, count(m) AS observed_samples FROM (SELECT run, CASE WHEN run % 9 <> 0 AND event <> 'error' THEN metric END AS m FROM journal) GROUP BY run""")
def resource_summary(spark, d):
    rows = B.journal(spark, d).withColumn("metric", F.when((F.col("run") % 9 != 0) & (F.col("event") != "error"), F.col("metric")))
    return N.resource_summary(rows, ["run"])


@query("M04_counter_rate_stream", f"WITH {COUNTER} SELECT * FROM r")
def counter_rate_stream(spark, d):
    return rounded(N.counter_rate_stream(counters(journal_stream(spark, d))), "rate")
