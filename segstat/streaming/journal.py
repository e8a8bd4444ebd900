"""Run-journal queries that work on a batch table and on a stream alike."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.scalars import ratio
from ..plans.ordering import previous_row
from ..sources.scratch import scratch_path

# Window of the periodic samples, and the finished states of a stage.
SAMPLE_WINDOW = "5 minutes"
FINISHED = ("stage_finished", "stage_failed")


def split_journal(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON lines to typed rows, and unreadable lines to issues. Works on a stream."""
    declared = T.StructType.fromDDL(schema)
    parsed = lines.withColumn("_row", F.from_json(column, declared.add("_corrupt", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_row").isNull() | F.col("_row._corrupt").isNotNull() | ~F.col(column).rlike(r"^\s*\{")
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    return parsed.where(~bad).select(*[F.col("_row." + n).alias(n) for n in names]), parsed.where(bad).select(F.col(column).alias("line"), F.lit("invalid_json_line").alias("error"))


def read_journal(spark: SparkSession, folder: str, schema: str, fmt: str = "text") -> DataFrame:
    """A stream over journal files in a folder."""
    if fmt == "text":
        return spark.readStream.format("text").load(folder)
    return spark.readStream.schema(schema).format(fmt).load(folder)


def run_available(stream: DataFrame, label: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Processes everything that is available and returns all rows written so far.

    Append output goes to a file table. Complete output replaces a numbered
    folder per batch; the last one is the result. Progress is kept under
    ``root``: a run that is given the same folder again continues where the last one
    stopped, and returns the earlier result if nothing is new. Without it a fresh folder is taken.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, label)
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", root + "/progress").outputMode(mode)
    if mode == "append":
        writer.format("parquet").option("path", root + "/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(root + "/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    writer.foreachBatch(keep).start().awaitTermination()
    try:
        every = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(root + "/rows")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)       # no batch has ever run
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")


def event_counts(df: DataFrame, allow: Sequence[str], event: str = "event", stage: str = "stage") -> DataFrame:
    """Counts by (event, stage) for listed events only; the same rows from batch and stream."""
    return df.where(F.col(event).isin(*allow)).groupBy(event, stage).agg(F.count(F.lit(1)).alias("count"))


def resource_windows(df: DataFrame, size: str = SAMPLE_WINDOW, watermark: str | None = None, time: str = "timestamp", metric: str = "metric", by: Sequence[str] = ()) -> DataFrame:
    """Samples, mean, min and max per tumbling window. On a stream the watermark bounds the state."""
    timed = df.withWatermark(time, watermark) if watermark else df
    return timed.groupBy(F.window(time, size).alias("_w"), *by).agg(
        F.count(metric).alias("samples"), F.avg(metric).alias("mean"), F.min(metric).alias("minimum"), F.max(metric).alias("maximum")
    ).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, "samples", "mean", "minimum", "maximum")


def late_rows(df: DataFrame, watermark: str, previous_max: DataFrame, time: str = "timestamp") -> DataFrame:
    """How many rows of a new batch arrive behind the watermark of the earlier data."""
    limit = previous_max.agg(F.max(time) - F.expr(f"INTERVAL {watermark}")).scalar()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(time) < limit).alias("late_rows"))


def counter_rate(df: DataFrame, source: str, order: Sequence[str], value: str, seconds: str, scale: float = 100.0, limit: int | None = None, memo: tuple | None = None) -> DataFrame:
    """Change of a cumulative counter per second and source; NULL for the first sample."""
    before = previous_row(df, [source], order, [value, seconds], "_p_", limit, memo)
    rate = scale * ratio(F.col(value) - F.col("_p_" + value), F.col(seconds) - F.col("_p_" + seconds))
    return before.select(*df.columns, rate.alias("rate"))


def counter_rate_stream(stream: DataFrame, root: str | None = None) -> DataFrame:
    """Rates from a stream of (source, sample, seconds, counter), exact for any order of arrival.

    A late sample changes the rates around it, so the stream only takes samples in, each
    once, and rates are derived from all of them; ``root`` names the folder of a run that continues.
    """
    samples = run_available(stream, "counter-samples", root=root)
    return counter_rate(samples, "source", ["seconds", "sample"], "counter", "seconds").select("source", "sample", "rate")


def stage_durations(df: DataFrame, run: str = "run", stage: str = "stage", event: str = "event", time: str = "timestamp") -> DataFrame:
    """First start and last end per (run, stage). A failure outranks a finish, a finish outranks a start."""
    at = lambda *kinds: F.when(F.col(event).isin(*kinds), F.col(time))
    got = df.groupBy(run, stage).agg(F.min(at("stage_started")).alias("started"), F.max(at(*FINISHED)).alias("ended"),
                                     F.max((F.col(event) == "stage_failed").cast("int")).alias("_failed"), F.max((F.col(event) == "stage_finished").cast("int")).alias("_finished"))
    status = F.when(F.col("_failed") == 1, "failed").when(F.col("_finished") == 1, "complete").when(F.col("started").isNotNull(), "running").otherwise("uncollected")
    seconds = (F.unix_micros("ended") - F.unix_micros("started")) / 1e6
    return got.select(run, stage, F.when(F.col("ended") >= F.col("started"), seconds).alias("seconds"), status.alias("status"))


def issue_status(issues: DataFrame, run: str = "run") -> DataFrame:
    """Failed units and overall status per run. Rows: run, unit, failed."""
    return issues.groupBy(run).agg(F.count_if("failed").alias("failed_units")).withColumn(
        "status", F.when(F.col("failed_units") > 0, "complete_with_issues").otherwise("complete"))


def blocked_stages(stages: DataFrame, edges: DataFrame, run: str = "run") -> DataFrame:
    """Stages that cannot run because a stage they need is not complete, directly or through others.

    edges: stage, needs (a short fixed list). Blocking spreads one edge per
    round, so as many rounds as there are edges reach everything.
    """
    links = [(r["stage"], r["needs"]) for r in edges.select("stage", "needs").collect()]
    names = sorted({n for pair in links for n in pair})
    ok = stages.groupBy(run, "stage").agg(F.max(F.col("status").isin("complete", "complete_with_issues").cast("int")).alias("_ok"))
    state = ok.groupBy(run).agg(*[F.coalesce(F.max(F.when(F.col("stage") == n, F.col("_ok"))), F.lit(0)).alias(n) for n in names])
    blocked = {n: F.lit(False) for n in names}
    for _ in links:
        blocked = {n: _any([(F.col(need) == 0) | blocked[need] for stage, need in links if stage == n]) for n in names}
    rows = F.array(*[F.struct(F.lit(n).alias("stage"), blocked[n].alias("blocked")) for n in names])
    return state.select(run, F.inline(rows))


def _any(terms: list[Column]) -> Column:
    verdict = F.lit(False)
    for term in terms:
        verdict = verdict | term
    return verdict


def resource_summary(df: DataFrame, by: Sequence[str] = (), metric: str = "metric", observed: str | None = None) -> DataFrame:
    """Samples, peak and minimum; a metric never observed is NULL, not zero."""
    seen = F.count(metric) if observed is None else F.count_if(observed)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.max(metric).alias("peak"), F.min(metric).alias("minimum"), seen.alias("observed_samples"))
