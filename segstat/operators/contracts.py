"""Contract checks: labels against windows, uniform sampling, quarantine, allow-lists."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import as_double, finite, flag, number_error, strict_double, valid_cluster


def strict_numbers(df: DataFrame, token: str) -> DataFrame:
    return df.withColumn("value", strict_double(F.col(token))).withColumn("error", number_error(F.col(token)))


def expand_bits(df: DataFrame, bits: str, keys: Sequence[str]) -> DataFrame:
    """'0_1_0' to one row per position; a text with other tokens yields one row with an error."""
    good = F.coalesce(F.col(bits).rlike(r"^[01](_[01])*$"), F.lit(False))
    tokens = F.when(good, F.split(bits, "_")).otherwise(F.array(F.lit(None).cast("string")))
    rows = df.select(*keys, good.alias("_good"), F.posexplode(tokens).alias("_pos", "_bit"))
    return rows.select(*keys, F.when(F.col("_good"), F.col("_pos")).cast("bigint").alias("position"), F.col("_bit").cast("int").alias("bit"),
                       F.when(~F.col("_good"), "not_binary_labels").alias("error"))


def check_alignment(labels: DataFrame, windows: DataFrame, record: str = "record_id") -> DataFrame:
    """Label and window counts per record; a mismatch disqualifies the whole record."""
    sides = labels.select(record, F.lit(1).alias("l"), F.lit(0).alias("w")).unionByName(windows.select(record, F.lit(0).alias("l"), F.lit(1).alias("w")))
    return sides.groupBy(record).agg(F.sum("l").alias("n_labels"), F.sum("w").alias("n_windows")).withColumn("aligned", F.col("n_labels") == F.col("n_windows"))


def select_track(df: DataFrame, id_column: str, paired: Column, name: str) -> DataFrame:
    """Paired recordings keep only the tracks of their own sibling; singletons keep all."""
    suffix = F.substring_index(id_column, "_", -1)
    own = suffix.isin("1", "2") & F.contains(F.lower(name), F.concat(F.lit("twin"), suffix))
    return df.where(~paired | own)


def check_uniform(df: DataFrame, record: str, interval: str, tolerance: float = 1e-9) -> DataFrame:
    """All windows of a record share one positive interval (relative tolerance)."""
    got = df.groupBy(record).agg(F.min(interval).alias("min_interval"), F.max(interval).alias("max_interval"))
    close = F.col("max_interval") - F.col("min_interval") <= F.col("max_interval") * tolerance
    return got.withColumn("uniform", F.coalesce((F.col("min_interval") > 0) & close, F.lit(False)))


def exclude_missing(df: DataFrame, threshold: float = 0.3, fraction: str = "missing_fraction") -> tuple[DataFrame, DataFrame]:
    """Kept segments, and the excluded ones with a reason."""
    over = F.col(fraction) > threshold
    return df.where(~over), df.where(over).withColumn("reason", F.lit("fhr_missing_gt_threshold"))


def quarantine(df: DataFrame, errors: DataFrame, record: str = "record_id") -> DataFrame:
    """Removes every row of a record that has any error."""
    return df.join(errors.select(record).distinct(), record, "left_anti")


def require_cluster(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    return df.where(valid_cluster(F.col(cluster)))


def box_audit(labels: DataFrame, boxes: DataFrame, dims: DataFrame, record: str = "record_id") -> DataFrame:
    """Whether a record's boxes sit exactly on its flagged segments.

    labels: record, position, bit. boxes: record, x1, y1, x2, y2, w, h.
    dims: record, width, height (absent: image missing). Everything is counted
    per record and position; no record is gathered.
    """
    tally = labels.groupBy(record).agg(F.count(F.lit(1)).alias("n_segments"), F.sum("bit").alias("n_abnormal"))
    step = F.col("width") / F.col("n_segments")
    placed = boxes.join(tally, record).join(dims, record).withColumn("position", F.bround(F.col("x1") / step, 0).cast("bigint"))
    off = lambda a, b: F.abs(a - b) > 0.5
    checked = placed.select(
        record, "position",
        (off(F.col("x1"), F.col("position") * step) | off(F.col("x2"), (F.col("position") + 1) * step)).alias("boundary"),
        ((F.abs("y1") > 0.5) | off(F.col("y2"), F.col("height")) | (F.col("w") != F.col("width")) | (F.col("h") != F.col("height"))).alias("dimensions"))
    spots = checked.select(record, "position", F.lit(1).alias("b"), F.lit(0).alias("f")).unionByName(
        labels.where(F.col("bit") == 1).select(record, "position", F.lit(0).alias("b"), F.lit(1).alias("f")))
    misplaced = spots.groupBy(record, "position").agg((F.sum("b") != F.sum("f")).alias("_m")).groupBy(record).agg(F.max("_m").alias("_positions"))
    per_record = checked.groupBy(record).agg(F.max("boundary").alias("_boundary"), F.max("dimensions").alias("_dimensions"))
    owned = boxes.groupBy(record).agg(F.count(F.lit(1)).alias("n_boxes"))
    joined = (tally.join(owned, record, "left").fillna(0, ["n_boxes"]).join(dims.select(record, F.lit(True).alias("_image")), record, "left")
              .join(per_record, record, "left").join(misplaced, record, "left"))
    reasons = F.concat_ws(",", F.when(F.col("_positions"), "flag_positions"), F.when(F.col("_dimensions"), "image_dimensions"),
                          F.when(F.col("_boundary"), "segment_boundary"))
    done = (F.col("n_boxes") > 0) & F.col("_image").isNotNull()
    reason = (F.when((F.col("n_boxes") == 0) & (F.col("n_abnormal") > 0), "positive_without_boxes").when(F.col("n_boxes") == 0, "normal_without_boxes")
              .when(F.col("_image").isNull(), "image_missing").when(reasons == "", "ok").otherwise(reasons))
    return joined.select(record, "n_boxes", "n_segments", "n_abnormal", done.alias("checked"), F.when(done, reasons == "").alias("valid"), reason.alias("reason"))


def derive_age(df: DataFrame, birth: str, mother_birth: str, weeks: str, days: str) -> DataFrame:
    """Age from YYYYMM-like integers, and gestational weeks with days as a fraction."""
    year = lambda c: F.floor(F.col(c) / 100)
    return df.withColumn("maternal_age", (year(birth) - year(mother_birth) + 1).cast("double")).withColumn(
        "gestational_age", F.col(weeks) + F.coalesce(F.col(days), F.lit(0)) / 7)


def observed(df: DataFrame, column: str, low: float, high: float, cutoff: float) -> DataFrame:
    """Marks range-valid rows and, for those, whether the value is below the cut-off."""
    valid = F.coalesce(F.col(column).between(low, high), F.lit(False))
    return df.withColumn("observed", valid).withColumn("target", F.when(valid, (F.col(column) < cutoff).cast("int")))


def complete_cases(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    return df.dropna(subset=list(columns)).where(F.col(target).isin(0, 1))


def allowlist(df: DataFrame, labels: dict[str, Sequence[str]], numerics: Sequence[str]) -> DataFrame:
    """Only known labels and declared columns pass; values become finite numbers or NULL."""
    kept = df
    for column, allowed in labels.items():
        kept = kept.where(F.col(column).isin(*allowed))
    number = lambda c: F.when(finite(as_double(F.col(c).cast("string"))), as_double(F.col(c).cast("string")))
    return kept.select(*labels, *[number(c).alias(c) for c in numerics])


def assert_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Violations of key uniqueness; empty when the keys are unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def domain_violations(df: DataFrame, target: str = "target", score: str = "score") -> DataFrame:
    """Counts of non-binary targets and of scores outside [0, 1]."""
    bad_score = ~F.coalesce(finite(F.col(score)) & F.col(score).between(0, 1), F.lit(False))
    return df.agg(F.count_if(~F.coalesce(F.col(target).isin(0, 1), F.lit(False))).alias("bad_targets"), F.count_if(bad_score).alias("bad_scores"))


def parse_flag(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, flag(F.col(column)))
