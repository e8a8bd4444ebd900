"""Disclosure control: suppression, pseudonyms and release rules for aggregates.

All rules fail closed: an unknown denominator suppresses. Suppressed rows stay
in the table with NULL numbers and a status.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Default minimum of contributing clusters, and the review states of a released row.
MIN_CLUSTERS = 10
SCREENED = "screened_aggregate_pending_review"
SUPPRESSED = "suppressed_requires_review"

# Columns that identify individuals and never leave in a released table.
BANNED_COLUMNS = ("record_id", "cluster_id", "seg_idx", "target", "score", "path", "model_file", "source_path")


def enough(counts: Sequence[str | Column], minimum: int = MIN_CLUSTERS) -> Column:
    """All counts known and at least the minimum."""
    verdict = F.lit(True)
    for count in counts:
        column = F.col(count) if isinstance(count, str) else count
        verdict = verdict & F.coalesce(column >= minimum, F.lit(False))
    return verdict


def empty_or_enough(count: str | Column, minimum: int = MIN_CLUSTERS) -> Column:
    """A cell may be empty, but not small."""
    column = F.col(count) if isinstance(count, str) else count
    return F.coalesce((column == 0) | (column >= minimum), F.lit(False))


def apply_screen(df: DataFrame, numerics: Sequence[str], allowed: Column, status: str = "review_status") -> DataFrame:
    marked = df.withColumn("_allowed", allowed)
    kept = [F.when(F.col("_allowed"), F.col(c)).alias(c) if c in numerics else F.col(c) for c in df.columns if c != status]
    return marked.select(*kept, F.when(F.col("_allowed"), SCREENED).otherwise(SUPPRESSED).alias(status))


def screen(df: DataFrame, numerics: Sequence[str], counts: Sequence[str] = ("clusters", "positive_clusters", "negative_clusters"),
           minimum: int = MIN_CLUSTERS) -> DataFrame:
    """Primary suppression of the declared numeric columns."""
    return apply_screen(df, numerics, enough(counts, minimum))


def screen_partition(df: DataFrame, partition: Sequence[str], numerics: Sequence[str], cell_count: str,
                     minimum: int = MIN_CLUSTERS, also: Column | None = None) -> DataFrame:
    """If any non-empty cell of a partition is small, the whole partition is suppressed."""
    cell_ok = empty_or_enough(cell_count, minimum)
    if also is not None:
        cell_ok = cell_ok & also
    window = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    return apply_screen(df, numerics, F.min(cell_ok).over(window))


def screen_complementary(df: DataFrame, group: Sequence[str], numerics: Sequence[str],
                         counts: Sequence[str] = ("clusters", "positive_clusters", "negative_clusters"),
                         minimum: int = MIN_CLUSTERS) -> DataFrame:
    """One failing bin blocks every bin of its feature, so nothing follows by subtraction."""
    return apply_screen(df, numerics, F.min(enough(counts, minimum)).over(Window.partitionBy(*group)))


def screen_linked(tables: dict[str, tuple[DataFrame, str]], margin: DataFrame, numerics: Sequence[str], allowed: Column,
                  count: str = "clusters", minimum: int = MIN_CLUSTERS) -> tuple[dict[str, DataFrame], DataFrame]:
    """Screens several break-downs of one total so that no blanked cell follows by subtraction.

    tables: name to (cells, key column); the cells of each add up to the one row
    of ``margin`` in every numeric. ``allowed`` is the primary rule of a row. In
    a table that hides one cell, or only cells that together may stem from fewer
    than ``minimum`` contributors, the smallest shown cell (then by key) is
    hidden too. Where none can be, the total is hidden; and where the total is
    hidden, a table that shows every cell hides its smallest, as it would add up
    to the total. The tables are short lists of cells, so each is one window.
    """
    def judged(cells: DataFrame, key: str) -> DataFrame:
        every = Window.partitionBy(F.lit(0))
        marked = cells.withColumn("_ok", F.coalesce(allowed, F.lit(False))).withColumn("_free", F.col("_ok") & F.coalesce(F.col(count) >= minimum, F.lit(False)))
        seen = marked.withColumns({
            "_hidden": F.count_if(~F.col("_ok")).over(every), "_widest": F.max(F.when(~F.col("_ok"), F.col(count))).over(every),
            "_choices": F.count_if("_free").over(every), "_turn": F.row_number().over(every.orderBy(F.col("_free").desc(), count, key))})
        open_ = (F.col("_hidden") > 0) & ((F.col("_hidden") == 1) | F.coalesce(F.col("_widest") < minimum, F.lit(True)))
        return seen.withColumn("_open", open_)

    cells = {name: judged(df, key) for name, (df, key) in tables.items()}
    stuck = F.lit(False)
    for df in cells.values():
        stuck = stuck | F.coalesce(df.agg(F.bool_or(F.col("_open") & (F.col("_choices") == 0)).alias("v")).scalar(), F.lit(False))
    total = apply_screen(margin, numerics, F.coalesce(allowed, F.lit(False)) & ~stuck)
    gone = F.coalesce(total.agg(F.bool_or(F.col("review_status") == SUPPRESSED).alias("v")).scalar(), F.lit(False))
    out = {}
    for name, df in cells.items():
        extra = F.col("_free") & (F.col("_turn") == 1) & (F.col("_open") | ((F.col("_hidden") == 0) & gone))
        out[name] = apply_screen(df, numerics, F.col("_ok") & ~extra).drop("_ok", "_free", "_hidden", "_widest", "_choices", "_turn", "_open")
    return out, total


def screen_alarm_metrics(df: DataFrame, numerics: Sequence[str],
                         alarm_metrics: Sequence[str] = ("normal_record_alarm_rate", "false_alarms_per_normal_hour"),
                         minimum: int = MIN_CLUSTERS) -> DataFrame:
    """Alarm metrics need their own normal / alarmed / quiet clusters on top of the class counts."""
    own = enough(["normal_clusters", "normal_alarm_clusters", "normal_quiet_clusters"], minimum)
    # Both verdicts come from the counts before any of them is blanked.
    judged = df.withColumn("_own", own)
    shown = apply_screen(judged, numerics, enough(["clusters", "positive_clusters", "negative_clusters"], minimum))
    return shown.select(*[F.when(F.col("_own"), F.col(c)).alias(c) if c in alarm_metrics else F.col(c) for c in shown.columns if c != "_own"])


def screen_moments(df: DataFrame, numerics: Sequence[str], minimum: int = MIN_CLUSTERS) -> DataFrame:
    """Feature moments also need zero and non-zero contributors that are absent or numerous."""
    allowed = enough(["clusters", "positive_clusters", "negative_clusters"], minimum)
    return apply_screen(df, numerics, allowed & empty_or_enough("zero_clusters", minimum) & empty_or_enough("nonzero_clusters", minimum))


def pseudonymise(df: DataFrame, column: str, name: str = "alias", prefix: str = "S") -> DataFrame:
    """Ordinal pseudonyms by sorted name; the key is dropped.

    Only the distinct names are ordered: sites are a short, fixed code list.
    """
    names = df.select(column).distinct()
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column))
    text = number.cast("string")
    labels = names.select(F.col(column).alias("_name"), F.concat(F.lit(prefix), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)).alias(name))
    return df.join(labels, F.col(column).eqNullSafe(F.col("_name"))).drop(column, "_name")


def release_count(count: Column, minimum: int = MIN_CLUSTERS) -> Column:
    """A count is shown only when it is zero or at least the minimum."""
    return F.when((count == 0) | (count >= minimum), count)


def banned_columns(df: DataFrame, deny: Sequence[str] = BANNED_COLUMNS) -> list[str]:
    return sorted(set(df.columns) & set(deny))


def coverage(tables: dict[str, DataFrame], status: str = "review_status") -> DataFrame:
    """Rows and suppressed rows per released table; an empty table is 'uncollected'."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(status) == SUPPRESSED).alias("suppressed_rows"))
             .select(F.lit(section).alias("section"), "rows", "suppressed_rows") for section, df in tables.items()]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.withColumn("status", F.when(F.col("rows") > 0, "available").otherwise("uncollected"))
