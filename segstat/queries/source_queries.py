"""Sources and profiles (A), contracts (B), alignment (E) and scalars (K)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as V
from ..operators import align as J, contracts as Q, splits as S
from ..plans.ordering import exact_quantiles
from ..sources import bindings as B, ingest as I, profiling as R
from ..sources.scratch import materialize, scratch_path
from .metric_queries import SPLIT, rounded
from .registry import query

SEG = ["record_id", "seg_idx"]


# --- A: sources ------------------------------------------------------------

@query("A01_scan_sources")
def scan_sources(spark, d):
    """Writes the raw texts as one folder of JSON files per kind and scans the tree."""
    root = scratch_path(spark, "raw")
    B.raw_files(spark, d).write.mode("errorifexists").partitionBy("kind").json(root)
    found = I.scan_sources(spark, root, ["documents", "pages", "conversations"])
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def segment_json(spark, d):
    """Segment rows as JSON text; every seventh is cut short and some are not objects."""
    rows = B.segments(spark, d).select(*SEG, "n", "target")
    text = F.to_json(F.struct("record_id", "seg_idx", "n", "target"))
    key = F.col("record_id") + F.col("seg_idx")
    payload = F.when(key % 7 == 0, F.expr("substring(_t, 1, length(_t) - 1)")).when(key % 11 == 0, F.concat(F.lit("["), F.col("_t"), F.lit("]"))).otherwise(F.col("_t"))
    return rows.withColumn("_t", text).select(F.concat_ws("_", *SEG).alias("path"), payload.alias("payload"))


@query("A02_tolerant_json", """SELECT record_id || '_' || seg_idx AS path, CASE WHEN (record_id + seg_idx) % 7 = 0 THEN 'unreadable_json' WHEN (record_id + seg_idx) % 11 = 0 THEN 'not_an_object' ELSE 'ok' END AS category,
CASE WHEN (record_id + seg_idx) % 7 <> 0 AND (record_id + seg_idx) % 11 <> 0 THEN n END AS n, CASE WHEN (record_id + seg_idx) % 7 <> 0 AND (record_id + seg_idx) % 11 <> 0 THEN target END AS target FROM segments""")
def tolerant_json(spark, d):
    good, bad = I.read_json_tolerant(segment_json(spark, d), "payload", "record_id bigint, seg_idx bigint, n bigint, target int")
    return J.stack_tables(good.select("path", F.lit("ok").alias("category"), "n", "target"), bad.select("path", "category"))


@query("A03_inventory", "SELECT kind, count(*) AS files, CAST(sum(strlen(payload)) AS BIGINT) AS bytes, count(*) FILTER (WHERE length(trim(payload)) > 20) AS parsed FROM raw_files GROUP BY kind")
def inventory(spark, d):
    return R.inventory(B.raw_files(spark, d), parsed=F.length(F.trim("payload")) > 20)


FIELD_ROWS = """f AS (
 SELECT 'documents' AS kind, unnest(['doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic', 'blank']) AS field,
   unnest([CAST(record_id AS VARCHAR), site, cluster_id, CAST(n_chars AS VARCHAR), CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR), CASE WHEN record_id % 9 = 0 THEN ' ' WHEN record_id % 9 = 1 THEN '9999' WHEN record_id % 9 = 2 THEN '0' ELSE 'v' END]) AS v,
   unnest(['i', 's', 's', 'i', 'i', 'i', 's']) AS t FROM doc_outcomes
 UNION ALL SELECT 'conversations', unnest(['conv_id', 'turn', 'role', 'share']), unnest([CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, CAST(turn + 0.5 AS VARCHAR)]), unnest(['i', 'i', 's', 'f']) FROM conversations),
den AS (SELECT 'documents' AS kind, count(*) AS d FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations)"""


@query("A04_field_profile", f"""WITH {FIELD_ROWS} SELECT kind, field, count(v) AS present, count(v) FILTER (WHERE t = 's') AS type_string, count(v) FILTER (WHERE t = 'i') AS type_int,
count(v) FILTER (WHERE t = 'f') AS type_float, CAST(0 AS BIGINT) AS type_bool, CAST(0 AS BIGINT) AS type_array, CAST(0 AS BIGINT) AS type_object,
count(*) FILTER (WHERE trim(v) = '') AS null_or_blank, count(*) FILTER (WHERE trim(v) = '9999') AS sentinel_9999, count(*) FILTER (WHERE trim(v) = '0') AS zero,
max(d) AS parsed_denominator, max(d) - count(v) AS absent FROM f JOIN den USING (kind) GROUP BY kind, field HAVING count(v) > 0""")
def field_profile(spark, d):
    key = F.col("record_id") % 9
    blank = F.when(key == 0, " ").when(key == 1, "9999").when(key == 2, "0").otherwise("v")
    docs = B.doc_outcomes(spark, d).select(F.lit("documents").alias("kind"), F.to_json(F.struct(
        F.col("record_id").alias("doc_id"), F.col("site").alias("lang"), F.col("cluster_id").alias("source"), "n_chars", "quality", "toxic", blank.alias("blank"))).alias("payload"))
    talks = B.table(spark, d, "conversations").select(F.lit("conversations").alias("kind"), F.to_json(F.struct(
        "conv_id", "turn", "role", (F.col("turn") + 0.5).alias("share"))).alias("payload"))
    return R.profile_fields(docs.unionByName(talks))


@query("A05_shape_variants", """SELECT '10' AS interval, n AS x_samples, n AS y_samples, CASE WHEN site % 2 = 0 THEN 'str' ELSE 'list' END AS x_type, 'str' AS y_type, count(*) AS windows FROM segments GROUP BY ALL""")
def shape_variants(spark, d):
    rows = B.segments(spark, d).select(F.lit("10").alias("interval"), F.col("n").alias("x_samples"), F.col("n").alias("y_samples"),
                                       F.when(F.col("site") % 2 == 0, "str").otherwise("list").alias("x_type"), F.lit("str").alias("y_type"))
    return R.shape_variants(rows)


TOKEN = "CASE WHEN event_type = 'signup' AND y < 10 THEN 'bad' WHEN event_type = 'click' AND y < 5 THEN 'nan' WHEN event_type = 'view' AND y > 95 THEN '-1' ELSE CAST(x AS VARCHAR) END"


def channel_text(spark, d):
    """Each segment's channels as comma-separated text, with some tokens damaged on purpose."""
    token = (F.when((F.col("event_type") == "signup") & (F.col("y") < 10), "bad").when((F.col("event_type") == "click") & (F.col("y") < 5), "nan")
             .when((F.col("event_type") == "view") & (F.col("y") > 95), "-1").otherwise(F.col("x").cast("string")))
    rows = B.samples(spark, d).select(*SEG, "cluster_id", "site", "sample_idx", token.alias("x"), (F.floor(F.col("y") / 20) * 20).cast("string").alias("y"))
    packed = F.array_sort(F.collect_list(F.struct("sample_idx", "x", "y")))
    return rows.groupBy(*SEG, "cluster_id", "site").agg(packed.alias("_s")).select(
        *SEG, "cluster_id", "site", F.array_join(F.col("_s.x"), ",").alias("x"), F.array_join(F.col("_s.y"), ",").alias("y"))


def stats_sql(value: str, name: str) -> str:
    return f"""{name}_v AS (SELECT record_id, seg_idx, cluster_id, site, sample_idx, CASE WHEN isfinite(TRY_CAST({value} AS DOUBLE)) THEN TRY_CAST({value} AS DOUBLE) END AS v FROM samples),
{name}_m AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE 1 END AS nz, CASE WHEN v <> 0 AND v = lag(v) OVER w THEN 0 ELSE 1 END AS nf FROM {name}_v WINDOW w AS (PARTITION BY record_id, seg_idx ORDER BY sample_idx)),
{name}_r AS (SELECT *, sum(nz) OVER w AS zr, sum(nf) OVER w AS fr FROM {name}_m WINDOW w AS (PARTITION BY record_id, seg_idx ORDER BY sample_idx)),
{name}_z AS (SELECT record_id, seg_idx, max(l) AS lz FROM (SELECT record_id, seg_idx, zr, count(*) FILTER (WHERE v = 0) AS l FROM {name}_r GROUP BY ALL) GROUP BY ALL),
{name}_f AS (SELECT record_id, seg_idx, max(l) AS lf FROM (SELECT record_id, seg_idx, fr, count(*) FILTER (WHERE v <> 0) AS l FROM {name}_r GROUP BY ALL) GROUP BY ALL),
{name} AS (SELECT record_id, seg_idx, cluster_id, site, count(*) AS samples, count(*) FILTER (WHERE v IS NULL) AS invalid, count(*) FILTER (WHERE v = 0) AS zeros, count(*) FILTER (WHERE v < 0) AS negative,
  max(lz) AS longest_zero, max(lf) AS longest_flat, min(v) AS minimum, max(v) AS maximum FROM {name}_r JOIN {name}_z USING (record_id, seg_idx) JOIN {name}_f USING (record_id, seg_idx) GROUP BY ALL)"""


XS, YS = stats_sql(TOKEN, "xs"), stats_sql("CAST(floor(y / 20) * 20 AS VARCHAR)", "ys")


@query("A06_signal_stats", f"WITH {XS} SELECT * EXCLUDE (cluster_id, site) FROM xs")
def signal_stats(spark, d):
    return R.signal_stats(channel_text(spark, d), SEG, "x")


def window_stats(spark, d):
    """Both channels' raw statistics side by side, with the contract flag."""
    text = channel_text(spark, d)
    keys = [*SEG, "cluster_id", "site"]
    both = None
    for channel in ("x", "y"):
        stats = R.signal_stats(text, keys, channel).select(*keys, *[F.col(m).alias(f"{channel}_{m}") for m in ("samples", "invalid", "zeros", "negative")])
        both = stats if both is None else both.join(stats, keys)
    return R.contract_flag(both.withColumn("interval", F.lit(10.0)), 10.0, B.SEGMENT_SAMPLES)


CONTRACT = f"""{XS}, {YS}, ws AS (SELECT xs.record_id, xs.seg_idx, xs.cluster_id, xs.site, xs.samples AS x_samples, xs.zeros AS x_zeros, xs.invalid AS x_invalid, xs.negative AS x_negative,
 ys.samples AS y_samples, ys.zeros AS y_zeros, ys.invalid AS y_invalid, ys.negative AS y_negative,
 xs.samples = 10 AND ys.samples = 10 AND xs.invalid = 0 AND ys.invalid = 0 AND xs.negative = 0 AS contract_candidate, xs.samples = ys.samples AS equal_lengths
 FROM xs JOIN ys ON xs.record_id = ys.record_id AND xs.seg_idx = ys.seg_idx)"""


@query("A07_contract_flag", f"WITH {CONTRACT} SELECT record_id, seg_idx, contract_candidate, equal_lengths FROM ws")
def contract_flag(spark, d):
    return window_stats(spark, d).select(*SEG, "contract_candidate", "equal_lengths")


@query("A08_site_quality", f"WITH {CONTRACT} SELECT site, count(*) AS windows, count(*) FILTER (WHERE contract_candidate) AS contract_candidates, "
       + ", ".join(f"CAST(sum({c}_{m}) AS BIGINT) AS {c}_{m}" for c in "xy" for m in ("samples", "zeros", "invalid", "negative")) + " FROM ws GROUP BY site")
def site_quality(spark, d):
    return R.site_quality(window_stats(spark, d))


GROUPED = """p AS (SELECT DISTINCT sha256(payload) AS fingerprint, kind || ':' || id AS id FROM raw_files),
g AS (SELECT fingerprint, count(*) AS distinct_ids, min(id) AS first_id FROM p GROUP BY 1 HAVING count(*) > 1)"""


def named_files(spark, d):
    return B.raw_files(spark, d).select(F.concat_ws(":", "kind", "id").alias("id"), "payload")


@query("A09_duplicate_groups", f"WITH {GROUPED} SELECT * FROM g")
def duplicate_groups(spark, d):
    return R.duplicate_groups(named_files(spark, d), "id", ["payload"])


@query("A09_duplicate_members", f"WITH {GROUPED} SELECT fingerprint, id, distinct_ids FROM p JOIN g USING (fingerprint)")
def duplicate_members(spark, d):
    return R.duplicate_members(named_files(spark, d), "id", ["payload"])


@query("A10_duplicate_ids", """WITH c AS (SELECT conv_id, count(*) AS files FROM conversations GROUP BY 1 HAVING count(*) > 1)
SELECT 'conversations' AS kind, conv_id AS id, files, conv_id || '/' || turn AS path FROM conversations JOIN c USING (conv_id)""")
def duplicate_ids(spark, d):
    rows = B.table(spark, d, "conversations").select(F.lit("conversations").alias("kind"), F.col("conv_id").alias("id"), F.concat_ws("/", "conv_id", "turn").alias("path"))
    return R.duplicate_ids(rows, ["kind", "id"], "path")


@query("A11_linkage_funnel", """WITH k AS (SELECT id, max(a) AS a, max(l) AS l, max(e) AS e FROM (SELECT doc_id AS id, 1 AS a, 0 AS l, 0 AS e FROM documents UNION ALL SELECT doc_id, 0, 1, 0 FROM labels UNION ALL SELECT page_id, 0, 0, 1 FROM pages) GROUP BY id)
SELECT count(*) FILTER (WHERE a = 1) AS a_ids, count(*) FILTER (WHERE a = 1 AND l = 1) AS a_with_l, count(*) FILTER (WHERE a + l + e = 3) AS a_with_l_and_e, count(*) FILTER (WHERE a = 1 AND l = 0) AS a_without_l,
count(*) FILTER (WHERE a = 1 AND e = 0) AS a_without_e, count(*) FILTER (WHERE a = 0 AND l = 1) AS l_without_a, count(*) FILTER (WHERE a = 0 AND e = 1) AS e_without_a FROM k""")
def linkage(spark, d):
    docs, labels, pages = (B.table(spark, d, t) for t in ("documents", "labels", "pages"))
    return R.linkage(docs.select("doc_id"), labels.select("doc_id"), pages.select(F.col("page_id").alias("doc_id")), "doc_id")


@query("A12_dedup_with_conflicts", """WITH c AS (SELECT sha256(text) AS id, lang AS content, quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT id, count(*) AS copies, min(quality) AS quality, CASE WHEN min(content) <> max(content) OR min(quality) <> max(quality) THEN 'conflict' WHEN count(*) > 1 THEN 'deduplicated' ELSE 'single' END AS status FROM c GROUP BY id""")
def dedup_with_conflicts(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("id"), F.col("lang").alias("content"))
    rows = docs.join(B.table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.dedup_with_conflicts(rows, "id", "content", "quality")


@query("A13_typed_csv_table", """SELECT CAST(record_id AS VARCHAR) AS record_id, CAST(cluster_id AS VARCHAR) AS cluster_id, CAST(site AS VARCHAR) AS site, target, m1 FROM predictions""")
def typed_csv(spark, d):
    """Writes predictions as CSV and reads them back: ids are text, floats make the round trip."""
    folder = scratch_path(spark, "csv")
    I.write_tables({"predictions": B.scored(spark, d).drop("m2")}, folder, "csv")
    return I.read_table(spark, folder + "/predictions", "record_id string, cluster_id string, site string, target int, m1 double")


@query("A14_write_tables", """SELECT CASE WHEN target = 1 THEN 'positives' ELSE 'negatives' END AS section, count(*) AS rows FROM predictions GROUP BY 1 UNION ALL SELECT 'impossible', 0""")
def write_tables(spark, d):
    folder = scratch_path(spark, "tables")
    rows = B.scored(spark, d)
    I.write_tables({"positives": rows.where("target = 1"), "negatives": rows.where("target = 0"), "impossible": rows.where("target > 1")}, folder)
    back = [spark.read.parquet(f"{folder}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("section"), "rows") for n in ("positives", "negatives", "impossible")]
    return J.stack_tables(*back)


@query("A15_manifest", "SELECT kind || ':' || id AS name, sha256(payload) AS sha256, CAST(strlen(payload) AS BIGINT) AS bytes FROM raw_files")
def manifest(spark, d):
    return I.manifest(named_files(spark, d), "id", "payload")


@query("A15_verify_manifest", """SELECT kind || ':' || id AS name, CASE WHEN kind = 'pages' THEN 'missing' ELSE 'changed' END AS state FROM raw_files
WHERE kind = 'pages' OR (kind = 'conversations' AND payload <> upper(payload))""")
def verify_manifest(spark, d):
    files = B.raw_files(spark, d)
    named = lambda df: df.select(F.concat_ws(":", "kind", "id").alias("id"), "payload")
    changed = files.where("kind <> 'pages'").withColumn("payload", F.when(F.col("kind") == "conversations", F.upper("payload")).otherwise(F.col("payload")))
    return I.verify_manifest(I.manifest(named(files), "id", "payload"), I.manifest(named(changed), "id", "payload"))


# --- B: contracts ----------------------------------------------------------

CODED = "CASE WHEN record_id % 10 = 0 THEN '9999' WHEN record_id % 10 = 1 THEN 'abc' WHEN record_id % 10 = 2 THEN 'NaN' WHEN record_id % 10 = 3 THEN '' ELSE CAST(balance AS VARCHAR) END"


def coded(spark, d):
    key = F.col("record_id") % 10
    text = F.when(key == 0, "9999").when(key == 1, "abc").when(key == 2, "NaN").when(key == 3, "").otherwise(F.col("balance").cast("string"))
    return B.records(spark, d).select("record_id", "cluster_id", text.alias("token"))


@query("B01_numeric_or_null", f"""WITH t AS (SELECT record_id, TRY_CAST({CODED} AS DOUBLE) AS v FROM records)
SELECT record_id, CASE WHEN isfinite(v) AND v <> 9999 THEN v END AS value FROM t""")
def numeric_or_null(spark, d):
    return coded(spark, d).select("record_id", V.numeric_or_null(F.col("token")).alias("value"))


@query("B02_strict_numbers", f"""WITH t AS (SELECT record_id, seg_idx, sample_idx, CASE WHEN event_type = 'purchase' AND y < 3 THEN 'true' WHEN event_type = 'purchase' AND y < 6 THEN ' ' ELSE {TOKEN} END AS token FROM samples),
u AS (SELECT *, TRY_CAST(token AS DOUBLE) AS v FROM t)
SELECT record_id, seg_idx, sample_idx, CASE WHEN isfinite(v) AND token <> 'true' THEN v END AS value,
CASE WHEN trim(token) = '' THEN 'blank' WHEN token = 'true' THEN 'boolean' WHEN v IS NULL THEN 'not_numeric' WHEN NOT isfinite(v) THEN 'not_finite' END AS error FROM u""")
def strict_numbers(spark, d):
    purchase = F.col("event_type") == "purchase"
    token = (F.when(purchase & (F.col("y") < 3), "true").when(purchase & (F.col("y") < 6), " ")
             .when((F.col("event_type") == "signup") & (F.col("y") < 10), "bad").when((F.col("event_type") == "click") & (F.col("y") < 5), "nan")
             .when((F.col("event_type") == "view") & (F.col("y") > 95), "-1").otherwise(F.col("x").cast("string")))
    return Q.strict_numbers(B.samples(spark, d).select(*SEG, "sample_idx", token.alias("token")), "token").drop("token")


def label_text(spark, d):
    """Labels as '0_1_0' text, 16 segments to a line so that a long record has many lines."""
    rows = B.segments(spark, d).select("record_id", "seg_idx", "target", F.expr("seg_idx div 16").alias("block"))
    packed = F.array_sort(F.collect_list(F.struct("seg_idx", "target")))
    return rows.groupBy("record_id", "block").agg(packed.alias("_p")).select("record_id", "block", F.array_join(
        F.transform("_p", lambda s: F.when((s["seg_idx"] == 5) & (F.col("record_id") % 17 == 0), "2").otherwise(s["target"].cast("string"))), "_").alias("bits"))


@query("B03_expand_bits", """WITH bad AS (SELECT DISTINCT record_id FROM segments WHERE seg_idx = 5 AND record_id % 17 = 0)
SELECT record_id, seg_idx // 16 AS block, seg_idx % 16 AS position, target AS bit, CAST(NULL AS VARCHAR) AS error FROM segments WHERE NOT (seg_idx // 16 = 0 AND record_id IN (SELECT record_id FROM bad))
UNION ALL SELECT record_id, 0, NULL, NULL, 'not_binary_labels' FROM bad""")
def expand_bits(spark, d):
    return Q.expand_bits(label_text(spark, d), "bits", ["record_id", "block"])


@query("B04_label_alignment", """SELECT record_id, count(*) FILTER (WHERE NOT (record_id % 6 = 0 AND seg_idx = 0)) AS n_labels, count(*) AS n_windows,
count(*) FILTER (WHERE NOT (record_id % 6 = 0 AND seg_idx = 0)) = count(*) AS aligned FROM segments GROUP BY record_id""")
def label_alignment(spark, d):
    rows = B.segments(spark, d).select(*SEG)
    return Q.check_alignment(rows.where(~((F.col("record_id") % 6 == 0) & (F.col("seg_idx") == 0))), rows)


@query("B05_select_track", """WITH t AS (SELECT record_id || '_' || (record_id % 3) AS case_id, record_id % 3 > 0 AS paired, 'rec_Twin' || (1 + seg_idx % 2) || '_p' || seg_idx AS name FROM segments)
SELECT case_id, name FROM t WHERE NOT paired OR contains(lower(name), 'twin' || split_part(case_id, '_', 2))""")
def select_track(spark, d):
    kind = F.col("record_id") % 3
    rows = B.segments(spark, d).select(F.concat_ws("_", "record_id", kind).alias("case_id"), (kind > 0).alias("paired"),
                                       F.concat(F.lit("rec_Twin"), 1 + F.col("seg_idx") % 2, F.lit("_p"), F.col("seg_idx")).alias("name"))
    return Q.select_track(rows, "case_id", F.col("paired"), "name").select("case_id", "name")


@query("B06_site_code", "SELECT record_id, trim(split_part(site || '_' || cluster_id || '_' || record_id, '_', 1)) AS site_code FROM doc_outcomes")
def site_code(spark, d):
    return B.doc_outcomes(spark, d).select("record_id", V.site_of(F.concat_ws("_", "site", "cluster_id", "record_id")).alias("site_code"))


@query("B07_flag_parse", """SELECT record_id, seg_idx, CASE seg_idx % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS paired FROM segments""")
def flag_parse(spark, d):
    k = F.col("seg_idx") % 4
    raw = F.when(k == 0, " True").when(k == 1, "false").when(k == 2, "TRUE").otherwise("yes")
    return B.segments(spark, d).select(*SEG, V.flag(raw).alias("paired"))


@query("B08_ordinal_recode", """SELECT record_id, CASE WHEN n_segments % 3 = 1 THEN 1 WHEN n_segments % 3 = 2 THEN 0 END AS acceleration,
CASE WHEN n_segments - 2 > 0 THEN 1 WHEN n_segments = 2 THEN 0 END AS deceleration, CASE WHEN n_segments BETWEEN 0 AND 3 THEN CAST(n_segments AS INTEGER) END AS variability FROM records""")
def ordinal_recode(spark, d):
    n = F.col("n_segments")
    return B.records(spark, d).select("record_id", V.yes_no(n % 3).alias("acceleration"), V.presence(n - 2).alias("deceleration"),
                                      F.when(n.between(0, 3), n).cast("int").alias("variability"))


@query("B09_uniform_interval", """WITH t AS (SELECT record_id, CASE WHEN record_id % 8 = 0 AND seg_idx = 2 THEN 12.5 ELSE 10 END::DOUBLE AS dt FROM segments)
SELECT record_id, min(dt) AS min_interval, max(dt) AS max_interval, min(dt) > 0 AND max(dt) - min(dt) <= max(dt) * 1e-9 AS uniform FROM t GROUP BY record_id""")
def uniform_interval(spark, d):
    dt = F.when((F.col("record_id") % 8 == 0) & (F.col("seg_idx") == 2), 12.5).otherwise(10.0)
    return Q.check_uniform(B.segments(spark, d).select("record_id", dt.alias("dt")), "record_id", "dt")


@query("B10_exclude_missing", """SELECT record_id, seg_idx, round(missing_fraction, 6) AS missing_fraction, 'fhr_missing_gt_threshold' AS reason FROM segments WHERE missing_fraction > 0.3::DOUBLE""")
def exclude_missing(spark, d):
    _, excluded = Q.exclude_missing(B.segments(spark, d))
    return rounded(excluded.select(*SEG, "missing_fraction", "reason"), "missing_fraction")


@query("B10_kept_segments", "SELECT record_id, seg_idx, target FROM segments WHERE missing_fraction <= 0.3::DOUBLE")
def kept_segments(spark, d):
    return Q.exclude_missing(B.segments(spark, d))[0].select(*SEG, "target")


@query("B11_quarantine_records", "SELECT record_id, seg_idx, n FROM segments WHERE record_id NOT IN (SELECT record_id FROM segments WHERE missing_fraction > 0.5)")
def quarantine(spark, d):
    rows = B.segments(spark, d)
    return Q.quarantine(rows.select(*SEG, "n"), rows.where(F.col("missing_fraction") > 0.5))


@query("B12_require_cluster", """SELECT record_id, cluster_id FROM (SELECT record_id, CASE record_id % 7 WHEN 0 THEN '' WHEN 1 THEN '9999' WHEN 2 THEN NULL WHEN 3 THEN 'nan' ELSE CAST(cluster_id AS VARCHAR) END AS cluster_id FROM records) WHERE cluster_id NOT IN ('', '9999', 'nan', 'None')""")
def require_cluster(spark, d):
    k = F.col("record_id") % 7
    raw = F.when(k == 0, "").when(k == 1, "9999").when(k == 2, F.lit(None)).when(k == 3, "nan").otherwise(F.col("cluster_id").cast("string"))
    return Q.require_cluster(B.records(spark, d).select("record_id", raw.alias("cluster_id")))


def box_tables(spark, d):
    """Boxes on the flagged units of each record, some shifted, resized, dropped or without an image."""
    units = materialize(B.predictions(spark, d).select("record_id", F.col("seg_idx").alias("position"), F.col("target").alias("bit")), "units")
    dims = units.groupBy("record_id").agg((F.count(F.lit(1)) * 100.0).alias("width")).where(F.col("record_id") % 29 != 0).withColumn("height", F.lit(200.0))
    shift = F.when(F.col("record_id") % 17 == 0, 3.0).otherwise(0.0)
    kept = (F.col("bit") == 1) & (F.col("record_id") % 5 != 0) & ~((F.col("record_id") % 23 == 0) & (F.col("position") == 0))
    width = units.groupBy("record_id").agg((F.count(F.lit(1)) * 100.0).alias("w"))
    boxes = units.where(kept).join(width, "record_id").select(
        "record_id", (F.col("position") * 100 + shift).alias("x1"), F.lit(0.0).alias("y1"), ((F.col("position") + 1) * 100.0).alias("x2"), F.lit(200.0).alias("y2"),
        "w", F.when(F.col("record_id") % 19 == 0, 201.0).otherwise(200.0).alias("h"))
    return units, boxes, dims


@query("B13_box_audit", """WITH u AS (SELECT record_id, seg_idx AS pos, target AS bit FROM predictions),
t AS (SELECT record_id, count(*) AS n_segments, CAST(sum(bit) AS BIGINT) AS n_abnormal FROM u GROUP BY 1),
b AS (SELECT record_id, pos FROM u WHERE bit = 1 AND record_id % 5 <> 0 AND NOT (record_id % 23 = 0 AND pos = 0)),
c AS (SELECT record_id, count(*) AS n_boxes FROM b GROUP BY 1),
m AS (SELECT record_id, n_segments, n_abnormal, coalesce(n_boxes, 0) AS n_boxes, coalesce(n_boxes, 0) > 0 AND record_id % 29 <> 0 AS checked,
  concat_ws(',', CASE WHEN n_boxes <> n_abnormal THEN 'flag_positions' END, CASE WHEN record_id % 19 = 0 THEN 'image_dimensions' END, CASE WHEN record_id % 17 = 0 THEN 'segment_boundary' END) AS why
  FROM t LEFT JOIN c USING (record_id))
SELECT record_id, n_boxes, n_segments, n_abnormal, checked, CASE WHEN checked THEN why = '' END AS valid,
CASE WHEN n_boxes = 0 AND n_abnormal > 0 THEN 'positive_without_boxes' WHEN n_boxes = 0 THEN 'normal_without_boxes' WHEN record_id % 29 = 0 THEN 'image_missing' WHEN why = '' THEN 'ok' ELSE why END AS reason FROM m""")
def box_audit(spark, d):
    return Q.box_audit(*box_tables(spark, d))


@query("B14_derived_covariates", """WITH t AS (SELECT record_id, year(order_date) * 100 + month(order_date) AS birth, 196000 + (record_id % 30) * 100 + 7 AS mother, 30 + n_segments AS wks, record_id % 7 AS dd FROM records)
SELECT record_id, CAST(birth // 100 - mother // 100 + 1 AS DOUBLE) AS maternal_age, round(wks + dd / 7::DOUBLE, 6) AS gestational_age FROM t""")
def derived_covariates(spark, d):
    rows = B.records(spark, d).select("record_id", (F.year("order_date") * 100 + F.month("order_date")).alias("birth"),
                                      (F.lit(196000) + (F.col("record_id") % 30) * 100 + 7).alias("mother"), (30 + F.col("n_segments")).alias("wks"), (F.col("record_id") % 7).alias("dd"))
    return rounded(Q.derive_age(rows, "birth", "mother", "wks", "dd").select("record_id", "maternal_age", "gestational_age"), "gestational_age")


@query("B15_observed_outcome", """SELECT record_id, balance BETWEEN 0 AND 10000 AS observed, CASE WHEN balance BETWEEN 0 AND 10000 THEN CASE WHEN balance < 2000 THEN 1 ELSE 0 END END AS target FROM records""")
def observed_outcome(spark, d):
    return Q.observed(B.records(spark, d), "balance", 0, 10000, 2000).select("record_id", "observed", "target")


@query("B16_complete_cases", "SELECT record_id, quality, toxic, n_chars FROM doc_outcomes WHERE quality IS NOT NULL AND n_chars IS NOT NULL AND toxic IN (0, 1)")
def complete_cases(spark, d):
    return Q.complete_cases(B.doc_outcomes(spark, d), ["quality", "n_chars"], "toxic").select("record_id", "quality", "toxic", "n_chars")


@query("B17_allow_list", """SELECT model, CAST(site AS DOUBLE) AS site, CAST(target AS DOUBLE) AS target, CASE WHEN record_id % 4 <> 0 THEN round(score, 6) END AS score FROM preds WHERE model IN ('m1', 'm3')""")
def allow_list(spark, d):
    rows = B.by_model(B.scored(spark, d)).withColumn("score", F.when(F.col("record_id") % 4 == 0, "secret").otherwise(F.round("score", 6).cast("string")))
    return Q.allowlist(rows, {"model": ["m1", "m3"]}, ["site", "target", "score"])


@query("B18_key_violations", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_violations(spark, d):
    return Q.assert_keys(B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("B18_domain_violations", "SELECT count(*) FILTER (WHERE target NOT IN (0, 1)) AS bad_targets, count(*) FILTER (WHERE NOT (score BETWEEN 0 AND 0.5)) AS bad_scores FROM preds")
def domain_violations(spark, d):
    return Q.domain_violations(B.by_model(B.scored(spark, d)).withColumn("score", F.col("score") * 2))


# --- E: joins and alignment ------------------------------------------------

@query("E01_many_to_one_join", f"WITH {SPLIT} SELECT record_id, seg_idx, target, split FROM predictions LEFT JOIN split USING (cluster_id)")
def many_to_one(spark, d):
    rows = B.predictions(spark, d).select("cluster_id", *SEG, "target")
    joined, _ = J.join_m1(rows, S.holdout_split(B.scored(spark, d)), ["cluster_id"])
    return joined.select(*SEG, "target", "split")


@query("E02_one_to_one_join", """SELECT record_id, seg_idx, m1, CASE WHEN m2 >= 0.25 THEN m2 END AS m2, m2 >= 0.25 AS complete FROM predictions""")
def one_to_one(spark, d):
    rows = B.predictions(spark, d)
    joined, _ = J.join_11(rows.select(*SEG, "m1"), rows.where(F.col("m2") >= 0.25).select(*SEG, "m2"), SEG)
    return joined


@query("E01_cardinality_violations", "SELECT cluster_id, count(*) AS rows FROM predictions GROUP BY cluster_id HAVING count(*) > 1")
def cardinality_violations(spark, d):
    """The same predictions on the right side of a join by cluster: every cluster with several rows breaks it."""
    rows = B.predictions(spark, d).select("cluster_id", *SEG)
    return J.join_m1(rows.select("cluster_id").distinct(), rows, ["cluster_id"])[1]


@query("E02_cardinality_violations", "SELECT record_id, count(*) AS rows, unnest(['left', 'right']) AS side FROM predictions GROUP BY record_id HAVING count(*) > 1")
def one_to_one_violations(spark, d):
    rows = B.predictions(spark, d)
    return J.join_11(rows.select("record_id", "m1"), rows.select("record_id", "m2"), ["record_id"])[1]


@query("E03_cohort_difference", """SELECT record_id, seg_idx, CASE WHEN m1 <= 0.11 THEN 'only_right' WHEN m2 >= 0.95 THEN 'only_left' ELSE 'value_mismatch' END AS problem FROM predictions
WHERE (m1 <= 0.11 AND m2 < 0.95) OR (m1 > 0.11 AND m2 >= 0.95) OR (m1 > 0.91 AND m2 < 0.95)""")
def cohort_difference(spark, d):
    """Two cohorts that lost different rows, with some targets changed in one of them."""
    rows = B.predictions(spark, d).select(*SEG, "target", "m1", "m2")
    left = rows.where(F.col("m1") > 0.11)
    right = rows.where(F.col("m2") < 0.95).withColumn("target", F.when(F.col("m1") > 0.91, 1 - F.col("target")).otherwise(F.col("target")))
    return J.cohort_diff(left, right, SEG, ["target"])


@query("E04_common_subset", "SELECT record_id, seg_idx, m1, m2 FROM predictions WHERE m1 > 0.31 AND m2 < 0.75")
def common_subset(spark, d):
    rows = B.predictions(spark, d)
    return J.common_subset(rows.where(F.col("m1") > 0.31).select(*SEG, "m1"), rows.where(F.col("m2") < 0.75).select(*SEG, "m2"), SEG)


@query("E05_exclude_clusters", "SELECT record_id, seg_idx, site FROM predictions WHERE cluster_id NOT IN (SELECT cluster_id FROM predictions WHERE site = 3)")
def exclude_clusters(spark, d):
    rows = B.predictions(spark, d)
    return J.exclude_clusters(rows, rows.where(F.col("site") == 3)).select(*SEG, "site")


@query("E06_member_flag", "SELECT record_id, seg_idx, cluster_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS prior_seen FROM predictions")
def member_flag(spark, d):
    prior = B.table(spark, d, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("cluster_id"))
    return S.flag_member(B.predictions(spark, d), prior).select(*SEG, "prior_seen")


@query("E07_stack_tables", "SELECT record_id, seg_idx, m1 AS score, CAST(NULL AS DOUBLE) AS threshold FROM predictions UNION ALL SELECT record_id, seg_idx, m2, 0.5 FROM predictions")
def stack(spark, d):
    rows = B.predictions(spark, d)
    return J.stack_tables(rows.select(*SEG, F.col("m1").alias("score")), rows.select(*SEG, F.col("m2").alias("score"), F.lit(0.5).alias("threshold")))


@query("E08_id_difference", "SELECT record_id AS doc_id FROM doc_outcomes EXCEPT SELECT doc_id FROM labels")
def id_difference(spark, d):
    return J.id_diff(B.table(spark, d, "documents").select("doc_id"), B.table(spark, d, "labels").select("doc_id"))


@query("E08_id_intersection", "SELECT doc_id FROM labels INTERSECT SELECT page_id FROM pages")
def id_intersection(spark, d):
    return J.id_intersect(B.table(spark, d, "labels").select("doc_id"), B.table(spark, d, "pages").select(F.col("page_id").alias("doc_id")))


@query("E09_wide_to_long", "SELECT record_id, seg_idx, 'm1' AS model, m1 AS score, 0.5 AS threshold FROM predictions UNION ALL SELECT record_id, seg_idx, 'm2', m2, 0.7 FROM predictions".replace("0.5 AS", "0.5::DOUBLE AS").replace("m2, 0.7", "m2, 0.7::DOUBLE"))
def wide_to_long(spark, d):
    wide = B.predictions(spark, d).select(*SEG, F.col("m1").alias("score__m1"), F.lit(0.5).alias("threshold__m1"), F.col("m2").alias("score__m2"), F.lit(0.7).alias("threshold__m2"))
    return J.to_long(wide, ["m1", "m2"])


@query("E09_long_to_wide", """SELECT record_id, seg_idx, m1 AS score__m1, 0.5::DOUBLE AS threshold__m1, m2 AS score__m2, 0.5::DOUBLE AS threshold__m2 FROM predictions""")
def long_to_wide(spark, d):
    return J.to_wide(B.by_model(B.predictions(spark, d)).withColumn("threshold", F.lit(0.5)), SEG, ["m1", "m2"])


@query("E10_prior_cohort", "SELECT DISTINCT CAST(cluster_id AS VARCHAR) AS cluster_id FROM records WHERE CAST(cluster_id AS VARCHAR) NOT IN ('', '9999', 'nan', 'None')")
def prior_cohort(spark, d):
    return J.prior_cohort(B.records(spark, d))


# --- K: ordering and scalars -----------------------------------------------

@query("K01_stable_order", "SELECT record_id, seg_idx, m1 FROM predictions ORDER BY m1 DESC NULLS LAST, record_id, seg_idx")
def stable_order(spark, d):
    return J.order_by(B.predictions(spark, d).select(*SEG, "m1"), F.col("m1").desc_nulls_last(), F.col("record_id").asc(), F.col("seg_idx").asc())


@query("K02_top_k_per_group", "SELECT * FROM (SELECT site, record_id, seg_idx, m1, CAST(row_number() OVER (PARTITION BY site ORDER BY m1 DESC, record_id, seg_idx) AS INTEGER) AS rank FROM predictions) WHERE rank <= 5")
def top_k(spark, d):
    return J.top_k(B.predictions(spark, d).select("site", *SEG, "m1"), ["site"], [F.col("m1").desc(), "record_id", "seg_idx"], 5)


@query("K03_arg_extremes", """SELECT record_id, seg_idx, (list(sample_idx ORDER BY x DESC, sample_idx))[1] AS argmax, (list(sample_idx ORDER BY x, sample_idx))[1] AS argmin FROM samples GROUP BY ALL""")
def arg_extremes(spark, d):
    rows = B.samples(spark, d)
    return J.arg_first(rows, SEG, "x", "sample_idx", True, "argmax").join(J.arg_first(rows, SEG, "x", "sample_idx", False, "argmin"), SEG)


@query("K04_math_scalars", """SELECT record_id, seg_idx, round(ln(least(greatest(m1, 1e-6), 1 - 1e-6) / (1 - least(greatest(m1, 1e-6), 1 - 1e-6))), 6) AS logit,
round(least(greatest(m2, 0.2), 0.8), 6) AS clipped, record_id // 100 AS hundreds, CAST(ceil(m1 * 10) AS BIGINT) AS up, round(abs(m1 - m2), 6) AS gap, round(m1 / nullif(m2, 0), 6) AS quotient FROM predictions""")
def math_scalars(spark, d):
    m1, m2 = F.col("m1"), F.col("m2")
    out = B.predictions(spark, d).select(*SEG, V.logit(m1).alias("logit"), V.clip(m2, 0.2, 0.8).alias("clipped"), F.expr("record_id div 100").alias("hundreds"),
                                         F.ceil(m1 * 10).alias("up"), F.abs(m1 - m2).alias("gap"), V.ratio(m1, m2).alias("quotient"))
    return rounded(out, "logit", "clipped", "gap", "quotient")


@query("K05_string_scalars", r"""SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS words, lower(trim(source)) AS source, regexp_extract(source, '(\d+)$', 1) AS digits, starts_with(lang, 'e') AS english_like,
lang || '|' || source AS joined, split_part(lang || '_' || source, '_', 1) AS head FROM documents""")
def string_scalars(spark, d):
    return B.table(spark, d, "documents").select(
        "doc_id", F.size(F.split("text", " ")).alias("words"), F.lower(F.trim("source")).alias("source"), F.regexp_extract("source", r"(\d+)$", 1).alias("digits"),
        F.startswith("lang", F.lit("e")).alias("english_like"), F.array_join(F.array("lang", "source"), "|").alias("joined"), F.substring_index(F.concat_ws("_", "lang", "source"), "_", 1).alias("head"))


@query("K06_array_scalars", """WITH a AS (SELECT record_id, seg_idx, list(x ORDER BY sample_idx) AS xs, list(y ORDER BY sample_idx) AS ys, string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), '-' ORDER BY sample_idx) AS txt FROM samples GROUP BY ALL)
SELECT record_id, seg_idx, len(list_distinct(list_concat(xs, ys))) AS n_unique, len(list_filter(xs, lambda v: v <> 0)) AS n_nonzero, round(list_sum(list_transform(range(2, len(ys) + 1), lambda i: abs(ys[i] - ys[i - 1]))), 6) AS path_length,
list_sort(ys)[1] AS smallest, list_sum(list_transform(regexp_extract_all(txt, '\\d+'), lambda t: CAST(t AS BIGINT)))::BIGINT AS digit_sum FROM a""".replace("\\\\d", "\\d"))
def array_scalars(spark, d):
    packed = F.array_sort(F.collect_list(F.struct("sample_idx", "x", "y")))
    rows = B.samples(spark, d).groupBy(*SEG).agg(packed.alias("s")).select(*SEG, F.col("s.x").alias("xs"), F.col("s.y").alias("ys"))
    text = F.array_join(F.transform("ys", lambda v: v.cast("bigint").cast("string")), "-")
    steps = F.zip_with(F.slice("ys", 2, F.greatest(F.size("ys") - 1, F.lit(0))), F.slice("ys", 1, F.greatest(F.size("ys") - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    total = F.when(F.size("ys") > 1, F.aggregate(steps, F.lit(0.0), lambda a, v: a + v))
    digits = F.aggregate(F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), 0), lambda t: t.cast("bigint")), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return rows.select(*SEG, F.size(F.array_distinct(F.concat("xs", "ys"))).cast("bigint").alias("n_unique"), F.size(F.filter("xs", lambda v: v != 0)).cast("bigint").alias("n_nonzero"),
                       V.r6(total).alias("path_length"), F.array_min("ys").alias("smallest"), digits.alias("digit_sum"))


@query("K07_json_scalars", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256('{"id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || '}') AS canonical FROM events""")
def json_scalars(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return B.table(spark, d, "events").select("event_id", k.alias("k"), F.sha2(F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))), 256).alias("canonical"))


@query("K08_exact_quantiles", "SELECT site, " + ", ".join(f"round(quantile_cont(price, {p}), 6) AS q{int(p * 1000)}" for p in (0.025, 0.25, 0.5, 0.75, 0.975)) + " FROM records GROUP BY site")
def quantiles(spark, d):
    probs = [0.025, 0.25, 0.5, 0.75, 0.975]
    names = [f"q{int(p * 1000)}" for p in probs]
    return rounded(exact_quantiles(B.records(spark, d), ["site"], "price", probs, names), *names)
