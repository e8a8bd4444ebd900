"""Table-level models on Spark ML, fitted and scored without leaving the cluster.

Loops run over models or folds (short fixed lists); all sites, and all features of a scan, are
fitted in the same passes. The rows of every fit stay distributed.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from ..functions.scalars import logit
from ..plans.ordering import exact_quantiles, null_safe_join, spread
from ..sources.scratch import materialize
from . import joint_logistic, metrics as M, splits as S
from .align import exclude_clusters
from .bootstrap import REPLICATES, paired

# Spline size, boosting settings of the two tree families.
SPLINE_KNOTS = 5
TREE_RATE = 0.05
TREE_DEPTHS = {"deep": 6, "shallow": 4}
# Rows of a joint fit that one task reads.
FIT_ROWS_PER_TASK = 250_000

Fit = Callable[[DataFrame, DataFrame], "PipelineModel"]


def logistic(train: DataFrame, columns: Sequence[str], c: float = 1.0, target: str = "target", iterations: int = 100) -> PipelineModel:
    """Median filling, standardisation, L2-regularised logistic regression."""
    rows = train.count()
    filled = [f"_fill_{col}" for col in columns]
    stages = [
        median_filler(train, columns),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="_z"),
        LogisticRegression(featuresCol="_z", labelCol=target, regParam=1.0 / (c * rows), standardization=False, maxIter=iterations),
    ]
    return Pipeline(stages=stages).fit(train)


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The exact median of each column's values that are present; 0 where there are none. One row for each column reaches the driver."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    found = {r["column"]: r["median"] for r in exact_quantiles(long, ["column"], "value", [0.5], ["median"]).collect()}
    return {c: float(found.get(c, 0.0)) for c in columns}


def median_filler(train: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """A stage that adds ``_fill_*`` columns with missing values replaced by training medians; it is saved with its pipeline."""
    fill = exact_medians(train, columns)
    filled = [f"coalesce(nanvl(CAST(`{c}` AS double), NULL), {fill[c]!r}D) AS `_fill_{c}`" for c in columns]
    return SQLTransformer(statement=f"SELECT *, {', '.join(filled)} FROM __THIS__")


def predict(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the positive-class probability; helper columns are removed."""
    scored = model.transform(df)
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(name))


def spline_terms(column: str, low: float, high: float, knots: int = SPLINE_KNOTS) -> list[Column]:
    """Uniform cubic spline basis with constant extrapolation and no bias column.

    On uniform knots every basis function is the same bump, shifted, so each is
    a closed-form polynomial of the distance to its first knot. A constant
    predictor yields one zero column.
    """
    if not high > low:
        return [F.lit(0.0)]
    step = (high - low) / (knots - 1)
    x = F.least(F.greatest(F.col(column), F.lit(float(low))), F.lit(float(high)))

    def bump(j: int) -> Column:
        u = (x - F.lit(low + (j - 3) * step)) / F.lit(step)
        rise = F.pow(u, 3) / 6
        left = (-3 * F.pow(u, 3) + 12 * F.pow(u, 2) - 12 * u + 4) / 6
        right = (3 * F.pow(u, 3) - 24 * F.pow(u, 2) + 60 * u - 44) / 6
        fall = F.pow(4 - u, 3) / 6
        return F.when((u < 0) | (u >= 4), 0.0).when(u < 1, rise).when(u < 2, left).when(u < 3, right).otherwise(fall)

    return [bump(j) for j in range(knots + 1)]


def spline_bounds(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Smallest and largest training value of each column: one row to the driver."""
    row = train.agg(*[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    return {c: (float(row["lo_" + c]), float(row["hi_" + c])) for c in columns}


def spline_basis(df: DataFrame, column: str, low: float, high: float, knots: int = SPLINE_KNOTS) -> tuple[DataFrame, list[str]]:
    terms = spline_terms(column, low, high, knots)
    names = [f"{column}_s{k}" for k in range(len(terms))]
    return df.select("*", *[t.alias(n) for t, n in zip(terms, names)]), names


def single_feature_scan(train: DataFrame, val: DataFrame, columns: Sequence[str], family: str = "linear", target: str = "target") -> DataFrame:
    """One logistic per feature, ranked by validation AUROC. All are fitted in the same passes and evaluated in one plan."""
    bounds = spline_bounds(train, columns) if family == "nonlinear_spline" else {}
    terms, members = [], []
    for column in columns:
        own = spline_terms(column, *bounds[column]) if bounds else [F.col(column)]
        members.append(list(range(len(terms), len(terms) + len(own))))
        terms += [t.cast("double") for t in own]
    x, every = F.array(*terms).alias("x"), F.lit(list(range(len(columns)))).alias("use")
    models = joint_logistic.fit(materialize(train.select(x, every, F.col(target).alias("target")), "scan"), members)
    arms = F.array(*[F.struct(F.lit(column).alias("feature"), joint_logistic.score(models, F.lit(m)).alias("score")) for m, column in enumerate(columns)])
    scored = val.select(x, target).select(target, F.inline(arms))
    table = M.auroc(scored, ["feature"], target=target)
    return table.select(F.lit(family).alias("family"), "feature", F.col("auroc").alias("validation_auroc"))


def boosted_trees(train: DataFrame, val: DataFrame, columns: Sequence[str], seed: int, iterations: int = 30, depth: int = TREE_DEPTHS["deep"], target: str = "target") -> PipelineModel:
    """Gradient-boosted trees with square-root class weights, stopped early on the validation rows."""
    totals = train.agg(F.sum(target).alias("p"), F.count(F.lit(1)).alias("n")).first()
    weight = ((totals["n"] - totals["p"]) / max(totals["p"], 1)) ** 0.5
    marked = train.withColumn("_validation", F.lit(False)).unionByName(val.withColumn("_validation", F.lit(True)))
    weighted = marked.withColumn("_weight", F.when(F.col(target) == 1, F.lit(float(weight))).otherwise(1.0))
    trees = GBTClassifier(featuresCol="_features", labelCol=target, weightCol="_weight", validationIndicatorCol="_validation", maxIter=iterations,
                          maxDepth=depth, stepSize=TREE_RATE, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="keep"), trees]).fit(weighted)


def oof_predict(df: DataFrame, folds: DataFrame, fit: Fit, cluster: str = "cluster_id") -> DataFrame:
    """Every row scored by a model that never saw its cluster, with the alarm limit of that fold.

    folds: outer_fold, cluster, role (fit / tune / hold), from ``nested_folds``.
    """
    parts = []
    for fold in [r["outer_fold"] for r in folds.select("outer_fold").distinct().orderBy("outer_fold").collect()]:
        assigned = df.join(folds.where(F.col("outer_fold") == fold), cluster)
        role = {r: assigned.where(F.col("role") == r) for r in ("fit", "tune", "hold")}
        model = fit(role["fit"].select(*df.columns), role["tune"].select(*df.columns))
        limit = M.threshold90(predict(model, role["tune"]), ["outer_fold"])
        parts.append(predict(model, role["hold"]).join(limit, "outer_fold").select(*df.columns, F.col("outer_fold").alias("fold"), "score", "alarm_above"))
    return reduce(DataFrame.unionByName, parts)


def coverage_status(df: DataFrame, oof: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per arm: keys of the cohort, and those scored as often as the cohort has them. Anything less, or a key from elsewhere, makes the arm's metrics unavailable."""
    cohort = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    scored = oof.groupBy(*by, *keys).agg(F.count_if(F.col("score").isNotNull()).alias("_scored"))
    total = cohort.agg(F.count(F.lit(1)).alias("n")).scalar()
    covered = null_safe_join(scored, cohort, keys, "left").groupBy(*by).agg(
        F.count_if(F.col("_scored") == F.col("_rows")).alias("scored"), F.count_if(F.col("_rows").isNull()).alias("_foreign"))
    whole = (F.col("expected") == F.col("scored")) & (F.col("_foreign") == 0)
    return covered.withColumn("expected", total).select(*by, "expected", "scored", F.when(whole, "ok").otherwise("unavailable").alias("status"))


def oof_metrics(df: DataFrame, oof: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Pooled metrics of each arm's out-of-fold scores, never on a reduced cohort: an arm that lacks a row of ``df`` has its
    counts of keys, the status ``unavailable`` and no metrics."""
    covered = coverage_status(df, oof, keys, by).withColumnRenamed("status", "_coverage")
    found = M.evaluate(oof, by, F.col("score") > F.col("alarm_above"))
    whole = F.col("_coverage") == "ok"
    values = [F.when(whole, F.col(c)).alias(c) for c in found.columns if c not in (*by, "status")]
    return null_safe_join(covered, found, by, "left").select(*by, "expected", F.col("scored"), F.when(whole, F.col("status")).otherwise("unavailable").alias("status"), *values)


def platt(val: DataFrame, held: DataFrame, score: str = "score", target: str = "target") -> tuple[DataFrame, DataFrame, float]:
    """Recalibrates scores with a logistic on their logits, fitted on source validation rows only.

    Returns both tables with ``platt`` added, and the slope: an increasing map keeps the ranking.
    """
    prepared = val.withColumn("_logit", logit(F.col(score)))
    rows = prepared.count()
    assembler = VectorAssembler(inputCols=["_logit"], outputCol="_v")
    fitted = LogisticRegression(featuresCol="_v", labelCol=target, regParam=1.0 / rows, standardization=False).fit(assembler.transform(prepared))
    slope, intercept = float(fitted.coefficients[0]), float(fitted.intercept)
    recalibrated = 1 / (1 + F.exp(-(logit(F.col(score)) * slope + intercept)))
    return val.withColumn("platt", recalibrated), held.withColumn("platt", recalibrated), slope


def linear_contributions(model: PipelineModel, df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Exact contributions of a fitted logistic: coefficient times the standardised value, long form."""
    filler, _, scaler, classifier = model.stages
    parts = []
    for k, column in enumerate(columns):
        value = F.col(f"_fill_{column}")
        spread = float(scaler.std[k])
        weight = float(classifier.coefficients[k]) / spread if spread else 0.0
        parts.append(F.struct(F.lit(column).alias("feature"), value.alias("value"), ((value - F.lit(float(scaler.mean[k]))) * F.lit(weight)).alias("contribution")))
    return filler.transform(df).select(*keep, F.inline(F.array(*parts)))


def transfer_roles(df: DataFrame, held: Column, folds: int = 5, seed: int = 42, cluster: str = "cluster_id") -> DataFrame:
    """Rows with their role: held site, source validation (the first fold) or source fit.

    Source rows of clusters that the held site also has are left out.
    """
    away = df.where(held)
    source = exclude_clusters(df.where(~held), away, cluster)
    assigned = S.assign(source, S.group_folds(source, folds, seed, cluster).select(cluster, "fold"), cluster)
    roles = assigned.withColumn("role", F.when(F.col("fold") == 0, "validation").otherwise("fit")).drop("fold")
    return roles.unionByName(away.withColumn("role", F.lit("held")))


def transfer(roles: DataFrame, score: str = "score", target: str = "target") -> tuple[DataFrame, float]:
    """Held rows with raw and recalibrated scores, each with the alarm limit chosen on source validation; and the map's slope."""
    val, moved, slope = platt(roles.where(F.col("role") == "validation"), roles.where(F.col("role") == "held"), score, target)
    arms = F.array(F.struct(F.lit("raw").alias("arm"), F.col(score).alias("score")), F.struct(F.lit("platt").alias("arm"), F.col("platt").alias("score")))
    limits = M.threshold90(val.select(F.col(target).alias("target"), F.inline(arms)), ["arm"])
    keep = [c for c in roles.columns if c not in ("role", score)]
    return moved.select(*keep, F.inline(arms)).join(limits, "arm"), slope


ARMS = ("base", "base_plus_extra")


def incremental_scores(df: DataFrame, base: Sequence[str], extra: Sequence[str], k: int, seed: int = 42, keys: Sequence[str] = ("record_id",)) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores of a base arm and base plus extra columns, side by side: of all rows by the fold that holds them, and of
    the rows that tune each fold.

    All folds and both arms are fitted in the same passes over one written table; a row says which models learn from it.
    A model whose rows have a single class gives that class.
    """
    roles = materialize(S.nested_folds(df, k, 3, seed), "folds")
    fold = F.col("outer_fold")
    of = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, fold)))
    placed = roles.groupBy("cluster_id").agg(F.max(F.when(F.col("role") == "hold", fold)).alias("fold"), of("fit").alias("_fit"), of("tune").alias("_tune")).select(
        "cluster_id", "fold", "_tune", F.flatten(F.transform("_fit", lambda f: F.array(f * 2, f * 2 + 1))).alias("use"))
    columns = [*base, *extra]
    x = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    # Dealt by count: each pass of the fit costs more than the size of the table tells.
    dealt = spread(df, df.count(), FIT_ROWS_PER_TASK, "cluster_id")
    rows = materialize(dealt.join(placed, "cluster_id").select(*keys, "cluster_id", "target", x, "use", "fold", "_tune"), "rows")
    models = joint_logistic.fit(rows, [list(range(len(base))), list(range(len(columns)))] * k)
    single = {}
    if None in models:
        single = {r["model"]: r["share"] for r in rows.select(F.explode("use").alias("model"), "target").groupBy("model").agg(F.avg("target").alias("share")).collect()}
    shares = F.array(*[F.lit(single.get(m)) for m in range(2 * k)]).cast("array<double>")
    scores = [F.coalesce(joint_logistic.score(models, F.col("fold") * 2 + i), F.get(shares, F.col("fold") * 2 + i)).alias(arm) for i, arm in enumerate(ARMS)]
    held = rows.select(*keys, "cluster_id", "target", "fold", *scores)
    return held, rows.select("target", "x", F.explode("_tune").alias("fold")).select("target", "fold", *scores)


def incremental_metrics(df: DataFrame, held: DataFrame, tuned: DataFrame, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Out-of-fold metrics of both arms of ``incremental_scores``, each fold with its own alarm limit."""
    arms = F.array(*[F.struct(F.lit(arm).alias("arm"), F.col(arm).alias("score")) for arm in ARMS])
    limits = M.threshold90(tuned.select("target", "fold", F.inline(arms)), ["fold", "arm"])
    oof = held.select(*keys, "cluster_id", "target", "fold", F.inline(arms)).join(limits, ["fold", "arm"])
    return oof_metrics(df, materialize(oof, "oof"), keys, ["arm"])


def incremental_value(df: DataFrame, base: Sequence[str], extra: Sequence[str], k: int, seed: int = 42, replicates: int = REPLICATES, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Paired difference of base plus extra columns against the base arm, on the same out-of-fold rows."""
    held, _ = incremental_scores(df, base, extra, k, seed, keys)
    return paired(held, ARMS[1], ARMS[0], replicates, seed)


def _sites(rows: DataFrame, sites: Sequence, site: str = "site") -> Column:
    return F.lit(list(sites)).cast(ArrayType(rows.schema[site].dataType))


def loso_roles(rows: DataFrame, sites: Sequence, seed: int = 42, folds: int = 5, min_clusters: int = 8, site: str = "site", cluster: str = "cluster_id",
               target: str = "target") -> tuple[DataFrame, DataFrame]:
    """What every cluster is to every held site, and each site's counts with its status.

    Clusters a site has are left out of its development rows wherever they occur; of the others the first of
    the folds validates. Worked out on clusters, not rows. Roles: one row for each cluster, with the positions in
    ``sites`` of those it is fitted for (``use``) and of those it validates (``tune``).
    """
    known = _sites(rows, sites, site)
    pairs = materialize(rows.groupBy(cluster, site).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("pos"), F.max(target).alias("stratum")), "loso-pairs")
    clusters = pairs.groupBy(cluster).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("stratum").alias("stratum"), F.collect_set(site).alias("own"))
    away = clusters.select(cluster, "n", "pos", "stratum", F.explode(F.array_except(known, "own")).alias("held"))
    placed = materialize(S.numbered(materialize(away, "loso-away"), seed, cluster, ["held"]).withColumn("tunes", F.col("_position") % folds == 0), "loso-folds")
    at = F.array_position(known, F.col("held")).cast("int") - 1
    roles = placed.groupBy(cluster).agg(F.sort_array(F.collect_list(F.when(~F.col("tunes"), at))).alias("use"), F.sort_array(F.collect_list(F.when(F.col("tunes"), at))).alias("tune"))
    inside = pairs.groupBy(F.col(site).alias("held")).agg(F.sum("n").alias("held_rows"), F.count(F.lit(1)).alias("held_clusters"), F.sum("pos").alias("held_positives"))
    split = lambda c, tunes: F.sum(F.when(F.col("tunes") == tunes, F.col(c)).otherwise(0))
    outside = placed.groupBy("held").agg(
        F.count(F.lit(1)).alias("development_clusters"), split("n", False).alias("fit_rows"), split("pos", False).alias("fit_positives"),
        split("n", True).alias("validation_rows"), split("pos", True).alias("validation_positives"))
    counts = [c for c in outside.columns if c != "held"]
    plan = inside.where(F.col("held").isNotNull()).join(outside, "held", "left").fillna(0, counts)
    mixed = lambda n, pos: (pos > 0) & (pos < n)
    c = lambda role, what: F.col(f"{role}_{what}")
    ready = mixed(c("held", "rows"), c("held", "positives")) & (F.col("development_clusters") >= min_clusters) & mixed(
        c("fit", "rows") + c("validation", "rows"), c("fit", "positives") + c("validation", "positives"))
    tunable = mixed(c("fit", "rows"), c("fit", "positives")) & mixed(c("validation", "rows"), c("validation", "positives"))
    status = F.when(~ready, "insufficient_classes_or_groups").when(~tunable, "insufficient_validation_classes").otherwise("ok")
    return roles, plan.select(F.col("held").alias("site"), "held_rows", "held_clusters", "held_positives", *counts, status.alias("status"))


def loso_scores(df: DataFrame, columns: Sequence[str], seed: int = 42, keys: Sequence[str] = ("record_id",)) -> tuple[DataFrame, DataFrame]:
    """Leave every site out: raw and recalibrated scores of its rows with each arm's alarm limit, and the sites' counts and statuses.

    All sites are fitted in the same passes, over counts of equal rows (site, role, target, columns): a row is read
    once, and what the passes read is as large as the columns have distinct values. Both Platt's map and the limits come
    from the validation rows of the same held site.
    """
    rows = materialize(df, "loso")
    sites = [r["site"] for r in rows.select("site").where("site IS NOT NULL").distinct().orderBy("site").collect()]
    roles, plan = loso_roles(rows, sites, seed)
    plan = materialize(plan, "loso-plan")
    ready = {r["site"] for r in plan.where("status = 'ok'").select("site").collect()}
    able = F.lit([m for m, s in enumerate(sites) if s in ready]).cast("array<int>")
    # Two places for each held site: even where a cluster is fitted for it, odd where it validates.
    place = lambda role, odd: F.transform(F.array_intersect(F.col(role), able), lambda m: m * 2 + odd)
    placed = roles.select("cluster_id", F.concat(place("use", 0), place("tune", 1)).alias("places"))
    values = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    names = [f"_x{i}" for i in range(len(columns))]
    x = F.array(*[F.col(n) for n in names]).alias("x")
    counted = null_safe_join(rows.select("cluster_id", "target", *values), placed, ["cluster_id"]).select(
        "target", *names, F.explode("places").alias("place")).groupBy("place", "target", *names).agg(F.count(F.lit(1)).alias("n"))
    cells = materialize(counted.select("target", x, F.expr("place div 2").cast("int").alias("model"), (F.col("place") % 2 == 1).alias("tunes"), "n"), "loso-cells")
    member = [F.array("model").alias("use"), F.array("n").alias("weight")]
    models = joint_logistic.fit(cells.where("NOT tunes").select("x", "target", *member), [list(range(len(columns)))] * len(sites), weight="weight")
    tune = materialize(cells.where("tunes").withColumn("raw", joint_logistic.score(models, F.col("model"))).select(
        "model", "target", "raw", "n", F.array(logit(F.col("raw"))).alias("x"), *member), "loso-tune")
    maps = joint_logistic.fit(tune, [[0]] * len(sites), standardise=False, weight="weight")
    rising = F.lit([bool(m and m.weights[0] > 0) for m in maps]).cast("array<boolean>")
    platt_score = joint_logistic.score(maps, F.col("model"), F.array(logit(F.col("raw"))))
    arms = F.array(F.struct(F.lit("raw").alias("arm"), F.col("raw").alias("score")), F.struct(F.lit("platt").alias("arm"), platt_score.alias("score")))
    limits = M.threshold90(tune.select("model", "target", "n", F.inline(arms)), ["model", "arm"], weight=F.col("n"))
    keep = [*keys, "cluster_id", "site", "target"]
    held = rows.withColumn("model", F.array_position(_sites(rows, sites), F.col("site")).cast("int") - 1).where(F.array_contains(able, F.col("model")))
    scored = held.select(*keep, "model", *values).select(*keep, "model", joint_logistic.score(models, F.col("model"), x).alias("raw"))
    long = scored.select(*keep, "model", F.get(rising, F.col("model")).alias("monotone_increasing"), F.inline(arms))
    return long.join(limits, ["model", "arm"]).drop("model"), plan


def loso_evaluate(df: DataFrame, columns: Sequence[str], seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics and calibration bins of every site and arm, and the plan. A site that cannot be judged has one row with its status and no arm."""
    scored, plan = loso_scores(df, columns, seed)
    scored = materialize(scored, "loso-held")
    metrics = M.evaluate(scored, ["site", "arm", "monotone_increasing"], F.col("score") > F.col("alarm_above"))
    skipped = plan.where("status <> 'ok'").select("site", "status", F.col("held_rows").alias("n"), F.col("held_clusters").alias("clusters"), F.col("held_positives").alias("positives"))
    return metrics.unionByName(skipped, allowMissingColumns=True), M.calibration(scored, ["site", "arm"]), plan
