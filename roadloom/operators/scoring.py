"""Scores as a product: which part, what it saves, why, the alerts, the runs on disk, and the checks before a model is trusted."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.operators import boosting, learning
from roadloom.operators.boosting import BoostedTrees
from roadloom.sources.tables import exists, folders, stable_id


def train_component(positives: DataFrame, columns: list[str], component: str = "component", trees: int = 30, seed: int = 7):
    """A forest that tells, for vehicles that will fail, which part it will be. positives: rows with a part. A missing value is the
    column's median beside a column that says that it was missing; both are stages of the model, with the medians of these rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, SQLTransformer, StringIndexer, VectorAssembler

    known = positives.where(F.col(component).isNotNull())
    have = {c for c, n in known.agg(*[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in columns]).first().asDict().items() if n}
    numbers = [c for c in columns if c in have]  # a column without any value has no median, and tells nothing
    index = StringIndexer(inputCol=component, outputCol="_part", stringOrderType="alphabetAsc")
    missing = SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST(`{c}` AS DOUBLE) AS `_v_{c}`, CAST(`{c}` IS NULL OR isnan(CAST(`{c}` AS DOUBLE)) AS DOUBLE) AS `_no_{c}`" for c in numbers) + " FROM __THIS__")
    impute = Imputer(strategy="median", inputCols=[f"_v_{c}" for c in numbers], outputCols=[f"_m_{c}" for c in numbers])
    forest = RandomForestClassifier(labelCol="_part", featuresCol="_x", predictionCol="_guess", rawPredictionCol="_raw", probabilityCol="_prob", numTrees=trees, maxDepth=5, seed=seed)
    return Pipeline(stages=[index, missing, impute, VectorAssembler(inputCols=[f"{p}{c}" for c in numbers for p in ("_m_", "_no_")], outputCol="_x"), forest]).fit(known)


def component_of(rows: DataFrame, model) -> DataFrame:
    """The rows with `component`, the likeliest part."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    out = rows
    for stage in model.stages[1:]:
        out = stage.transform(out)
    return out.select(*rows.columns, F.get(names, F.col("_guess").cast("int")).alias("component"))


def with_saving(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """The rows with `saving`: what a breakdown of the component costs over its repair, 0 for parts without costs. costs: component,
    breakdown_cost, repair_cost; one row a part."""
    return rows.join(costs.select("component", (F.col("breakdown_cost") - F.col("repair_cost")).alias("_saving")), "component", "left").withColumn("saving", F.round(F.coalesce("_saving", F.lit(0.0)), 2)).drop("_saving")


def failure_alerts(scored: DataFrame, threshold: float, version: str, day) -> DataFrame:
    """Alerts of the batch rule HIGH_FAILURE_RISK for the rows with p at the threshold or above: id, vin, rule, severity, dedup_key
    (one a vehicle and day, so a run that is repeated opens none again) and details as JSON."""
    key = F.concat_ws(":", "vin", F.lit("HIGH_FAILURE_RISK"), F.lit(str(day)))
    details = F.to_json(F.struct(F.round("p", 3).alias("probability"), "component", F.col("saving").alias("est_cost_avoided"), F.lit(version).alias("model_version"), *(["factors"] if "factors" in scored.columns else [])))
    return scored.where(F.col("p") >= threshold).select(stable_id(key).alias("id"), "vin", F.lit("HIGH_FAILURE_RISK").alias("rule"), F.lit("CRITICAL").alias("severity"), key.alias("dedup_key"), details.alias("details"))


def scoring_run(features: DataFrame, label: str, columns: list[str], categorical: list[str], costs: DataFrame, today, threshold: float, version: str, **options) -> tuple[DataFrame, DataFrame]:
    """(scores, alerts) of one run, from features to alerts. features: vin, asof, split, the label, component (null where nothing
    breaks), the columns. Trees and calibration learn from the rows with a split, the parts' forest from the positives among the
    training rows; the rows of `today` get p, component, saving and factors, and an alert from the threshold on."""
    models = learning.train_risk(features.where("split is not null"), columns, label, categorical, **options)
    parts = train_component(features.where(f"split = 'train' and {label} = 1"), [c for c in columns if c not in categorical])
    now = learning.score_risk(features.where(F.col("asof") == F.lit(today).cast("date")).drop("component", "split", label), models)
    scores = boosting.factors(with_saving(component_of(now, parts), costs), models[0])
    return scores, failure_alerts(scores, threshold, version, today)


def latest_complete_day(daily: DataFrame, today, day: str = "day"):
    """The last day before today: today's is still filling. None where there is none."""
    return daily.where(F.col(day) < F.lit(today).cast("date")).agg(F.max(day)).first()[0]


def write_run(folder: str, run: str, scores: DataFrame, alerts: DataFrame, signatures: DataFrame) -> None:
    """One scoring run: scores by run (a run that is repeated replaces its own rows), signatures as a whole anew, and alerts whose
    dedup_key no earlier one has. Scores come first and alerts last, so that an alert always has its score."""
    spark = scores.sparkSession
    scores.write.mode("overwrite").parquet(f"{folder}/risk_score/run={run}")
    signatures.write.mode("overwrite").parquet(f"{folder}/fault_signature/run={run}")
    some = exists(spark, f"{folder}/alert") and any(f != f"run={run}" for f in folders(spark, f"{folder}/alert"))
    earlier = spark.read.parquet(f"{folder}/alert").where(F.col("run") != run).select("dedup_key") if some else alerts.select("dedup_key").limit(0)
    alerts.dropDuplicates(["dedup_key"]).join(earlier, "dedup_key", "left_anti").write.mode("overwrite").parquet(f"{folder}/alert/run={run}")


def save_model(folder: str, version: str, stages: dict, meta: dict, active: bool = True) -> None:
    """A model in the registry: its stages by name, and meta (features, threshold, metrics) as JSON, written last, so that a model
    without meta is none. `active` is the row that names the model in force."""
    spark = SparkSession.active()
    for name, stage in stages.items():
        (stage if isinstance(stage, BoostedTrees) else stage.write().overwrite()).save(f"{folder}/{version}/{name}")
    spark.createDataFrame([(json.dumps({**meta, "version": version, "stages": {n: type(s).__module__ + "." + type(s).__name__ for n, s in stages.items()}}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{folder}/{version}/meta")
    if active:
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{folder}/active")


def load_active(folder: str) -> tuple[dict, dict]:
    """(meta, stages) of the model in force."""
    import importlib

    spark = SparkSession.active()
    version = spark.read.text(f"{folder}/active").first()[0]
    meta = json.loads(spark.read.text(f"{folder}/{version}/meta").first()[0])
    stages = {}
    for name, kind in meta["stages"].items():
        module, cls = kind.rsplit(".", 1)
        stages[name] = getattr(importlib.import_module(module), cls).load(f"{folder}/{version}/{name}")
    return meta, stages


def same_model_again(meta: dict, columns: list[str], average_precision: float, tolerance: float = 0.002) -> float:
    """The difference to the registered figure. A ValueError where the data give other features than the model was trained on, or
    where the figure is off by more than the tolerance: then the data have changed, and its other figures mean nothing."""
    if list(columns) != list(meta["features"]):
        raise ValueError("the features are not those of the model; train again")
    difference = abs(round(average_precision, 3) - meta["metrics"]["average_precision"])
    if difference > tolerance:
        raise ValueError(f"average precision is off by {difference:.3f}: the data have changed")
    return difference


def at_threshold(scored: DataFrame, threshold: float, group: str = "oem") -> DataFrame:
    """(group, n, flagged, caught, precision, recall) at a threshold."""
    flagged, hit = F.col("p") >= threshold, (F.col("p") >= threshold) & (F.col("label") == 1)
    out = scored.groupBy(group).agg(F.count("*").alias("n"), F.count_if(flagged).alias("flagged"), F.count_if(hit).alias("caught"), F.count_if(F.col("label") == 1).alias("_positives"))
    return out.select(group, "n", "flagged", "caught", (F.col("caught") / F.greatest("flagged", F.lit(1))).alias("precision"), (F.col("caught") / F.greatest("_positives", F.lit(1))).alias("recall"))


def unseen_maker(features: DataFrame, columns: list[str], threshold: float, group: str = "oem", **options) -> DataFrame:
    """(group, model, n, flagged, caught, precision, recall): each maker's test rows by the model of all makers and by one that was
    trained and calibrated without it, as on the day on which a new maker comes. A loop over makers, of which there are few; each fit
    runs over the whole cluster."""
    test = features.where("split = 'test'")
    makers = [r[0] for r in test.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).collect()]  # a handful
    whole = learning.train_risk(features, columns, "label", **options)
    out = at_threshold(learning.score_risk(test, whole), threshold, group).withColumn("model", F.lit("trained_with"))
    for maker in makers:
        models = learning.train_risk(features.where(F.col(group) != maker), columns, "label", **options)
        own = at_threshold(learning.score_risk(test.where(F.col(group) == maker), models), threshold, group)
        out = out.unionByName(own.withColumn("model", F.lit("never_seen")))
    return out.where(F.col(group).isNotNull())


def signatures(frame: DataFrame, now: DataFrame, breakdowns: DataFrame, columns: list[str], key: str = "vin") -> DataFrame:
    """(key, window_end, embedding, component, cost): the features of past breakdowns two days before they came, as z-scores by the
    mean and deviation of the fleet of today; what is missing is 0. frame: (key, asof, columns); now: today's rows of it;
    breakdowns: key, at, component, cost. With a frame of today's risky vehicles and no breakdowns they have no outcome."""
    stats = now.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = lambda c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0), F.lit(0.0))
    past = frame.join(breakdowns.select(key, F.date_sub(F.to_date("at"), 2).alias("asof"), "component", "cost"), [key, "asof"])
    return past.join(F.broadcast(stats)).select(key, F.date_add("asof", 1).alias("window_end"), F.array(*[F.round(z(c), 5) for c in columns]).alias("embedding"), "component", "cost")  # one row
