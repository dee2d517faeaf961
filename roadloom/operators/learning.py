"""As-of features, labels, splits and evaluation, without reading the future."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.hashing import sha_group
from roadloom.operators import boosting


def asof_windows(daily: DataFrame, day: str, days: int = 7, keep: Column | None = None) -> DataFrame:
    """Each daily row once for each of the `days` as-of days that see it, with `asof` and `age` (0: the as-of day itself). One
    aggregation over (key, asof) then serves all windows, so no window needs a join of its own."""
    out = daily.withColumn("asof", F.explode(F.sequence(F.col(day), F.date_add(F.col(day), days - 1))))
    out = out.withColumn("age", F.datediff("asof", day))
    return out if keep is None else out.where(keep)


def block_sum(value: Column, inside: Column) -> Column:
    """Sum over the rows inside a window's block: null where the block has no row, 0 where its rows have no value."""
    return F.when(F.count_if(inside) > 0, F.coalesce(F.sum(F.when(inside, value)), F.lit(0)))


def first_in_horizon(grid: DataFrame, events: DataFrame, key: str, asof: str, at: str, days: int = 7, first_day: int = 1) -> DataFrame:
    """The grid with the first event in [asof + first_day, asof + first_day + days), by time and then by the other columns: `label`,
    `days_to` and the event's columns. An event is spread over the as-of days that it concerns, so the join is on equal keys."""
    spread = events.withColumn("_day", F.to_date(at)).withColumn(asof, F.explode(F.sequence(F.date_sub("_day", first_day + days - 1), F.date_sub("_day", first_day))))
    rest = [c for c in events.columns if c not in (key, at)]
    first = spread.groupBy(key, asof).agg(F.min(F.struct(at, *rest)).alias("_e"))
    out = grid.join(first, [key, asof], "left")
    return out.select(*grid.columns, F.col("_e").isNotNull().cast("int").alias("label"), F.datediff(F.col(f"_e.{at}"), asof).alias("days_to"), *[F.col(f"_e.{c}").alias(c) for c in (at, *rest)])


def split_of(key: Column, early: Column) -> Column:
    """train, valid, test or none: by the key's group of ten and whether the as-of day is before the cut."""
    named = lambda g: F.when((g < 7) & early, "train").when((g == 7) & early, "valid").when((g >= 8) & ~early, "test")
    return F.get(F.transform(F.array(sha_group(key)), named), F.lit(0))  # the group is made once a row


def baseline_rule(serious: Column, hottest: Column, lowest_battery: Column, health_drop: Column) -> Column:
    """The mechanic's rule; what is missing says nothing."""
    said = [serious > 0, hottest > 100, lowest_battery < 12.0, health_drop > 2]
    out = F.lit(False)
    for s in said:
        out = out | F.coalesce(s, F.lit(False))
    return out


def threshold_counts(scored: DataFrame, score: str, label: str, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """(groups, score, tp, fp, positives, negatives): by distinct score, how many rows score as high or higher. Ties are one step."""
    by = scored.groupBy(*groups, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("_hits"), F.count("*").alias("_n"))
    w = Window.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    return by.select(*groups, score, F.sum("_hits").over(w).alias("tp"), (F.sum("_n").over(w) - F.sum("_hits").over(w)).alias("fp"), "_hits", (F.col("_n") - F.col("_hits")).alias("_misses"), F.sum("_hits").over(whole).alias("positives"), F.sum(F.col("_n") - F.col("_hits")).over(whole).alias("negatives"))


def ranking_metrics(scored: DataFrame, score: str, label: str, groups: list[str] = []) -> DataFrame:  # noqa: B006
    """(groups, n, average_precision, roc_auc, brier). Average precision sums precision over the steps in recall; the area under the
    ROC curve is the share of pairs in order, ties counted half. Scores are met as distinct values before any window."""
    t = threshold_counts(scored, score, label, groups)
    some = lambda c: F.nullif(F.col(c), F.lit(0))  # no positives or no negatives: null
    ap = F.sum(F.col("_hits") / some("positives") * F.col("tp") / (F.col("tp") + F.col("fp")))
    auc = F.sum(F.col("_misses") * (F.col("tp") - F.col("_hits") / 2)) / (F.first(some("positives")) * F.first(some("negatives")))
    brier = F.sum(F.col("_hits") * (F.col(score) - 1) * (F.col(score) - 1) + F.col("_misses") * F.col(score) * F.col(score)) / F.sum(F.col("_hits") + F.col("_misses"))
    out = (F.sum(F.col("_hits") + F.col("_misses")).alias("n"), ap.alias("average_precision"), auc.alias("roc_auc"), brier.alias("brier"))
    return t.groupBy(*groups).agg(*out) if groups else t.agg(*out)


def cost_curve(scored: DataFrame, score: str, label: str, saving: str, thresholds: list[float]) -> DataFrame:
    """(threshold, flagged, caught, saved, precision, recall) for each threshold; one aggregation with a sum a threshold."""
    yes = F.col(label) == 1
    sums = [f.alias(f"{n}_{i}") for i, t in enumerate(thresholds) for n, f in (("flagged", F.count_if(F.col(score) >= t)), ("caught", F.count_if((F.col(score) >= t) & yes)), ("saved", F.coalesce(F.sum(F.when((F.col(score) >= t) & yes, F.col(saving))), F.lit(0))))]
    one = scored.agg(F.count_if(yes).alias("positives"), *sums)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in ("flagged", "caught", "saved")]) for i, t in enumerate(thresholds)])
    out = one.select("positives", F.explode(rows).alias("x")).select("positives", "x.*")
    return out.select("threshold", "flagged", "caught", "saved", (F.col("caught") / F.greatest("flagged", F.lit(1))).alias("precision"), (F.col("caught") / F.greatest("positives", F.lit(1))).alias("recall"))


#: Trees of a training at most, and after how many without a gain on the held rows it ends: the original's 3,000 and 150 at its rate of
#: 0.03 go as far as these at the rate of 0.2 here.
TREES, PATIENCE = 450, 23


def train_risk(features: DataFrame, columns: list[str], label: str, categorical: list[str] = [], iterations: int = TREES, depth: int = 3, patience: int = PATIENCE):  # noqa: B006
    """Boosted trees over numbers and categories, which learn where a missing value goes and stop growing when the rows whose split is
    valid gain no more for `patience` trees, and an isotonic calibration of their scores on those rows. features: with `split`. Returns
    (trees, calibration model)."""
    from pyspark.ml.regression import IsotonicRegression

    ready = features.where("split in ('train', 'valid')").withColumn("_valid", F.col("split") == "valid")
    model = boosting.fit(ready, columns, label, categorical, held="_valid", iterations=iterations, depth=depth, patience=patience)
    valid = _probability(ready.where("_valid"), model).select("_s", F.col(label).cast("double").alias("_y")).where("_y is not null")
    return model, IsotonicRegression(labelCol="_y", featuresCol="_s").fit(valid)


def _probability(rows: DataFrame, model: boosting.BoostedTrees) -> DataFrame:
    return boosting.scored(rows, model, "_margin").withColumn("_s", 1 / (1 + F.exp(-F.col("_margin"))))


def score_risk(features: DataFrame, models, low: float = 0.001, high: float = 0.99) -> DataFrame:
    """The rows with `p`, the calibrated probability within the bounds."""
    model, calibration = models
    out = calibration.transform(_probability(features, model))
    return out.select(*features.columns, F.greatest(F.least("prediction", F.lit(high)), F.lit(low)).alias("p"))


#: Daily columns that the feature frame is made from, beside a 0/1 column `dtc_<code>` for each fault code.
DAILY = ("samples", "km", "coolant_max", "coolant_avg", "batt_v_min", "batt_v_avg", "soh_min", "rpm_avg", "dtc_events", "harsh_events", "idle_samples")


def feature_frame(daily: DataFrame, codes: list[str], serious: list[str], key: str = "vin", day: str = "day", tasks: int | None = None) -> DataFrame:
    """(key, asof, features): for each vehicle and as-of day levels and sums of the last week, of its last 3 days and of the 4 before
    them, of the day itself, trends between them, and the days with each fault code. One aggregation serves all windows; a window
    without a row gives null. tasks: so many, if given, have the vehicles; daily rows are dealt before they are spread to their as-of
    days, so these are not moved, and with tasks in proportion to the rows the memory of one stays as it is."""
    rows = asof_windows(daily if tasks is None else daily.repartition(tasks, key), day)
    recent, prior, last = F.col("age") <= 2, F.col("age") >= 3, F.col("age") == 0
    some = lambda f, c, inside=None: f(c if inside is None else F.when(inside, F.col(c)))
    out = {
        "days_active_7d": F.count("*"), "km_7d": F.sum("km"), "coolant_max_7d": F.max("coolant_max"), "coolant_avg_7d": F.avg("coolant_avg"), "batt_min_7d": F.min("batt_v_min"), "batt_avg_7d": F.avg("batt_v_avg"),
        "soh_min_7d": F.min("soh_min"), "soh_drop_7d": F.max("soh_min") - F.min("soh_min"), "rpm_avg_7d": F.avg("rpm_avg"), "dtc_events_7d": F.sum("dtc_events"), "harsh_7d": F.sum("harsh_events"),
        "idle_ratio_7d": F.sum("idle_samples") / F.greatest(F.sum("samples"), F.lit(1)),
        "coolant_max_3d": some(F.max, "coolant_max", recent), "coolant_avg_3d": some(F.avg, "coolant_avg", recent), "batt_min_3d": some(F.min, "batt_v_min", recent), "batt_avg_3d": some(F.avg, "batt_v_avg", recent),
        "rpm_avg_3d": some(F.avg, "rpm_avg", recent), "dtc_events_3d": block_sum(F.col("dtc_events"), recent), "harsh_3d": block_sum(F.col("harsh_events"), recent), "km_3d": block_sum(F.col("km"), recent),
        "serious_dtc_days_3d": block_sum(sum((F.coalesce(F.col(f"dtc_{c}"), F.lit(0)) for c in serious), F.lit(0)), recent),
        "coolant_max_1d": some(F.max, "coolant_max", last), "batt_v_min_1d": some(F.min, "batt_v_min", last), "dtc_events_1d": some(F.max, "dtc_events", last),
        "_coolant": some(F.avg, "coolant_avg", prior), "_batt": some(F.avg, "batt_v_avg", prior), "_rpm": some(F.avg, "rpm_avg", prior), "_harsh": block_sum(F.col("harsh_events"), prior), "_km": block_sum(F.col("km"), prior),
        **{f"dtc_{c}_days_7d": F.sum(f"dtc_{c}") for c in codes},
    }
    f = rows.groupBy(key, "asof").agg(*[c.alias(n) for n, c in out.items()])
    per_100 = lambda harsh, km: 100 * F.col(harsh) / F.greatest(km, F.lit(1))
    f = f.withColumns({"coolant_trend": F.col("coolant_avg_3d") - F.col("_coolant"), "batt_trend": F.col("batt_avg_3d") - F.col("_batt"), "rpm_trend": F.col("rpm_avg_3d") - F.col("_rpm"), "harsh_per_100km_3d": F.when(F.col("km_3d").isNotNull(), per_100("harsh_3d", "km_3d")), "harsh_per_100km_prior": F.when(F.col("_km").isNotNull(), per_100("_harsh", "_km"))})
    return f.withColumn("harsh_trend", F.col("harsh_per_100km_3d") - F.col("harsh_per_100km_prior")).drop("_coolant", "_batt", "_rpm", "_harsh", "_km")
