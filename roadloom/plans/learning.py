"""Features, labels, evaluation, drift, similar cases. Labels with a score made from the id stand for a model's scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.numbers import half_up, interpolate, per_at_least
from roadloom.operators import drift, learning
from roadloom.operators.rollups import top_by_group
from roadloom.plans.telemetry import T
from roadloom.sources.tables import checkpointed, table, telemetry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: A score in hundredths: high for toxic ones, with noise from the id.
SCORED = "(SELECT l.doc_id AS id, l.toxic AS y, d.lang AS oem, (d.n_chars % 97)::BIGINT AS saving, (l.doc_id % 31) AS as_of, least(99, l.toxic * 40 + (l.doc_id * 37) % 60)::BIGINT AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("oem"), (F.col("n_chars") % 97).alias("saving"))
    rows = table(spark, sf, "labels").join(d, "doc_id")
    s = F.least(F.lit(99), F.col("toxic") * 40 + (F.col("doc_id") * 37) % 60).cast("bigint")
    return rows.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), "oem", "saving", (F.col("doc_id") % 31).alias("as_of"), s.alias("s"))


@query("SELECT count(*) AS n, sum(toxic)::BIGINT AS found, floor(sum((doc_id % 100) / 100.0::DOUBLE) * 1000 + 0.5) / 1000 AS expected, floor(sqrt(sum((doc_id % 100) * (100 - doc_id % 100))::DOUBLE / 10000) * 1000 + 0.5) / 1000 AS sd, CASE WHEN count(*) < 20 THEN 'TOO_FEW' WHEN sum(toxic) < sum(doc_id % 100) / 100.0 - 2 * sqrt(sum((doc_id % 100) * (100 - doc_id % 100)) / 10000.0) THEN 'BELOW' WHEN sum(toxic) > sum(doc_id % 100) / 100.0 + 2 * sqrt(sum((doc_id % 100) * (100 - doc_id % 100)) / 10000.0) THEN 'ABOVE' ELSE 'ON_TRACK' END AS status FROM labels")
def model_health(spark: SparkSession, sf: str) -> DataFrame:
    """Whether what was found lies within two deviations of what was expected."""
    m = F.col("doc_id") % 100
    a = table(spark, sf, "labels").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("bigint")).alias("found"), (F.sum(m) / 100.0).alias("e"), F.sqrt(F.sum(m * (100 - m)) / 10000.0).alias("d"))
    status = F.when(F.col("n") < 20, "TOO_FEW").when(F.col("found") < F.col("e") - 2 * F.col("d"), "BELOW").when(F.col("found") > F.col("e") + 2 * F.col("d"), "ABOVE").otherwise("ON_TRACK")
    return a.select("n", "found", half_up(F.col("e"), 3).alias("expected"), half_up(F.col("d"), 3).alias("sd"), status.alias("status"))


@query(f"""SELECT vin, day, label, ts, seq, days_to FROM (SELECT g.vin, g.day, (e.ts IS NOT NULL)::INT AS label, e.ts, e.seq, date_diff('day', g.day, e.ts::DATE) AS days_to, row_number() OVER (PARTITION BY g.vin, g.day ORDER BY e.ts, e.seq) AS rn
  FROM (SELECT DISTINCT vin, ts::DATE AS day FROM {T}) g LEFT JOIN (SELECT * FROM {T} WHERE evt = 'error') e ON e.vin = g.vin AND e.ts >= g.day + INTERVAL 1 DAY AND e.ts < g.day + INTERVAL 8 DAY) WHERE rn = 1""")
def label_first_event_in_horizon(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(spark, sf)
    grid = t.select("vin", F.to_date("ts").alias("day")).distinct()
    out = learning.first_in_horizon(grid, t.where("evt = 'error'").select("vin", "ts", "seq"), "vin", "day", "ts")
    return out.select("vin", "day", "label", "ts", "seq", F.col("days_to").cast("bigint").alias("days_to"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """One aggregation over (vehicle, as-of day) for all windows: days, sums, means and extremes of 7, 3, the 4 before, and 1 day."""
    t = telemetry(spark, sf)
    daily = t.groupBy("vin", F.to_date("ts").alias("day")).agg(F.count("*").alias("samples"), F.count_if(F.col("evt") == "error").alias("serious"), F.max("reading").alias("high"), F.min("reading").alias("low"), F.sum("level").alias("km"))
    rows = learning.asof_windows(daily, "day").withColumnRenamed("asof", "as_of").where(F.col("as_of") <= F.lit("2024-01-30").cast("date"))
    recent, prior, last = F.col("age") <= 2, F.col("age") >= 3, F.col("age") == 0
    out = rows.groupBy("vin", "as_of").agg(
        F.count("*").alias("days_7d"), F.sum("samples").alias("samples_7d"), F.sum("serious").alias("serious_7d"), F.max("high").alias("high_7d"), F.sum("km").alias("km_7d"),
        learning.block_sum(F.col("serious"), recent).alias("serious_3d"), F.max(F.when(recent, F.col("high"))).alias("high_3d"), F.min(F.when(recent, F.col("low"))).alias("low_3d"),
        learning.block_sum(F.col("serious"), prior).alias("serious_prior"), F.max(F.when(last, F.col("high"))).alias("high_1d"),
    )
    vehicles = table(spark, sf, "customer").select(F.col("c_custkey").alias("vin"), F.col("c_mktsegment").alias("powertrain"))
    out = out.join(vehicles, "vin")
    return out.withColumn("serious_per_100", half_up(per_at_least(100 * F.col("serious_7d"), F.col("km_7d").cast("double")), 4))


FEATURES = f"""(SELECT f.*, c_mktsegment AS powertrain, floor(100 * serious_7d / greatest(km_7d::DOUBLE, 1) * 10000 + 0.5) / 10000 AS serious_per_100 FROM (
  SELECT vin, as_of, count(*) AS days_7d, sum(samples)::BIGINT AS samples_7d, sum(serious)::BIGINT AS serious_7d, max(high) AS high_7d, sum(km)::BIGINT AS km_7d,
    sum(serious) FILTER (age <= 2)::BIGINT AS serious_3d, max(high) FILTER (age <= 2) AS high_3d, min(low) FILTER (age <= 2) AS low_3d, sum(serious) FILTER (age >= 3)::BIGINT AS serious_prior, max(high) FILTER (age = 0) AS high_1d
  FROM (SELECT d.*, d.day + a.age::INT AS as_of, a.age FROM (SELECT vin, ts::DATE AS day, count(*) AS samples, count(*) FILTER (evt = 'error') AS serious, max(reading) AS high, min(reading) AS low, sum(level) AS km FROM {T} GROUP BY 1, 2) d CROSS JOIN range(0, 7) a(age))
  WHERE as_of <= DATE '2024-01-30' GROUP BY 1, 2) f JOIN customer ON c_custkey = f.vin)"""


@query(f"SELECT * FROM {FEATURES}")
def features_asof(spark: SparkSession, sf: str) -> DataFrame:
    return features(spark, sf)


@query(f"SELECT vin, as_of, coalesce(serious_3d > 1, false) OR coalesce(high_3d > 100, false) OR coalesce(low_3d < 12, false) AS flagged FROM {FEATURES}")
def baseline_rule(spark: SparkSession, sf: str) -> DataFrame:
    f = features(spark, sf)
    return f.select("vin", "as_of", learning.baseline_rule(F.col("serious_3d") - 1, F.col("high_3d"), F.col("low_3d"), F.lit(None).cast("double")).alias("flagged"))


@query(f"SELECT id, as_of, rank FROM (SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY s DESC, id) AS rank FROM {SCORED}) WHERE rank <= as_of % 4 + 1")
def topk_at_daily_budget(spark: SparkSession, sf: str) -> DataFrame:
    top = top_by_group(_scored(spark, sf), ["as_of"], [F.desc("s"), F.col("id")], F.col("as_of") % 4 + 1)
    return top.select("id", "as_of", F.col("rank").cast("bigint").alias("rank"))


@query(f"""SELECT floor(count(*) FILTER (s >= 50)::DOUBLE / count(DISTINCT as_of) * 10000 + 0.5) / 10000 AS flagged_per_day, floor(count(*) FILTER (s >= 50 AND y = 1)::DOUBLE / greatest(count(*) FILTER (s >= 50), 1) * 10000 + 0.5) / 10000 AS precision,
  floor(count(*) FILTER (s >= 50 AND y = 1)::DOUBLE / greatest(sum(y), 1) * 10000 + 0.5) / 10000 AS recall, quantile_cont(as_of, 0.5) FILTER (s >= 50 AND y = 1) AS median_days, coalesce(sum(saving) FILTER (s >= 50 AND y = 1), 0)::BIGINT - 15 * count(*) FILTER (s >= 50) AS net FROM {SCORED}""")
def policy_outcome(spark: SparkSession, sf: str) -> DataFrame:
    r = _scored(spark, sf)
    flagged, caught = F.col("s") >= 50, (F.col("s") >= 50) & (F.col("y") == 1)
    f, c = F.count_if(flagged), F.count_if(caught)
    return r.agg(half_up(f.cast("double") / F.countDistinct("as_of"), 4).alias("flagged_per_day"), half_up(c.cast("double") / F.greatest(f, F.lit(1)), 4).alias("precision"), half_up(c.cast("double") / F.greatest(F.sum("y"), F.lit(1)), 4).alias("recall"), F.percentile(F.when(caught, F.col("as_of")), 0.5).alias("median_days"), (F.coalesce(F.sum(F.when(caught, F.col("saving"))), F.lit(0)) - 15 * f).alias("net"))


CURVE = f"""(SELECT t::DOUBLE AS threshold, count(*) FILTER (s >= t) AS flagged, count(*) FILTER (s >= t AND y = 1) AS caught, coalesce(sum(saving) FILTER (s >= t AND y = 1), 0)::BIGINT AS saved,
  count(*) FILTER (s >= t AND y = 1)::DOUBLE / greatest(count(*) FILTER (s >= t), 1) AS precision, count(*) FILTER (s >= t AND y = 1)::DOUBLE / greatest(sum(y), 1) AS recall FROM {SCORED} CROSS JOIN (SELECT unnest([5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95]) AS t) GROUP BY t)"""
THRESHOLDS = [5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95]


@query(f"SELECT * FROM {CURVE}")
def cost_curve(spark: SparkSession, sf: str) -> DataFrame:
    return learning.cost_curve(_scored(spark, sf), "s", "y", "saving", THRESHOLDS)


#: Hundredths: fine where alerts are decided, coarse above.
FINE = [*range(1, 10), *[10 + 2.5 * i for i in range(35)]]


@query(CURVE[1:-1].replace("[5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95]", str(FINE)))
def cost_curve_fine(spark: SparkSession, sf: str) -> DataFrame:
    """The curve at 44 thresholds, dense where decisions fall; still one pass."""
    return learning.cost_curve(_scored(spark, sf), "s", "y", "saving", FINE)


@query(f"SELECT cost, arg_max(threshold, threshold) FILTER (threshold <= cost * 1.5 + 1e-9) AS rule, max(saved - cost * flagged) AS best_net, arg_max(threshold, (saved - cost * flagged, -threshold)) AS best FROM {CURVE} CROSS JOIN range(10, 61, 10) c(cost) GROUP BY cost")
def cost_choice_from_curve(spark: SparkSession, sf: str) -> DataFrame:
    curve = learning.cost_curve(_scored(spark, sf), "s", "y", "saving", THRESHOLDS).withColumn("cost", F.explode(F.lit([10, 20, 30, 40, 50, 60]).cast("array<bigint>")))
    net = F.col("saved") - F.col("cost") * F.col("flagged")
    return curve.groupBy("cost").agg(F.max(F.when(F.col("threshold") <= F.col("cost") * 1.5 + 1e-9, F.col("threshold"))).alias("rule"), F.max(net).alias("best_net"), F.max_by("threshold", F.struct(net, -F.col("threshold"))).alias("best"))


@query(f"""WITH r AS (SELECT oem, s, sum(y) AS p, count(*) - sum(y) AS q FROM {SCORED} GROUP BY 1, 2), w AS (SELECT *, sum(p) OVER o AS tp, sum(q) OVER o AS fp, sum(p) OVER g AS pos, sum(q) OVER g AS neg FROM r WINDOW o AS (PARTITION BY oem ORDER BY s DESC), g AS (PARTITION BY oem))
  SELECT oem, sum(p + q)::BIGINT AS n, floor(sum(p / pos * tp / (tp + fp)) * 1e6 + 0.5) / 1e6 AS average_precision, floor(sum(q * (tp - p / 2)) / (max(pos) * max(neg)) * 1e6 + 0.5) / 1e6 AS roc_auc FROM w GROUP BY 1""")
def metrics_by_group(spark: SparkSession, sf: str) -> DataFrame:
    m = learning.ranking_metrics(_scored(spark, sf), "s", "y", ["oem"])
    return m.select("oem", "n", half_up(F.col("average_precision"), 6).alias("average_precision"), half_up(F.col("roc_auc"), 6).alias("roc_auc"))


@query(f"SELECT CASE WHEN s <= 5 THEN 1 WHEN s <= 20 THEN 2 WHEN s <= 50 THEN 3 WHEN s <= 80 THEN 4 ELSE 5 END AS bin, floor(avg(s) * 10000 + 0.5) / 10000 AS mean_score, floor(avg(y) * 10000 + 0.5) / 10000 AS mean_label, count(*) AS n FROM {SCORED} GROUP BY 1")
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s")
    b = F.when(s <= 5, 1).when(s <= 20, 2).when(s <= 50, 3).when(s <= 80, 4).otherwise(5)
    return _scored(spark, sf).groupBy(b.alias("bin")).agg(half_up(F.avg("s"), 4).alias("mean_score"), half_up(F.avg("y"), 4).alias("mean_label"), F.count("*").alias("n"))


@query(f"SELECT oem, CASE WHEN as_of < 19 THEN 'early' ELSE 'late' END AS split, count(*) AS n, sum(y)::BIGINT AS positives, floor(avg(y) * 10000 + 0.5) / 10000 AS base_rate FROM {SCORED} GROUP BY 1, 2")
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).groupBy("oem", F.when(F.col("as_of") < 19, "early").otherwise("late").alias("split")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("bigint")).alias("positives"), half_up(F.avg("y"), 4).alias("base_rate"))


@query(f"SELECT floor(150 / avg(saving) * 10000 + 0.5) / 10000 AS threshold, count(*) AS n FROM (SELECT DISTINCT ON (oem, as_of) saving FROM {SCORED} WHERE y = 1 ORDER BY oem, as_of, id)")
def cost_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The cost over the mean saving, one row counted for each key: the first by id."""
    first = _scored(spark, sf).where("y = 1").groupBy("oem", "as_of").agg(F.min_by("saving", "id").alias("saving"))
    return first.agg(half_up(150 / F.avg("saving"), 4).alias("threshold"), F.count("*").alias("n"))


@query(f"SELECT id, floor(p0) AS p FROM (SELECT id, greatest(least(CASE WHEN s <= 10 THEN 0.02 WHEN s <= 50 THEN 0.02 + (s - 10) * (0.4 - 0.02) / 40 WHEN s <= 90 THEN 0.4 + (s - 50) * (1.0 - 0.4) / 40 ELSE 1.0 END::DOUBLE, 0.99), 0.001) * 1000 AS p0 FROM {SCORED})")
def calibration_interp_clip(spark: SparkSession, sf: str) -> DataFrame:
    p = interpolate(F.col("s").cast("double"), [10, 50, 90], [0.02, 0.4, 1.0], 0.001, 0.99)
    return _scored(spark, sf).select("id", F.floor(p * 1000).cast("double").alias("p"))


@query(f"SELECT id, array_to_string(list_transform(list_reverse_sort([{{'v': s::BIGINT, 'n': 'score'}}, {{'v': saving::BIGINT, 'n': 'saving'}}, {{'v': as_of::BIGINT, 'n': 'asof'}}, {{'v': (y * 50)::BIGINT, 'n': 'label'}}])[1:3], lambda e: e.n), ',') AS top FROM {SCORED}")
def top3_contributions(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.array(*[F.struct(v.cast("bigint").alias("v"), F.lit(n).alias("n")) for v, n in ((F.col("s"), "score"), (F.col("saving"), "saving"), (F.col("as_of"), "asof"), (F.col("y") * 50, "label"))])
    return _scored(spark, sf).select("id", F.array_join(F.transform(F.slice(F.sort_array(parts, asc=False), 1, 3), lambda x: x.n), ",").alias("top"))


PSI = f"""(WITH r AS (SELECT evt, reading, ts >= TIMESTAMP '2024-01-20' AS cur FROM {T}), e AS (SELECT evt, list_distinct(quantile_cont(reading, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM r WHERE NOT cur GROUP BY 1),
  b AS (SELECT r.evt, len(list_filter(edges, lambda x: x <= reading)) AS bin, count(*) FILTER (NOT cur) AS b, count(*) FILTER (cur) AS c FROM r JOIN e ON e.evt = r.evt GROUP BY 1, 2), t AS (SELECT evt, sum(b) AS bn, sum(c) AS cn FROM b GROUP BY 1)
  SELECT b.evt, sum((greatest(c / cn, 1e-4) - greatest(b / bn, 1e-4)) * ln(greatest(c / cn, 1e-4) / greatest(b / bn, 1e-4))) AS psi, max(bn)::BIGINT AS baseline_n, max(cn)::BIGINT AS current_n FROM b JOIN t ON t.evt = b.evt GROUP BY 1)"""


def _psi(spark: SparkSession, sf: str) -> DataFrame:
    return drift.psi(telemetry(spark, sf).withColumn("cur", F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")), "evt", "reading", "cur")


@query(f"SELECT evt, floor(psi * 1e6 + 0.5) / 1e6 AS psi, baseline_n, current_n FROM {PSI}")
def psi_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return _psi(spark, sf).select("evt", half_up(F.col("psi"), 6).alias("psi"), "baseline_n", "current_n")


@query(f"""SELECT a.evt, floor(quantile_cont(b.psi, 0.5) * 1e6 + 0.5) / 1e6 AS peers, CASE WHEN a.psi > 0.02 AND a.psi - quantile_cont(b.psi, 0.5) > 0.02 THEN 'DRIFT' WHEN a.psi > 0.005 AND a.psi - quantile_cont(b.psi, 0.5) > 0.005 THEN 'WATCH' ELSE 'OK' END AS status
  FROM {PSI} a JOIN {PSI} b ON a.evt <> b.evt GROUP BY a.evt, a.psi""")
def drift_classify(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.classify(_psi(spark, sf).withColumn("field", F.lit("reading")), ["field"], "evt", 0.005, 0.02)
    return out.select("evt", half_up(F.col("peers"), 6).alias("peers"), "status")


@query(f"SELECT evt, floor(avg(reading) FILTER (ts < TIMESTAMP '2024-01-20') * 100 + 0.5) / 100 AS baseline_mean, floor(avg(reading) FILTER (ts >= TIMESTAMP '2024-01-20') * 100 + 0.5) / 100 AS current_mean, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS current_n FROM {T} GROUP BY 1 HAVING count(*) FILTER (ts >= TIMESTAMP '2024-01-20') >= 300")
def drift_table(spark: SparkSession, sf: str) -> DataFrame:
    return _psi(spark, sf).where("current_n >= 300").select("evt", half_up(F.col("baseline_mean"), 2).alias("baseline_mean"), half_up(F.col("current_mean"), 2).alias("current_mean"), "current_n")


@query(f"""WITH ok AS (SELECT evt FROM {T} GROUP BY 1 HAVING count(DISTINCT date_trunc('minute', ts)) >= 0.9 * 2000)
  SELECT evt, floor(avg(reading) FILTER (ts < TIMESTAMP '2024-01-20') * 100 + 0.5) / 100 AS baseline_mean, floor(avg(reading) FILTER (ts >= TIMESTAMP '2024-01-20') * 100 + 0.5) / 100 AS current_mean, count(*) FILTER (ts >= TIMESTAMP '2024-01-20') AS current_n FROM {T} JOIN ok USING (evt) GROUP BY 1""")
def drift_where_covered(spark: SparkSession, sf: str) -> DataFrame:
    """Drift only of makers (event types) with readings in at least nine tenths of 2,000 minutes: what was hardly heard isn't judged."""
    t = telemetry(spark, sf)
    enough = drift.covered(t, "evt", "ts", 2000)
    rows = t.join(enough.select("evt"), "evt", "left_semi").withColumn("cur", F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    return drift.psi(rows, "evt", "reading", "cur").select("evt", half_up(F.col("baseline_mean"), 2).alias("baseline_mean"), half_up(F.col("current_mean"), 2).alias("current_mean"), "current_n")


@query("SELECT o_orderpriority AS component, count(*) AS inspected, count(*) FILTER (o_orderkey % 3 = 0) AS found, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 4 = o_custkey % 4) AS part_right, CASE WHEN count(*) FILTER (o_orderkey % 3 = 0) > 0 THEN floor(count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 4 = o_custkey % 4)::DOUBLE / count(*) FILTER (o_orderkey % 3 = 0) * 10000 + 0.5) / 10000 END AS share FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def model_health_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Of the inspections that found a fault, how many found it in the part that the model named, by priority."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    found = F.col("o_orderkey") % 3 == 0
    right = found & (F.col("o_orderkey") % 4 == F.col("o_custkey") % 4)
    a = o.groupBy(F.col("o_orderpriority").alias("component")).agg(F.count("*").alias("inspected"), F.count_if(found).alias("found"), F.count_if(right).alias("part_right"))
    return a.withColumn("share", F.when(F.col("found") > 0, half_up(F.col("part_right") / F.col("found"), 4)))


@query("SELECT e.vec_id, e.label, floor(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) * 1e5 + 0.5) / 1e5 AS similarity FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 ORDER BY similarity DESC, e.vec_id LIMIT 5")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The five cases most like one case; the one vector is sent to all."""
    from roadloom.functions.vectors import cosine

    e = table(spark, sf, "embeddings")
    one = e.where("vec_id = 7").select(F.col("embedding").alias("q"))
    rows = e.where("vec_id <> 7").join(F.broadcast(one)).select("vec_id", "label", half_up(cosine(F.col("embedding"), F.col("q")), 5).alias("similarity"))
    return rows.orderBy(F.desc("similarity"), "vec_id").limit(5)


@query("SELECT vec_id, " + ", ".join(f"floor((embedding[{i + 1}]::DOUBLE - avg(embedding[{i + 1}]::DOUBLE) OVER ()) / stddev_samp(embedding[{i + 1}]::DOUBLE) OVER () * 1e4 + 0.5) / 1e4 AS z{i}" for i in range(4)) + " FROM embeddings")
def signature_zscore(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"z{i}") for i in range(4)])
    z = drift.standardised(e, [f"z{i}" for i in range(4)])
    return z.select("vec_id", *[half_up(F.col(f"z{i}"), 4).alias(f"z{i}") for i in range(4)])


@query()
def risk_scores_trained(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees with a calibration, trained on early as-of days of some vehicles and applied to the latest day."""
    columns = ["days_7d", "samples_7d", "serious_7d", "high_7d", "km_7d", "serious_3d", "high_3d", "low_3d", "serious_prior", "high_1d", "serious_per_100"]
    events = telemetry(spark, sf).where("evt = 'error'").select("vin", "ts", "seq")
    f = features(spark, sf).select("vin", "as_of", *[F.col(c).cast("double").alias(c) for c in columns])
    labelled = learning.first_in_horizon(f, events, "vin", "as_of", "ts").withColumn("split", learning.split_of(F.col("vin"), F.col("as_of") < F.lit("2024-01-16").cast("date")))
    learned = checkpointed(labelled.where("split is not null").select("vin", "as_of", *columns, "label", "split"))  # each pass of the training reads it
    models = learning.train_risk(learned, columns, "label")
    return learning.score_risk(f.where("as_of = date'2024-01-30'"), models).select("vin", "as_of", "p")


_GROUP = "list_sum(list_transform(range(1, 65), lambda i: (instr('0123456789abcdef', substr(h, i::BIGINT, 1)) - 1) * CASE WHEN i = 64 THEN 1 ELSE 6 END)) % 10"


@query(f"""SELECT id, g, CASE WHEN g < 7 AND early THEN 'train' WHEN g = 7 AND early THEN 'valid' WHEN g >= 8 AND NOT early THEN 'test' END AS part FROM (SELECT id, early, {_GROUP} AS g FROM (SELECT c_custkey AS id, sha256(c_custkey::VARCHAR) AS h, c_custkey % 2 = 0 AS early FROM customer))""")
def split_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The split of a key: by its group of ten from the SHA-256, and by time. Powers of 16 end in 6, so the last digit of the hash as a
    number is that of six times its other digits and the last one."""
    from roadloom.functions.hashing import sha_group

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return c.select("id", sha_group(F.col("id")).cast("bigint").alias("g"), learning.split_of(F.col("id"), F.col("id") % 2 == 0).alias("part"))


@query(f"SELECT evt, count(*) FILTER (level > 10) AS moving, floor(avg(reading) FILTER (level > 10) * 100 + 0.5) / 100 AS mean_moving FROM {T} GROUP BY 1")
def moving_means(spark: SparkSession, sf: str) -> DataFrame:
    """Readings while the vehicle moves: only those are compared between makers. NaN is no speed."""
    speed = F.when(F.col("seq") % 1_000_000_007 == -1, float("nan")).otherwise(F.greatest(F.col("level") - 10, F.lit(0)).cast("double"))
    value = drift.moving_only(F.col("reading"), speed)
    return telemetry(spark, sf).groupBy("evt").agg(F.count_if(speed > 0).alias("moving"), half_up(F.avg(value), 2).alias("mean_moving"))
