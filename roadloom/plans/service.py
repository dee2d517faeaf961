"""State changes, service plans, the audit chain, scores and the shapes of answers: named queries with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.numbers import half_up
from roadloom.operators import boosting, drift, learning, planning, scoring, states
from roadloom.plans.fleet import RISK, _fleet, _risk
from roadloom.plans.telemetry import T
from roadloom.sources import skipping
from roadloom.sources.tables import checkpointed, days_between, parameterised, shared_folder, stable_id, table, telemetry, truncated, write_by_day

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Alerts are orders; who acknowledges and who resolves follows from the id, and some requests name no alert.
_ALERTS = "(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS s0 FROM orders)"
_MOVES = f"""(SELECT id, s0, id % 3 = 0 AS asks1, id % 5 = 0 AS asks2, CASE WHEN id % 3 = 0 AND s0 = 'OPEN' THEN 'ACKNOWLEDGED' ELSE s0 END AS s1 FROM {_ALERTS})"""


def _alert_requests(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("at"))
    status = F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "P", "ACKNOWLEDGED").otherwise("RESOLVED")
    alerts = o.select("id", status.alias("status"), F.lit(None).cast("string").alias("acknowledged_by"), F.lit(None).cast("timestamp").alias("resolved_at"))
    asks = lambda rows, n, to, by: rows.select((F.col("id") * 4 + n).alias("request"), "id", F.lit(to).alias("to"), (F.col("at") + F.make_dt_interval(F.lit(n))).alias("at"), F.lit(by).alias("by"))
    lost = o.where("id % 50 = 0 and id > 0").withColumn("id", -F.col("id"))
    return alerts, asks(o.where("id % 3 = 0"), 1, "ACKNOWLEDGED", "ann").unionByName(asks(o.where("id % 5 = 0"), 2, "RESOLVED", "bob")).unionByName(asks(lost, 3, "RESOLVED", "eve"))


@query(f"""SELECT id, CASE WHEN asks2 AND s1 IN ('OPEN', 'ACKNOWLEDGED') THEN 'RESOLVED' ELSE s1 END AS status, CASE WHEN asks1 AND s0 = 'OPEN' THEN 'ann' WHEN asks2 AND s1 IN ('OPEN', 'ACKNOWLEDGED') THEN 'bob' END AS acknowledged_by,
  asks2 AND s1 IN ('OPEN', 'ACKNOWLEDGED') AS resolved_now FROM {_MOVES}""")
def alert_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts after all requests: OPEN, ACKNOWLEDGED, RESOLVED, each move only from where it may start."""
    out, _ = states.alert_transitions(*_alert_requests(spark, sf))
    return out.select("id", "status", "acknowledged_by", F.col("resolved_at").isNotNull().alias("resolved_now"))


@query(f"""SELECT id * 4 + 1 AS request, s0 AS found, CASE WHEN s0 = 'OPEN' THEN 'done' ELSE 'conflict' END AS outcome FROM {_MOVES} WHERE asks1
  UNION ALL SELECT id * 4 + 2, s1, CASE WHEN s1 IN ('OPEN', 'ACKNOWLEDGED') THEN 'done' ELSE 'conflict' END FROM {_MOVES} WHERE asks2 UNION ALL SELECT -id * 4 + 3, NULL, 'not_found' FROM {_ALERTS} WHERE id % 50 = 0 AND id > 0""")
def alert_transition_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return states.alert_transitions(*_alert_requests(spark, sf))[1].select("request", "found", "outcome")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'DONE' WHEN o_orderstatus = 'O' THEN 'SCHEDULED' ELSE 'CANCELLED' END AS status, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN o_orderkey % 3 = 0 END AS fault_found,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 6 = 0 THEN 'part' || (o_orderkey % 4) END AS found_component, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 6 = 0 THEN o_orderkey % 4 = o_custkey % 4 END AS part_right FROM orders""")
def inspection_results(spark: SparkSession, sf: str) -> DataFrame:
    """Bookings after the mechanics' findings."""
    part = lambda c: F.concat(F.lit("part"), (F.col(c) % 4).cast("string"))
    o = table(spark, sf, "orders")
    nothing = {"fault_found": "boolean", "found_component": "string", "completed_at": "timestamp", "part_right": "boolean"}
    bookings = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "SCHEDULED").otherwise("CANCELLED").alias("status"), part("o_custkey").alias("predicted_component"), *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    results = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("request"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.lit("ann").alias("by"), (F.col("o_orderkey") % 3 == 0).alias("fault_found"), part("o_orderkey").alias("component"))
    return states.inspection_results(bookings, results)[0].select("id", "status", "fault_found", "found_component", "part_right")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' THEN 'EXECUTED' WHEN o_orderkey % 4 = 3 THEN 'PROPOSED' WHEN o_orderkey % 4 = 2 THEN 'REJECTED' WHEN bad > 0 THEN 'FAILED' ELSE 'EXECUTED' END AS status,
  CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 < 2 AND bad > 0 THEN 'over_capacity' END AS error, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 < 2 AND bad = 0 THEN n END AS bookings
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity >= 45) AS bad FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def proposal_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed plans after people's decisions: a plan with one item that no longer fits books nothing."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("item"), F.col("l_partkey").alias("vehicle"), F.when(F.col("l_quantity") >= 45, "over_capacity").alias("reason"))
    o = table(spark, sf, "orders").join(items.select(F.col("id").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    proposals = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "PROPOSED").otherwise("EXECUTED").alias("status"))
    decisions = o.where("o_orderkey % 4 <> 3").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4 < 2).alias("approve"), F.lit("ann").alias("by"), F.col("o_orderdate").alias("at"))
    return states.decided_proposals(proposals, decisions, items)[0].select("id", "status", "error", "bookings")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("tenant"), F.col("o_orderstatus").alias("action"))


_CHAIN = """WITH RECURSIVE log AS (SELECT o_orderkey AS id, o_custkey AS tenant, o_orderkey::VARCHAR || '|' || o_orderstatus AS body, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
  chain AS (SELECT id, tenant, rn, '' AS prev_hash, sha256(body) AS row_hash FROM log WHERE rn = 1 UNION ALL SELECT l.id, l.tenant, l.rn, c.row_hash, sha256(c.row_hash || l.body) FROM chain c JOIN log l ON l.tenant = c.tenant AND l.rn = c.rn + 1)
  SELECT id, prev_hash, row_hash FROM chain"""


@query(_CHAIN)
def audit_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Each tenant's log as a chain: a row's hash covers that of the row before it."""
    return states.audit_chain(_log(spark, sf), "id", "tenant", ["action"]).select("id", "prev_hash", "row_hash")


@query(_CHAIN)
def audit_chain_appended(spark: SparkSession, sf: str) -> DataFrame:
    """The same chain in two appends: the second goes on from the last hashes of the first, and costs its own rows."""
    log = _log(spark, sf)
    middle = F.broadcast(log.agg((F.max("id") / 2).alias("_middle")))  # one row
    parts = [log.join(middle).where(half).drop("_middle") for half in (F.col("id") <= F.col("_middle"), F.col("id") > F.col("_middle"))]
    first = checkpointed(states.audit_chain(parts[0], "id", "tenant", ["action"]))
    second = states.audit_chain(parts[1], "id", "tenant", ["action"], after=first)
    return first.union(second).select("id", "prev_hash", "row_hash")


@query("SELECT o_orderkey AS id, o_orderkey % 97 <> 5 AND coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) % 89 <> 3, true) AS ok FROM orders")
def audit_chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A chain with rows changed after the fact (a row's own hash does not fit) and with hashes replaced (the next row's link breaks)."""
    log = _log(spark, sf)
    chain = log.join(states.audit_chain(log, "id", "tenant", ["action"]).drop("tenant"), "id")
    forged = F.sha2(F.concat("prev_hash", F.concat_ws("|", F.col("id").cast("string"), F.lit("X"))).cast("binary"), 256)
    swapped = F.col("id") % 89 == 3
    tampered = chain.withColumn("row_hash", F.when(swapped, forged).otherwise(F.col("row_hash"))).withColumn("action", F.when((F.col("id") % 97 == 5) & ~swapped, "Y").when(swapped & (F.col("id") % 97 != 5), "X").otherwise(F.col("action")))
    return states.chain_checked(tampered, "id", "tenant", ["action"])


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def parameterised_read(spark: SparkSession, sf: str) -> DataFrame:
    sql = "SELECT o_orderkey AS id, o_totalprice AS price FROM {orders} WHERE o_orderstatus = :status AND o_totalprice >= :least AND array_contains(:priorities, o_orderpriority)"
    return parameterised(spark, sql, {"orders": table(spark, sf, "orders")}, status="O", least=100000, priorities=F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))


@query("SELECT c_custkey AS id, c_name AS vin, true AS truncated FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def truncated_list(spark: SparkSession, sf: str) -> DataFrame:
    return truncated(table(spark, sf, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 20).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("vin"), "truncated")


@query("SELECT o_orderkey AS id, o_orderpriority AS version, o_orderdate AS scored_at FROM orders WHERE (o_orderpriority, o_orderdate) IN (SELECT o_orderpriority, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderpriority DESC LIMIT 1)")
def latest_run_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The scores of the latest run: equality of two columns with one row, which is sent to all."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("version"), F.col("o_orderdate").alias("scored_at"))
    run = o.agg(F.max(F.struct("scored_at", "version")).alias("r")).select("r.version", "r.scored_at")
    return o.join(F.broadcast(run), ["version", "scored_at"]).select("id", "version", "scored_at")  # one row


_MD5 = "md5(c_custkey::VARCHAR || '|' || c_name)"


@query(f"SELECT c_custkey AS key, substr({_MD5}, 1, 8) || '-' || substr({_MD5}, 9, 4) || '-' || substr({_MD5}, 13, 4) || '-' || substr({_MD5}, 17, 4) || '-' || substr({_MD5}, 21, 12) AS id FROM customer")
def stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), stable_id(F.col("c_custkey"), F.col("c_name")).alias("id"))


@query(f"SELECT vin, ts::DATE AS day, count(*) AS samples, max(reading) AS high FROM {T} WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13' AND vin BETWEEN 10 AND 60 GROUP BY 1, 2")
def day_partitioned_read(spark: SparkSession, sf: str) -> DataFrame:
    """A rollup written by day, with files sorted by vehicle and a bloom filter on it; of it three days and some vehicles are read."""
    daily = telemetry(spark, sf).groupBy("vin", F.to_date("ts").alias("day")).agg(F.count("*").alias("samples"), F.max("reading").alias("high"))
    path = f"{shared_folder(spark, 'tables')}/vehicle_day"
    write_by_day(daily, path, "day", search=["vin"], order=["vin"])
    return days_between(spark, path, "2024-01-10", "2024-01-13").where("vin BETWEEN 10 AND 60").select("vin", "day", "samples", "high")


_COSTS = "(SELECT o_orderpriority AS component, floor(max(o_totalprice)) AS breakdown_cost, floor(min(o_totalprice)) AS repair_cost FROM orders GROUP BY 1)"


@query(f"""SELECT 'v' || vehicle_id || ':HIGH_FAILURE_RISK:2024-01-30' AS dedup_key, p AS probability, o_orderpriority AS component, breakdown_cost - repair_cost AS saving, 'CRITICAL' AS severity
  FROM {RISK} r JOIN orders o USING (o_orderkey) JOIN {_COSTS} c ON c.component = o_orderpriority WHERE rn = 1 AND p >= 0.9""")
def failure_risk_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts for the latest scores over the threshold, with the saving of the part that will fail."""
    o = table(spark, sf, "orders")
    costs = o.groupBy(F.col("o_orderpriority").alias("component")).agg(F.floor(F.max("o_totalprice")).cast("double").alias("breakdown_cost"), F.floor(F.min("o_totalprice")).cast("double").alias("repair_cost"))
    latest = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("x"))
    scored = latest.select(F.concat(F.lit("v"), "o_custkey").alias("vin"), ((F.col("x.o_orderkey") % 1000) / 1000.0).alias("p"), F.col("x.o_orderpriority").alias("component"))
    alerts = scoring.failure_alerts(scoring.with_saving(scored, costs), 0.9, "v1", "2024-01-30")
    detail = lambda c: F.get_json_object("details", f"$.{c}")
    return alerts.select("dedup_key", detail("probability").cast("double").alias("probability"), detail("component").alias("component"), detail("est_cost_avoided").cast("double").alias("saving"), "severity")


_CODES = [f"C{i:02}" for i in range(15)]
_SERIOUS = _CODES[:8]
_DAILY = f"""(SELECT vin, ts::DATE AS day, count(*) AS samples, sum(level)::BIGINT AS km, max(level) AS coolant_max, avg(level) * 0.91731372718281::DOUBLE AS coolant_avg, min(level) / 8.0::DOUBLE AS batt_v_min, avg(level) / 7.31374197182818::DOUBLE AS batt_v_avg, 100 - max(level) / 50.0::DOUBLE AS soh_min, avg(level * 30) * 1.00313792718281::DOUBLE AS rpm_avg,
  count(*) FILTER (evt = 'error') AS dtc_events, count(*) FILTER (evt IN ('error', 'click')) AS harsh_events, count(*) FILTER (evt = 'view') AS idle_samples, {", ".join(f"max((level % 15 = {i})::INT)::BIGINT AS dtc_{c}" for i, c in enumerate(_CODES))} FROM {T} GROUP BY 1, 2)"""
_R4 = lambda e: f"floor(({e}) * 1e4 + 0.5) / 1e4"
_FRAME_SQL = f"""SELECT vin, "asof", count(*) AS days_active_7d, sum(km)::BIGINT AS km_7d, max(coolant_max) AS coolant_max_7d, {_R4("avg(coolant_avg)")} AS coolant_avg_7d, min(batt_v_min) AS batt_min_7d, {_R4("avg(batt_v_avg)")} AS batt_avg_7d, {_R4("min(soh_min)")} AS soh_min_7d, {_R4("max(soh_min) - min(soh_min)")} AS soh_drop_7d,
  {_R4("avg(rpm_avg)")} AS rpm_avg_7d, sum(dtc_events)::BIGINT AS dtc_events_7d, sum(harsh_events)::BIGINT AS harsh_7d, {_R4("sum(idle_samples)::DOUBLE / greatest(sum(samples), 1)")} AS idle_ratio_7d,
  max(coolant_max) FILTER (age <= 2) AS coolant_max_3d, {_R4("avg(coolant_avg) FILTER (age <= 2)")} AS coolant_avg_3d, min(batt_v_min) FILTER (age <= 2) AS batt_min_3d, {_R4("avg(batt_v_avg) FILTER (age <= 2)")} AS batt_avg_3d, {_R4("avg(rpm_avg) FILTER (age <= 2)")} AS rpm_avg_3d,
  (sum(dtc_events) FILTER (age <= 2))::BIGINT AS dtc_events_3d, (sum(harsh_events) FILTER (age <= 2))::BIGINT AS harsh_3d, (sum(km) FILTER (age <= 2))::BIGINT AS km_3d, (sum({" + ".join(f"dtc_{c}" for c in _SERIOUS)}) FILTER (age <= 2))::BIGINT AS serious_dtc_days_3d,
  max(coolant_max) FILTER (age = 0) AS coolant_max_1d, min(batt_v_min) FILTER (age = 0) AS batt_v_min_1d, max(dtc_events) FILTER (age = 0) AS dtc_events_1d, {", ".join(f"sum(dtc_{c})::BIGINT AS dtc_{c}_days_7d" for c in _CODES)},
  {_R4("avg(coolant_avg) FILTER (age <= 2) - avg(coolant_avg) FILTER (age >= 3)")} AS coolant_trend, {_R4("avg(batt_v_avg) FILTER (age <= 2) - avg(batt_v_avg) FILTER (age >= 3)")} AS batt_trend, {_R4("avg(rpm_avg) FILTER (age <= 2) - avg(rpm_avg) FILTER (age >= 3)")} AS rpm_trend,
  {_R4("100.0::DOUBLE * sum(harsh_events) FILTER (age <= 2) / CASE WHEN sum(km) FILTER (age <= 2) < 1 THEN 1 ELSE sum(km) FILTER (age <= 2) END")} AS harsh_per_100km_3d,
  {_R4("100.0::DOUBLE * sum(harsh_events) FILTER (age >= 3) / CASE WHEN sum(km) FILTER (age >= 3) < 1 THEN 1 ELSE sum(km) FILTER (age >= 3) END")} AS harsh_per_100km_prior,
  {_R4("100.0::DOUBLE * sum(harsh_events) FILTER (age <= 2) / CASE WHEN sum(km) FILTER (age <= 2) < 1 THEN 1 ELSE sum(km) FILTER (age <= 2) END - 100.0::DOUBLE * sum(harsh_events) FILTER (age >= 3) / CASE WHEN sum(km) FILTER (age >= 3) < 1 THEN 1 ELSE sum(km) FILTER (age >= 3) END")} AS harsh_trend
  FROM (SELECT d.*, d.day + a.age::INT AS "asof", a.age FROM {_DAILY} d CROSS JOIN range(0, 7) a(age)) GROUP BY 1, 2"""


def daily_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Daily columns of a vehicle, from the level in the payload."""
    t, level = telemetry(spark, sf), F.col("level")
    flags = [F.max((level % 15 == i).cast("bigint")).alias(f"dtc_{c}") for i, c in enumerate(_CODES)]
    return t.groupBy("vin", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("samples"), F.sum("level").alias("km"), F.max("level").alias("coolant_max"), (F.avg("level") * 0.91731372718281).alias("coolant_avg"), (F.min("level") / 8).alias("batt_v_min"), (F.avg("level") / 7.31374197182818).alias("batt_v_avg"), (100 - F.max("level") / 50).alias("soh_min"), (F.avg(level * 30) * 1.00313792718281).alias("rpm_avg"),
        F.count_if(F.col("evt") == "error").alias("dtc_events"), F.count_if(F.col("evt").isin("error", "click")).alias("harsh_events"), F.count_if(F.col("evt") == "view").alias("idle_samples"), *flags,
    )


#: A task of the feature frame has the vehicles of about so many events.
TASK_EVENTS = 50_000


def _frame(spark: SparkSession, sf: str) -> DataFrame:
    tasks = 1 + table(spark, sf, "events").count() // TASK_EVENTS  # from the files' footers
    return learning.feature_frame(daily_signals(spark, sf), _CODES, _SERIOUS, tasks=tasks)


@query(_FRAME_SQL)
def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    """All features of a vehicle and as-of day, those of the 15 codes too."""
    f = _frame(spark, sf)
    whole = {n for n, t in f.dtypes if t == "double"} - {"batt_min_7d", "batt_min_3d", "batt_v_min_1d"}
    return f.select(*[(half_up(F.col(c), 4).alias(c) if c in whole else F.col(c)) for c in f.columns])


@query(f"""WITH m AS (SELECT evt, avg(level) FILTER (ts < TIMESTAMP '2024-01-20') AS b, avg(CASE WHEN evt = 'click' THEN level / 1.609344::DOUBLE ELSE level END) FILTER (ts >= TIMESTAMP '2024-01-20') AS c FROM {T} GROUP BY 1), f AS (SELECT quantile_cont(c / b, 0.5) AS ratio FROM m)
  SELECT evt, floor(c / b * 100 + 0.5) / 100 AS ratio, CASE WHEN c / b / f.ratio > 0.55 AND c / b / f.ratio < 0.70 THEN 'miles for kilometres' WHEN c / b / f.ratio > 1.45 AND c / b / f.ratio < 1.80 THEN 'converted twice' WHEN c / b / f.ratio > 900 AND c / b / f.ratio < 1100 THEN 'thousandths' END AS hint FROM m CROSS JOIN f""")
def unit_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Makers (event types) whose speeds look like another unit, once the fleet's own change, the median of all ratios, is divided out."""
    t = telemetry(spark, sf)
    now = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    seen = F.when(F.col("evt") == "click", F.col("level") / 1.609344).otherwise(F.col("level").cast("double"))
    means = t.groupBy("evt").agg(F.avg(F.when(~now, F.col("level"))).alias("b"), F.avg(F.when(now, seen)).alias("c"))
    fleet = means.agg(F.percentile(F.col("c") / F.col("b"), 0.5).alias("fleet"))  # one row a maker goes in
    hint = drift.unit_hint(F.lit("speed_kmh"), F.col("b"), F.col("c"), F.col("fleet"))
    return means.join(F.broadcast(fleet)).select("evt", half_up(F.col("c") / F.col("b"), 2).alias("ratio"), hint.alias("hint"))


@query(f"SELECT vin, seq, ts, reading FROM {T} WHERE vin IN (7, 57, 107) AND ts::DATE >= DATE '2024-01-10' AND ts::DATE < DATE '2024-01-13'")
def vehicles_in_days(spark: SparkSession, sf: str) -> DataFrame:
    """Events of three vehicles in three days of a table by day, from the files that can have any: a table of files is asked first."""
    t = telemetry(spark, sf).withColumn("day", F.to_date("ts"))
    home = shared_folder(spark, "skipping")
    t.select("vin", "seq", "ts", "reading", "day").repartition("day", F.pmod("vin", F.lit(4))).write.partitionBy("day").parquet(f"{home}/rows")
    index = skipping.refreshed(spark, f"{home}/rows", f"{home}/index", "day", "vin")
    return skipping.read_with(spark, f"{home}/rows", index, "day", "vin", "2024-01-10", "2024-01-13", [7, 57, 107]).select("vin", "seq", "ts", "reading")


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("depot"), (F.col("s_suppkey") % 10 * 2.0).alias("lat"), (F.col("s_suppkey") % 7 * 2.5).alias("lon"))
    risk = _risk(spark, sf).join(_fleet(spark, sf), F.col("vehicle_id") == F.col("c_custkey")).withColumn("value", planning.expected_value(F.col("p"), F.col("saving") / 100, 150.0))
    depots = F.broadcast(s.agg(F.count("*").alias("n")))  # one row
    candidates = risk.join(depots).select(F.col("r_name").alias("tenant"), F.col("vehicle_id").alias("vehicle"), (F.col("c_custkey") % F.col("n")).alias("home"), "p", "value")
    bays = s.join(F.broadcast(table(spark, sf, "region").select(F.col("r_name").alias("tenant"))), F.lit(True)).select("tenant", "depot", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("day"), F.lit(3).alias("free"))  # one row a tenant
    return planning.service_plan(candidates, bays, planning.reach(s))


#: The plan vehicle by vehicle: each row of the recursion has a tenant's free bays as a list, a depot's five days next to each other.
_PLAN_SQL = f"""WITH RECURSIVE s AS (SELECT s_suppkey AS depot, s_suppkey % 10 * 2.0::DOUBLE AS lat, s_suppkey % 7 * 2.5::DOUBLE AS lon, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
  km AS (SELECT a.depot, b.depot AS near, b.i, 2 * 6371.0::DOUBLE * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0::DOUBLE))) AS km FROM s a JOIN s b ON true),
  near AS (SELECT depot, list(i ORDER BY depot <> near, round(km, 6), near) AS options FROM km WHERE km <= 350 GROUP BY depot),
  c AS (SELECT r_name AS tenant, vehicle_id AS vehicle, c_custkey % (SELECT count(*) FROM supplier) AS home, p, p * (saving / 100) - 150.0::DOUBLE AS value, p >= 0.8 AS urgent FROM {RISK} r JOIN customer ON c_custkey = vehicle_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE rn = 1),
  w AS (SELECT c.*, row_number() OVER (PARTITION BY tenant ORDER BY urgent DESC, value DESC, vehicle) AS k, CASE WHEN urgent THEN list_transform(options, lambda d: d * 5 - 4) ELSE flatten(list_transform(options, lambda d: [d * 5 - 4, d * 5 - 3, d * 5 - 2, d * 5 - 1, d * 5])) END AS slots FROM c JOIN near ON depot = home WHERE value > 0),
  r AS (SELECT r_name AS tenant, 0::BIGINT AS k, (SELECT flatten(list([3 FOR d IN range(5)] ORDER BY i)) FROM s) AS free, 0::BIGINT AS slot FROM region
    UNION ALL SELECT tenant, k, list_transform(free, lambda n, j: n - (j = slot)::BIGINT), slot FROM (SELECT r.tenant, w.k, r.free, coalesce(list_filter(w.slots, lambda x: r.free[x] > 0)[1], 0) AS slot FROM r JOIN w ON w.tenant = r.tenant AND w.k = r.k + 1)),
  plan AS (SELECT c.tenant, c.vehicle, c.home, c.p, floor(c.value * 100 + 0.5) / 100 AS value, CASE WHEN w.k IS NOT NULL THEN c.urgent END AS urgent, s.depot, CASE WHEN slot > 0 THEN ((slot - 1) % 5 + 1)::INT END AS day, CASE WHEN w.k IS NULL THEN 'not_worth' WHEN slot > 0 THEN 'planned' WHEN c.urgent THEN 'too_risky_to_wait' ELSE 'waiting' END AS outcome
    FROM c LEFT JOIN w ON w.tenant = c.tenant AND w.vehicle = c.vehicle LEFT JOIN r ON r.tenant = w.tenant AND r.k = w.k LEFT JOIN s ON slot > 0 AND s.i = (slot - 1) // 5 + 1)"""


@query(_PLAN_SQL + " SELECT plan.*, CASE WHEN plan.depot <> home THEN home END AS moved_from, CASE WHEN plan.depot <> home THEN round(km.km) END AS km FROM plan LEFT JOIN km ON km.depot = plan.home AND km.near = plan.depot")
def greedy_service_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Plans for each tenant's candidates; depots by distance, from the supplier's number."""
    return _plan(spark, sf).withColumn("value", half_up(F.col("value"), 2))


@query(_PLAN_SQL + " SELECT tenant, count(*) FILTER (outcome = 'planned') AS planned, count(*) FILTER (outcome = 'waiting') AS waiting, count(*) FILTER (outcome = 'too_risky_to_wait') AS too_risky_to_wait, count(*) FILTER (outcome = 'not_worth') AS not_worth, count(*) FILTER (depot <> home) AS moved, floor(sum(CASE WHEN outcome = 'planned' THEN value ELSE 0 END) * 100 + 0.5) / 100 AS value FROM plan GROUP BY tenant")
def service_plan_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A tenant's plan in numbers, of values in hundredths."""
    rounded = _plan(spark, sf).withColumn("value", half_up(F.col("value"), 2))
    return planning.plan_totals(rounded).withColumn("value", half_up(F.col("value"), 2))


def _labelled_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The feature frame with the vehicle's powertrain, the part of the first error within the week, if any, and the split."""
    frame = _frame(spark, sf)
    errors = telemetry(spark, sf).where("evt = 'error'").select("vin", "ts", F.concat(F.lit("part"), (F.col("level") % 3).cast("string")).alias("component"))
    labelled = learning.first_in_horizon(frame, errors, "vin", "asof", "ts").drop("ts", "days_to")
    vehicles = table(spark, sf, "customer").select(F.col("c_custkey").alias("vin"), F.col("c_mktsegment").alias("powertrain"))
    return labelled.join(vehicles, "vin").withColumn("split", learning.split_of(F.col("vin"), F.col("asof") < F.lit("2024-01-16").cast("date")))


def _scoring_run(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    labelled = checkpointed(_labelled_frame(spark, sf))
    columns = [c for c in labelled.columns if c not in ("vin", "asof", "label", "component", "split")]
    costs = spark.createDataFrame([(f"part{i}", 900.0 + 100 * i, 300.0) for i in range(3)], "component string, breakdown_cost double, repair_cost double")
    return scoring.scoring_run(labelled, "label", columns, ["powertrain"], costs, "2024-01-30", 0.5, "v1")


@query()
def scoring_run_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One scoring run from events to scores: features, trees with nulls and categories, calibration, part, saving and the exact
    contributions that push a vehicle's odds up most. tests hold its pieces against plain versions."""
    return _scoring_run(spark, sf)[0].select("vin", F.round("p", 4).alias("p"), "component", "saving", F.transform("factors", lambda x: x["feature"]).alias("factors"))


@query()
def scoring_run_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts of the same run, from the threshold on."""
    return _scoring_run(spark, sf)[1]


@query()
def feature_gains(spark: SparkSession, sf: str) -> DataFrame:
    """The features that the trees of risk split by, by what their splits gain."""
    labelled = _labelled_frame(spark, sf).where("split in ('train', 'valid')").withColumn("held", F.col("split") == "valid")
    columns = [c for c in labelled.columns if c not in ("vin", "asof", "label", "component", "split", "held")]
    ranking = boosting.gain_ranking(boosting.fit(labelled, columns, "label", ["powertrain"], held="held", iterations=learning.TREES, patience=learning.PATIENCE))
    return spark.createDataFrame([(i + 1, c, round(g, 4)) for i, (c, g) in enumerate(ranking)], "rank int, feature string, gain double")
