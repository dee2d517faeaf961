"""Telemetry: rollups, ranges, latest values, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.numbers import half_up
from roadloom.operators import ranks
from roadloom.operators.rollups import finish, latest, merge, newest, state_columns
from roadloom.sources.tables import table, telemetry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Telemetry in SQL.
T = "(SELECT user_id AS vin, event_id AS seq, ts, event_type AS evt, value AS reading, json_extract(props, '$.k')::INT AS level FROM events) t"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r2(c: Column, digits: int = 2) -> Column:
    return half_up(c, digits)


@query(f"""SELECT vin, date_trunc('minute', ts) AS minute, count(*) AS samples, floor(avg(reading) * 100 + 0.5) / 100 AS avg_reading, max(reading) AS high, min(reading) AS low,
  arg_max(reading, (ts, seq)) AS last_reading FROM {T} GROUP BY 1, 2""")
def rollup_1m(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(spark, sf)
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")
    states = t.groupBy("vin", minute).agg(*state_columns(counts={"samples": F.lit(True)}, averages={"avg_reading": F.col("reading")}, highs={"high": F.col("reading")}, lows={"low": F.col("reading")}, lasts={"last_reading": (F.col("reading"), F.struct("ts", "seq"))}))
    return finish(states, "vin", "minute").withColumn("avg_reading", r2(F.col("avg_reading")))


@query(f"""SELECT vin, date_trunc('hour', ts) AS hour, count(*) AS samples, floor(sum(reading) / count(*) * 100 + 0.5) / 100 AS mean_reading, max(reading) AS high,
  array_to_string(list_sort(list_distinct(list(evt))), ',') AS codes FROM {T} GROUP BY 1, 2""")
def rollup_hour_states_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Hours from the states of minutes: states merge."""
    t = telemetry(spark, sf)
    minutes = t.groupBy("vin", F.date_trunc("minute", "ts").alias("minute")).agg(*state_columns(counts={"samples": F.lit(True)}, averages={"mean_reading": F.col("reading")}, highs={"high": F.col("reading")}, sets={"codes": F.array("evt")}))
    hours = merge(minutes.withColumn("hour", F.date_trunc("hour", "minute").cast("timestamp_ntz")).drop("minute"), "vin", "hour")
    return finish(hours, "vin", "hour").withColumn("mean_reading", r2(F.col("mean_reading"))).withColumn("codes", F.array_join("codes", ","))


@query(f"""SELECT t.vin, n.n_name AS fleet, r.r_name AS tenant, t.ts::DATE AS day, count(*) AS samples, max(level) - min(level) AS distance, floor(avg(reading) * 100 + 0.5) / 100 AS avg_reading,
  min(reading) AS low, max(reading) AS high, sum(level) AS codes, count(*) FILTER (evt IN ('error', 'click')) AS harsh, count(*) FILTER (evt = 'view' AND reading < 50) AS idle
  FROM {T} JOIN customer c ON c.c_custkey = t.vin JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2, 3, 4""")
def vehicle_daily_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The day of each vehicle from partial states, joined to its fleet and tenant after the aggregation."""
    t = telemetry(spark, sf)
    states = t.groupBy("vin", F.to_date("ts").alias("day")).agg(*state_columns(counts={"samples": F.lit(True), "harsh": F.col("evt").isin("error", "click"), "idle": (F.col("evt") == "view") & (F.col("reading") < 50)}, averages={"avg_reading": F.col("reading")}, lows={"low": F.col("reading"), "first": F.col("level")}, highs={"high": F.col("reading"), "last": F.col("level")}, sums={"codes": F.col("level")}))
    days = finish(merge(states, "vin", "day"), "vin", "day")
    fleet = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    fleet = fleet.select(F.col("c_custkey").alias("vin"), F.col("n_name").alias("fleet"), F.col("r_name").alias("tenant"))
    return days.join(fleet, "vin").select("vin", "fleet", "tenant", "day", "samples", (F.col("last") - F.col("first")).alias("distance"), r2(F.col("avg_reading")).alias("avg_reading"), "low", "high", "codes", "harsh", "idle")


@query(f"SELECT vin, ts::DATE AS day, array_to_string(list_sort(list_distinct(list(evt))), ',') AS codes, count(DISTINCT evt) AS n_codes FROM {T} GROUP BY 1, 2")
def rollup_distinct_codes(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(spark, sf).withColumn("day", F.to_date("ts"))
    parts = t.groupBy("vin", "day", F.hour("ts").alias("h")).agg(*state_columns(sets={"codes": F.array("evt")}))
    out = finish(merge(parts.drop("h"), "vin", "day"), "vin", "day")
    return out.select("vin", "day", F.array_join("codes", ",").alias("codes"), F.size("codes").cast("bigint").alias("n_codes"))


@query(f"SELECT vin, seq, ts, CASE WHEN seq % 3 = 0 THEN reading + 1 ELSE reading END AS reading FROM {T}")
def final_read_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """A table with a second copy of each third row, written later: the later copy replaces the earlier one."""
    t = telemetry(spark, sf).select("vin", "seq", "ts", "reading").withColumn("version", F.lit(1))
    again = t.where("seq % 3 = 0").withColumn("reading", F.col("reading") + 1).withColumn("version", F.lit(2))
    return newest(t.unionByName(again), ["vin", "ts", "seq"], "version").select("vin", "seq", "ts", "reading")


@query(f"SELECT vin, seq, ts, reading FROM {T} WHERE vin = 7 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' ORDER BY ts, seq LIMIT 20000")
def telemetry_range_raw(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(spark, sf).where("vin = 7 AND ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-12'")
    return t.select("vin", "seq", "ts", "reading").orderBy("ts", "seq").limit(20000)


@query(f"SELECT vin, max(seq) FILTER (true) AS n_seq, arg_max(seq, (ts, seq)) AS seq, max(ts) AS ts, arg_max(reading, (ts, seq)) AS reading FROM {T} GROUP BY 1")
def latest_per_vehicle(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(spark, sf).groupBy("vin").agg(F.max("seq").alias("n_seq"), F.max(F.struct("ts", "seq", "reading")).alias("last"))
    return t.select("vin", "n_seq", "last.seq", "last.ts", "last.reading")


@query(f"""SELECT c.c_custkey AS vin, c.c_mktsegment AS segment, l.ts, l.reading FROM customer c LEFT JOIN LATERAL (SELECT ts, reading FROM {T} WHERE t.vin = c.c_custkey ORDER BY ts DESC, seq DESC LIMIT 1) l ON true""")
def latest_lateral(spark: SparkSession, sf: str) -> DataFrame:
    """The latest reading of every vehicle, also of those without one: by aggregation and a left join, not row by row."""
    t = latest(telemetry(spark, sf).select("vin", "ts", "seq", "reading"), ["vin"], ["ts", "seq"])
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("vin"), F.col("c_mktsegment").alias("segment")).join(t, "vin", "left").select("vin", "segment", "ts", "reading")


@query(f"""SELECT vin, lat, lon, status FROM (SELECT vin, arg_max(level, (ts, seq)) - 50 AS lat, arg_max(reading, (ts, seq)) / 3 AS lon,
  CASE WHEN arg_max(evt, (ts, seq)) = 'error' THEN 'OFF' WHEN arg_max(reading, (ts, seq)) >= 10 THEN 'DRIVING' ELSE 'IDLING' END AS status FROM {T} GROUP BY 1)
  WHERE lat BETWEEN -40 AND 40 AND lon BETWEEN 0 AND 120 ORDER BY vin LIMIT 60000""")
def live_map_bbox(spark: SparkSession, sf: str) -> DataFrame:
    from roadloom.functions.geo import in_box

    live = _live(spark, sf)
    return live.where(in_box(F.col("lat"), F.col("lon"), -40, 0, 40, 120)).orderBy("vin").limit(60000)


def _live(spark: SparkSession, sf: str) -> DataFrame:
    t = latest(telemetry(spark, sf).select("vin", "ts", "seq", "evt", "reading", "level"), ["vin"], ["ts", "seq"])
    status = F.when(F.col("evt") == "error", "OFF").when(F.col("reading") >= 10, "DRIVING").otherwise("IDLING")
    return t.select("vin", (F.col("level") - 50).alias("lat"), (F.col("reading") / 3).alias("lon"), status.alias("status"))


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN arg_max(evt, (ts, seq)) = 'error' THEN 'OFF' WHEN arg_max(reading, (ts, seq)) >= 10 THEN 'DRIVING' ELSE 'IDLING' END AS status FROM {T} GROUP BY vin) GROUP BY 1""")
def live_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""SELECT vin, seq, ts, reading, floor(abs(reading - last) * 100 + 0.5) / 100 AS jump FROM (SELECT *, lag(reading) OVER w AS last, lag(ts) OVER w AS last_ts FROM {T} WINDOW w AS (PARTITION BY vin ORDER BY ts, seq))
  WHERE abs(reading - last) > 25 AND ts - last_ts <= INTERVAL 12 HOUR""")
def coolant_jump_lag(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("vin").orderBy("ts", "seq")
    t = telemetry(spark, sf).withColumn("last", F.lag("reading").over(w)).withColumn("last_ts", F.lag("ts").over(w))
    jump = F.abs(F.col("reading") - F.col("last"))
    return t.where((jump > 25) & (F.col("ts") - F.col("last_ts") <= F.expr("INTERVAL 12 HOUR"))).select("vin", "seq", "ts", "reading", r2(jump).alias("jump"))


def episodes(t: DataFrame, key: str, order: list[str], held: Column, gap: str) -> DataFrame:
    """(key, start, end, n): runs of rows for which the condition holds, broken by a row for which it does not and by a gap in
    time longer than the interval."""
    w = Window.partitionBy(key).orderBy(*order)
    held = F.coalesce(held, F.lit(False))
    marked = t.select(key, *order, held.alias("_held"), (~F.coalesce(F.lag(held).over(w), F.lit(False)) | (F.col(order[0]) - F.lag(order[0]).over(w) > F.expr(f"INTERVAL {gap}"))).alias("_fresh"))
    numbered = marked.withColumn("_run", F.sum((F.col("_held") & F.col("_fresh")).cast("int")).over(w)).where("_held")
    return numbered.groupBy(key, "_run").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count("*").alias("n")).drop("_run")


@query(f"""SELECT vin, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY vin ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, reading > 60 AND (NOT coalesce(lag(reading > 60) OVER w, false) OR ts - lag(ts) OVER w > INTERVAL 12 HOUR) AS fresh FROM {T} WINDOW w AS (PARTITION BY vin ORDER BY ts, seq)))
  WHERE reading > 60 GROUP BY vin, run HAVING count(*) > 1""")
def episodes_gaps_islands(spark: SparkSession, sf: str) -> DataFrame:
    return episodes(telemetry(spark, sf), "vin", ["ts", "seq"], F.col("reading") > 60, "12 HOUR").where("n > 1")


@query(f"""SELECT vin, ts, first_ts FROM (SELECT vin, ts, lag(ts, 4) OVER (PARTITION BY vin ORDER BY ts, seq) AS first_ts FROM {T} WHERE evt IN ('error', 'click')) WHERE ts - first_ts <= INTERVAL 36 HOUR""")
def harsh_five_in_window(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("vin").orderBy("ts", "seq")
    t = telemetry(spark, sf).where(F.col("evt").isin("error", "click")).select("vin", "ts", F.lag("ts", 4).over(w).alias("first_ts"))
    return t.where(F.col("ts") - F.col("first_ts") <= F.expr("INTERVAL 36 HOUR"))


@query(f"""SELECT coalesce(a.evt, b.evt) AS evt, coalesce(sent, 0) AS sent, coalesce(stored, 0) AS stored, coalesce(sent, 0) - coalesce(stored, 0) AS missing, coalesce(minutes, 0) AS minutes
  FROM (SELECT evt, count(*) AS sent FROM {T} WHERE seq > 100 GROUP BY 1) a FULL JOIN (SELECT evt, count(DISTINCT (vin, seq)) AS stored, count(DISTINCT date_trunc('minute', ts)) AS minutes FROM {T} WHERE seq > 100 AND evt <> 'view' GROUP BY 1) b ON a.evt = b.evt""")
def reconcile_sent_stored(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(spark, sf).where("seq > 100")
    sent = t.groupBy("evt").agg(F.count("*").alias("sent"))
    stored = t.where("evt <> 'view'").groupBy("evt").agg(F.countDistinct("vin", "seq").alias("stored"), F.countDistinct(F.date_trunc("minute", "ts")).alias("minutes"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return sent.join(stored, "evt", "full_outer").select("evt", z("sent").alias("sent"), z("stored").alias("stored"), (z("sent") - z("stored")).alias("missing"), z("minutes").alias("minutes"))


@query()
def sampled_hash(spark: SparkSession, sf: str) -> DataFrame:
    from roadloom.functions.hashing import sampled

    return telemetry(spark, sf).where(sampled(20, "vin", "seq")).select("vin", "seq", "reading")


@query(f"SELECT CASE WHEN c.c_custkey IS NULL THEN 'unregistered_vin' ELSE 'stored' END AS outcome, count(*) AS n FROM {T} LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 3) c ON c.c_custkey = t.vin GROUP BY 1")
def unmapped_enrichment_counts(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("vin"), F.lit(True).alias("known"))
    t = telemetry(spark, sf).select("vin").join(known, "vin", "left")
    return t.groupBy(F.when(F.col("known"), "stored").otherwise("unregistered_vin").alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""SELECT evt, quantile_cont(reading, 0.5) AS median, quantile_cont(reading, 0.95) AS p95_interpolated FROM {T} GROUP BY 1""")
def median_by_group(spark: SparkSession, sf: str) -> DataFrame:
    q = ranks.quantiles(telemetry(spark, sf).select("evt", "reading"), "reading", [0.5, 0.95], ["evt"])
    return q.select("evt", F.get("q", F.lit(0)).alias("median"), F.get("q", F.lit(1)).alias("p95_interpolated"))


@query(f"""WITH r AS (SELECT evt, reading, row_number() OVER (PARTITION BY evt ORDER BY reading) - 1 AS i, count(*) OVER (PARTITION BY evt) AS n FROM {T})
  SELECT evt, max(reading) FILTER (i = round_even(0.5 * (n - 1), 0)) AS p50, max(reading) FILTER (i = round_even(0.95 * (n - 1), 0)) AS p95, max(reading) FILTER (i = round_even(0.99 * (n - 1), 0)) AS p99 FROM r GROUP BY 1""")
def p95_latency_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest rank: the reading at place round(p (n - 1)), halves to the even one, from counts of equal readings."""
    counts = telemetry(spark, sf).groupBy("evt", "reading").agg(F.count("*").alias("c"))
    ranked = ranks.placed(counts, ["reading"], ["evt"], "c").join(counts.groupBy("evt").agg(F.sum("c").alias("n")), "evt")
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(p * (F.col("n") - 1)), F.col("reading")))
    return ranked.groupBy("evt").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query(f"""SELECT evt, max(ts) AS checked_at, max(reading) AS highest FROM {T} WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1""")
def drift_recent_max(spark: SparkSession, sf: str) -> DataFrame:
    """The newest time is a scalar subquery, so that the filter reaches the scan."""
    t = telemetry(spark, sf).select("evt", "ts", "reading")
    newest = t.select(F.max("ts").alias("m")).scalar()
    return t.where(F.col("ts") > newest - F.expr("INTERVAL 24 HOUR")).groupBy("evt").agg(F.max("ts").alias("checked_at"), F.max("reading").alias("highest"))


@query(f"""SELECT vin, ts::DATE AS day, sum(n) OVER (PARTITION BY vin ORDER BY day_no RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)::BIGINT AS n_7d, sum(n) OVER (PARTITION BY vin ORDER BY day_no RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS n_3d,
  coalesce(sum(n) OVER (PARTITION BY vin ORDER BY day_no RANGE BETWEEN 6 PRECEDING AND 3 PRECEDING), 0)::BIGINT AS n_prior FROM (SELECT vin, ts::DATE AS ts, date_diff('day', DATE '2024-01-01', ts::DATE) AS day_no, count(*) AS n FROM {T} GROUP BY 1, 2, 3)""")
def rolling_windows(spark: SparkSession, sf: str) -> DataFrame:
    day_no = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    d = telemetry(spark, sf).groupBy("vin", F.to_date("ts").alias("day"), day_no.alias("day_no")).agg(F.count("*").alias("n"))
    w = lambda a, b: Window.partitionBy("vin").orderBy("day_no").rangeBetween(a, b)
    return d.select("vin", "day", F.sum("n").over(w(-6, 0)).alias("n_7d"), F.sum("n").over(w(-2, 0)).alias("n_3d"), F.coalesce(F.sum("n").over(w(-6, -3)), F.lit(0)).alias("n_prior"))


@query("SELECT day, rank FROM (SELECT ts::DATE AS day, row_number() OVER (ORDER BY ts::DATE) - 1 AS rank, count(*) OVER () AS n FROM (SELECT DISTINCT ts::DATE AS ts FROM events)) WHERE rank >= 6 AND rank < n - 8")
def asof_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The days for which features and labels are whole: from the seventh day on, and eight days before the last."""
    days = telemetry(spark, sf).select(F.to_date("ts").alias("day")).distinct()
    bounds = days.agg(F.sort_array(F.collect_set("day")).alias("days"))  # one entry a day
    return bounds.select(F.posexplode("days").alias("rank", "day"), F.size("days").alias("n")).where("rank >= 6 AND rank < n - 8").select("day", F.col("rank").cast("bigint").alias("rank"))


@query(f"""SELECT vin, max((evt = 'error')::INT) AS has_error, max((evt = 'click')::INT) AS has_click, max((evt = 'purchase')::INT) AS has_purchase FROM {T} GROUP BY 1""")
def array_flag_columns(spark: SparkSession, sf: str) -> DataFrame:
    codes = telemetry(spark, sf).groupBy("vin").agg(F.collect_set("evt").alias("codes"))
    return codes.select("vin", *[F.array_contains("codes", c).cast("int").alias(f"has_{c}") for c in ("error", "click", "purchase")])
