"""Streams to their end: rollups, dedup and rules over a folder of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions.numbers import half_up
from roadloom.operators import chains
from roadloom.operators.rollups import finish, merge, state_columns
from roadloom.plans.telemetry import T
from roadloom.sources.tables import shared_folder, table, telemetry
from roadloom.streaming import dedup, rules, sinks, store

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream's files, in the shared place that the session names."""
    return shared_folder(spark, "streams", name)


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/events*.parquet")
    level = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("vin"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("evt"), F.col("value").alias("reading"), level.alias("level"))


@query(f"SELECT vin, ts::DATE AS day, count(*) AS samples, max(reading) AS high, floor(avg(reading) * 100 + 0.5) / 100 AS mean_reading FROM {T} GROUP BY 1, 2")
def stream_rollup_available_now(spark: SparkSession, sf: str) -> DataFrame:
    """States of each micro-batch below its number, merged when they are read."""
    out, marks = folder(spark, "rollup"), folder(spark, "rollup-marks")
    states = lambda b: b.groupBy("vin", F.to_date("ts").alias("day")).agg(*state_columns(counts={"samples": F.lit(True)}, averages={"mean_reading": F.col("reading")}, highs={"high": F.col("reading")}))
    sinks.run_to_end(event_stream(spark, sf), sinks.batch_files(out, states), marks)
    done = finish(merge(sinks.read_batches(spark, out), "vin", "day"), "vin", "day")
    return done.select("vin", "day", "samples", "high", half_up(F.col("mean_reading"), 2).alias("mean_reading"))


@query(f"SELECT vin, count(*) AS n, count(DISTINCT seq) AS distinct_n FROM {T} GROUP BY 1")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each event sent twice in a row, taken once."""
    out, marks = folder(spark, "dedup"), folder(spark, "dedup-marks")
    twice = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    sinks.run_to_end(dedup.stream_dedup(twice, "vin", "seq", ["ts", "seq", "copy"]), sinks.batch_files(out), marks)
    return sinks.read_batches(spark, out).groupBy("vin").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("distinct_n"))


@query(f"SELECT vin, ts::DATE AS day, count(*) AS n FROM {T} GROUP BY 1, 2")
def stream_windows_by_event_time(spark: SparkSession, sf: str) -> DataFrame:
    """Days by the events' own time with a watermark. Counts come out as they grow, and the delay is longer than the data, so no event is
    too late; of each day the last count is read."""
    out, marks = folder(spark, "windows"), folder(spark, "windows-marks")
    days = sinks.keyed_by_time(event_stream(spark, sf), "ts", "40 days").groupBy("vin", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    stream = days.select("vin", F.to_date("w.start").alias("day"), "n")
    run = stream.writeStream.outputMode("update").foreachBatch(sinks.batch_files(out)).option("checkpointLocation", marks).trigger(availableNow=True).start()
    run.awaitTermination()
    return sinks.read_batches(spark, out).groupBy("vin", "day").agg(F.max("n").alias("n"))  # counts only go up


@query(f"SELECT DISTINCT ON (vin) vin, evt, reading, seq FROM {T} ORDER BY vin, ts DESC, seq DESC")
def stream_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """Each vehicle's last event, kept by a stream: a batch rewrites only the buckets of its vehicles, and only what is newer wins."""
    kept = store.LatestStore(folder(spark, "latest"), ["vin"], "at", buckets=16)
    sinks.run_to_end(event_stream(spark, sf), store.sink(kept, lambda b: b.select("vin", F.struct("ts", "seq").alias("at"), "evt", "reading")), folder(spark, "latest-marks"))
    return kept.read(spark).select("vin", "evt", "reading", F.col("at.seq").alias("seq"))


#: Events are hours apart, so times are stretched.
LIMITS = rules.Limits(stretch=360, overheat_c=60.0, critical=("PURCHASE",), harsh=("click", "error"))


def as_canonical(t: DataFrame) -> DataFrame:
    dtc = F.when(F.col("reading") > 150, F.array(F.upper("evt"))).otherwise(F.array().cast("array<string>"))
    nothing = F.lit(None).cast("double")
    return t.select("vin", "seq", F.col("ts").cast("timestamp").alias("ts"), (F.col("evt") != "view").alias("engine_on"), (F.col("level") % 30 / 10.0).alias("speed_kmh"), nothing.alias("fuel_pct"), F.col("level").cast("double").alias("soc_pct"), F.col("reading").alias("coolant_c"), (F.col("level") % 20 * 1.0).alias("batt_v"), dtc.alias("dtc"), "evt", F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"))


@query()
def rule_engine_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.batch_alerts(as_canonical(telemetry(spark, sf)), ["ts", "seq"], LIMITS)


@query()
def stream_rules(spark: SparkSession, sf: str) -> DataFrame:
    out, marks = folder(spark, "rules"), folder(spark, "rules-marks")
    sinks.run_to_end(rules.stream_alerts(as_canonical(event_stream(spark, sf)), ["ts", "seq"], LIMITS), sinks.ignore_known(out, "dedup_key", F.to_date(F.timestamp_millis("opened_at"))), marks)
    return sinks.read_batches(spark, out)


@query(f"""WITH RECURSIVE e AS (SELECT vin, ts, seq, row_number() OVER (PARTITION BY vin ORDER BY ts, seq) AS i FROM {T} WHERE evt = 'error'),
  r AS (SELECT vin, i, ts AS fired, true AS fires FROM e WHERE i = 1 UNION ALL SELECT e.vin, e.i, CASE WHEN e.ts - r.fired >= INTERVAL 72 HOUR THEN e.ts ELSE r.fired END, e.ts - r.fired >= INTERVAL 72 HOUR FROM r JOIN e ON e.vin = r.vin AND e.i = r.i + 1)
  SELECT vin, fired FROM r WHERE fires""")
def cooldown_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """One firing, then quiet for three days of the vehicle's own time."""
    return chains.cooldown(telemetry(spark, sf).where("evt = 'error'"), "vin", "ts", "seq", 3 * chains.DAY).select("vin", F.col("ts").alias("fired"))


@query(f"""WITH RECURSIVE e AS (SELECT vin, ts, row_number() OVER w AS i, lag(ts, 4) OVER w AS first FROM {T} WHERE evt IN ('error', 'click') WINDOW w AS (PARTITION BY vin ORDER BY ts, seq)),
  r AS (SELECT vin, i, 0::BIGINT AS fired, first, ts, false AS fires FROM e WHERE i = 1
    UNION ALL SELECT vin, i, CASE WHEN fires THEN i ELSE fired END, first, ts, fires FROM (SELECT e.vin, e.i, r.fired, e.first, e.ts, e.i - r.fired >= 5 AND e.ts - e.first <= INTERVAL 36 HOUR AS fires FROM r JOIN e ON e.vin = r.vin AND e.i = r.i + 1))
  SELECT vin, first, ts FROM r WHERE fires""")
def harsh_five_with_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Five harsh events within 36 hours; those of a firing count for no other."""
    return chains.n_in_window(telemetry(spark, sf).where(F.col("evt").isin("error", "click")), "vin", "ts", "seq", 5, 36 * 3_600_000_000)
