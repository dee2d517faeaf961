"""Mappings that change between two batches of events."""

import json

from pyspark.sql import functions as F

from roadloom.operators import normalize
from roadloom.streaming import mappings, sinks

FIELDS = {"vin": {"path": "v"}, "seq": {"path": "n"}, "ts": {"path": "t", "transform": "epoch_ms"}, "lat": {"path": "a"}, "lon": {"path": "o"}}
VIN = "1HGCM82633A004352"


def spec(version, path="speed", oem="AUR", **more):
    return {"oem": oem, "version": version, "fields": {**FIELDS, "speed_kmh": {"path": path, "transform": "number"}}, **more}


def records(spark, *rows):
    return spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v), i) for i, (k, v) in enumerate(rows)], "key string, value string, offset int")


def test_an_event_takes_the_version_in_force(spark, tmp_path):
    table = mappings.Mappings(f"{tmp_path}/mappings")
    assert table.in_force(spark) == {}
    raw = lambda n: json.dumps({"v": VIN, "n": n, "t": 1704067200000, "a": 1.5, "o": 2, "speed": 10, "v2": 70})

    def events(n):
        spark.createDataFrame([("aur", raw(n)), ("bor", raw(n))], "oem string, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")

    def run():
        stream = spark.readStream.schema("oem string, value string").parquet(f"{tmp_path}/events")
        keep = sinks.batch_files(f"{tmp_path}/out", lambda df: df.select("oem", F.col("event.seq").alias("seq"), F.col("event.speed_kmh").alias("speed"), "reason"))
        sinks.run_to_end(stream, mappings.normalised(table, keep, lambda _: F.lit("2024-01-01 00:01:00").cast("timestamp")), f"{tmp_path}/marks")

    table.take(records(spark, ("AUR", spec(1))), 0)
    events(1)
    run()
    changes = records(spark, ("aur", spec(3, "v2")), ("AUR", spec(2)), ("AUR", "{broken"), ("AUR", None), ("AUR", spec(9, oem="BOR")), ("AUR", spec(9, "no[path")), ("AUR", "[1]"))
    for _ in range(2):  # the batch runs again
        table.take(changes, 1)
    assert {m: s["version"] for m, s in table.in_force(spark).items()} == {"AUR": 3}
    events(2)
    run()
    table.take(records(spark, ("BOR", spec(1, oem="BOR"))), 2)
    events(3)
    run()
    got = {(r.oem, r.seq): (r.speed, r.reason) for r in sinks.read_batches(spark, f"{tmp_path}/out").collect()}
    assert got[("aur", 1)] == (10.0, None) and got[("aur", 2)] == (70.0, None) and got[("aur", 3)] == (70.0, None) and got[("bor", 3)] == (10.0, None)
    assert sinks.read_batches(spark, f"{tmp_path}/out").where("reason = 'UNMAPPED_OEM'").count() == 2
    assert normalize.check_mapping(spec(4), 3)
