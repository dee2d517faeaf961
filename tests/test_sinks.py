"""What an insert-ignore sink hands on, and how long after its time a row is stored."""

from pyspark.sql import functions as F

from roadloom.streaming import sinks

SCHEMA = "k string, at long"


def test_only_inserted_rows_are_handed_on(spark, tmp_path):
    told = []
    hand_on = lambda rows, number: told.append((number, sorted(r.k for r in rows.collect())))
    for day in (None, F.to_date(F.timestamp_millis("at"))):
        told.clear()
        sink = sinks.ignore_known(f"{tmp_path}/{day is None}", "k", day, hand_on)
        for number, keys in ((0, "aab"), (1, "bc"), (1, "bc"), (2, "a"), (3, "")):
            sink(spark.createDataFrame([(k, 1_704_067_200_000) for k in keys], SCHEMA), number)
        assert told == [(0, ["a", "b"]), (1, ["c"]), (1, ["c"]), (2, []), (3, [])]
        assert sorted(r.k for r in sinks.read_batches(spark, f"{tmp_path}/{day is None}").collect()) == ["a", "b", "c"]


def test_latency(spark):
    rows = spark.createDataFrame([("a", 1_000), ("b", 2_000), ("c", 99_000), ("d", None)], SCHEMA)
    assert tuple(sinks.stored_after(rows, "at", F.lit(63_000)).first()) == (3, 61_000.0, 61_900.0, 2)
    assert sinks.stored_after(rows.limit(0), "at").first().n == 0
