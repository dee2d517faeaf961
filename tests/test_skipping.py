"""Files that a read doesn't open: counted, and never one that has a row."""

import datetime
import random

from pyspark.sql import functions as F

from roadloom.sources import skipping


def day(d):
    return datetime.date(2024, 1, d)


def test_only_files_that_can_have_rows_are_read(spark, tmp_path):
    r, folder, index = random.Random(2), f"{tmp_path}/t", f"{tmp_path}/index"
    rows = [(day(d), r.randrange(100_000), i) for d in range(1, 11) for i in range(300)] + [(day(3), None, -1), (day(4), 77, -2)]
    df = spark.createDataFrame(rows, "day date, vin long, i int")
    df.repartition(4, F.xxhash64("vin")).write.partitionBy("day").parquet(folder)
    table = skipping.refreshed(spark, folder, index, "day", "vin")
    whole = spark.read.parquet(folder).inputFiles()
    assert len(whole) >= 40
    wanted = [rows[5][1], rows[2000][1], 77, 123_456_789]
    got = skipping.read_with(spark, folder, table, "day", "vin", day(3), day(9), wanted)
    want = sorted(x[2] for x in rows if day(3) <= x[0] < day(9) and x[1] in wanted)
    assert sorted(x.i for x in got.collect()) == want and -2 in want
    opened = skipping.files_with(table, day(3), day(9), wanted)
    assert len(opened) <= 6 and len(skipping.files_with(table, day(3), day(5))) == sum("day=2024-01-03" in f or "day=2024-01-04" in f for f in whole)
    assert set(got.inputFiles()) == set(opened)
    for k in {x[1] for x in r.sample(rows, 40) if x[1] is not None}:  # none is missed
        assert sorted(x.i for x in skipping.read_with(spark, folder, table, "day", "vin", keys=[k]).collect()) == sorted(x[2] for x in rows if x[1] == k)


def test_new_files_are_added_and_lost_ones_left_out(spark, tmp_path):
    folder, index = f"{tmp_path}/t", f"{tmp_path}/index"
    write = lambda d, vins: spark.createDataFrame([(day(d), v) for v in vins], "day date, vin long").coalesce(1).write.mode("append").partitionBy("day").parquet(folder)
    write(1, range(50))
    assert {x.n for x in skipping.refreshed(spark, folder, index, "day", "vin").collect()} == {50}
    write(2, range(100_000, 140_000))  # so many keys take several bitmaps
    table = skipping.refreshed(spark, folder, index, "day", "vin")
    assert table.select("file").distinct().count() == 2 and table.agg(F.max("maps")).first()[0] > 5
    assert skipping.read_with(spark, folder, table, "day", "vin", keys=[100_007, 139_999, 7]).count() == 3
    assert len(skipping.files_with(table, keys=[100_007])) == 1 and len(skipping.files_with(table, keys=["absent"])) == 0
    hits = [len(skipping.files_with(table, keys=[139_999 * 10 + i])) for i in range(3)]
    assert hits == [0, 0, 0] or sum(hits) <= 1
