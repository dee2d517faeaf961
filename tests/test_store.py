"""The store of latest rows: late rows, equal versions, batches that run again, and what is rewritten."""

import random

from roadloom.sources import tables
from roadloom.streaming.store import LatestStore

SCHEMA = "k long, version int, value string"


def plain(batches):
    out = {}
    for batch in batches:
        for k in {r[0] for r in batch}:
            own = [r for r in batch if r[0] == k and r[1] is not None]
            if own:
                v, x = max((r[1], r[2]) for r in own)
                if k not in out or v > out[k][0]:
                    out[k] = (v, x)
    return out


def state(spark, store):
    rows = store.read(spark)
    return {r.k: (r.version, r.value) for r in rows.collect()} if rows is not None else {}


def test_newer_wins_and_batches_run_again(spark, tmp_path):
    r, store = random.Random(1), LatestStore(f"{tmp_path}/s", ["k"], "version", buckets=8)
    assert store.read(spark) is None
    batches = [[(r.randrange(60), r.choice([None, *range(12)]), f"{b}-{i}") for i in range(80)] for b in range(4)]
    for b, batch in enumerate(batches):
        for _ in range(2 if b == 2 else 1):
            store.write(spark.createDataFrame(batch, SCHEMA), b)
        assert state(spark, store) == plain(batches[: b + 1])
    store.write(spark.createDataFrame([], SCHEMA), 4)
    assert state(spark, store) == plain(batches)
    assert store.vacuum(spark) == [] or state(spark, store) == plain(batches)


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    store = LatestStore(f"{tmp_path}/s", ["k"], "version", buckets=32)
    store.write(spark.createDataFrame([(k, 1, "a") for k in range(2000)], SCHEMA), 0)
    store.write(spark.createDataFrame([(7, 2, "b"), (7, 1, "late"), (9, 1, "equal")], SCHEMA), 1)
    whole, few = (len(tables.folders(spark, f"{tmp_path}/s/data/batch={b}")) for b in (0, 1))
    assert whole == 32 and few <= 2
    got = state(spark, store)
    assert len(got) == 2000 and got[7] == (2, "b") and got[9] == (1, "a")
    assert store.vacuum(spark) == [] and tables.folders(spark, f"{tmp_path}/s/manifest") == ["batch=1"]  # the first batch's other buckets are in force


def test_a_batch_without_a_manifest_is_not_there(spark, tmp_path):
    """A crash between the rows and the manifest: readers see the batch before, and the batch that runs again leaves one copy."""
    store = LatestStore(f"{tmp_path}/s", ["k"], "version", buckets=4)
    first, second = [(k, 1, "a") for k in range(20)], [(k, 2, "b") for k in range(0, 20, 2)]
    store.write(spark.createDataFrame(first, SCHEMA), 0)
    store.write(spark.createDataFrame(second, SCHEMA), 1)
    tables.removed(spark, f"{tmp_path}/s/manifest/batch=1/_SUCCESS")
    assert state(spark, store) == plain([first])
    store.write(spark.createDataFrame(second, SCHEMA), 1)
    assert state(spark, store) == plain([first, second])
