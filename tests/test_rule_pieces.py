"""Alerts of histories in pieces against the plain fold of each vehicle's events."""

import datetime
import random

import pytest

from roadloom.streaming import rules

START = datetime.datetime(2024, 1, 1)
SCHEMA = "vin string, n long, ts timestamp, engine_on boolean, speed_kmh double, fuel_pct double, soc_pct double, coolant_c double, batt_v double, dtc array<string>, evt string, lat double, lon double"


def history(seed, n):
    """One vehicle has a third of all events; some stand still for hours, some events come late or at the same time, some without values."""
    r, rows, clock = random.Random(seed), [], {}
    for i in range(n):
        v = r.choice(["hot", "a", "b", *("cdefgh" if seed % 2 else "")]) if r.random() > 0.33 else "hot"
        pause = 4 * 3600 if r.random() < 0.01 else r.choice([5, 20, 20, 60])
        clock[v] = clock.get(v, 0) + pause
        at = clock[v] - (r.choice([30, 3600]) if r.random() < 0.05 else 0)
        maybe = lambda x: None if r.random() < 0.05 else x
        still = clock[v] // 1500 % 2 == 0
        rows.append((v, i, START + datetime.timedelta(seconds=at), maybe(True), maybe(0.0 if still else 60.0), maybe(50.0) if v != "a" else None, maybe(r.choice([5.0, 50.0])), maybe(r.choice([90.0, 95.0, 112.0, 113.0, 130.0])), maybe(r.choice([11.5, 12.6])), ["P0217"] if r.random() < 0.02 else [], "HARSH_BRAKE" if r.random() < 0.2 else "SAMPLE", 1.0, None))
    return rows


def fold(rows):
    out, names = [], [c.split()[0] for c in SCHEMA.split(", ")]
    for v in {x[0] for x in rows}:
        state = rules.State()
        for row in sorted((x for x in rows if x[0] == v), key=lambda x: x[1]):
            e = dict(zip(names, row, strict=True))
            out += rules.step(state, {**e, "ts": int((e["ts"] - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)})
    return sorted(tuple(x.values()) for x in out)


@pytest.mark.parametrize("seed,piece", [(1, 7), (2, 60), (3, 100_000)])
def test_pieces_give_the_alerts_of_the_whole(spark, seed, piece):
    rows = history(seed, 900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = rules.batch_alerts(df, ["n"], piece_events=piece)
    want = fold(rows)
    assert sorted((r.dedup_key, r.vin, r.rule, r.severity, r.opened_at, r.at, r.details) for r in got.collect()) == want
    assert len({x[2] for x in want}) >= 5


def test_many_vehicles_cost_no_more_than_their_events(spark, monkeypatch):
    """A task goes through its rows once: no call of a function for each vehicle, whose cost would outweigh its few events."""
    rows = [(f"v{i % 300}", i, START + datetime.timedelta(seconds=20 * i), True, 60.0, 50.0, float("nan") if i % 2 else 5.0, 112.0, 12.6, [], "HARSH_BRAKE", 1.0, None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    calls = []
    monkeypatch.setattr(type(df.groupBy("vin").cogroup(df.groupBy("vin"))), "applyInPandas", lambda *a: calls.append(a))
    got = rules.batch_alerts(df, ["n"])
    assert sorted((r.dedup_key, r.at) for r in got.collect()) == sorted((x[0], x[5]) for x in fold([tuple(None if v != v else v for v in row) for row in rows])) and not calls


def test_stream_in_buckets(spark, tmp_path):
    """Vehicles that share a bucket keep their own states from one micro-batch to the next."""
    rows = history(5, 600)
    for part in (0, 1):
        spark.createDataFrame(rows[300 * part : 300 * part + 300], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = []
    rules_ = rules.stream_alerts(stream, ["n"], buckets=2)
    rules_.writeStream.foreachBatch(lambda b, i: got.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.dedup_key, r.vin, r.rule, r.severity, r.opened_at, r.at, r.details) for r in got) == fold(rows)


def test_no_piece_is_larger_than_stated(spark):
    rows = history(4, 600)
    ready = rules._pieces(rules._ready(spark.createDataFrame(rows, SCHEMA)), ["n"], 50)
    sizes = {(r.vin, r.piece): r["count"] for r in ready.groupBy("vin", "piece").count().collect()}
    assert max(sizes.values()) <= 50 and sum(sizes.values()) == 600 and sum(v == "hot" for v, _ in sizes) > 4
    assert rules.batch_alerts(spark.createDataFrame([], SCHEMA), ["n"]).count() == 0


def test_after_a_long_pause_nothing_is_left():
    state = rules.State(last=5, held={"ENGINE_OVERHEAT": [1, True]}, coolant=80.0, coolant_at=5, jump_at=5, jumps=2, suspect_until=9, harsh=[4], raised={"LOW_12V_BATTERY": 5})
    assert rules.settled(state, 5 + 6 * rules.HOUR, rules.Limits()) == rules.State() == rules.settled(state, None, rules.Limits())
    assert rules.settled(state, 5, rules.Limits()) == state
