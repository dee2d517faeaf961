"""State changes, service plans, scores on disk and the checks of a model, against plain versions."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions.text import json_strings, suspicious_in_json
from roadloom.operators import boosting, learning, normalize, planning, ranks, scoring, states
from roadloom.plans import service
from roadloom.sources import tables

T = datetime.datetime(2024, 1, 1)


def test_alert_requests_in_order(spark):
    alerts = spark.createDataFrame([(1, "OPEN", None, None), (2, "ACKNOWLEDGED", "zoe", None), (3, "RESOLVED", "zoe", T), (4, "OPEN", None, None)], "id long, status string, acknowledged_by string, resolved_at timestamp")
    asks = [(10, 1, "ACKNOWLEDGED", 1, "ann"), (11, 1, "ACKNOWLEDGED", 1, "bob"), (12, 1, "RESOLVED", 2, "bob"), (13, 2, "RESOLVED", 1, "bob"), (14, 3, "RESOLVED", 1, "bob"), (15, 9, "RESOLVED", 1, "bob"), (16, 4, "OPEN", 1, "bob"), (17, None, "RESOLVED", 1, "x")]
    requests = spark.createDataFrame([(r, i, to, T + datetime.timedelta(hours=h), by) for r, i, to, h, by in asks], "request long, id long, to string, at timestamp, by string")
    out, verdicts = states.alert_transitions(alerts, requests)
    assert {r.request: r.outcome for r in verdicts.collect()} == {10: "done", 11: "conflict", 12: "done", 13: "done", 14: "conflict", 15: "not_found", 16: "conflict", 17: "not_found"}
    got = {r.id: (r.status, r.acknowledged_by, r.resolved_at) for r in out.collect()}
    assert got == {1: ("RESOLVED", "ann", T + datetime.timedelta(hours=2)), 2: ("RESOLVED", "zoe", T + datetime.timedelta(hours=1)), 3: ("RESOLVED", "zoe", T), 4: ("OPEN", None, None)}


def test_plans_are_booked_whole_or_not(spark):
    proposals = spark.createDataFrame([(1, "PROPOSED"), (2, "PROPOSED"), (3, "PROPOSED"), (4, "REJECTED"), (5, "PROPOSED")], "id long, status string")
    decisions = spark.createDataFrame([(1, True, "ann", T), (1, False, "bob", T + datetime.timedelta(1)), (2, True, "ann", T), (3, False, "ann", T), (4, True, "ann", T)], "id long, approve boolean, by string, at timestamp")
    items = spark.createDataFrame([(1, 1, 7, None), (1, 2, 8, None), (2, 1, 9, None), (2, 2, 10, "over_capacity"), (3, 1, 11, None)], "id long, item int, vehicle long, reason string")
    out, bookings = states.decided_proposals(proposals, decisions, items)
    assert {r.id: (r.status, r.error, r.bookings) for r in out.collect()} == {1: ("EXECUTED", None, 2), 2: ("FAILED", "over_capacity", None), 3: ("REJECTED", None, None), 4: ("REJECTED", None, None), 5: ("PROPOSED", None, None)}
    assert sorted(r.vehicle for r in bookings.collect()) == [7, 8]


def plain_plan(candidates, bays, near, days, urgent):
    """One vehicle after the other, over whole tenants."""
    free = {(t, d, day): n for t, d, day, n in bays}
    options = {}
    for d, n, km, rank in sorted(near, key=lambda r: r[3]):
        options.setdefault(d, []).append((n, km))
    out = {}
    line = sorted(candidates, key=lambda c: (c[0], c[3] < urgent, -c[4], c[1]))
    for t, v, home, p, value in line:
        if value <= 0 or home not in options:
            out[v] = ("not_worth", None, None, None)
            continue
        tries = [(d, 1) for d, _ in options[home]] if p >= urgent else [(d, day) for d, _ in options[home] for day in range(1, days + 1)]
        hit = next((x for x in tries if free.get((t, *x), 0) > 0), None)
        if hit is None:
            out[v] = ("too_risky_to_wait" if p >= urgent else "waiting", None, None, None)
        else:
            free[(t, *hit)] -= 1
            out[v] = ("planned", *hit, home if hit[0] != home else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_service_plan(spark, seed):
    r = random.Random(seed)
    depots = [(d, d % 4 * 2.0, d // 4 * 9.0) for d in range(12)]
    near = [tuple(x) for x in planning.nearby(spark.createDataFrame(depots, "depot long, lat double, lon double")).select("depot", "near", "km", "rank").collect()]
    candidates = [(f"t{v % 3}", v, r.randrange(14), round(r.random(), 3), float(r.randrange(-3, 30))) for v in range(300)]
    bays = [(f"t{t}", d, day, r.randrange(3)) for t in range(3) for d in range(10) for day in range(1, 4)]
    plan = planning.service_plan(spark.createDataFrame(candidates, "tenant string, vehicle long, home long, p double, value double"), spark.createDataFrame(bays, "tenant string, depot long, day int, free int"), spark.createDataFrame(near, "depot long, near long, km double, rank int"), days=3, urgent=0.8)
    got = {x.vehicle: (x.outcome, x.depot, x.day, x.moved_from) for x in plan.collect()}
    assert got == plain_plan(candidates, bays, near, 3, 0.8)
    totals = {x.tenant: x for x in planning.plan_totals(plan).collect()}
    assert sum(x.planned + x.waiting + x.too_risky_to_wait + x.not_worth for x in totals.values()) == 300
    assert all((x.km is None) == (x.moved_from is None) for x in plan.collect())


def test_service_plan_of_crowded_places(spark, monkeypatch):
    """Depots of one place share a list: the same plan as one by one, without pairs of depots, and refused vehicles, however many a
    home has, are dealt along the list at once instead of three a round."""
    written, real = [], planning.checkpointed
    monkeypatch.setattr(planning, "checkpointed", lambda df: written.append(df.columns) or real(df))
    r = random.Random(7)
    depots = spark.createDataFrame([(d, d % 2 * 2.0, 0.0) for d in range(80)] + [(80, 70.0, 179.5), (81, 70.0, -179.5)], "depot long, lat double, lon double")
    near = [tuple(x) for x in planning.nearby(depots).select("depot", "near", "km", "rank").collect()]
    assert len(near) == 80 * 80 + 4 and len({(d, n) for d, n, _, _ in near}) == len(near)
    candidates = [(f"t{v % 2}", v, home, 0.9 if home % 3 else 0.2, float(home % 23)) for v, home in enumerate([h for h in (1, 2, 4, 5, 9, 11, 14, 30, 41) for _ in range(40)] + [80, 81, r.randrange(80)] * 9)]
    bays = [(f"t{t}", d, day, d % 3) for t in range(2) for d in range(82) for day in range(1, 4)]
    written.clear()
    plan = planning.service_plan(spark.createDataFrame(candidates, "tenant string, vehicle long, home long, p double, value double"), spark.createDataFrame(bays, "tenant string, depot long, day int, free int"), planning.reach(depots), days=3, urgent=0.8)
    got = {x.vehicle: (x.outcome, x.depot, x.day, x.moved_from) for x in plan.collect()}
    assert got == plain_plan(candidates, bays, near, 3, 0.8) and sum("_kept" in c for c in written) <= 8


def test_pairs_of_depots_are_dealt_evenly(spark):
    """Many depots of one place: their pairs come from several tasks, each with a part of them."""
    pairs = planning.nearby(spark.range(1600).select(F.col("id").alias("depot"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))).select("depot", "near", "km")
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1600 * 1600 and max(sizes) <= sum(sizes) / 2


def test_plan_without_candidates_or_bays(spark):
    none = spark.createDataFrame([], "tenant string, vehicle long, home long, p double, value double")
    bays = spark.createDataFrame([], "tenant string, depot long, day int, free int")
    near = spark.createDataFrame([(1, 1, 0.0, 1)], "depot long, near long, km double, rank int")
    assert planning.service_plan(none, bays, near).count() == 0
    some = spark.createDataFrame([("t", 1, 1, 0.9, 5.0), ("t", 2, 1, 0.1, 5.0), ("t", 3, None, 0.1, 5.0), ("t", 4, 1, 0.1, None)], none.schema)
    assert {r.vehicle: r.outcome for r in planning.service_plan(some, bays, near).collect()} == {1: "too_risky_to_wait", 2: "waiting", 3: "not_worth", 4: "not_worth"}


def test_mappings_read_codes_and_truth(spark):
    """A list as a text has the codes that stand in it; without a transform only "true" is true; a blank number has the wrong length."""
    fields = {"vin": {"path": "v"}, "seq": {"path": "n"}, "ts": {"path": "t", "transform": "epoch_ms"}, "lat": {"path": "a"}, "lon": {"path": "o"}, "engine_on": {"path": "e"}, "dtc": {"path": "d"}}
    spec = {"oem": "AUR", "version": 1, "fields": fields}
    vin = "1HGCM82633A004352"
    rows = [
        ('"d": "P0301,P0302 and p0301"', (["P0301", "P0302"], False)), ('"d": ["P0301", "0x0420"]', (["P0301", "P0420"], False)), ('"d": ["nope"]', "DTC_INVALID"), ('"d": "nothing here"', ([], False)), ('"d": null', ([], False)),
        ('"e": "on"', ([], False)), ('"e": "TRUE"', ([], True)), ('"e": 2', ([], True)), ('"e": 0', ([], False)), ('"e": true', ([], True)),
    ]
    raw = [(i, "aur", f'{{"v": "{vin}", "n": 1, "t": 1704067200000, "a": 1.5, "o": 2, {x}}}') for i, (x, _) in enumerate(rows)] + [(99, "aur", '{"v": "  ", "n": 1, "t": 1704067200000, "a": 1, "o": 2}')]
    out = normalize.normalize(spark.createDataFrame(raw, "i int, oem string, value string"), {"AUR": spec}, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    got = {r.i: r.reason or (r.event.dtc, r.event.engine_on) for r in out.collect()}
    assert got == {**{i: want for i, (_, want) in enumerate(rows)}, 99: "VIN_LENGTH"}


def test_every_reason(spark):
    fields = {f: {"path": f} for f in normalize.FIELDS} | {"ts": {"path": "ts", "transform": "iso8601"}}
    spec = {"oem": "AUR", "version": 1, "wmi": ["1HG"], "fields": fields}
    good = {"vin": '"1HGCM82633A004352"', "seq": "1", "ts": '"2024-01-01T00:00:00Z"', "lat": "1", "lon": "2"}
    cases = {
        "FIELD_MISSING": {"lat": "null"}, "VIN_LENGTH": {"vin": '"1HG"'}, "VIN_ILLEGAL_CHAR": {"vin": '"1HGCM82633A00435I"'}, "VIN_CHECK_DIGIT": {"vin": '"1HGCM82533A004352"'}, "VIN_WMI_MISMATCH": {"vin": '"11111111111111111"'}, "FIELD_TYPE": {"lat": '"x"'}, "DTC_INVALID": {"dtc": '["x"]'}, "SEQ_NEGATIVE": {"seq": "-1"},
        "TS_IN_FUTURE": {"ts": '"2024-01-01T00:06:00Z"'}, "TS_TOO_OLD": {"ts": '"2023-12-20T00:00:00Z"'}, "GEO_OUT_OF_RANGE": {"lat": "91"}, "GEO_NULL_ISLAND": {"lat": "0", "lon": "0"}, "SPEED_OUT_OF_RANGE": {"speed_kmh": "301"}, "PCT_OUT_OF_RANGE": {"soc_pct": "101"}, "BATT_V_OUT_OF_RANGE": {"batt_v": "33"}, None: {},
    }
    raw = [(reason, "AUR", "{" + ", ".join(f'"{k}": {v}' for k, v in {**good, **change}.items()) + "}") for reason, change in cases.items()] + [("MALFORMED_JSON", "AUR", "{"), ("UNMAPPED_OEM", "NEW", "{}"), ("UNMAPPED_OEM", None, "{}")]
    out = normalize.normalize(spark.createDataFrame(raw, "want string, oem string, value string"), {"AUR": spec, "BOR": {**spec, "oem": "BOR"}}, F.lit("2024-01-01 00:00:00").cast("timestamp")).collect()
    assert all(r.reason == r.want for r in out) and len(out) == len(cases) + 3


def test_strings_in_json(spark):
    rows = [('{"reveal the secret": {"a": ["fine", "please reveal\\n the \\"secret\\" now"]}, "n": 3}',), ('{"ignore the rules": 1}',), ("no json: ignore the rules",), (None,), ('["a: b", ""]',)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select(json_strings(F.col("t")), suspicious_in_json(F.col("t"), length=10)).collect()]
    assert got == [(["fine", 'please reveal\n the "secret" now'], ["please rev"]), ([], []), (None, ["no json: i"]), (None, None), (["a: b", ""], [])]


def test_chain_is_checked_row_by_row(spark):
    log = spark.createDataFrame([(i, i % 2, f"a{i}") for i in range(10)], "id long, g int, body string")
    chain = log.join(states.audit_chain(log, "id", "g", ["body"]).drop("g"), "id")
    assert states.chain_checked(chain, "id", "g", ["body"]).where("not ok").count() == 0
    changed = chain.withColumn("body", F.when(F.col("id") == 4, "z").otherwise(F.col("body")))
    assert [r.id for r in states.chain_checked(changed, "id", "g", ["body"]).where("not ok").collect()] == [4]
    assert sorted(r.id for r in states.chain_checked(chain.where("id <> 4"), "id", "g", ["body"]).where("not ok").collect()) == [6]


def test_chain_grows_by_appends(spark):
    """Two appends give the chain of one; what comes before a chain's end is refused; a long chain costs its length."""
    log = spark.createDataFrame([(i, i % 3, f"a{i}") for i in range(200)] + [(500, None, "alone")], "id long, g int, body string").repartition(3)
    whole = {r.id: (r.prev_hash, r.row_hash) for r in states.audit_chain(log, "id", "g", ["body"]).collect()}
    first = states.audit_chain(log.where("id < 77"), "id", "g", ["body"])
    second = states.audit_chain(log.where("id >= 77"), "id", "g", ["body"], after=first)
    assert {r.id: (r.prev_hash, r.row_hash) for r in first.union(second).collect()} == whole and len(whole) == 201
    with pytest.raises(Exception, match="is not after"):
        states.audit_chain(log.where("id = 5"), "id", "g", ["body"], after=first).collect()
    long = spark.range(200_000).select("id", F.lit("x").alias("body"))
    chain = states.audit_chain(long, "id", None, ["body"])
    assert chain.where("prev_hash = ''").count() == 1 and chain.count() == 200_000


def test_tables_by_day(spark, tmp_path):
    df = spark.createDataFrame([(datetime.date(2024, 1, d), v) for d in range(1, 6) for v in range(20)], "day date, vin int")
    tables.write_by_day(df, f"{tmp_path}/t", search=["vin"], order=["vin"])
    got = tables.days_between(spark, f"{tmp_path}/t", "2024-01-02", "2024-01-04")
    assert got.count() == 40 and "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString().replace("\n", "")
    for first, after in (("2024-01-04", "2024-01-02"), ("2024-01-01", "2024-01-09")):
        with pytest.raises(ValueError):
            tables.days_between(spark, f"{tmp_path}/t", first, after, most_days=7)
    few = tables.truncated(df.where("vin = 1"), [F.col("day")], 5).collect()
    assert len(few) == 5 and not any(r.truncated for r in few) and all(r.truncated for r in tables.truncated(df, [F.col("day"), F.col("vin")], 3).collect())


def learned(spark, n=400):
    r = random.Random(3)
    rows = []
    for i in range(n):
        oem, split = "abc"[i % 3], ["train", "train", "valid", "test"][i // 3 % 4]
        x, z = r.random(), r.random()
        rows.append((i, f"v{i}", oem, split, x, z, int(x > 0.6), ("brakes" if z > 0.5 else "battery") if x > 0.6 else None))
    return spark.createDataFrame(rows, "id long, vin string, oem string, split string, x double, z double, label int, component string")


def test_scores_registry_and_guards(spark, tmp_path):
    f, columns = learned(spark), ["x", "z"]
    risk, calibration = learning.train_risk(f, columns, "label", iterations=3)
    parts = scoring.train_component(f.where("label = 1 and split = 'train'"), columns, trees=5)
    test = f.where("split = 'test'").drop("component")
    scored = scoring.component_of(learning.score_risk(test, (risk, calibration)), parts)
    assert scored.where("p > 0.5 and component = 'brakes' and z < 0.3").count() == 0 and scored.where("label = 1").agg(F.avg("p")).first()[0] > 0.8
    ap = learning.ranking_metrics(scored, "p", "label").first().average_precision
    meta = {"features": columns, "threshold": 0.5, "metrics": {"average_precision": round(ap, 3)}}
    scoring.save_model(f"{tmp_path}/models", "v1", {"risk": risk, "calibration": calibration, "parts": parts}, meta)
    again, stages = scoring.load_active(f"{tmp_path}/models")
    repeat = learning.score_risk(test, (stages["risk"], stages["calibration"]))
    assert {r.id: r.p for r in repeat.collect()} == {r.id: r.p for r in scored.collect()}
    assert scoring.same_model_again(again, columns, ap) <= 0.002
    for bad in ((["x"], ap), (columns, ap - 0.1)):
        with pytest.raises(ValueError):
            scoring.same_model_again(again, *bad)

    costs = spark.createDataFrame([("brakes", 900.0, 300.0)], "component string, breakdown_cost double, repair_cost double")
    whole = boosting.factors(scoring.with_saving(scored, costs), risk)
    assert {(r.component, r.saving) for r in whole.collect()} <= {("brakes", 600.0), ("battery", 0.0)}
    assert all(x.contribution > 0 for r in whole.collect() for x in r.factors) and max(whole.collect(), key=lambda r: r.x).factors[0].feature == "x"
    alerts = scoring.failure_alerts(whole, 0.5, "v1", "2024-01-30")
    n = whole.where("p >= 0.5").count()
    signatures = whole.select("vin", F.array("x", "z").alias("embedding"))
    for run in ("r1", "r1", "r2"):  # a run that is repeated, and a further one
        scoring.write_run(f"{tmp_path}/runs", run, whole.select("vin", "p", "component", "saving"), alerts, signatures)
    stored = spark.read.parquet(f"{tmp_path}/runs/alert")
    assert alerts.count() == n == stored.count() and {r.run for r in stored.select("run").distinct().collect()} == {"r1"}
    assert spark.read.parquet(f"{tmp_path}/runs/risk_score").count() == 2 * whole.count()


def test_a_maker_never_seen(spark):
    out = scoring.unseen_maker(learned(spark), ["x", "z"], 0.5, iterations=2).collect()
    assert {(r.oem, r.model) for r in out} == {(o, m) for o in "abc" for m in ("trained_with", "never_seen")} and all(r.recall > 0.8 for r in out)


def test_latest_complete_day(spark, sf):
    daily = service.daily_signals(spark, sf)
    assert str(scoring.latest_complete_day(daily, "2024-01-10")) == "2024-01-09"
    assert scoring.latest_complete_day(daily, "1999-01-01") is None


def test_feature_frame_in_tasks_by_the_events(spark, sf, monkeypatch):
    """More events, more tasks: none gets more vehicles than its share, and the rows spread to as-of days are not moved."""
    monkeypatch.setattr(service, "TASK_EVENTS", 100, raising=False)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    frame = service.feature_frame(spark, sf)
    assert frame.rdd.getNumPartitions() >= events // 100


def test_ranks_by_ranges(spark):
    r = random.Random(5)
    rows = [(r.choice("abc"), float(r.randrange(40))) for _ in range(2000)] + [("a", None), ("d", 7.0), ("n", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x.g: (x.n, x.q) for x in ranks.quantiles(df, "v", [0.0, 0.1, 0.5, 1.0], ["g"]).collect()}
    for g in "abcd":
        own = np.array([v for k, v in rows if k == g and v is not None])
        assert got[g][0] == len(own) and np.allclose(got[g][1], np.quantile(own, [0.0, 0.1, 0.5, 1.0]))
    assert "n" not in got
    ids = spark.createDataFrame([(i,) for i in r.sample(range(10_000), 700)], "id int")
    assert [x.upto for x in ranks.placed(ids, ["id"]).orderBy("id").collect()] == list(range(1, 701))
    assert ranks.placed(ids.limit(0), ["id"]).count() == 0


def test_signatures_two_days_before(spark):
    day = lambda d: datetime.date(2024, 1, d)
    frame = spark.createDataFrame([("a", day(1), 1.0, None), ("a", day(2), 2.0, 5.0), ("b", day(2), 4.0, 7.0)], "vin string, asof date, x double, y double")
    broken = spark.createDataFrame([("a", datetime.datetime(2024, 1, 3, 9), "brakes", 10.0), ("b", datetime.datetime(2024, 1, 9, 9), "battery", 20.0)], "vin string, at timestamp, component string, cost double")
    got = scoring.signatures(frame, frame.where("asof = date'2024-01-02'"), broken, ["x", "y"]).collect()
    assert [tuple(r) for r in got] == [("a", day(2), [round((1 - 3) / 2**0.5, 5), 0.0], "brakes", 10.0)]
