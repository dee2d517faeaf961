"""Live alert rules with a state for each vehicle.

One function steps a state by one event; a stream applies it with keyed state, a batch to pieces of a vehicle's history, both in the
order of arrival. Point rules and the count of harsh events look at every event; what is held over time, only at events in order.
A cooldown keeps a rule quiet for a vehicle, and an alert is named by vehicle, rule and the begin of its episode, so the same events
give the same alerts again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators import ranks
from roadloom.sources.tables import checkpointed

VERSION = 2
MINUTE, HOUR = 60_000, 3_600_000

#: Severity and cooldown of each rule.
RULES = {
    "ENGINE_OVERHEAT": ("CRITICAL", 15 * MINUTE),
    "CRITICAL_DTC": ("CRITICAL", 1 * HOUR),
    "LOW_12V_BATTERY": ("WARNING", 6 * HOUR),
    "HARSH_DRIVING": ("WARNING", 30 * MINUTE),
    "EV_LOW_SOC": ("WARNING", 1 * HOUR),
    "EXCESSIVE_IDLING": ("INFO", 30 * MINUTE),
    "SENSOR_FAULT": ("WARNING", 6 * HOUR),
}
#: Fault codes of the highest severity.
CRITICAL_CODES = ("P0217", "P0A80", "P0AA6")
HARSH = ("HARSH_BRAKE", "HARSH_ACCEL")


@dataclass(frozen=True)
class Limits:
    """Thresholds and times in milliseconds. `stretch` multiplies all times, for feeds that report less often."""

    overheat_c: float = 110.0
    overheat_for: int = MINUTE // 2
    low_battery_v: float = 11.8
    low_charge_pct: float = 10.0
    harsh_events: int = 5
    harsh_window: int = 10 * MINUTE
    idle_for: int = 10 * MINUTE
    gap: int = 2 * MINUTE
    jump_c: float = 25.0
    jumps: int = 3
    jump_window: int = 5 * MINUTE
    suspect_for: int = 30 * MINUTE
    stretch: int = 1
    critical: tuple[str, ...] = CRITICAL_CODES
    harsh: tuple[str, ...] = HARSH


@dataclass
class State:
    """What a vehicle's rules remember; times in milliseconds, None for never. held: for each rule about something that lasts since
    when it does, and whether that was told."""

    last: int | None = None
    held: dict[str, list] = field(default_factory=dict)
    coolant: float | None = None
    coolant_at: int | None = None
    jump_at: int | None = None
    jumps: int = 0
    suspect_until: int = -1
    harsh: list[int] = field(default_factory=list)
    raised: dict[str, int] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps({"version": VERSION, **self.__dict__})

    @classmethod
    def load(cls, text: str | None) -> State:
        """The state written before; a fresh one where there is none, or where another version wrote it."""
        values = json.loads(text) if text else {}
        return cls(**values) if values.pop("version", None) == VERSION else cls()


def _below(value, bound: float) -> bool:
    return value is not None and value < bound


#: Rules that one event decides by itself: what the alert tells, or None.
POINT_RULES = {
    "CRITICAL_DTC": lambda e, lim: next(({"dtc": c} for c in e.get("dtc") or () if c in lim.critical), None),
    "LOW_12V_BATTERY": lambda e, lim: {"batt_v": e["batt_v"], "threshold_v": lim.low_battery_v} if not e.get("engine_on") and _below(e.get("batt_v"), lim.low_battery_v) else None,
    # a vehicle that reports charge and no fuel is electric
    "EV_LOW_SOC": lambda e, lim: {"soc_pct": e["soc_pct"], "threshold_pct": lim.low_charge_pct} if e.get("fuel_pct") is None and (e.get("speed_kmh") or 0) > 0 and _below(e.get("soc_pct"), lim.low_charge_pct) else None,
}


class _Step:
    """One event on its way into a vehicle's state."""

    def __init__(self, s: State, e: dict, lim: Limits):
        self.s, self.e, self.lim, self.ts, self.alerts = s, e, lim, e["ts"], []

    def time(self, limit: int) -> int:
        return limit * self.lim.stretch

    def tell(self, rule: str, at: int, opened: int, details: dict) -> bool:
        """An alert, unless the rule is still quiet for the vehicle at that time (or was told of something later)."""
        severity, quiet = RULES[rule]
        before = self.s.raised.get(rule)
        if before is not None and at - before < self.time(quiet):
            return False
        self.s.raised[rule] = at if before is None else max(before, at)
        said = json.dumps({**details, "lat": self.e.get("lat"), "lon": self.e.get("lon")}, sort_keys=True)
        self.alerts.append({"dedup_key": f"{self.e['vin']}:{rule}:{opened}", "vin": self.e["vin"], "rule": rule, "severity": severity, "opened_at": opened, "at": self.ts, "details": said})
        return True

    def lasting(self, rule: str, holds: bool, least: int, told: dict, seconds: str) -> None:
        """A rule about what lasts: told once, when it has held for `least` milliseconds."""
        if not holds:
            self.s.held.pop(rule, None)
            return
        entry = self.s.held.setdefault(rule, [self.ts, False])
        if not entry[1] and self.ts - entry[0] >= least:
            entry[1] = True
            self.tell(rule, self.ts, entry[0], {**told, seconds: (self.ts - entry[0]) // 1000})

    def harsh(self) -> None:
        """Enough harsh events within the window; late ones take their place, and the next alert needs as many new ones."""
        kept = sorted([*self.s.harsh, self.ts])[-self.lim.harsh_events :]
        span = kept[-1] - kept[0]
        full = len(kept) == self.lim.harsh_events and span <= self.time(self.lim.harsh_window)
        self.s.harsh = [] if full and self.tell("HARSH_DRIVING", kept[-1], kept[0], {"events": len(kept), "window_seconds": span // 1000}) else kept

    def sensor(self, coolant: float) -> None:
        """Readings that jump to and fro mean a failing sensor: while it is suspect, its heat isn't believed."""
        s, lim = self.s, self.lim
        jumped = s.coolant_at is not None and self.ts - s.coolant_at <= self.time(lim.gap) and abs(coolant - s.coolant) > lim.jump_c
        if jumped:
            again = s.jump_at is not None and self.ts - s.jump_at <= self.time(lim.jump_window)
            s.jump_at, s.jumps = (s.jump_at, s.jumps + 1) if again else (self.ts, 1)
            if s.jumps >= lim.jumps:
                fresh, s.suspect_until = self.ts >= s.suspect_until, self.ts + self.time(lim.suspect_for)
                if fresh:
                    told = {"sensor": "coolant", "jumps": s.jumps, "window_seconds": (self.ts - s.jump_at) // 1000, "readings_c": [s.coolant, coolant], "max_plausible_change_c": lim.jump_c, "overheat_alerts_held": True}
                    self.tell("SENSOR_FAULT", self.ts, s.jump_at, told)
        s.coolant, s.coolant_at = coolant, self.ts


def step(s: State, e: dict, lim: Limits = Limits()) -> list[dict]:
    """Takes one event into the state and returns its alerts. e: vin, ts (milliseconds), engine_on, speed_kmh, fuel_pct, soc_pct,
    coolant_c, batt_v, dtc, evt, lat, lon; what is missing is null."""
    now = _Step(s, e, lim)
    for rule, told_by in POINT_RULES.items():
        if (told := told_by(e, lim)) is not None:
            now.tell(rule, e["ts"], e["ts"], told)
    if e.get("evt") in lim.harsh:
        now.harsh()
    if s.last is not None and e["ts"] < s.last:  # late: what lasts is known already
        return now.alerts
    if s.last is not None and e["ts"] - s.last > now.time(lim.gap):
        s.held.clear()
    coolant = e.get("coolant_c")
    if coolant is not None:
        now.sensor(coolant)
    hot = coolant is not None and coolant > lim.overheat_c and e["ts"] >= s.suspect_until
    now.lasting("ENGINE_OVERHEAT", hot, now.time(lim.overheat_for), {"coolant_c": coolant, "threshold_c": lim.overheat_c}, "above_for_seconds")
    idle = bool(e.get("engine_on")) and (e.get("speed_kmh") or 0) < 1
    now.lasting("EXCESSIVE_IDLING", idle, now.time(lim.idle_for) + 1, {}, "idle_seconds")
    s.last = e["ts"]
    return now.alerts


ALERTS = "dedup_key string, vin string, rule string, severity string, opened_at long, at long, details string"


def _records(names: list[str], columns: list[list]) -> Iterator[dict]:
    """Rows of columns of plain values; NaN says nothing."""
    for row in zip(*[[None if v != v else v for v in c] for c in columns], strict=True):
        yield dict(zip(names, row, strict=True))


def _events(frame: pd.DataFrame) -> Iterator[dict]:
    listed = lambda c: [list(v) if hasattr(v, "tolist") else v for v in c]
    return _records(list(frame.columns), [listed(frame[c].tolist()) for c in frame.columns])


def settled(s: State, after: int | None, lim: Limits) -> State:
    """The state without what no event from the time `after` on can tell any more (None: there is none): quiet times that are over,
    what was held before a gap, harsh events and jumps beyond their windows. Two states with the same rest give the same alerts."""
    if after is None:
        return State()
    over = lambda at, limit: at is None or after - at > limit * lim.stretch
    out = State()
    if s.last is not None and not over(s.last, lim.gap):
        out.last, out.held = s.last, s.held
    if not over(s.coolant_at, lim.gap):
        out.coolant, out.coolant_at = s.coolant, s.coolant_at
    if not over(s.jump_at, lim.jump_window):
        out.jump_at, out.jumps = s.jump_at, s.jumps
    out.suspect_until = s.suspect_until if s.suspect_until > after else -1
    out.harsh = [t for t in s.harsh if not over(t, lim.harsh_window)]
    out.raised = {r: at for r, at in s.raised.items() if after - at < RULES[r][1] * lim.stretch}
    return out


#: Events of a piece of a vehicle's history that one task looks at.
PIECE_EVENTS = 20_000
_RAN = f"piece long, state string, {ALERTS}"


def _pieces(ready: DataFrame, arrival: list[str], piece_events: int) -> DataFrame:
    """The events with `piece`: 0 for a vehicle with as many as one piece has, else the number of each stretch of so many in the order
    of arrival. The numbers come from ranges over the whole table, so no task has a vehicle's events."""
    many = checkpointed(ready.groupBy("vin").agg(F.count("*").alias("_n")).where(F.col("_n") > piece_events).select("vin"))
    if not many.take(1):
        return ready.withColumn("piece", F.lit(0).cast("long"))
    few = ready.join(many, "vin", "left_anti").withColumn("piece", F.lit(0).cast("long"))
    # an event's columns tell apart what arrives at once
    numbered = ranks.placed(ready.join(many, "vin", "left_semi").withColumn("_h", F.xxhash64(*ready.columns)), [*arrival, "_h"], ["vin"])
    return few.unionByName(numbered.withColumn("piece", F.floor((F.col("upto") - 1) / piece_events)).drop("_h", "upto"))


def batch_alerts(events: DataFrame, arrival: list[str], limits: Limits = Limits(), piece_events: int = PIECE_EVENTS) -> DataFrame:
    """The alerts of all events, each vehicle's in the order of arrival. events: the columns of `step`, ts as a timestamp.

    A long history is cut into pieces, and all pieces run at once, each as if it were the first. What a piece leaves behind, as far as
    it can still matter to later events (`settled`), is then held against what the next piece began with: pieces that began otherwise
    run again, with the right state, until none is left. After a pause as long as the longest quiet time nothing is left behind, so most
    pieces run once. A piece is right one round after the one before it, so there are no more rounds than pieces of a vehicle."""
    ready = checkpointed(_pieces(_ready(events).where("vin is not null"), arrival, piece_events))
    later = Window.partitionBy("vin").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    bounds = ready.groupBy("vin", "piece").agg(F.min("ts").alias("_least")).withColumn("after", F.min("_least").over(later)).drop("_least")  # a row for each piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in _RAN.split(", "))])
        state, first, out = State(), None, []

        def left() -> list[dict]:
            if first is None:
                return []
            return [{"piece": first["piece"], "state": settled(state, first["after"], limits).dump(), "vin": first["vin"]}]

        for batch in batches:
            for e in _records(batch.schema.names, [c.to_pylist() for c in batch.columns]):
                if e["state"] is not None:  # a piece begins
                    out += left()
                    state, first = State.load(e["state"]), e
                else:
                    out += [{"piece": e["piece"], **x} for x in step(state, e, limits)]
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        yield pa.RecordBatch.from_pylist(left(), schema)

    def stepped(events: DataFrame, begins: DataFrame) -> DataFrame:
        """The pieces' alerts and what they leave behind. What a piece begins with comes as a row before its events, so a task goes through
        its rows once, with one state at a time, and a vehicle costs no more than its events."""
        rows = events.unionByName(begins, allowMissingColumns=True).repartition("vin", "piece")
        return rows.sortWithinPartitions("vin", "piece", F.col("state").isNull(), *[F.asc_nulls_last(c) for c in arrival]).mapInArrow(run, _RAN)

    begins = checkpointed(bounds.withColumn("state", F.lit(State().dump())))
    begun, done = begins, None
    while True:
        again = ready if done is None else ready.join(begins.select("vin", "piece"), ["vin", "piece"], "left_semi")
        ran = checkpointed(stepped(again, begins))
        if done is not None:
            ran = checkpointed(done.join(begins.select("vin", "piece"), ["vin", "piece"], "left_anti").unionByName(ran))
        done = ran
        left = done.where("state is not null").select("vin", (F.col("piece") + 1).alias("piece"), F.col("state").alias("left"))
        begun = checkpointed(begun.join(left, ["vin", "piece"], "left").withColumn("again", F.coalesce(F.col("left") != F.col("state"), F.lit(False))).select("vin", "piece", "after", F.coalesce("left", "state").alias("state"), "again"))
        begins = begun.where("again").drop("again")
        begun = begun.drop("again")
        if not begins.take(1):
            return done.where("state is null").select(*[c.split()[0] for c in ALERTS.split(", ")])


#: Vehicles of a stream are dealt to so many buckets, each with one state.
BUCKETS = 1024


def stream_alerts(events: DataFrame, arrival: list[str], limits: Limits = Limits(), buckets: int = BUCKETS) -> DataFrame:
    """The same over a stream. A bucket of vehicles has one state with a text for each vehicle, so that the calls of a micro-batch do not
    grow with the vehicles; only the vehicles that have events are read and written anew. Within a micro-batch events are put in order
    of arrival, which an exchange does not keep."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        texts, states, out = dict(json.loads(held.get[0])) if held.exists else {}, {}, []
        for e in sorted((e for f in frames for e in _events(f)), key=lambda e: [(e[c] is None, e[c]) for c in arrival]):
            if e["vin"] not in states:
                states[e["vin"]] = State.load(texts.get(e["vin"]))
            out += step(states[e["vin"]], e, limits)
        held.update((json.dumps([*{**texts, **{v: s.dump() for v, s in states.items()}}.items()]),))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERTS.split(", ")])

    bucket = F.pmod(F.xxhash64("vin"), F.lit(buckets)).cast("int")
    return _ready(events).withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(run, ALERTS, "states string", "append", GroupStateTimeout.NoTimeout)


def _ready(events: DataFrame) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.withColumn("ts", millis).withColumn("vin", F.col("vin").cast("string"))
