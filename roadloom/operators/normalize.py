"""Raw payloads of makers to one canonical event, by mappings that are data.

A mapping names, for each canonical field, a path or a constant and a transform. It is checked when it is compiled, and compiled to
column expressions; no Python runs for a row. A row keeps the first reason for which it is refused, in a fixed order.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.functions.numbers import half_up
from roadloom.functions.payload import TRANSFORMS, Value, lookup, number, steps
from roadloom.functions.vehicles import fault_code, fault_codes_in, vin_reason

#: Canonical fields in the order in which they are read, with their kinds.
FIELDS = {
    "vin": "text", "seq": "long", "ts": "time", "lat": "number", "lon": "number", "speed_kmh": "number", "odo_km": "number", "engine_on": "bool",
    "rpm": "number", "fuel_pct": "number", "soc_pct": "number", "soh_pct": "number", "coolant_c": "number", "batt_v": "number", "dtc": "list", "evt": "text",
}
REQUIRED = ("vin", "seq", "ts", "lat", "lon")
#: The kinds of events.
EVENTS = ("PERIODIC", "IGNITION_ON", "IGNITION_OFF", "HARSH_BRAKE", "HARSH_ACCEL", "CHARGING_START", "CHARGING_STOP")
_MAKER = re.compile(r"^[A-Z][A-Z0-9_]{1,29}$")


class MappingError(ValueError):
    """A mapping that cannot be compiled."""


def check_mapping(spec: dict, above: int | None = None) -> dict:
    """The mapping, if it is whole: a maker, a positive version (over `above`, the version in force), known fields with a path or
    a constant each, known transforms with what they need, and the required fields."""
    if not _MAKER.match(str(spec.get("oem", ""))):
        raise MappingError("no maker's name")
    if not isinstance(spec.get("version"), int) or spec["version"] < 1 or (above is not None and spec["version"] <= above):
        raise MappingError("the version does not go up")
    fields = spec.get("fields", {})
    for name, rule in fields.items():
        if name not in FIELDS:
            raise MappingError(f"unknown field {name}")
        if "path" not in rule and "const" not in rule:
            raise MappingError(f"{name} has neither a path nor a constant")
        if "path" in rule:
            try:
                steps(rule["path"])
            except ValueError as error:
                raise MappingError(f"{name}: {error}") from error
        transform = rule.get("transform", "none").lower()
        if transform not in TRANSFORMS:
            raise MappingError(f"{name}: unknown transform {transform}")
        if transform == "datetime" and not rule.get("format"):
            raise MappingError(f"{name}: datetime needs a format")
    if missing := [f for f in REQUIRED if f not in fields]:
        raise MappingError(f"required fields are missing: {', '.join(missing)}")
    return spec


def latest_mappings(specs: list[dict]) -> dict[str, dict]:
    """By maker the mapping with the highest version; one that is broken, or not newer, leaves what is there in force."""
    current: dict[str, dict] = {}
    for spec in specs:
        maker = str(spec.get("oem", "")).upper()
        try:
            current[maker] = check_mapping(spec, current.get(maker, {}).get("version"))
        except MappingError:
            continue
    return current


_TYPES = {"text": "string", "long": "bigint", "time": "timestamp", "number": "double", "bool": "boolean", "list": "array<string>"}


def _text(payload: Column, name: str, rule: dict | None) -> Column:
    """What a field's path or constant gives: a text, or for lists the texts of it."""
    kind = "array<string>" if FIELDS[name] == "list" else "string"
    if rule is None:
        return F.lit(None).cast(kind)
    if "path" not in rule:
        const = rule["const"]
        source = Value(F.lit(str(const).lower() if isinstance(const, bool) else str(const)), None)
    else:
        source = lookup(payload, rule["path"])
    if FIELDS[name] != "list":
        return source.text if source.text is not None else F.get(source.many, F.lit(0))
    if source.many is not None:
        return source.many
    if rule.get("transform", "none").lower() == "csv_list":
        return TRANSFORMS["csv_list"](source.text)
    # a JSON array has its items, a text the codes that stand in it
    return F.when(F.ltrim(source.text).startswith("["), F.from_json(source.text, "array<string>")).otherwise(fault_codes_in(source.text))


def _value(text: Column, name: str, rule: dict | None) -> Column:
    """A field's value from its text; null where it cannot be read."""
    kind = FIELDS[name]
    if rule is None:
        return F.lit(None).cast(_TYPES[kind])
    if kind == "list":
        return F.transform(text, fault_code)
    transform = rule.get("transform", "none").lower()
    extra = {"datetime": ("format",), "map": ("map",)}.get(transform, ())
    value = TRANSFORMS[transform](text, *[rule.get(e) for e in extra])
    if kind == "bool" and transform != "bool":
        # without the transform a text is true only if it says so; a number is, if it is not 0
        plain = F.lower(F.trim(value.cast("string")))
        value = F.when(plain.isNotNull(), (plain == "true") | F.coalesce(number(plain) != 0, F.lit(False)))
    elif transform in ("none", "map", "list"):
        value = {"number": number, "long": number, "text": F.trim, "time": TRANSFORMS["iso8601"]}[kind](value)
    return value.try_cast("bigint") if kind == "long" else value


def _error(text: Column, value: Column, name: str, rule: dict | None) -> Column:
    """Why a field cannot be read, or null."""
    if rule is None:
        return F.lit(None).cast("string")
    if FIELDS[name] == "list":
        return F.when(F.exists(value, lambda c: c.isNull()), "DTC_INVALID")
    return F.when(text.isNull(), F.lit("FIELD_MISSING" if name in REQUIRED else None)).when(value.isNull(), "FIELD_TYPE")


def _layer(rows: DataFrame, name: str, columns: dict[str, Column]) -> DataFrame:
    """The rows with a struct of the columns. A generator stands behind it, a border that no projection crosses: what is made here
    is made once, however often it is looked at further on."""
    return rows.withColumn(name, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# Limits of a canonical event, and the reasons for which a row is refused, in the order in which they are looked for.
LIMITS = {"lat": 90, "lon": 180, "speed_kmh": (0, 300), "pct": (0, 100.0001), "batt_v": (0, 32)}


def _reason(v: Column, errors: Column, allowed: Column | None, now: Column) -> Column:
    check = lambda condition, reason: F.when(condition, F.lit(reason))
    outside = lambda c, low, high: (c < low) | (c > high)
    reasons = [check(v["vin"].isNull(), "FIELD_MISSING"), vin_reason(v["vin"])]
    if allowed is not None:
        reasons.append(check(~F.array_contains(allowed, F.substr(v["vin"], F.lit(1), F.lit(3))), "VIN_WMI_MISMATCH"))
    reasons += [errors[f] for f in FIELDS if f != "vin"]
    reasons += [
        check(v["seq"] < 0, "SEQ_NEGATIVE"),
        check(v["ts"] > now + F.expr("INTERVAL 5 MINUTES"), "TS_IN_FUTURE"),
        check(v["ts"] < now - F.expr("INTERVAL 7 DAYS"), "TS_TOO_OLD"),
        check((F.abs(v["lat"]) > LIMITS["lat"]) | (F.abs(v["lon"]) > LIMITS["lon"]), "GEO_OUT_OF_RANGE"),
        check((v["lat"] == 0) & (v["lon"] == 0), "GEO_NULL_ISLAND"),
        check(outside(v["speed_kmh"], *LIMITS["speed_kmh"]), "SPEED_OUT_OF_RANGE"),
        *[check(outside(v[p], *LIMITS["pct"]), "PCT_OUT_OF_RANGE") for p in ("fuel_pct", "soc_pct", "soh_pct")],
        check(outside(v["batt_v"], *LIMITS["batt_v"]), "BATT_V_OUT_OF_RANGE"),
    ]
    return F.coalesce(*reasons)


def _event(v: Column, errors: Column, maker: Column, reason: Column, null_battery_is_zero: bool) -> dict[str, Column]:
    first_bad = F.coalesce(*[F.when(errors[f].isNotNull(), F.lit(f)) for f in FIELDS])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    battery = half_up(v["batt_v"], 2)
    return {
        "vin": v["vin"], "oem": maker, "seq": v["seq"], "ts": F.date_trunc("millisecond", v["ts"]), "lat": v["lat"], "lon": v["lon"],
        "speed_kmh": half_up(zero(v["speed_kmh"]), 1), "odo_km": half_up(zero(v["odo_km"]), 1), "engine_on": F.coalesce(v["engine_on"], F.lit(False)),
        "rpm": F.greatest(F.floor(zero(v["rpm"]) + 0.5), F.lit(0)).cast("int"), "fuel_pct": half_up(v["fuel_pct"], 2), "soc_pct": half_up(v["soc_pct"], 2), "soh_pct": half_up(v["soh_pct"], 2),
        "coolant_c": half_up(v["coolant_c"], 2), "batt_v": zero(battery) if null_battery_is_zero else battery, "dtc": F.coalesce(F.array_distinct(v["dtc"]), F.array().cast("array<string>")),
        "evt": F.when(v["evt"].isin(*EVENTS), v["evt"]).otherwise("PERIODIC"), "reason": reason, "detail": F.when(reason.isNotNull(), F.coalesce(first_bad, F.lit(""))),
    }


def normalize(raw: DataFrame, mappings: dict[str, dict], now: Column, value: str = "value", maker: str = "oem", null_battery_is_zero: bool = False) -> DataFrame:
    """The raw rows with `event`, a struct of the canonical fields with its `reason`: UNMAPPED_OEM without a mapping, MALFORMED_JSON
    where the payload is none, else the mapping's own. One pass in layers, whatever the number of mappings: texts, then values, then
    the reason and the event, each made once a row."""
    name = F.upper(F.trim(F.col(maker)))
    known = F.coalesce(name.isin(*mappings), F.lit(False)) if mappings else F.lit(False)
    reason = F.when(~known, "UNMAPPED_OEM")
    if not mappings:
        return raw.withColumn("event", F.lit(None)).withColumn("reason", reason)

    def by_maker(of) -> Column:
        """of(spec) for the row's maker; one expression, where all mappings ask for the same."""
        cases = {m: of(spec) for m, spec in mappings.items()}
        return reduce(lambda rest, m: F.when(F.col("_maker") == m, cases[m]).otherwise(rest), list(cases)[1:], F.when(F.col("_maker") == next(iter(cases)), next(iter(cases.values()))))

    rule = lambda f: lambda spec: spec["fields"].get(f)
    rows = _layer(raw, "_p", {"json": F.when(known, F.try_parse_json(F.col(value))), "maker": name}).withColumn("_maker", F.col("_p.maker"))
    rows = _layer(rows, "_t", {f: by_maker(lambda spec, f=f: _text(F.col("_p.json"), f, rule(f)(spec))) for f in FIELDS})
    values = {f: by_maker(lambda spec, f=f: _value(F.col(f"_t.{f}"), f, rule(f)(spec))) for f in FIELDS}
    rows = _layer(rows, "_v", {f: (F.upper(F.trim(c)) if f in ("vin", "evt") else c) for f, c in values.items()})
    errors = {f: by_maker(lambda spec, f=f: _error(F.col(f"_t.{f}"), F.col(f"_v.{f}"), f, rule(f)(spec))) for f in FIELDS}
    rows = _layer(rows, "_e", errors)
    prefixes = {m: ([w] if isinstance(w, str) else list(w)) for m, spec in mappings.items() if (w := spec.get("wmi"))}
    allowed = F.try_element_at(F.create_map(*[x for m, w in prefixes.items() for x in (F.lit(m), F.array(*map(F.lit, w)))]), F.col("_maker")) if prefixes else None
    said = _reason(F.col("_v"), F.col("_e"), allowed, now)
    rows = _layer(rows, "_r", {"reason": F.coalesce(reason, F.when(F.col("_p.json").isNull(), "MALFORMED_JSON"), said)})
    rows = _layer(rows, "event", _event(F.col("_v"), F.col("_e"), F.col("_maker"), F.col("_r.reason"), null_battery_is_zero))
    return rows.withColumn("reason", F.col("_r.reason")).select(*raw.columns, "event", "reason")


def good(normalized: DataFrame) -> DataFrame:
    """The canonical events that passed."""
    return normalized.where("reason is null").select("event.*").drop("reason", "detail")


def dead_letters(normalized: DataFrame) -> DataFrame:
    """The rows refused, as they came, with dlq_reason and dlq_detail of 300 characters at most."""
    rest = [c for c in normalized.columns if c not in ("event", "reason")]
    return normalized.where("reason is not null").select(*rest, F.col("reason").alias("dlq_reason"), F.substring(F.coalesce("event.detail", F.lit("")), 1, 300).alias("dlq_detail"))


def replay(letters: DataFrame, mappings: dict[str, dict], maker: str, now: Column) -> DataFrame:
    """The dead letters that waited for this maker's mapping, through the normaliser again."""
    waiting = letters.where((F.upper("oem") == maker.upper()) & (F.col("dlq_reason") == "UNMAPPED_OEM")).drop("dlq_reason", "dlq_detail")
    return normalize(waiting, mappings, now)


def preview(normalized: DataFrame, order: str = "value") -> DataFrame:
    """(reason, n, example, first): how many rows passed (reason null) or failed for each reason, with the payload of the first of
    them, by `order` (the topic's offset; without one, the payload itself)."""
    return normalized.groupBy("reason").agg(F.count("*").alias("n"), F.min_by("value", order).alias("example"), F.min(order).alias("first"))


def wire_format(event: DataFrame, shape: dict[str, str]) -> DataFrame:
    """Canonical events as JSON of a maker's shape: {"a.b": "expression"} nests by dots. For fixtures and round trips."""
    tree: dict = {}
    for path, expression in shape.items():
        *heads, last = path.split(".")
        node = tree
        for h in heads:
            node = node.setdefault(h, {})
        node[last] = expression

    def build(node: dict) -> Column:
        return F.struct(*[(build(x) if isinstance(x, dict) else F.expr(x)).alias(k) for k, x in node.items()])

    return event.withColumn("value", F.to_json(build(tree)))
