"""Paths into JSON payloads and the named transforms of their values, compiled to column expressions over VARIANT."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.?([A-Za-z_][\w-]*)|\[(\d+)\]|\[([\w-]+)=([^\]]+)\]|\[(\*)\]")


class Value(NamedTuple):
    """What a path gives: one value as text, or the texts of several."""

    text: Column | None
    many: Column | None


def steps(path: str) -> list[tuple[str, ...]]:
    """The path's steps: ("at", JSON path), ("where", key, value), ("each",). ValueError where it is no path."""
    out: list[tuple[str, ...]] = []
    at = 0
    while at < len(path):
        m = _STEP.match(path, at)
        if not m or (at == 0) != (m[0][:1] not in ".["):
            raise ValueError(f"not a path: {path}")
        if m[1] or m[2]:
            part = f".{m[1]}" if m[1] else f"[{m[2]}]"
            out = [*out[:-1], ("at", out[-1][1] + part)] if out and out[-1][0] == "at" else [*out, ("at", "$" + part)]
        else:
            out.append(("each",) if m[5] else ("where", m[3], m[4]))
        at = m.end()
    if not out:
        raise ValueError("an empty path")
    return out


def lookup(payload: Column, path: str) -> Value:
    """The value at a path of a VARIANT: names, [n], [key=value] (the first match), [*] (all, without missing ones). What is
    missing, null, or asked of something that is no array gives null."""

    def one(v: Column, rest: list[tuple[str, ...]]) -> Value:
        if not rest:
            return Value(F.try_variant_get(v, "$", "string"), None)
        kind, *args = rest[0]
        if kind == "at":
            if len(rest) == 1:
                return Value(F.try_variant_get(v, args[0], "string"), None)
            if rest[1][0] == "at":
                return one(F.try_variant_get(v, args[0], "variant"), rest[1:])
            items = F.try_variant_get(v, args[0], "array<variant>")
            return each(items, rest[1:])
        return each(F.try_variant_get(v, "$", "array<variant>"), rest)

    def each(items: Column, rest: list[tuple[str, ...]]) -> Value:
        kind, *args = rest[0]
        if kind == "where":
            hit = F.get(F.filter(items, lambda x: F.coalesce(F.try_variant_get(x, f"$.{args[0]}", "string") == args[1], F.lit(False))), F.lit(0))
            return one(hit, rest[1:])
        texts = F.transform(items, lambda x: one(x, rest[1:]).text)
        return Value(None, F.filter(texts, lambda t: t.isNotNull()))

    return one(payload, steps(path))


def number(text: Column) -> Column:
    """A number, or text that is one; null otherwise."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def truth(text: Column) -> Column:
    """True for true, for numbers other than 0, and for the words on, yes, running, drive and run; false for other texts."""
    t = F.lower(F.trim(text))
    return F.when(text.isNotNull(), t.isin("true", "1", "on", "yes", "running", "drive", "run") | F.coalesce(number(t) != 0, F.lit(False)))


def instant(text: Column) -> Column:
    """A point in time written in ISO 8601 with its zone; null otherwise (words such as yesterday, or a missing zone)."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(t))


def parts(text: Column) -> Column:
    """A list written with commas, semicolons, bars or white space."""
    return F.filter(F.split(text, r"[,;|\s]+"), lambda x: x != "")


def millis(x: Column) -> Column:
    return F.timestamp_millis(x.cast("bigint"))


#: Transforms of a text to a column of the kind in TRANSFORM_KINDS; `datetime` and `map` take an argument.
TRANSFORMS: dict[str, Callable[..., Column]] = {
    "none": lambda t: t,
    "number": number,
    "mph_to_kmh": lambda t: number(t) * 1.609344,
    "miles_to_km": lambda t: number(t) * 1.609344,
    "f_to_c": lambda t: (number(t) - 32) * 5.0 / 9.0,
    "fraction_to_pct": lambda t: number(t) * 100,
    "iso8601": instant,
    "epoch_ms": lambda t: millis(number(t)),
    "epoch_s": lambda t: millis(F.floor(number(t) * 1000 + 0.5)),
    "datetime": lambda t, fmt: F.try_to_timestamp(F.trim(t), F.lit(fmt)),
    "bool": truth,
    "map": lambda t, table: F.when(t.isNotNull(), F.coalesce(*[F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), k) for k in (t, F.lit("*"))], t) if table else t),
    "csv_list": parts,
    "list": lambda t: F.when(t.isNotNull(), F.array(t)),
}
