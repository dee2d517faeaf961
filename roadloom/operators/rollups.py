"""Rollups as partial states: what a day or a minute has seen, in columns that merge.

An average is a sum with a count, the last value a struct led by its time, a set of codes an array. States of any number of files,
batches or days merge by one more aggregation, and become results by `finish`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_columns(counts: dict[str, Column] = {}, averages: dict[str, Column] = {}, lows: dict[str, Column] = {}, highs: dict[str, Column] = {}, sums: dict[str, Column] = {}, lasts: dict[str, tuple[Column, Column]] = {}, sets: dict[str, Column] = {}) -> list[Column]:  # noqa: B006
    """Aggregates that make states. counts: conditions; lasts: (value, order)."""
    out = [F.count_if(c).alias(f"{n}__count") for n, c in counts.items()]
    out += [x for n, c in averages.items() for x in (F.sum(c.cast("double")).alias(f"{n}__sum"), F.count(c).alias(f"{n}__n"))]
    out += [F.min(c).alias(f"{n}__min") for n, c in lows.items()] + [F.max(c).alias(f"{n}__max") for n, c in highs.items()]
    out += [F.sum(c).alias(f"{n}__total") for n, c in sums.items()]
    out += [F.max(F.struct(by.alias("by"), c.alias("v"))).alias(f"{n}__last") for n, (c, by) in lasts.items()]
    out += [F.array_distinct(F.flatten(F.collect_set(c))).alias(f"{n}__set") for n, c in sets.items()]
    return out


def merge(states: DataFrame, *keys: str) -> DataFrame:
    """One state for each key."""
    how = {"count": F.sum, "sum": F.sum, "n": F.sum, "total": F.sum, "min": F.min, "max": F.max, "last": F.max}
    aggregates = []
    for c in states.columns:
        if c not in keys:
            kind = c.rpartition("__")[2]
            aggregates.append((F.array_distinct(F.flatten(F.collect_list(c))) if kind == "set" else how[kind](c)).alias(c))
    return states.groupBy(*keys).agg(*aggregates)


def finish(states: DataFrame, *keys: str) -> DataFrame:
    """The states' results, under their names; averages of nothing are null, sets are sorted."""
    out: list[Column] = [F.col(k) for k in keys]
    for c in states.columns:
        name, _, kind = c.rpartition("__")
        if c in keys or kind == "n":
            continue
        value = {"sum": lambda: F.col(c) / F.nullif(F.col(f"{name}__n"), F.lit(0)), "last": lambda: F.col(f"{c}.v"), "set": lambda: F.array_sort(c)}.get(kind, lambda: F.col(c))()  # noqa: B023
        out.append(value.alias(name))
    return states.select(*out)


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """For each key the row with the highest version: the read of a table where later rows replace earlier ones. One aggregation,
    which meets the copies map-side; of equal versions the greatest row stays."""
    rest = [c for c in rows.columns if c not in keys and c != version]
    top = rows.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_row"))
    return top.select(*keys, "_row.*").select(*rows.columns)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """For each key the row that comes last in the order."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    top = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return top.select(*keys, "_row.*").select(*rows.columns)


def once(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet, each key once: an insert that ignores conflicts."""
    return rows.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def top_by_group(rows: DataFrame, keys: list[str], order: list[Column], budget: Column | int) -> DataFrame:
    """The first rows of each group in the order, as many as the budget says (a column of the group, or a number)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= budget)
