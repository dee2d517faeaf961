"""Greedy choices along time, without going through the events one by one.

Where a rule fires, then takes no notice for a while, and fires again, each firing has one successor: the first event after it at which
the rule can fire again. The successor of every event is found at once, by sorting in pieces of time, and what is reached from the
first firing is found by doubling: with pointers to the 1st, 2nd, 4th ... successor, n firings take log n joins. No key's events have
to be in one place: the joins are on (key, time, number), and a sort has the events of one key within one piece of time.

Times are microseconds; an event is named by (key, time, number) and is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.sources.tables import checkpointed

DAY = 86_400_000_000


def micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def first_after(probes: DataFrame, items: DataFrame, piece: int = DAY) -> DataFrame:
    """The probes (key, t, s, ...) with `found`: the first of the items (key, t, s, item) of the key after (t, s), null where there is
    none. Items are compared as (t, s, item). Both are sorted together within a piece of time; where the piece has no item left, the
    first one of the next piece that has any is taken."""
    rest = [c for c in probes.columns if c not in ("key", "t", "s")]
    rows = probes.select("key", "t", "s", F.lit(0).alias("_kind"), F.lit(None).cast(items.schema["item"].dataType).alias("item"), F.struct(*rest, F.lit(1).alias("_one")).alias("_rest"))
    empty = F.lit(None).cast(rows.schema["_rest"].dataType)
    both = rows.union(items.select("key", "t", "s", F.lit(1), "item", empty)).withColumn("_piece", F.floor(F.col("t") / piece))
    ordered = F.when(F.col("_kind") == 1, F.struct("t", "s", "item"))
    # from the end: an item at the probe's own place comes after it, so it is not found
    seen = Window.partitionBy("key", "_piece").orderBy(F.desc("t"), F.desc("s"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    within = both.withColumn("_in", F.min(ordered).over(seen)).where("_kind = 0")
    later = Window.partitionBy("key").orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = both.groupBy("key", "_piece").agg(F.min(ordered).alias("_first")).withColumn("_next", F.min("_first").over(later)).where("_next is not null").select("key", "_piece", "_next")
    out = within.join(pieces, ["key", "_piece"], "left")
    return out.select("key", "t", "s", *[F.col(f"_rest.{c}").alias(c) for c in rest], F.coalesce("_in", "_next")["item"].alias("found"))


def reached(first: DataFrame, pointers: DataFrame) -> DataFrame:
    """(key, at) of all that is reached from `first` (key, at) by the pointers (key, at, to). `to` lies after `at`, so there is no way
    back; each round doubles the number of steps."""
    marks, steps = checkpointed(first), checkpointed(pointers.where("to is not null"))
    while True:
        ahead = marks.join(steps, ["key", "at"]).select("key", F.col("to").alias("at"))
        new = checkpointed(ahead.join(marks, ["key", "at"], "left_anti").distinct())
        if not new.take(1):
            return marks
        marks = marks.union(new)
        further = steps.select("key", F.col("at").alias("to"), F.col("to").alias("_to"))
        steps = checkpointed(steps.join(further, ["key", "to"]).select("key", "at", F.col("_to").alias("to")))


def cooldown(events: DataFrame, key: str, at: str, number: str, quiet: int, piece: int = DAY) -> DataFrame:
    """(key, at) of the events that fire, one row each: a key's first one, and each first one at least `quiet` microseconds after the
    last that fired. Events are in the order of time and number; rows equal in all three are one."""
    e = events.select(F.col(key).alias("key"), micros(at).alias("t"), F.col(number).cast("long").alias("s"), F.col(at).alias("_at")).dropDuplicates(["key", "t", "s"])
    items = e.select("key", "t", "s", F.struct("t", "s").alias("item"))
    # what lies at the end of the quiet time fires
    probes = e.select("key", (F.col("t") + quiet).alias("t"), F.lit(-(1 << 63)).cast("long").alias("s"), F.struct("t", "s").alias("at"))
    pointers = first_after(probes, items, piece).select("key", "at", F.col("found").alias("to"))
    fired = reached(e.groupBy("key").agg(F.min(F.struct("t", "s")).alias("at")), pointers)
    out = fired.select("key", F.col("at.t").alias("t"), F.col("at.s").alias("s")).join(e, ["key", "t", "s"])
    return out.select(F.col("key").alias(key), F.col("_at").alias(at))


def n_in_window(events: DataFrame, key: str, at: str, number: str, n: int, window: int) -> DataFrame:
    """(key, first, at) of the firings: an event that is the n-th within `window` microseconds, none of the n having been part of an
    earlier firing. Events are in the order of time and number; rows equal in all three are one. first: the time of the first of the n.

    The events of the n - 1 places before are found within pieces of time as long as the window, each with the events of the piece
    before that a window can still reach."""
    e = events.select(F.col(key).alias("key"), micros(at).alias("t"), F.col(number).cast("long").alias("s"), F.col(at).alias("_at")).dropDuplicates(["key", "t", "s"])
    own = F.floor(F.col("t") / window)
    near = e.select("*", F.explode(F.array(own, own + 1)).alias("_piece"))
    before = F.lag(F.struct("t", "s", "_at"), n - 1).over(Window.partitionBy("key", "_piece").orderBy("t", "s"))
    full = near.withColumn("_from", before).where((F.col("_piece") == own) & (F.col("t") - F.col("_from.t") <= window))
    full = checkpointed(full.select("key", "t", "s", "_at", "_from"))
    # after a firing the next one has its first event after it
    items = full.select("key", F.col("_from.t").alias("t"), F.col("_from.s").alias("s"), F.struct("t", "s").alias("item"))
    probes = full.select("key", "t", "s", F.struct("t", "s").alias("at"))
    pointers = first_after(probes, items, max(window, DAY)).select("key", "at", F.col("found").alias("to"))
    fired = reached(full.groupBy("key").agg(F.min(F.struct("t", "s")).alias("at")), pointers)
    out = fired.select("key", F.col("at.t").alias("t"), F.col("at.s").alias("s")).join(full, ["key", "t", "s"])
    return out.select(F.col("key").alias(key), F.col("_from._at").alias("first"), F.col("_at").alias(at))
