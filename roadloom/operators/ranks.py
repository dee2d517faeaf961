"""Ranks and quantiles over whole tables, in ranges of the value: no task sees a group, however large it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.sources.tables import checkpointed


def placed(rows: DataFrame, order: list[str], group: list[str] = [], weight: str | None = None) -> DataFrame:  # noqa: B006
    """The rows with `upto`: the number (or the weight) of the rows of the group up to and with this one, in the order, which must tell
    all rows apart. Rows are dealt by ranges of group and order; each range is summed by itself, and what lies before it, one row a
    range and group, is added. The dealt rows are cut off once, so that both looks at them see the same ranges."""
    w = F.lit(1) if weight is None else F.col(weight)
    dealt = checkpointed(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sizes = dealt.groupBy("_part", *group).agg(F.sum(w).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")  # a row for each range and group
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    offsets = offsets.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], "_before")
    return dealt.withColumn("_own", F.sum(w).over(inside)).join(offsets, same).withColumn("upto", F.col("_own") + F.col("_before")).select(*rows.columns, "upto")


def quantiles(rows: DataFrame, value: str, cuts: list[float], group: list[str] = []) -> DataFrame:  # noqa: B006
    """(group, n, q): the exact quantiles of a group's values at the cuts, an array, interpolated between the two next ranks; nulls
    don't count. Equal values are counted first, so a group's work is that of its distinct values, spread over ranges."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    ranked = placed(counts, [value], group, "_c")
    n = ranked.groupBy(*group).agg(F.max("upto").alias("n"))
    met = ranked.join(n.select(*[F.col(g).alias(f"_n_{g}") for g in group], "n"), _all_same(group, "_n_"))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col(value)))

    picks = []
    for i, q in enumerate(cuts):
        place = q * (F.col("n") - 1)
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
    out = met.groupBy(*group, "n").agg(*picks)
    between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))) for i, q in enumerate(cuts)]
    return out.select(*group, "n", F.array(*between).alias("q"))


def _all_same(group: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"{prefix}{g}"))
    return on
