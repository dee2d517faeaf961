"""Feed drift: the population stability index over the baseline's deciles, peers, and hints at mistaken units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.operators.ranks import quantiles


def psi(rows: DataFrame, group: str, value: str, current: str, floor: float = 1e-4) -> DataFrame:
    """(group, psi, baseline_mean, current_mean, baseline_n, current_n). rows: a boolean column `current` tells the sample. Edges are
    the baseline's deciles, equal ones merged; a value on an edge belongs to the bin above; shares are `floor` at least. Nulls
    belong to no bin. The edges, nine a group, come from one aggregation and meet the values by a join on the group."""
    rows = rows.where(F.col(value).isNotNull() & F.col(current).isNotNull())
    cuts = [i / 10 for i in range(1, 10)]
    edges = quantiles(rows.where(~F.col(current)), value, cuts, [group]).select(group, F.array_distinct("q").alias("_edges"))
    binned = rows.join(edges, group).withColumn("_bin", F.size(F.filter("_edges", lambda e: e <= F.col(value))))
    sums = binned.groupBy(group, "_bin").agg(F.first("_edges").alias("_edges"), F.count_if(~F.col(current)).alias("b"), F.count_if(F.col(current)).alias("c"), F.sum(F.when(~F.col(current), F.col(value))).alias("bs"), F.sum(F.when(F.col(current), F.col(value))).alias("cs"))
    total = sums.groupBy(group).agg(F.sum("b").alias("baseline_n"), F.sum("c").alias("current_n"), (F.sum("bs") / F.sum("b")).alias("baseline_mean"), (F.sum("cs") / F.nullif(F.sum("c"), F.lit(0))).alias("current_mean"), F.first(F.size("_edges")).alias("_n"), F.collect_list(F.struct("_bin", "b", "c")).alias("_bins"))
    share = lambda x, n: F.greatest(x / n, F.lit(floor))
    term = lambda b, c: (share(c, F.col("current_n")) - share(b, F.col("baseline_n"))) * F.log(share(c, F.col("current_n")) / share(b, F.col("baseline_n")))
    # bins that neither sample fills add nothing: both shares are the floor
    return total.select(group, F.aggregate("_bins", F.lit(0.0), lambda a, x: a + term(x.b, x.c)).alias("psi"), "baseline_mean", "current_mean", "baseline_n", "current_n")


def classify(drift: DataFrame, peers_of: list[str], who: str, watch: float = 0.1, drifted: float = 0.25) -> DataFrame:
    """Adds `peers`, the median of the other groups' psi for the same field, and `status`: DRIFT or WATCH where psi is over the
    bound and over the peers' by the bound, else OK. One with no peers is judged alone."""
    left, right = drift.alias("l"), drift.select(*[F.col(c).alias(f"_{c}") for c in (*peers_of, who, "psi")])
    other = [F.col(f"l.{c}") == F.col(f"_{c}") for c in peers_of] + [F.col(f"l.{who}") != F.col(f"_{who}")]
    on = other[0]
    for c in other[1:]:
        on = on & c
    joined = left.join(right, on, "left").groupBy(*[f"l.{c}" for c in drift.columns]).agg(F.percentile("_psi", 0.5).alias("peers"))
    over = lambda bound: (F.col("psi") > bound) & (F.col("psi") - F.coalesce("peers", F.lit(0.0)) > bound)
    return joined.withColumn("status", F.when(over(drifted), "DRIFT").when(over(watch), "WATCH").otherwise("OK"))


#: Bands of the ratio of means that look like another unit.
MILES, TWICE, THOUSANDTHS = (0.55, 0.70), (1.45, 1.80), (900, 1100)


def unit_hint(field: Column, baseline: Column, current: Column, fleet_ratio: Column | float = 1.0) -> Column:
    """What a mean's change looks like, once the change of all makers (`fleet_ratio`) is divided out: miles for kilometres or twice
    converted speeds, degrees Fahrenheit, thousandths; null where it looks like none."""
    ratio = current / F.when(F.abs(baseline) >= 1e-6, baseline) / fleet_ratio
    speed, coolant = field == "speed_kmh", field == "coolant_c"
    within = lambda band: (ratio > band[0]) & (ratio < band[1])
    return (
        F.when(speed & within(MILES), "miles for kilometres")
        .when(speed & within(TWICE), "converted twice")
        .when(coolant & (F.abs(current - (baseline * 9 / 5 + 32)) < 0.1 * current), "Fahrenheit for Celsius")
        .when(within(THOUSANDTHS), "thousandths")
    )


def moving_only(value: Column, speed: Column) -> Column:
    """The value while the vehicle moves; NaN is no speed."""
    return F.when((speed > 0) & ~F.isnan(speed), value)


def covered(rows: DataFrame, group: str, ts: str, minutes: int, least: float = 0.9) -> DataFrame:
    """Groups with readings in enough distinct minutes."""
    return rows.groupBy(group).agg(F.countDistinct(F.date_trunc("minute", ts)).alias("minutes")).where(F.col("minutes") >= least * minutes)


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores: by the sample deviation, 1 where it is 0; nulls become 0 afterwards."""
    stats = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    z = lambda c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0), F.lit(0.0)).alias(c)
    return rows.join(F.broadcast(stats)).select(*[z(c) if c in columns else F.col(c) for c in rows.columns])  # one row
