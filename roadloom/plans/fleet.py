"""Fleet, alerts, risk, maintenance: the business queries. Customers are vehicles, nations fleets, regions tenants, orders alerts and
bookings, suppliers depots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.functions.hashing import sha_group
from roadloom.functions.numbers import half_up
from roadloom.operators import planning, ranks
from roadloom.operators.rollups import once
from roadloom.sources.tables import TenantView, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _fleet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def page(rows: DataFrame, order: list[Column], size: int, after: Column | None = None) -> DataFrame:
    """A page by its key: the rows after the cursor in the order, and one more than asked, which tells that there are more."""
    return (rows if after is None else rows.where(after)).orderBy(*order).limit(size + 1)


@query("SELECT n_name AS fleet, r_name AS tenant, count(DISTINCT c_custkey) AS vehicles, count(DISTINCT s_suppkey) AS depots FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2")
def fleet_list_with_counts(spark: SparkSession, sf: str) -> DataFrame:
    """All fleets, the empty ones too. Each side is counted before it meets the fleets."""
    count = lambda name, key, what: table(spark, sf, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(what))
    fleets = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = fleets.join(count("customer", "c_nationkey", "vehicles"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "depots"), "n_nationkey", "left")
    return out.select(F.col("n_name").alias("fleet"), F.col("r_name").alias("tenant"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("vehicles", "depots")])


@query("SELECT c_custkey AS id, c_name AS vin, n_name AS fleet, c_mktsegment AS powertrain FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND c_name LIKE 'Customer%' AND c_custkey > 100 ORDER BY 1 LIMIT 51")
def vehicle_list_filtered_keyset(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fleet(spark, sf).where((F.col("c_mktsegment") == "BUILDING") & F.col("c_name").startswith("Customer"))
    rows = rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("vin"), F.col("n_name").alias("fleet"), F.col("c_mktsegment").alias("powertrain"))
    return page(rows, [F.col("id")], 50, F.col("id") > 100)


@query("SELECT c_custkey AS id, c_name AS vin FROM customer ORDER BY 1 LIMIT 51 OFFSET 60")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("vin")).orderBy("id").offset(60).limit(51)


@query("SELECT o_orderkey AS id, o_orderdate AS opened_at, o_orderpriority AS severity, c_name AS vin FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND (o_orderdate, o_orderkey) < (TIMESTAMP '1999-06-01', 500) ORDER BY opened_at DESC, id DESC LIMIT 51")
def alert_list_keyset_desc(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderstatus = 'O'").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("opened_at"), F.col("o_orderpriority").alias("severity"), F.col("c_name").alias("vin"))
    return page(rows, [F.desc("opened_at"), F.desc("id")], 50, F.expr("(opened_at < timestamp_ntz'1999-06-01' OR (opened_at = timestamp_ntz'1999-06-01' AND id < 500))"))


RISK = "(SELECT o_custkey AS vehicle_id, o_orderkey, (o_orderkey % 1000) / 1000.0::DOUBLE AS p, o_totalprice AS saving, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)"


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    """The latest score of each vehicle."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("vehicle_id")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x"))
    return o.select("vehicle_id", ((F.col("x.o_orderkey") % 1000) / F.lit(1000.0)).alias("p"), F.col("x.o_totalprice").alias("saving"))


@query(f"SELECT vehicle_id, p, c_name AS vin, n_name AS fleet FROM {RISK} JOIN customer ON c_custkey = vehicle_id JOIN nation ON n_nationkey = c_nationkey WHERE rn = 1 ORDER BY p DESC, vehicle_id LIMIT 51")
def at_risk_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _risk(spark, sf).join(_fleet(spark, sf), F.col("vehicle_id") == F.col("c_custkey"))
    return rows.select("vehicle_id", "p", F.col("c_name").alias("vin"), F.col("n_name").alias("fleet")).orderBy(F.desc("p"), "vehicle_id").limit(51)


@query(f"SELECT vehicle_id, p, saving FROM {RISK} WHERE rn = 1 AND (p < 0.8 OR (p = 0.8 AND vehicle_id > 40)) ORDER BY p DESC, saving DESC NULLS LAST, vehicle_id LIMIT 51")
def at_risk_topk_mixed_keyset(spark: SparkSession, sf: str) -> DataFrame:
    return page(_risk(spark, sf), [F.desc("p"), F.desc_nulls_last("saving"), F.col("vehicle_id")], 50, F.expr("p < 0.8 OR (p = 0.8 AND vehicle_id > 40)"))


@query("SELECT o_orderkey AS id, o_custkey AS vehicle_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)")
def tenant_filtered_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    vehicles = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("vehicle_id"), F.col("n_regionkey").alias("tenant_id"))
    alerts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("vehicle_id"))
    return TenantView(2, {"vehicle": vehicles, "alert": alerts}, through={"alert": ("vehicle", "vehicle_id")})["alert"].select("id", "vehicle_id")


@query(f"SELECT vehicle_id, floor((p * saving - 150) * 100 + 0.5) / 100 AS value FROM {RISK} r WHERE rn = 1 AND p * saving > 150 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = r.vehicle_id AND o.o_orderdate >= TIMESTAMP '2001-01-01' AND o.o_orderstatus = 'O')")
def candidates_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    booked = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'2001-01-01' AND o_orderstatus = 'O'").select(F.col("o_custkey").alias("vehicle_id"))
    value = planning.expected_value(F.col("p"), F.col("saving"), 150.0)
    return _risk(spark, sf).join(booked, "vehicle_id", "left_anti").where(value > 0).select("vehicle_id", half_up(value, 2).alias("value"))


@query("SELECT o_orderpriority AS severity, count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY 1")
def alerts_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") != "F").alias("open"))


@query(f"SELECT count(*) FILTER (p >= 0.8) AS urgent, count(*) FILTER (p < 0.8 AND p * saving > 150) AS worth, count(*) FILTER (p < 0.8 AND NOT p * saving > 150) AS rest, floor(sum(p) * 1000 + 0.5) / 1000 AS expected FROM {RISK} WHERE rn = 1")
def filtered_counts_bands(spark: SparkSession, sf: str) -> DataFrame:
    worth = F.col("p") * F.col("saving") > 150
    return _risk(spark, sf).agg(F.count_if(F.col("p") >= 0.8).alias("urgent"), F.count_if((F.col("p") < 0.8) & worth).alias("worth"), F.count_if((F.col("p") < 0.8) & ~worth).alias("rest"), half_up(F.sum("p"), 3).alias("expected"))


@query("""SELECT depot, part, floor(mean * 10000 + 0.5) / 10000 AS expected, greatest(floor(mean - 1.645 * sd), 0)::BIGINT AS low, ceil(mean + 1.645 * sd)::BIGINT AS high FROM (
  SELECT n_name AS depot, o_orderpriority AS part, sum(p::DECIMAL(10,3))::DOUBLE AS mean, sqrt(sum((p * (1 - p))::DECIMAL(12,6))::DOUBLE) AS sd FROM (SELECT *, (o_orderkey % 1000)::DECIMAL(10,3) / 1000 AS p FROM orders) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""")
def bernoulli_parts_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Failures as independent trials: mean and deviation of their number, and the band that holds it nine times in ten."""
    o = table(spark, sf, "orders").select("o_custkey", F.col("o_orderpriority").alias("part"), (F.col("o_orderkey") % 1000).alias("m"))
    vehicles = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("depot"))
    s = o.join(vehicles, F.col("o_custkey") == F.col("c_custkey")).groupBy("depot", "part").agg((F.sum("m") / 1000.0).alias("mean"), F.sqrt(F.sum(F.col("m") * (1000 - F.col("m"))) / 1e6).alias("sd"))
    return s.select("depot", "part", half_up(F.col("mean"), 4).alias("expected"), F.greatest(F.floor(F.col("mean") - 1.645 * F.col("sd")), F.lit(0)).cast("bigint").alias("low"), F.ceil(F.col("mean") + 1.645 * F.col("sd")).cast("bigint").alias("high"))


@query("SELECT part, " + ", ".join(f"coalesce(sum(n) FILTER (r = {i}), 0)::BIGINT AS depot_{i}" for i in range(5)) + ", sum(n)::BIGINT AS total FROM (SELECT o_orderpriority AS part, n_regionkey AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1 ORDER BY total DESC, part")
def parts_pivot(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    grid = o.groupBy(F.col("o_orderpriority").alias("part")).pivot("n_regionkey", list(range(5))).agg(F.count(F.lit(1)))
    cells = [F.coalesce(f"`{i}`", F.lit(0)) for i in range(5)]
    return grid.select("part", *[c.alias(f"depot_{i}") for i, c in enumerate(cells)], sum(cells[1:], cells[0]).alias("total")).orderBy(F.desc("total"), "part")


@query("SELECT (o_orderdate + INTERVAL 330 MINUTE)::DATE AS day, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def bookings_local_day(spark: SparkSession, sf: str) -> DataFrame:
    local = F.to_date(F.from_utc_timestamp(F.col("o_orderdate").cast("timestamp"), "Asia/Kolkata"))
    return table(spark, sf, "orders").groupBy(local.alias("day"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS depot, d AS day, coalesce(n, 0) AS booked, greatest(2 - coalesce(n, 0), 0) AS free FROM supplier CROSS JOIN range(1, 8) t(d)
  LEFT JOIN (SELECT o_custkey AS depot, day(o_orderdate) AS day, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01' GROUP BY 1, 2) b ON b.depot = s_suppkey AND b.day = d""")
def plan_grid_with_empty_cells(spark: SparkSession, sf: str) -> DataFrame:
    grid = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("depot"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint"))).alias("day"))
    booked = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1998-01-01' AND o_orderdate < timestamp_ntz'1998-02-01'").groupBy(F.col("o_custkey").alias("depot"), F.day("o_orderdate").cast("bigint").alias("day")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(booked, ["depot", "day"], "left").select("depot", "day", n.alias("booked"), F.greatest(2 - n, F.lit(0)).cast("bigint").alias("free"))


@query("""SELECT b.o_orderkey AS breakdown, r.o_orderkey AS repair, date_diff('day', b.o_orderdate, r.o_orderdate) AS days FROM orders b LEFT JOIN orders r ON r.o_custkey = b.o_custkey AND r.o_orderpriority = b.o_orderpriority AND r.o_orderstatus = 'O' AND r.o_orderdate > b.o_orderdate WHERE b.o_orderstatus = 'F'""")
def repair_after_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    b = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("breakdown"), "o_custkey", "o_orderpriority", F.col("o_orderdate").alias("at"))
    r = o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("repair"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("q"), F.col("o_orderdate").alias("repaired"))
    on = (F.col("c") == F.col("o_custkey")) & (F.col("q") == F.col("o_orderpriority")) & (F.col("repaired") > F.col("at"))
    return b.join(r, on, "left").select("breakdown", "repair", F.datediff("repaired", "at").cast("bigint").alias("days"))


@query("SELECT a.c_custkey AS vehicle, b.s_suppkey AS driver FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) a JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS rn FROM supplier) b USING (rn)")
def zip_join_row_number(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables side by side, each numbered by ranges of its key."""
    a = ranks.placed(table(spark, sf, "customer").select("c_custkey"), ["c_custkey"])
    b = ranks.placed(table(spark, sf, "supplier").select("s_suppkey", (-F.col("s_suppkey")).alias("back")), ["back"])
    return a.join(b, "upto").select(F.col("c_custkey").alias("vehicle"), F.col("s_suppkey").alias("driver"))


@query("SELECT id, vin FROM (SELECT c_custkey AS id, c_name AS vin, row_number() OVER (ORDER BY c_custkey) AS rn, count(*) OVER () AS n FROM customer) WHERE (rn - 1) % greatest(1, n // 40) = 0")
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every so manieth row in the order of the key, numbered by ranges of it."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("vin"))
    total = c.agg(F.count("*").alias("n"))
    rows = ranks.placed(c, ["id"]).join(F.broadcast(total))  # one row
    return rows.where((F.col("upto") - 1) % F.greatest(F.lit(1), F.expr("n div 40")) == 0).select("id", "vin")


@query("SELECT o_orderkey AS id, o_orderpriority AS component, floor((o_totalprice - m) * 100 + 0.5) / 100 AS above FROM orders JOIN (SELECT o_orderpriority AS q, floor(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) * 100 + 0.5) / 100 AS m FROM orders GROUP BY 1) ON q = o_orderpriority")
def mean_cost_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    mean = o.groupBy(F.col("o_orderpriority").alias("component")).agg(half_up(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*"), 2).alias("m"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("component"), "o_totalprice")
    return rows.join(mean, "component", "left").select("id", "component", half_up(F.col("o_totalprice") - F.col("m"), 2).alias("above"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS at FROM orders ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderdate END DESC NULLS LAST, o_orderdate, o_orderkey LIMIT 100")
def inspections_conditional_sort(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return o.orderBy(done.desc_nulls_last(), "o_orderdate", "o_orderkey").limit(100).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))


@query("SELECT o_orderkey AS id, src FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY src) AS rn FROM (SELECT o_orderkey, o_orderdate, 0 AS src FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_orderdate, 1 FROM orders WHERE o_orderpriority = '1-URGENT')) WHERE rn = 1 ORDER BY src, o_orderdate DESC, o_orderkey LIMIT 50")
def alert_feed_union_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Live alerts and stored ones, each once, live first."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    live, stored = o.where("o_orderstatus = 'O'").withColumn("src", F.lit(0)), o.where("o_orderpriority = '1-URGENT'").withColumn("src", F.lit(1))
    one = live.unionByName(stored).groupBy("o_orderkey", "o_orderdate").agg(F.min("src").alias("src"))
    return one.orderBy("src", F.desc("o_orderdate"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("id"), "src")


@query("SELECT DISTINCT o_custkey AS dedup_key FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "dedup_key")
    return once(o.where("o_orderstatus = 'O'").select("dedup_key"), o.where("o_orderstatus = 'P'"), "dedup_key")


BOOKINGS = "(SELECT o_orderkey AS id, o_custkey % 120 AS vehicle, o_custkey % 9 AS depot, (o_orderkey % 6)::INT AS day FROM orders)"


@query(f"""SELECT b.id, b.vehicle, b.depot, b.day, CASE WHEN again > 1 THEN 'duplicate_vehicle' WHEN v.vehicle IS NULL THEN 'foreign_vehicle' WHEN s.depot IS NULL THEN 'foreign_depot' WHEN k.vehicle IS NOT NULL THEN 'already_booked' WHEN b.day < 1 THEN 'past_day' WHEN place > coalesce(f.free, 0) THEN 'over_capacity' END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY id) AS again, row_number() OVER (PARTITION BY depot, day ORDER BY id) AS place FROM {BOOKINGS}) b
  LEFT JOIN (SELECT c_custkey AS vehicle FROM customer) v ON v.vehicle = b.vehicle LEFT JOIN (SELECT s_suppkey AS depot FROM supplier) s ON s.depot = b.depot
  LEFT JOIN (SELECT c_custkey AS vehicle FROM customer WHERE c_custkey % 10 = 4) k ON k.vehicle = b.vehicle LEFT JOIN (SELECT s_suppkey AS depot, d AS day, 2 + s_suppkey % 3 AS free FROM supplier CROSS JOIN range(1, 6) t(d)) f ON f.depot = b.depot AND f.day = b.day""")
def booking_capacity_check(spark: SparkSession, sf: str) -> DataFrame:
    o, c, s = (table(spark, sf, t) for t in ("orders", "customer", "supplier"))
    requests = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 120).alias("vehicle"), (F.col("o_custkey") % 9).alias("depot"), (F.col("o_orderkey") % 6).cast("int").alias("day"))
    free = s.select(F.col("s_suppkey").alias("depot"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("day"), (2 + F.col("s_suppkey") % 3).alias("free"))
    return planning.check_bookings(requests, c.select(F.col("c_custkey").alias("vehicle")), free, c.where("c_custkey % 10 = 4").select(F.col("c_custkey").alias("vehicle")), 1)


@query("SELECT o_orderkey::VARCHAR AS action, a.c_name AS requested_by, b.c_name AS decided_by FROM orders LEFT JOIN customer a ON a.c_custkey::VARCHAR = o_custkey::VARCHAR LEFT JOIN customer b ON b.c_custkey = (o_orderkey % 5000) WHERE o_orderstatus = 'P'")
def proposal_audit_join(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    a = c.select(F.col("c_custkey").cast("string").alias("ak"), F.col("c_name").alias("requested_by"))
    b = c.select(F.col("c_custkey").alias("bk"), F.col("c_name").alias("decided_by"))
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return o.join(a, F.col("o_custkey").cast("string") == F.col("ak"), "left").join(b, F.col("o_orderkey") % 5000 == F.col("bk"), "left").select(F.col("o_orderkey").cast("string").alias("action"), "requested_by", "decided_by")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND list_contains(['1-URGENT', '2-HIGH'], o_orderpriority) AND (NULL IS NULL OR o_custkey = NULL) AND o_totalprice IS NOT NULL")
def null_tolerant_filters(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(table(spark, sf, "orders"), not_status="F", severities=["1-URGENT", "2-HIGH"], vehicle=None).where("o_totalprice IS NOT NULL").select(F.col("o_orderkey").alias("id"))


def alerts(rows: DataFrame, not_status: str | None = None, severities: list[str] | None = None, vehicle: int | None = None) -> DataFrame:
    """Alerts by the filters that are given."""
    for given, condition in ((not_status, lambda v: F.col("o_orderstatus") != v), (severities, lambda v: F.col("o_orderpriority").isin(v)), (vehicle, lambda v: F.col("o_custkey") == v)):
        rows = rows if given is None else rows.where(condition(given))
    return rows


@query(f"SELECT vehicle_id, p, floor(p * saving * 100 + 0.5) / 100 AS value FROM {RISK} WHERE rn = 1 ORDER BY (p >= 0.8) DESC, p * saving DESC, vehicle_id LIMIT 20")
def sorted_limits(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("p") * F.col("saving")
    return _risk(spark, sf).orderBy((F.col("p") >= 0.8).desc(), value.desc(), "vehicle_id").limit(20).select("vehicle_id", "p", half_up(value, 2).alias("value"))


@query("SELECT c_custkey AS vin, (list_reduce(list_transform(range(1, 65), lambda i: strpos('0123456789abcdef', substr(sha256(c_custkey::VARCHAR), i, 1)) - 1), lambda a, x: (a * 16 + x) % 10))::INT AS grp FROM customer")
def vin_group_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("vin"), sha_group(F.col("c_custkey")).alias("grp"))
