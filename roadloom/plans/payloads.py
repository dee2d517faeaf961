"""Payloads: mappings over JSON, validation, dead letters, identifiers, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo, vehicles
from roadloom.functions.numbers import half_even, half_up
from roadloom.functions.payload import TRANSFORMS, lookup
from roadloom.functions.text import PHRASES, suspicious
from roadloom.operators import normalize as norm
from roadloom.sources.tables import table, telemetry

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: A mapping over the payloads that `raw` makes from events: nested objects, a list of named signals, codes in a text.
MAPPING = {
    "oem": "ACME", "version": 1,
    "fields": {
        "vin": {"path": "vehicle.id"}, "seq": {"path": "n", "transform": "number"}, "ts": {"path": "t", "transform": "epoch_ms"}, "lat": {"path": "gps[0]", "transform": "number"}, "lon": {"path": "gps[1]", "transform": "number"},
        "speed_kmh": {"path": "signals[name=SPEED].value", "transform": "mph_to_kmh"}, "coolant_c": {"path": "signals[name=ECT].value", "transform": "f_to_c"}, "soc_pct": {"path": "soc", "transform": "fraction_to_pct"},
        "engine_on": {"path": "state", "transform": "map", "map": {"view": "true", "*": "false"}}, "dtc": {"path": "codes", "transform": "csv_list"}, "evt": {"const": "PERIODIC"},
    },
}
#: The parts of a valid identification number for each vehicle, and its check character in SQL.
_VIN = "'1HGCM826' || '0' || lpad((vin % 100000)::VARCHAR, 8, '0')"
NOW = "2024-02-01 00:00:00"


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of one maker from the events: some malformed, some of another maker, some out of range."""
    t = telemetry(spark, sf)
    vin = vehicles.vin_from_parts(F.lit("1HG"), F.lit("CM826"), F.lpad((F.col("vin") % 100000).cast("string"), 8, "0"))
    seq = F.when(F.col("seq") % 41 == 0, -1).otherwise(F.col("seq"))
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    signals = F.array(F.struct(F.lit("ECT").alias("name"), F.col("reading").alias("value")), F.struct(F.lit("SPEED").alias("name"), (F.col("level") + F.when(F.col("seq") % 43 == 0, 500).otherwise(0)).alias("value")))
    body = F.to_json(F.struct(F.struct(vin.alias("id")).alias("vehicle"), seq.alias("n"), millis.alias("t"), F.array((F.col("level") * 0.5).alias("a"), F.col("level") * 1.5).alias("gps"), signals.alias("signals"), (F.col("level") / 100.0).alias("soc"), F.col("evt").alias("state"), F.concat(F.lit("P0301; u0100,p0301"), F.when(F.col("seq") % 47 == 0, F.lit(" Z9")).otherwise("")).alias("codes")))
    value = F.when(F.col("seq") % 53 == 0, F.concat(F.lit("{"), body)).otherwise(body)
    return t.select(F.when(F.col("seq") % 59 == 0, "OTHER").otherwise("acme").alias("oem"), value.alias("value"), F.col("seq").alias("offset"))


_REASON = "CASE WHEN seq % 59 = 0 THEN 'UNMAPPED_OEM' WHEN seq % 53 = 0 THEN 'MALFORMED_JSON' WHEN seq % 47 = 0 THEN 'DTC_INVALID' WHEN seq % 41 = 0 THEN 'SEQ_NEGATIVE' WHEN ts < TIMESTAMP '2024-01-25' THEN 'TS_TOO_OLD' WHEN level * 0.5 > 90 OR level * 1.5 > 180 THEN 'GEO_OUT_OF_RANGE' WHEN level = 0 THEN 'GEO_NULL_ISLAND' WHEN (level + CASE WHEN seq % 43 = 0 THEN 500 ELSE 0 END) * 1.609344 > 300 THEN 'SPEED_OUT_OF_RANGE' WHEN level > 100 THEN 'PCT_OUT_OF_RANGE' END"
_EVENTS = "(SELECT user_id AS vin, event_id AS seq, ts, event_type AS evt, value AS reading, json_extract(props, '$.k')::INT AS level FROM events)"


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    return norm.normalize(raw(spark, sf), norm.latest_mappings([MAPPING]), F.lit(NOW).cast("timestamp"))


@query(f"SELECT seq, floor(level * 1.609344::DOUBLE * 10 + 0.5) / 10 AS speed_kmh, floor((reading - 32) * 5.0::DOUBLE / 9.0 * 100 + 0.5) / 100 AS coolant_c, evt = 'view' AS engine_on, 'P0301,U0100' AS dtc FROM {_EVENTS} WHERE {_REASON} IS NULL")
def normalize_props(spark: SparkSession, sf: str) -> DataFrame:
    return norm.good(_normalized(spark, sf)).select("seq", "speed_kmh", "coolant_c", "engine_on", F.array_join("dtc", ",").alias("dtc"))


@query(f"SELECT {_REASON} AS dlq_reason, count(*) AS n FROM {_EVENTS} WHERE {_REASON} IS NOT NULL GROUP BY 1")
def dlq_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return norm.dead_letters(_normalized(spark, sf)).groupBy("dlq_reason").agg(F.count("*").alias("n"))


@query(f"SELECT {_REASON} AS reason, count(*) AS n, min(seq) AS first_offset FROM {_EVENTS} GROUP BY 1")
def mapping_preview(spark: SparkSession, sf: str) -> DataFrame:
    return norm.preview(_normalized(spark, sf), "offset").select("reason", "n", F.col("first").alias("first_offset"))


@query(f"SELECT seq AS \"offset\" FROM (SELECT *, row_number() OVER (PARTITION BY seq % 4 ORDER BY seq DESC) AS rn FROM {_EVENTS} WHERE {_REASON} IS NOT NULL) WHERE rn <= 500 AND {_REASON} = 'UNMAPPED_OEM' ORDER BY 1 DESC LIMIT 200")
def dlq_tail_sample(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    letters = norm.dead_letters(_normalized(spark, sf)).withColumn("partition", F.col("offset") % 4)
    newest = letters.withColumn("rn", F.row_number().over(Window.partitionBy("partition").orderBy(F.desc("offset")))).where("rn <= 500")
    return newest.where("dlq_reason = 'UNMAPPED_OEM'").orderBy(F.desc("offset")).limit(200).select("offset")


@query(f"SELECT count(*) AS n, count(*) FILTER (ts < TIMESTAMP '2024-01-25' AND seq % 53 <> 0 AND seq % 47 <> 0 AND seq % 41 <> 0) AS too_old FROM {_EVENTS} WHERE seq % 59 = 0")
def dlq_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Letters that waited for a mapping, again after its arrival: old ones are too old by then."""
    letters = norm.dead_letters(_normalized(spark, sf))
    again = norm.replay(letters, norm.latest_mappings([{**MAPPING, "oem": "OTHER"}]), "OTHER", F.lit(NOW).cast("timestamp"))
    return again.agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "TS_TOO_OLD").alias("too_old"))


@query(f"SELECT seq, json_extract_string(props, '$.k') AS k, (json_extract(props, '$.k')::INT) * 100 AS pct, NULL::VARCHAR AS missing FROM (SELECT event_id AS seq, props FROM events)")
def json_path_functions(spark: SparkSession, sf: str) -> DataFrame:
    t = telemetry(spark, sf).withColumn("v", F.try_parse_json("props"))
    k = lookup(F.col("v"), "k").text
    return t.select("seq", k.alias("k"), TRANSFORMS["fraction_to_pct"](k).cast("int").alias("pct"), lookup(F.col("v"), "k[0].x").text.alias("missing"))


@query("""SELECT event_id AS seq, '{"seq":' || event_id || ',"evt":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"late":' || (event_id % 2 = 0)::VARCHAR || '}' AS merged FROM events""")
def json_build_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A document built from columns, with the fields of the payload and of a patch; a later field of the same name takes the place of
    an earlier one."""
    t = telemetry(spark, sf)
    entry = lambda **fields: F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*[F.to_json(F.struct(v.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(v.alias("x")))) - 6) for v in fields.values()]))
    first, patch = entry(seq=F.col("seq"), evt=F.col("evt"), k=F.lit(-1)), entry(k=F.col("level"), late=F.col("seq") % 2 == 0)
    kept = F.map_concat(F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(patch), k)), patch)
    text = F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return t.select("seq", F.concat(F.lit("{"), text, F.lit("}")).alias("merged"))


@query("""SELECT event_id AS seq, ['C' || (event_id % 7), 'D' || (event_id % 5)] AS codes, 2 - (event_id % 3 = 0)::BIGINT AS n FROM events""")
def json_array_explode(spark: SparkSession, sf: str) -> DataFrame:
    """All codes of a list in a payload, by [*]; an entry without the field counts for nothing."""
    code = lambda letter, m: F.concat(F.lit(f'{{"c":"{letter}'), (F.col("seq") % m).cast("string"), F.lit('"}'))
    payload = F.concat(F.lit('{"d":['), code("C", 7), F.lit(',{"x":1},'), code("D", 5), F.lit("]}"))
    marks = F.concat(F.lit('{"m":[{"t":1},'), F.when(F.col("seq") % 3 == 0, F.lit('{"t":null}')).otherwise(F.lit('{"t":2}')), F.lit("]}"))
    t = telemetry(spark, sf).select("seq", F.parse_json(payload).alias("v"), F.parse_json(marks).alias("w"))
    return t.select("seq", lookup(F.col("v"), "d[*].c").many.alias("codes"), F.size(lookup(F.col("w"), "m[*].t").many).cast("bigint").alias("n"))


_DIGITS = "list_transform(string_split(translate(v, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789'), ''), lambda x: x::INT)"
_CHECK = f"substr('0123456789X', list_sum(list_transform(list_zip({_DIGITS}, [8,7,6,5,4,3,2,10,0,9,8,7,6,5,4,3,2]), lambda p: p[1] * p[2]))::INT % 11 + 1, 1)"


@query(f"""SELECT id, CASE WHEN id % 11 = 0 THEN 'VIN_LENGTH' WHEN id % 13 = 0 THEN 'VIN_ILLEGAL_CHAR' WHEN {_CHECK} <> substr(v, 9, 1) THEN 'VIN_CHECK_DIGIT' END AS reason FROM (SELECT c_custkey AS id, '1HGCM826' || (c_custkey % 10)::VARCHAR || lpad((c_custkey % 100000)::VARCHAR, 8, '0') AS v FROM customer)""")
def vin_check(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    v = F.concat(F.lit("1HGCM826"), (F.col("id") % 10).cast("string"), F.lpad((F.col("id") % 100000).cast("string"), 8, "0"))
    v = F.when(F.col("id") % 11 == 0, F.substr(v, F.lit(1), F.lit(16))).when(F.col("id") % 13 == 0, F.concat(F.lit("I"), F.substr(v, F.lit(2), F.lit(16)))).otherwise(v)
    return c.select("id", vehicles.vin_reason(v).alias("reason"))


_HEX = "lpad(upper(to_hex((c_custkey * 7919) % 65536)), 4, '0')"


@query(f"SELECT c_custkey AS id, substr('PCBU', ((c_custkey * 7919) % 65536 // 16384)::INT + 1, 1) || ((c_custkey * 7919) % 65536 // 4096 % 4)::VARCHAR || substr({_HEX}, 2, 3) AS code, ((c_custkey * 7919) % 65536)::INT AS raw FROM customer")
def dtc_decode(spark: SparkSession, sf: str) -> DataFrame:
    text = F.lpad(F.hex((F.col("c_custkey") * 7919) % 65536), 4, "0")
    code = vehicles.fault_code(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("0x"), F.lower(text))).otherwise(text))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), code.alias("code"), vehicles.fault_code_raw(code).cast("int").alias("raw"))


@query("SELECT c_custkey AS id, 'P0' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || ',U1' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS codes, 2 AS n FROM customer")
def dtc_list_ops(spark: SparkSession, sf: str) -> DataFrame:
    d = F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")
    codes = vehicles.fault_codes_in(F.concat(F.lit("seen p0"), d, F.lit(", then U1"), d, F.lit(" and P0"), d, F.lit(" again; XP0300 is none")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(codes, ",").alias("codes"), F.size(codes).alias("n"))


# Bit i of a geohash: of the longitude's cell for even i, of the latitude's for odd ones.
_BIT = "(CASE WHEN ({i}) % 2 = 0 THEN floor((lon + 180) / 360 * pow(2, ({i}) // 2 + 1)) ELSE floor((lat + 90) / 180 * pow(2, ({i}) // 2 + 1)) END)::BIGINT % 2"
_CHAR = "substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + " + " + ".join(f"{2 ** (4 - b)} * ({_BIT.format(i=f'5 * j + {b}')})" for b in range(5)) + ")::INT, 1)"


@query("SELECT id, " + ", ".join(f"array_to_string(list_transform(range({p}), lambda j: {_CHAR}), '') AS g{p}" for p in (1, 6, 12)) + " FROM (SELECT c_custkey AS id, c_custkey % 170 - 85 + 0.125::DOUBLE AS lat, c_custkey % 350 - 175 + 0.375::DOUBLE AS lon FROM customer)")
def geohash_encode(spark: SparkSession, sf: str) -> DataFrame:
    lat, lon = F.col("c_custkey") % 170 - 85 + 0.125, F.col("c_custkey") % 350 - 175 + 0.375
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), *[geo.geohash(lat, lon, p).alias(f"g{p}") for p in (1, 6, 12)])


_HAV = "2 * 6371 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1)))"
_DEPOTS = "(SELECT s_suppkey AS depot, s_suppkey % 10 * 2.0 AS lat, s_suppkey % 7 * 2.5 AS lon FROM supplier)"


@query(f"SELECT a.depot, b.depot AS near, floor({_HAV} * 1000 + 0.5) / 1000 AS km FROM {_DEPOTS} a JOIN {_DEPOTS} b ON {_HAV} <= 350")
def haversine_depots(spark: SparkSession, sf: str) -> DataFrame:
    from roadloom.operators.planning import nearby

    d = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("depot"), (F.col("s_suppkey") % 10 * 2.0).alias("lat"), (F.col("s_suppkey") % 7 * 2.5).alias("lon"))
    return nearby(d).select("depot", "near", half_up(F.col("km"), 3).alias("km"))


@query(rf"SELECT conv_id, turn, regexp_matches(text, '(?im)({'|'.join(p.replace(chr(39), chr(39) * 2) for p in PHRASES)})') AS suspicious FROM conversations")
def suspicious_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", suspicious(F.col("text")).alias("suspicious"))


@query("SELECT o_orderkey AS id, floor(o_totalprice / 7 * 10 + 0.5) / 10 AS up, floor(-o_totalprice / 7 * 10 + 0.5) / 10 AS down, round_even((o_orderkey % 9) + 0.5, 0) AS even FROM orders")
def java_rounding(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice") / 7
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), half_up(p, 1).alias("up"), half_up(-p, 1).alias("down"), half_even(F.col("o_orderkey") % 9 + F.lit(0.5)).alias("even"))


@query("SELECT c_custkey AS id, upper(trim(c_mktsegment)) AS segment, replace(c_name, '#', '-') AS name, CASE WHEN c_mktsegment LIKE 'B%' THEN 'Fault code ' || c_mktsegment || ' reported' ELSE lower(c_mktsegment) END AS label, abs(floor(c_acctbal))::BIGINT AS balance, coalesce(nullif(c_nationkey, 3), -1) AS nation, DATE '2024-03-01' + (c_custkey % 28)::INT + 1 AS next_day FROM customer")
def scalar_string_date_math(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("c_mktsegment")
    label = F.when(s.startswith("B"), F.concat(F.lit("Fault code "), s, F.lit(" reported"))).otherwise(F.lower(s))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.upper(F.trim(s)).alias("segment"), F.replace("c_name", F.lit("#"), F.lit("-")).alias("name"), label.alias("label"), F.abs(F.floor("c_acctbal")).cast("bigint").alias("balance"), F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(3)), F.lit(-1)).alias("nation"), F.date_add(F.lit("2024-03-01").cast("date"), (F.col("c_custkey") % 28 + 1).cast("int")).alias("next_day"))


_WORDS = ["true", " TRUE ", "on", "Drive", "0", "2.5", "no", "off"]


@query("""SELECT event_id AS seq, ['true', ' TRUE ', 'on', 'Drive', '0', '2.5', 'no', 'off'][event_id % 8 + 1] AS text, event_id % 8 IN (0, 1, 2, 3, 5) AS told FROM events""")
def truth_words(spark: SparkSession, sf: str) -> DataFrame:
    """What counts as true in a payload."""
    text = F.get(F.array(*[F.lit(w) for w in _WORDS]), (F.col("seq") % 8).cast("int"))
    return telemetry(spark, sf).select("seq", text.alias("text"), TRANSFORMS["bool"](text).alias("told"))


@query("""SELECT event_id AS seq, CASE WHEN event_id % 4 < 2 THEN epoch(date_trunc('second', ts))::BIGINT - CASE WHEN event_id % 4 = 1 THEN 7200 ELSE 0 END END AS iso, epoch(date_trunc('second', ts))::BIGINT AS written, epoch(date_trunc('second', ts))::BIGINT AS epoch_s FROM events""")
def times_in_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Points in time as ISO 8601 with a zone (without one, or as a word, there is none), in a format of a mapping, and as seconds."""
    t = telemetry(spark, sf)
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    iso = F.when(F.col("seq") % 4 == 0, F.concat(base, F.lit("Z"))).when(F.col("seq") % 4 == 1, F.concat(base, F.lit("+02:00"))).when(F.col("seq") % 4 == 2, base).otherwise(F.lit("yesterday"))
    seconds = F.unix_seconds(F.date_trunc("second", "ts").cast("timestamp"))
    of = lambda c: F.unix_seconds(c.cast("timestamp"))
    return t.select("seq", of(TRANSFORMS["iso8601"](iso)).alias("iso"), of(TRANSFORMS["datetime"](F.date_format("ts", "dd.MM.yyyy HH-mm-ss"), "dd.MM.yyyy HH-mm-ss")).alias("written"), of(TRANSFORMS["epoch_s"](seconds.cast("string"))).alias("epoch_s"))


@query(f"""SELECT id, made, substr(made, 1, 3) AS maker, true AS fits FROM (SELECT id, substr(v, 1, 8) || {_CHECK} || substr(v, 10) AS made FROM (SELECT c_custkey AS id, ['1HG', 'WVW', 'JTD'][c_custkey % 3 + 1] || 'CM826' || '0' || lpad((c_custkey % 100000)::VARCHAR, 8, '0') AS v FROM customer))""")
def vin_made(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers made from maker, descriptor and serial, with the check character that they ask for; and their makers."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    maker = F.get(F.array(F.lit("1HG"), F.lit("WVW"), F.lit("JTD")), (F.col("id") % 3).cast("int"))
    made = c.select("id", vehicles.vin_from_parts(maker, F.lit("CM826"), F.lpad((F.col("id") % 100000).cast("string"), 8, "0")).alias("made"))
    return made.select("id", "made", vehicles.vin_maker(F.col("made")).alias("maker"), vehicles.vin_reason(F.col("made")).isNull().alias("fits"))
