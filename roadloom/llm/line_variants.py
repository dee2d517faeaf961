"""Operator 6, line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines are copies when they are equal, or, if they are long enough, when the edit distance (insertions, deletions and
substitutions of characters) is 1: then deleting one character from the longer one, or the same place from both, gives the same
text. So a line emits its variants, itself and itself without each single character, as hashed keys; lines that share a key are
joined, the edit distance is verified on their text, and of two copies the later one goes.

Lines that share a variant with the same place left out differ in that place alone, so all of them are copies of each other, and
each only has to meet the earliest of them; a line that is another's variant meets the earliest of those. So a group of thousands
of lines that differ in one character costs its length.

A line of 300 characters has 301 variants, most of them of no use: copies also share, to the character, all that the edit leaves
alone. Lines first emit hashes of their halves, with the length that the shorter copy would have; lines that share one with
another line cut the other half into parts, again and again, and emit hashes of all but one; only where these meet, variants of the
last, short part are emitted. Nothing that the full neighbourhood would find is lost, and a line's work grows in proportion to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import cut, fresh, let, need, read, through_filter

#: Shorter lines are copies only of equal ones: one edit in fewer characters is more than a twentieth of the line.
LEAST_CHARS = 20
#: A region of more characters is cut into parts again, so many at most.
SEGMENT, FAN = 48, 16


def _half_keys(line: Column, size: Column) -> Column:
    """Structs (key, low, size, more): hashes of the beginning and the end that a copy with one edit in the other half shares,
    for shorter copies of this length or one less: floor(s / 2) characters from the front, or the other s - floor(s / 2) from
    the back; and the region left: its place, its size in the shorter copy, and by how much this line is longer."""
    halves = []
    for less in (0, 1):
        s = size - less
        front = F.floor(s / 2).cast("int")
        back = s - front
        halves.append(F.struct(F.xxhash64(s, F.lit(0), F.substr(line, F.lit(1), front)).alias("key"), front.alias("low"), back.alias("size"), F.lit(less).alias("more")))
        halves.append(F.struct(F.xxhash64(s, F.lit(1), F.substr(line, size - back + 1, back)).alias("key"), F.lit(0).alias("low"), front.alias("size"), F.lit(less).alias("more")))
    return F.array(*halves)


def _variants(key: Column, region: Column, more: Column) -> Column:
    """Structs (variant, longer): hashed keys of a region and of what lies around it. A line without `more` emits the region
    without the character at each place, with the place, for lines of its length, and the whole region for longer ones; a line with
    `more` the region without each character, as what a shorter line has there."""
    size = F.length(region)
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    rest = lambda i: F.concat(F.substr(region, F.lit(1), i - 1), F.substr(region, i + 1, size))
    entry = lambda h, longer: F.struct(h.alias("variant"), F.lit(longer).alias("longer"))
    own = F.concat(F.array(entry(F.xxhash64(key, F.lit(0), region), 0)), F.transform(places, lambda i: entry(F.xxhash64(key, i, rest(i)), 0)))
    return F.when(more == 0, own).otherwise(F.transform(places, lambda i: entry(F.xxhash64(key, F.lit(0), rest(i)), 1)))


def lines_of(docs: DataFrame) -> DataFrame:
    """(h, doc, key, place, line, size) for each line with a character that is not white space, of (doc, key, text)."""
    lines = docs.select("doc", "key", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).withColumn("size", F.length("line"))
    return lines.where(F.col("line").rlike(r"[^\x09-\x0D\x20]")).withColumn("h", F.xxhash64("line", F.col("size")))


def _parts(key: Column, line: Column, low: Column, size: Column, more: Column) -> Column:
    """Structs (key, low, size): the region of `size` characters (of the shorter copy; this line has `more`, 0 or 1) after the
    first `low` ones is cut into parts, FAN at most, and each stands with a hash of what lies on both of its sides."""
    n = F.least(F.lit(FAN), F.ceil(size / SEGMENT).cast("int"))

    def part(k: Column) -> Column:
        begin, end = F.floor(k * size / n).cast("int"), F.floor((k + 1) * size / n).cast("int")
        before, behind = F.substr(line, low + 1, begin), F.substr(line, low + end + more + 1, size - end)
        return F.struct(F.xxhash64(key, k, before, behind).alias("key"), (low + begin).alias("low"), (end - begin).alias("size"))

    return F.transform(F.sequence(F.lit(0), n - 1), part)


def _met(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key more than one line has."""
    shared = rows.groupBy(key).agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select(key)
    return rows.join(shared, key)


def copied_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h, at, near): lines that go somewhere, by hash, with their first place; a near copy of an earlier line goes there too."""
    lines = lines_of(docs)
    long = lines.where(F.col("size") >= least_chars)
    at = F.struct("doc", "key", "place")
    distinct = cut(lines.groupBy("h").agg(F.min(at).alias("at"), F.count("*").alias("n")))
    regions = cut(_met(long.select("h", F.explode(_half_keys(F.col("line"), F.col("size"))).alias("k")).select("h", "k.*"), "key").distinct())
    wanted = cut(distinct.join(regions.select("h").distinct(), "h").select("h", "at"))
    texts = through_filter(long, wanted).join(wanted, "h").where(at.eqNullSafe(F.col("at"))).select("h", "line", "at").dropDuplicates(["h"])
    texts = cut(texts)
    known = texts.select("h", "line")
    short = regions.where(F.col("size") <= SEGMENT)
    open_ = regions.where(F.col("size") > SEGMENT)
    while open_.take(1):  # a line of n characters is cut log(n / SEGMENT) / log(FAN) times
        parts = open_.join(known, "h").select("h", F.explode(_parts(F.col("key"), F.col("line"), F.col("low"), F.col("size"), F.col("more"))).alias("k"), "more").select("h", "k.*", "more")
        regions = cut(_met(parts, "key").distinct())
        short = short.unionByName(regions.where(F.col("size") <= SEGMENT))
        open_ = regions.where(F.col("size") > SEGMENT)
    region = F.substr("line", F.col("low") + 1, F.col("size") + F.col("more"))
    variants = short.join(texts, "h").select("h", "at", F.explode(_variants(F.col("key"), region, F.col("more"))).alias("v")).select("h", "at", "v.*")
    # of each variant the earliest line, and the earliest of those that are longer
    first = lambda longer: F.min(F.when(F.col("longer") == longer, F.struct("at", "h")))
    firsts = variants.groupBy("variant").agg(first(0).alias("own"), first(1).alias("other"), F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("variant", "own", "other")
    meeting = cut(variants.join(firsts, "variant"))
    # a shorter line meets the longer ones' earliest; lines of one length, and the longer ones, meet the earliest without more
    a = F.when((F.col("longer") == 0) & (F.col("other.at") < F.coalesce("own.at", "other.at")), F.col("other.h")).otherwise(F.col("own.h"))
    pairs = meeting.select(a.alias("a"), F.col("h").alias("b")).where("a <> b").distinct()
    x = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a"), F.col("at").alias("at_a"))
    y = texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"), F.col("at").alias("at_b"))
    close = pairs.join(x, "a").join(y, "b").where((F.col("at_a") < F.col("at_b")) & (F.levenshtein("line_a", "line_b", 1) >= 0))
    near = close.select(F.col("b").alias("h")).distinct().withColumn("near", F.lit(True))
    return distinct.join(near, "h", "left").where("n > 1 or near").select("h", "at", F.coalesce("near", F.lit(False)).alias("near"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_chars: int = LEAST_CHARS, keep_columns: bool = False) -> DataFrame:
    """Rows (id, n_lines, removed array<int>, text): the numbers of the lines removed, from 0, and the text without them. Of equal
    lines the one with the smallest (id, place) stays; a line of `least_chars` characters or more within one edit of a distinct such
    line that begins earlier goes everywhere, whether or not that one stays. Lines without a character other than white space stay.

    A null text stays null with no lines, an empty one is one empty line. Rows equal in id and text are one document: each comes
    out with the same result. Rows with the same id and other texts are documents of their own, ordered by a hash of the text;
    null ids come first. A text or line may be of any length: the work grows in proportion to it. With keep_columns the documents
    come back with all their columns and the new text."""
    key = F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    d = need(docs, id_column, text_column).select(F.col(id_column).alias("doc"), key.alias("key"), F.col(text_column).alias("text"))
    gone_name, gone_key = fresh(docs, "gone"), fresh(docs, "gone_key")
    copied = cut(copied_lines(d, least_chars))  # a join of two exchanges, of which Spark can split a hot line's part
    lines = lines_of(d).select("h", "doc", "key", "place")
    gone = lines.join(copied, "h").where(F.col("near") | ~F.struct("doc", "key", "place").eqNullSafe(F.col("at")))
    gone = gone.groupBy("key").agg(F.sort_array(F.collect_set("place")).alias(gone_name)).withColumnRenamed("key", gone_key)
    source = docs if keep_columns else need(docs, id_column, text_column)
    text = F.col(f"`{text_column}`")
    all_lines = F.split(text, "\n", -1)
    removed = F.coalesce(gone_name, F.array().cast("array<int>"))
    # the places left are a difference of sets, and the lines are split once
    left = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    kept = let(all_lines, lambda lines: F.array_join(F.transform(left(lines), lambda i: F.get(lines, i)), "\n"))
    new = F.when(F.size(removed) > 0, kept).otherwise(text)
    joined = source.join(gone, key == F.col(gone_key), "left")
    if keep_columns:
        return joined.select(*[(new.alias(c) if c == text_column else F.col(f"`{c}`")) for c in docs.columns])
    return joined.select(F.col(id_column), F.coalesce(F.size(all_lines), F.lit(0)).alias("n_lines"), removed.alias("removed"), new.alias("text"))


def op6_line_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("bigint").alias("n_lines"), F.size("removed").cast("bigint").alias("n_removed"), F.array_join("removed", ",").alias("removed"), "text")


#: The same in DuckDB: pairs that share a half and differ by one in length at most, tested character by character.
SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
),
firsts AS (
  SELECT line, length(line) AS size, min((doc_id, place)) AS spot FROM lines
  WHERE regexp_matches(line, '[^\\x09-\\x0D\\x20]') GROUP BY line
),
long AS (SELECT * FROM firsts WHERE size >= 20),
halves AS (
  SELECT line, size, spot, s, 0 AS side, substr(line, 1, s // 2) AS half FROM (SELECT *, unnest([size, size - 1]) AS s FROM long)
  UNION ALL
  SELECT line, size, spot, s, 1, substr(line, size - (s - s // 2) + 1) FROM (SELECT *, unnest([size, size - 1]) AS s FROM long)
),
pairs AS (
  SELECT DISTINCT a.line AS early, b.line AS late
  FROM halves a JOIN halves b ON a.s = b.s AND a.side = b.side AND a.half = b.half AND a.spot < b.spot
),
near AS (
  SELECT DISTINCT late AS line FROM pairs
  WHERE abs(length(early) - length(late)) <= 1 AND list_bool_or(list_transform(range(0, greatest(length(early), length(late))), lambda i:
      substr(early, 1, i) = substr(late, 1, i)
      AND substr(early, i + 1 + CASE WHEN length(early) >= length(late) THEN 1 ELSE 0 END)
        = substr(late, i + 1 + CASE WHEN length(late) >= length(early) THEN 1 ELSE 0 END)))
),
gone AS (
  SELECT l.doc_id, l.place FROM lines l JOIN firsts f ON l.line = f.line LEFT JOIN near n ON n.line = l.line
  WHERE n.line IS NOT NULL OR (l.doc_id, l.place) <> f.spot
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.removed, '') AS removed, k.text
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n_lines, count(g.place) AS n_removed,
    coalesce(string_agg(g.place::VARCHAR, ',' ORDER BY g.place), '') AS removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.place = g.place GROUP BY l.doc_id) k ON d.doc_id = k.doc_id
"""
