"""Operator 13, SimHash near-dedup with pivot distance tables.

A document's fingerprint has 64 bits: a bit is set if it is set in more than half of the XXH64 hashes of the text's word n-grams,
repeats included. Equal fingerprints are one class. Each class carries a row of the pivot table, made once: its Hamming distances
to many reference fingerprints. Two fingerprints within `MOST` bits of each other differ in none of these distances by more than
that, so a pair with a larger difference in any coordinate is discarded, and only what survives is verified bit by bit.

Distances to references alone give no key to join on: an unrelated fingerprint lies 32 bits from any reference, give or take 4, so a
window of 3 around a distance holds half of all. Which classes meet at all is therefore decided by bits: of six blocks at least
three are the same in both, so the classes meet by the 20 choices of three blocks (some 32 bits); what they meet is put to the
table. Only components are asked for: first each class of a bucket meets the bucket's first class, and when those links are merged,
buckets with more than one component left form pairs. Large buckets are parted before that by ten choices of two of five blocks
of the bits that are left, and meet their first classes again, so that pairs are formed only where some 45 bits are the same.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import cut, need, read, through_filter
from roadloom.llm.prefix_groups import smallest_reachable

N, MOST, SEED = 3, 3, 42
#: Buckets of so many classes or more are parted by further bits before pairs are formed.
LARGE = 64
#: Eight distances go into one long, seven bits each and a spare one.
PACKED = 8
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def references(n: int = 16, seed: int = SEED) -> list[int]:
    """Reference fingerprints: hashes of the numbers from 0, so any two differ in about half of their bits."""
    return [xxhash.xxh64_intdigest(str(i).encode(), seed) for i in range(n)]


def fingerprint(text: bytes, n: int = N, piece: int = PIECE) -> int:
    """The fingerprint of a text in UTF-8. A text of fewer than n words is one n-gram, one without words has fingerprint 0. Long texts
    are cut before white space, and a piece begins with the words before it, so memory is bounded however long the text."""
    ones, count, before, at = np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        stop = len(text)
        if stop - at > piece:
            found = _SPACE.search(text, at + piece)
            stop = found.start() if found else stop
        words = before + text[at:stop].lower().split()  # bytes: A-Z only, ASCII white space only
        at = stop
        if len(words) < n and (at < len(text) or count):
            before = words
            continue
        grams = zip(*[words[i:] for i in range(n)], strict=False) if len(words) >= n else [words] if words else []
        h = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], np.uint64)
        if len(h):
            ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
            count += len(h)
        before = words[-(n - 1) :] if n > 1 else []
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc, fp) of (doc, text): the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", n) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc", "fp"])

    return docs.mapInArrow(work, f"doc {docs.schema['doc'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of the given bits, as equal as they can be."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, n)]


def _masks(bits: list[int], n: int, chosen: int) -> list[int]:
    """Masks of all choices of so many of n blocks. Fingerprints that differ in n - chosen bits at most are alike in one of them."""
    return [sum(c) for c in itertools.combinations(_blocks(bits, n), chosen)]


#: 20 masks of some 32 bits, and for each of them ten masks of some 13 of the other bits.
COARSE = _masks(list(range(64)), MOST + 3, 3)
FINE = [_masks([b for b in range(64) if not m >> b & 1], MOST + 2, 2) for m in COARSE]


def table_row(fp: str) -> list[Column]:
    """The distances to all references, packed into columns d0, d1, ..."""
    refs = references()
    out = []
    for i in range(0, len(refs), PACKED):
        total = F.lit(0).cast("long")
        for k, r in enumerate(refs[i : i + PACKED]):
            total = total + F.shiftleft(F.bit_count(F.col(fp).bitwiseXOR(F.lit(_signed(r)))).cast("long"), 8 * k)
        out.append(total.alias(f"d{i // PACKED}"))
    return out


_TABLE = [f"d{i}" for i in range(-(-len(references()) // PACKED))]


def within(x: str, y: str, most: int = MOST) -> Column:
    """Whether no coordinate of the two rows of the table (columns with the prefixes x and y) differs by more than `most`."""
    at = lambda p, d, k: F.shiftright(F.col(f"{p}{d}"), 8 * k).bitwiseAND(F.lit(127))
    return F.greatest(*[F.abs(at(x, d, k) - at(y, d, k)) for d in _TABLE for k in range(PACKED)]) <= most


def linked(x: str, y: str, most: int = MOST) -> Column:
    """The table first, then the bits."""
    return within(x, y, most) & (F.bit_count(F.col(f"{x}fp").bitwiseXOR(F.col(f"{y}fp"))) <= most)


def _side(rows: DataFrame, prefix: str, *more: str) -> DataFrame:
    return rows.select("h", *[F.col(c).alias(f"{prefix}{c}") for c in ("fp", *_TABLE, *more)])


def _met(rows: DataFrame) -> DataFrame:
    """The rows (h, fp, table, ...) of the buckets h with several classes."""
    shared = cut(rows.groupBy("h").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("h"))
    return cut(through_filter(rows, shared).join(shared, "h", "left_semi"))


def _stars(met: DataFrame) -> DataFrame:
    """Links (a, b) of each class of a bucket with the bucket's first."""
    heads = met.groupBy("h").agg(F.min(F.struct("fp", *_TABLE)).alias("head")).select("h", *[F.col(f"head.{c}").alias(f"y{c}") for c in ("fp", *_TABLE)])
    pairs = _side(met, "x").join(heads, "h").where((F.col("xfp") != F.col("yfp")) & linked("x", "y"))
    return pairs.select(F.col("yfp").alias("a"), F.col("xfp").alias("b")).distinct()


def _apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the buckets with classes of several components, with their roots and the bucket's number of classes."""
    rooted = met.join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = cut(rooted)
    sizes = rooted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("h", "n")
    return cut(rooted.join(sizes, "h"))


def _pairs(apart: DataFrame) -> DataFrame:
    """Links (a, b) between classes of a bucket whose components are not the same."""
    x, y = _side(apart, "x", "root"), _side(apart, "y", "root")
    found = x.join(y, "h").where((F.col("xfp") < F.col("yfp")) & (F.col("xroot") != F.col("yroot")) & linked("x", "y"))
    return found.select(F.col("xfp").alias("a"), F.col("yfp").alias("b")).distinct()


def components(classes: DataFrame) -> DataFrame:
    """(v, root) of the fingerprints (fp, one row each) that are linked with others: root is the smallest that links reach."""
    table = classes.select("fp", *table_row("fp"))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("h")) for i, m in enumerate(COARSE)]))
    met = _met(table.select("fp", *_TABLE, keys.alias("k")).select("k.h", "k.i", "fp", *_TABLE))
    links = cut(_stars(met))
    apart = _apart(met, smallest_reachable(links))
    links = links.union(cut(_pairs(apart.where(F.col("n") < LARGE))))
    large = apart.where(F.col("n") >= LARGE)
    if large.take(1):
        spark = classes.sparkSession
        fine = spark.createDataFrame([(i, k, _signed(m)) for i, masks in enumerate(FINE) for k, m in enumerate(masks)], "i int, k int, mask long")
        parted = large.drop("root", "n").join(F.broadcast(fine), "i")  # 200 rows
        parted = _met(parted.withColumn("h", F.xxhash64("h", "k", F.col("fp").bitwiseAND(F.col("mask")))).select("h", "i", "fp", *_TABLE))
        links = cut(links.union(_stars(parted)))
        links = links.union(cut(_pairs(_apart(parted, smallest_reachable(links)))))
    return smallest_reachable(links)


def near_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = N) -> DataFrame:
    """Rows (id, fingerprint, component_id), one a document: 16 hexadecimal digits, and the smallest id that links reach, its own
    included. Null and empty texts and texts of white space have fingerprint 0 and are linked like any other. Repeated rows come
    out alike; rows with the same id and other texts each have their own fingerprint and component. A null id is no smallest id
    where another is reached. An empty table gives no rows. Further columns play no part."""
    d = need(docs, id_column, text_column).select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    found = cut(fingerprints(d, n))
    classes = cut(found.groupBy("fp").agg(F.min("doc").alias("doc")))
    roots = components(classes.select("fp"))
    rooted = classes.join(roots.select(F.col("v").alias("fp"), "root"), "fp", "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    of_class = cut(rooted.join(smallest, "root").select("fp", "component_id"))
    out = found.join(of_class, "fp")
    return out.select(F.col("doc").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(read(spark, sf_dir, "documents"))
