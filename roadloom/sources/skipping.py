"""A table of what files hold, which is asked before a scan: for each file the range of an order column, the range of a key, and a
bloom filter over the key's values. A read takes the files that can have a row; what is certain not to be there isn't opened.

The filter has one bit for each hash of a key, in bitmaps of 32,768 bits; a file with many keys has more of them, so that about one
bit in eight is set at most. The table has some 4 KB a bitmap; files that are new are added without looking at the others again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.sources.tables import exists

_BITS = 32_768
_SCHEMA = "file string, n long, first string, last string, least string, most string, maps int, map int, bits binary"


def _bit(hashed: Column, maps: Column | str) -> tuple[Column, Column]:
    """(bitmap, bit in it) of a hash."""
    place = F.pmod(hashed, F.lit(_BITS) * (F.col(maps) if isinstance(maps, str) else maps))
    return F.floor(place / _BITS).cast("int"), F.pmod(place, F.lit(_BITS))


def _text(c: Column) -> Column:
    return c.cast("string")


def index_files(files: DataFrame, order: str, key: str) -> DataFrame:
    """(file, n, first, last, least, most, maps, map, bits): a row for each bitmap of each file of a frame that is read from files. order:
    a column whose text has its order (a day, a time stamp). Nulls of either column are in no range and no filter; a file of nothing
    else has null ranges."""
    rows = files.select(F.input_file_name().alias("file"), _text(F.col(order)).alias("_o"), _text(F.col(key)).alias("_k"))
    keys = rows.groupBy("file", "_k").agg(F.count("*").alias("_n"), F.min("_o").alias("_f"), F.max("_o").alias("_l"))
    ranges = keys.groupBy("file").agg(F.sum("_n").alias("n"), F.min("_f").alias("first"), F.max("_l").alias("last"), F.min("_k").alias("least"), F.max("_k").alias("most"), F.ceil(F.greatest(F.count("_k"), F.lit(1)) * 8 / _BITS).cast("int").alias("maps"))
    placed = keys.where("_k is not null").join(ranges.select("file", "maps"), "file")
    which, bit = _bit(F.xxhash64("_k"), "maps")
    maps = placed.groupBy("file", which.alias("map")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    return ranges.join(maps, "file", "left")


def refreshed(spark: SparkSession, folder: str, index: str, order: str, key: str) -> DataFrame:
    """The index of a folder's files, kept at `index`: files that it doesn't have are added, those that are gone are left out."""
    files = spark.read.parquet(folder)
    there = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string")  # as many as Spark lists for any read
    known = spark.read.parquet(index) if exists(spark, index) else spark.createDataFrame([], _SCHEMA)
    new = [r.file for r in there.join(known.select("file").distinct(), "file", "left_anti").collect()]
    if new:
        index_files(spark.read.option("basePath", folder).parquet(*new), order, key).write.mode("append").parquet(index)
    return spark.read.schema(_SCHEMA).parquet(index).join(there, "file", "left_semi") if new or exists(spark, index) else known


def files_with(index: DataFrame, first: str | None = None, after: str | None = None, keys: list | None = None) -> list[str]:
    """The files that can have rows with first <= order < after and one of the keys."""
    out = index
    if first is not None:
        out = out.where(F.col("last") >= F.lit(str(first)))
    if after is not None:
        out = out.where(F.col("first") < F.lit(str(after)))
    if keys is not None:
        asked = index.sparkSession.createDataFrame([(str(k),) for k in keys], "k string")
        out = out.join(F.broadcast(asked), F.col("k").between(F.col("least"), F.col("most")))  # the keys of a request
        which, bit = _bit(F.xxhash64("k"), "maps")
        byte = F.conv(F.hex(F.substr("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out.where((F.col("map") == which) & (F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1))
    return sorted(r.file for r in out.select("file").distinct().collect())  # names of files


def read_with(spark: SparkSession, folder: str, index: DataFrame, order: str, key: str, first: str | None = None, after: str | None = None, keys: list | None = None) -> DataFrame:
    """The rows of a folder with first <= order < after and one of the keys, from the files that can have any."""
    files = files_with(index, first, after, keys)
    rows = spark.read.option("basePath", folder).parquet(*files) if files else spark.read.parquet(folder).limit(0)
    if first is not None:
        rows = rows.where(F.col(order) >= F.lit(first))
    if after is not None:
        rows = rows.where(F.col(order) < F.lit(after))
    return rows if keys is None else rows.where(F.col(key).isin(keys))
