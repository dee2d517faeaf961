"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A slice of a batch holds about so many bytes of text, so that numpy's work arrays stay small.
SLICE_BYTES = 1 << 20


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Smaller Arrow batches for this session: thousands of long texts at once would fill the memory beside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as the frame has a column of that name (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_path(spark: SparkSession, *parts: str) -> str | None:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share; None where it is unset."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    return "/".join([base.rstrip("/"), *parts, uuid.uuid4().hex]) if base else None


def _local_folder(spark: SparkSession) -> str:
    """A temporary folder, where the one machine is all there is."""
    import tempfile

    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="roadloom-")


def written(df: DataFrame, *parts: str) -> DataFrame:
    """The frame, written as Parquet below the shared folder and read again."""
    path = shared_path(df.sparkSession, *parts) or f"{_local_folder(df.sparkSession)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage at this point with a written table. Not with checkpoint(): what it returns keeps the size that was estimated for
    the plan before it, and a join multiplies the sizes of its sides, so in rounds that join what they made to itself the estimate
    doubles its digits each time, until the driver works, and runs out of memory, on a single number."""
    return written(df, "cut")


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, end row, bytes, offsets) of a string column, in UTF-8 without a copy; nulls count as empty. A slice has
    at least one row, and more while it stays below `most` bytes."""
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def text_pieces(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As text_slices, but a text of more than `most` bytes comes in several pieces, cut before white space: its row is named by
    each of them. What is done with the words of a piece then takes bounded memory, however long the text."""
    for row, end, data, offsets in text_slices(batch, column, most):
        at = 0
        while len(data) - at > most and end - row == 1:
            stop = at + most
            while stop < len(data) and NOT_SPACE[data[stop : stop + 65536]].all():
                stop += 65536
            stop = min(len(data), stop + int(np.argmin(NOT_SPACE[data[stop : stop + 65536]]))) if stop < len(data) else len(data)
            yield row, end, data[at:stop], np.array([0, stop - at])
            at = stop
        yield row, end, data[at:], offsets - at if not at else np.array([0, len(data) - at])


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the table `inside` marks; a run ends with its text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = inside[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = mask[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


_RANDOM = np.random.default_rng(20240607)
_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end], equal in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Lower case for A-Z and no other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word: all but white space in ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of a word: letters and digits of ASCII, and all that is not ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


#: Bytes that end a sentence when a word ends with them.
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[33, 46, 63]] = True


class Sentences:
    """Words and sentences of a slice. A word is a run without ASCII white space; a sentence ends after a word that ends with
    . ! or ?, at a line's end and at a text's end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends = runs(data, offsets, NOT_SPACE)
        n = len(self.starts)
        self.words = hash_runs(LOWER[data], self.starts, self.ends)
        self.text_of_word = np.searchsorted(offsets, self.starts, "right") - 1
        last = np.zeros(n, bool)
        if n:
            lines = np.concatenate([[0], np.cumsum(data == 10)])
            last[:-1] = (lines[self.starts[1:]] > lines[self.ends[:-1]]) | (self.text_of_word[1:] != self.text_of_word[:-1])
            last[-1] = True
            last |= SENTENCE_END[data[self.ends - 1]]
        self.end_word = np.flatnonzero(last) + 1
        self.first_word = np.concatenate([[0], self.end_word[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        self.text = self.text_of_word[self.first_word] if n else np.zeros(0, np.int64)
        #: for each text the number of its first sentence, and the end
        self.first_sentence = np.searchsorted(self.text, np.arange(len(offsets)))
        up, self._down = _powers(n + 1)
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * up[:n], out=self._total[1:])

    def hash_words(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of words."""
        return mix((self._total[end] - self._total[first]) * self._down[first] + (end - first).astype(np.uint64))


#: Bits of the filter through which rows are read again: at most so many, 32768 to a row of the table that is sent out.
FILTER_BITS = 1 << 26


def through_filter(rows: DataFrame, wanted: DataFrame, h: str = "h", most_bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose `h` (a long) is in `wanted`, and some others: tested on a bitmap of a size that is bounded, which is what is sent to
    all tasks. A full bitmap lets every row through; a join on h has to follow."""
    bits = 1 << 15
    n = wanted.count()
    while bits < min(16 * n, most_bits):
        bits *= 2
    place = F.pmod(F.col(h), F.lit(bits))
    maps = wanted.select(place.alias("p")).groupBy((F.expr("p div 32768")).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(32768))).alias("map"))
    byte = F.conv(F.hex(F.substr("map", F.expr(f"cast(pmod({h}, 32768) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("bucket", F.expr(f"pmod({h}, {bits}) div 32768")).join(F.broadcast(maps), "bucket")  # most_bits / 8 bytes at most
    return held.where(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(pmod({h}, 8) as int))")) != 0).drop("bucket", "map")
