"""Operator 5, n-gram Jaccard join by grouped prefixes.

A document's set holds its distinct word n-grams, as 64-bit hashes. In one order of all n-grams (rare ones first, by counts over
all documents in a table of bounded size, then by hash), two sets that are similar enough share an n-gram among their first few,
the prefix. Documents with the same set collapse into one class, and classes with identical prefixes and size into one group.
Group pairs that share a prefix n-gram and whose sizes allow the similarity are candidates; they expand to their classes, and
each pair of classes is verified on its whole sets.

Only components are asked for, so pairs that cannot change them are left out: first each member of an n-gram's list meets the
list's smallest member; when those links are merged, only pairs from different components remain to be met.

In a long list nearly every set holds the same n-grams, so that n-grams tell its members apart no more; what a member lacks or has
beside the others does. The members of long lists with the same head are a family, and its centre is the set of n-grams that more
than half of its members hold. With D = |A - centre| + |centre - A| for each member A, two members are similar enough exactly if
their differences overlap in enough n-grams, so a prefix join over the differences, rare n-grams first, finds all of them
(`differences`, `family_pairs`). Members whose differences are too small to have to overlap are linked for certain, all of them to
the one with the smallest difference. A list of thousands of near copies, linked or just under the similarity, thus costs its
length, while no link between different components is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, NOT_SPACE, cut, hash_runs, mix, need, read, runs, text_slices, through_filter

N, PERCENT = 3, 90
#: Lists and groups of so many members or more are met by their differences from a centre, shorter ones by all pairs.
LONG_LIST = 48
#: A hot key's rows are dealt to so many parts where they meet one row a key; longer lists than this have more rows than parts.
PARTS = 48
#: Counters of n-grams: the order's table has one for so many bytes of text, within these bounds (a byte each is sent to all tasks).
#: With too many n-grams to a counter frequent ones pass for rare, and their lists grow with the input.
COUNTERS, MOST_COUNTERS, COUNTED_BYTES = 1 << 20, 1 << 26, 128


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-grams, ordered by text and hash; a shorter text is one n-gram, an empty one none."""
    starts, ends = runs(data, offsets, NOT_SPACE)
    words = hash_runs(LOWER[data], starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    size = np.minimum(count, n)[text]  # words of the n-gram that begins here
    begins = np.arange(len(words)) + size <= first[1:][text]
    at = np.flatnonzero(begins & ((count[text] >= n) | (np.arange(len(words)) == first[:-1][text])))
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = size[at] > k
        h[inside] = mix(h[inside] * np.uint64(0x2545F4914F6CDD1D) + words[at[inside] + k] + np.uint64(k + 1))
    t = text[at]
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return t[fresh], h[fresh]


def counters_for(docs: DataFrame, text_column: str = "text") -> int:
    """How many counters the texts need: a power of two, one for some 20 n-grams of all texts, between COUNTERS and MOST_COUNTERS."""
    n = COUNTERS
    length = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
    while n * COUNTED_BYTES < length and n < MOST_COUNTERS:
        n *= 2
    return n


def _counter(h: np.ndarray, size: int) -> np.ndarray:
    return (h >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)  # the high bits


def count_table(docs: DataFrame, n: int) -> np.ndarray:
    """How often n-grams of each counter occur in all documents' sets, as the logarithm's half steps: 8 bits a counter. A task counts
    up to 65,535 a counter: what is more frequent comes last in any case."""
    size = counters_for(docs)
    block = min(size, 1 << 14)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint16)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch, 0):
                _, h = shingle_sets(data, offsets, n)
                at, c = np.unique(_counter(h, size), return_counts=True)
                total[at] = np.minimum(total[at] + c, 65535)
        some = total.reshape(-1, block)
        for k in range(0, len(some), 256):
            used = k + np.flatnonzero(some[k : k + 256].any(axis=1))
            yield _blocks(used, some[used])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        """Rows come by block, so that one block's sum is held at a time."""
        at, total = -1, np.zeros(block, np.int64)
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != at:
                    if at >= 0:
                        yield at, total
                    at, total = b, np.zeros(block, np.int64)
                total += _unpacked(c.as_buffer())
        if at >= 0:
            yield at, total

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, total in sums(batches):
            yield _blocks(np.array([b]), total[None])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, total in sums(batches):
            yield _blocks(np.array([b]), np.minimum(np.rint(4 * np.log2(total + 1)), 255).astype(np.uint8)[None])

    # merged in two levels, so that no task meets the counts of all others
    parts = docs.mapInArrow(work, "block int, counts binary").withColumn("part", F.spark_partition_id() % 256)
    some = parts.repartition("block", "part").sortWithinPartitions("block").select("block", "counts").mapInArrow(merge, "block int, counts binary")
    merged = some.repartition("block").sortWithinPartitions("block").mapInArrow(steps, "block int, counts binary").toArrow()  # MOST_COUNTERS bytes at most
    table = np.zeros((size // block, block), np.uint8)
    for b, c in zip(merged.column(0).to_pylist(), merged.column(1), strict=True):
        table[b] = _unpacked(c.as_buffer())
    return table.reshape(-1)


def _blocks(numbers: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Blocks of counts, each in the narrowest type that holds it, compressed: most counts of a task are small."""
    packed = []
    for c in counts:
        kind = next(k for k in ("u1", "u2", "u4", "u8") if c.max() <= np.iinfo(k).max)
        packed.append(kind.encode() + zlib.compress(c.astype(kind).tobytes(), 1))
    return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(packed, pa.binary())], ["block", "counts"])


def _unpacked(packed: pa.Buffer) -> np.ndarray:
    packed = memoryview(packed)
    return np.frombuffer(zlib.decompress(packed[2:]), bytes(packed[:2]).decode())


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    """n-grams of a set among which one must be shared: size - ceil(percent/100 * size) + 1."""
    return size - -(-percent * size // 100) + 1


def classes(docs: DataFrame, table, n: int, percent: int) -> DataFrame:
    """(doc, key, cls, size, prefix, prefix_key) for each document with a set: `cls` is a hash of the whole set, `prefix_key` of its
    size and prefix. table: the broadcast counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            for row, end, data, offsets in text_slices(batch, 2):
                t, h = shingle_sets(data, offsets, n)
                size = np.bincount(t, minlength=end - row)
                cls = np.zeros(end - row, np.uint64)
                np.add.at(cls, t, mix(h + np.uint64(77)))
                cls = mix(cls + size.astype(np.uint64))
                order = np.lexsort((h, counts[_counter(h, len(counts))], t))
                t, h = t[order], h[order]
                first = np.concatenate([[0], np.cumsum(size)])
                rank = np.arange(len(h)) - first[:-1][t]
                keep = rank < prefix_length(size, percent)[t]
                pt, ph = t[keep], h[keep]
                key = np.zeros(end - row, np.uint64)
                np.add.at(key, pt, mix(ph + np.uint64(99)))
                key = mix(key * np.uint64(31) + size.astype(np.uint64))
                bounds = np.searchsorted(pt, np.arange(end - row + 1))
                prefixes = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ph.view(np.int64)))
                have = pa.array(size > 0)
                whole = [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(cls.view(np.int64)), pa.array(size.astype(np.int64)), prefixes, pa.array(key.view(np.int64))]
                yield pa.RecordBatch.from_arrays([c.filter(have) for c in whole], ["doc", "key", "cls", "size", "prefix", "prefix_key"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(work, f"doc {kind}, key long, cls long, size long, prefix array<long>, prefix_key long")


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those whose sets are similar enough. texts: (cls, text), one row a class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[pa.Buffer, np.ndarray]] = {}  # the last text on each side: pairs of one class follow each other

        def own(side: int, text: pa.Scalar) -> np.ndarray:
            raw = text.as_buffer()
            if side not in held or not raw.equals(held[side][0]):
                held[side] = (raw, shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, raw.size]), n)[1])
            return held[side][1]

        for batch in batches:
            good = []
            for text_a, text_b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = own(0, text_a), own(1, text_b)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    # a class in many pairs (a list's head) is dealt to several tasks
    many = pairs.groupBy("a").agg(F.expr("cast(count(*) div 128 as int)").alias("last"))
    heads = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")).join(many, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    dealt = pairs.join(many, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), last + 1) as int)").alias("part"))
    b = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    # merge: sent out, texts would be unpacked in the driver's memory
    return dealt.join(b.hint("merge"), "b").join(heads.hint("merge"), ["a", "part"]).select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of the edges (a, b): root is the smallest vertex it reaches. Each round points every vertex at
    the smallest root among its own and its neighbours' and then at that one's root, and writes what it has."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots = both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root"))
    roots = cut(roots)
    while True:
        near = both.join(roots.select(F.col("v").alias("b"), F.col("root").alias("other")), "b").groupBy(F.col("a").alias("v")).agg(F.min("other").alias("other"))
        step = roots.join(near, "v").select("v", "root", F.least("root", "other").alias("low"))
        jump = roots.select(F.col("v").alias("low"), F.col("root").alias("far"))
        new = cut(step.join(jump, "low", "left").select("v", F.least("low", F.coalesce("far", "low")).alias("new"), "root"))
        roots = new.select("v", F.col("new").alias("root"))
        if not new.where("new <> root").take(1):
            return roots


def _sizes_fit(x: str, y: str, percent: int) -> Column:
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _overlap(percent: int) -> Column:
    """n-grams that sets of size_x and size_y have to share."""
    return F.ceil((F.col("size_x") + F.col("size_y")) * percent / (100 + percent))


def _room(shared: Column, percent: int) -> Column:
    """Whether sets of size_x and size_y whose prefixes share so many n-grams can be similar enough. One of the prefixes ends
    before the other in the order, so what the sets share lies in both prefixes or after that prefix's end."""
    after = lambda size: F.ceil(F.col(size) * percent / 100) - 1  # n-grams after the prefix
    return (shared + F.greatest(after("size_x"), after("size_y"))) * (100 + percent) >= (F.col("size_x") + F.col("size_y")) * percent


def fitting(pairs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y) of groups those whose sizes and prefixes leave room for the similarity."""
    side = lambda name, *more: groups.select(F.col("grp").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in more])
    sized = cut(pairs.join(side("x", "size").hint("merge"), "x").join(side("y", "size").hint("merge"), "y").where(_sizes_fit("size_x", "size_y", percent)))
    both = sized.join(side("x", "prefix").hint("merge"), "x").join(side("y", "prefix").hint("merge"), "y")
    shared = F.size(F.array_intersect("prefix_x", "prefix_y"))
    return both.where((shared > 0) & _room(shared, percent)).select("x", "y")


def differences(families: DataFrame, sets: DataFrame, table, percent: int) -> DataFrame:
    """(fam, cls, root, size, dsize, k, elems) of families (fam, cls, root, size): how a class differs from its family's centre, the
    n-grams that more than half of the members hold. dsize: the number of n-grams that one of both lacks; elems: the first of them,
    those that the centre lacks before those that it holds, rare ones first; k = (100 + percent) * dsize - (100 - percent) * size.

    Two sets of the sizes s and t are similar enough exactly if they differ in (s + t) * (100 - percent) / (100 + percent) n-grams at
    most. They differ in dsize_x + dsize_y - 2 * (what the differences share), so they are if k_x + k_y <= 2 * (100 + percent) * shared.
    sets: (cls, grams), one row a class. table: the broadcast counts."""
    held = families.join(sets.hint("merge"), "cls")
    n = families.groupBy("fam").agg(F.count("*").alias("n"))
    counts = held.select("fam", F.explode("grams").alias("gram")).groupBy("fam", "gram").agg(F.count("*").alias("c"))
    centre = counts.join(n, "fam").where("2 * c > n").groupBy("fam").agg(F.collect_list("gram").alias("centre"))  # at most twice a member's mean size
    dealt = _dealt(n.select("fam").join(centre, "fam", "left"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = table.value
        for batch in batches:
            dsize, elems = [], []
            for own, middle in zip(batch.column(4), batch.column(5), strict=True):
                x = own.values.to_numpy().view(np.uint64)
                c = middle.values.to_numpy().view(np.uint64) if middle.is_valid else x[:0]
                diff = np.setxor1d(x, c, assume_unique=True)
                within = np.isin(diff, c, assume_unique=True)
                dsize.append(len(diff))
                diff = diff[np.lexsort((diff, rare[_counter(diff, len(rare))], within))]
                # any set that is similar enough differs in no more than (100 - percent) / percent of the size
                elems.append(diff[: len(x) * (100 - percent) // percent + 1].view(np.int64))
            size = batch.column(3).to_numpy()
            d = np.array(dsize, np.int64)
            k = (100 + percent) * d - (100 - percent) * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(d), pa.array(k), pa.array(elems, pa.list_(pa.int64()))], ["fam", "cls", "root", "size", "dsize", "k", "elems"])

    rows = held.withColumn("part", _part()).join(dealt.hint("merge"), ["fam", "part"]).select("fam", "cls", "root", "size", "grams", "centre")
    return cut(rows.mapInArrow(work, "fam long, cls long, root long, size long, dsize long, k long, elems array<long>"))


def _part() -> Column:
    return F.expr(f"cast(pmod(xxhash64(cls), {PARTS}) as int)")


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows, one a key, once for each part."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def family_pairs(differing: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes from `differences`: those that are links for certain, and those to be verified. Pairs whose
    components are known to be the same are left out."""
    best = _dealt(differing.groupBy("fam").agg(F.min(F.struct("k", "cls", "root")).alias("m")))
    # two members with k_x + k_y <= 0 are each linked to the one with the smallest k, and so are all that it is linked to
    near = differing.withColumn("part", _part()).join(best, ["fam", "part"])
    near = near.withColumn("sure", F.expr("k + m.k <= 0"))
    sure = near.where("sure and cls <> m.cls").select(F.col("m.cls").alias("a"), F.col("cls").alias("b")).distinct()
    rows = near.select("fam", "cls", "size", "dsize", "k", F.when(F.col("sure"), F.col("m.root")).otherwise(F.col("root")).alias("root"), F.posexplode("elems").alias("pos", "elem"))
    # an n-gram of the difference that only one member has meets nothing
    met = cut(rows)
    shared = met.groupBy("fam", "elem").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("fam", "elem")
    met = cut(met.join(shared, ["fam", "elem"]))
    side = lambda name: met.select("fam", "elem", *[F.col(c).alias(f"{c}_{name}") for c in ("cls", "size", "dsize", "k", "pos", "root")])
    least = F.ceil((F.col("k_x") + F.col("k_y")) / (2 * (100 + percent)))  # n-grams that the differences have to share
    early = (F.col("pos_x") <= F.col("dsize_x") - least) & (F.col("pos_y") <= F.col("dsize_y") - least)
    most = F.least("pos_x", "pos_y") + F.least(F.col("dsize_x") - F.col("pos_x"), F.col("dsize_y") - F.col("pos_y"))
    pairs = side("x").join(side("y"), ["fam", "elem"]).where(F.expr("cls_x < cls_y and root_x <> root_y") & _sizes_fit("size_x", "size_y", percent) & early & (most >= least))
    return sure, pairs.select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b")).distinct()


def sets_of(texts: DataFrame, n: int) -> DataFrame:
    """(cls, grams) of (cls, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch, 1):
                t, h = shingle_sets(data, offsets, n)
                bounds = np.searchsorted(t, np.arange(end - row + 1))
                grams = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), grams], ["cls", "grams"])

    return texts.mapInArrow(work, "cls long, grams array<long>")


def row_key(id_column: str, text_column: str) -> Column:
    """Tells documents apart: the same for rows equal in id and text."""
    return F.xxhash64(id_column, text_column)


def _first() -> Column:
    """The smallest id, null last, with the smallest key."""
    return F.min(F.struct(F.isnull("doc").alias("none"), "doc", "key")).alias("first")


def similar_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = N, percent: int = PERCENT, keys: bool = False) -> DataFrame:
    """Rows (id, n_shingles, component_id), one a document: the size of its set and the smallest id that links reach, its own
    included. Null and empty texts and texts of white space have size 0 and only themselves. Rows equal in id and text come out
    alike; rows with the same id and other texts are documents of their own. A null id is no smallest id where another is
    reached. Further columns play no part. With `keys` also each document's key (row_key) and that of its component's first
    document, the one with the smallest id and then key (first_key)."""
    spark = docs.sparkSession
    d = need(docs, id_column, text_column).select(F.col(id_column).alias("doc"), row_key(id_column, text_column).alias("key"), F.col(text_column).alias("text"))
    table = spark.sparkContext.broadcast(count_table(d.select("text"), n))  # MOST_COUNTERS bytes at most
    found = cut(classes(d, table, n, percent))
    # a class is what has the same set, a group what has the same prefix and size; copies are met map-side
    reps = cut(found.groupBy("cls").agg(_first(), F.min("prefix_key").alias("grp")).select("cls", "first.doc", "first.key", "grp"))
    heads = reps.groupBy("grp").agg(F.min("cls").alias("cls"), F.count("*").alias("n"))
    groups = cut(found.select(F.col("prefix_key").alias("grp"), "size", "prefix").dropDuplicates(["grp"]))
    postings = groups.select("grp", F.posexplode("prefix").alias("pos", "gram"))
    # n-grams in the prefixes of several groups; both sides of the join come from an exchange, so that Spark can split a hot one
    shared = cut(postings.groupBy("gram").agg(F.min("grp").alias("head"), F.max("grp").alias("last")).where("head <> last").select("gram", "head"))
    met = cut(through_filter(postings, shared.select("gram"), "gram").join(shared, "gram"))

    # first: each group of a list with the list's first group, by their first classes, and each class with its group's first
    star = fitting(met.where("grp <> head").select(F.col("head").alias("x"), F.col("grp").alias("y")).distinct(), groups, percent)
    first = star.join(heads.select(F.col("grp").alias("x"), F.col("cls").alias("a")), "x").join(heads.select(F.col("grp").alias("y"), F.col("cls").alias("b")), "y").select("a", "b")
    inner = reps.join(heads.where("n > 1").select("grp", F.col("cls").alias("a")), "grp").where("a <> cls").select("a", F.col("cls").alias("b"))
    tried = cut(first.union(inner).distinct())
    links = cut(verify(tried, _texts(d, reps, tried), n, percent))
    roots = smallest_reachable(links)

    # then what is still apart: the pairs of groups of a short list, and of classes of a small group
    rooted, spread, lists = _apart(reps, roots, met, groups.select("grp", "size"))
    length = cut(lists.groupBy("gram").agg(F.count("*").alias("n"), F.min("grp").alias("fam")))
    short = lists.join(length.where(F.col("n") < LONG_LIST).select("gram"), "gram")
    side = lambda name: short.select("gram", F.col("grp").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("pos", "low", "high", "size")])
    # for two sizes the prefix that has to meet is known to the n-gram
    early = (F.col("pos_x") <= F.col("size_x") - _overlap(percent)) & (F.col("pos_y") <= F.col("size_y") - _overlap(percent))
    # before this n-gram the sets share no more than the smaller place, after it no more than the smaller rest
    most = F.least("pos_x", "pos_y") + F.least(F.col("size_x") - F.col("pos_x"), F.col("size_y") - F.col("pos_y"))
    near = side("x").join(side("y"), "gram").where(F.expr("x < y and not (low_x = high_y and high_x = low_y)") & _sizes_fit("size_x", "size_y", percent) & early & (most >= _overlap(percent)))
    small = spread.where((F.col("low") != F.col("high")) & (F.col("n") < LONG_LIST)).select(F.col("grp").alias("x"), F.col("grp").alias("y"))
    pairs = fitting(near.select("x", "y").distinct(), groups, percent).union(small)
    a = rooted.select(F.col("grp").alias("x"), F.col("cls").alias("a"), F.col("root").alias("root_a"))
    b = rooted.select(F.col("grp").alias("y"), F.col("cls").alias("b"), F.col("root").alias("root_b"))
    rest = pairs.join(a, "x").join(b, "y").where("root_a <> root_b and (x <> y or a < b)").select("a", "b")

    # the classes of long lists and large groups, by what tells them apart
    far = lists.join(length.where(F.col("n") >= LONG_LIST).select("gram", "fam"), "gram").select("fam", "grp")
    far = far.union(spread.where((F.col("low") != F.col("high")) & (F.col("n") >= LONG_LIST)).select("grp", "grp")).distinct()
    families = cut(far.join(rooted.join(groups.select("grp", "size"), "grp"), "grp").select("fam", "cls", "root", "size"))
    if families.take(1):
        of = cut(sets_of(_texts(d, reps, families.select(F.col("cls").alias("a"), F.col("cls").alias("b"))), n))
        sure, close = family_pairs(differences(families, of, table, percent), percent)
        links = links.union(cut(sure))
        rest = rest.union(close)
    rest = cut(rest.distinct().join(tried.union(tried.select("b", "a")), ["a", "b"], "left_anti"))
    links = links.union(cut(verify(rest, _texts(d, reps, rest), n, percent)))
    roots = smallest_reachable(links)

    component = cut(reps.join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "doc", "key", F.coalesce("root", "cls").alias("root")))
    smallest = component.groupBy("root").agg(_first()).select("root", F.col("first.doc").alias("component_id"), F.col("first.key").alias("first_key"))
    of_class = cut(component.join(smallest, "root").select("cls", "component_id", "first_key"))
    linked = found.select("key", "cls", "size").join(of_class, "cls").groupBy("key").agg(F.first("size").alias("size"), F.first("component_id").alias("component_id"), F.first("first_key").alias("first_key"))
    out = d.select("doc", "key").join(linked, "key", "left")
    more_columns = ["key", F.coalesce("first_key", "key").alias("first_key")] if keys else []
    return out.select(F.col("doc").alias(id_column), F.coalesce("size", F.lit(0)).cast("bigint").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"), *more_columns)


def _apart(reps: DataFrame, roots: DataFrame, met: DataFrame, size_of: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes with their roots; groups with the smallest and the largest root of their classes and their number; and the lists,
    with sizes, in which more than one root is left."""
    rooted = cut(reps.select("cls", "grp").join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("cls", "grp", F.coalesce("root", "cls").alias("root")))
    spread = rooted.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    lists = met.select("gram", "grp", "pos").join(spread.drop("n"), "grp")
    apart = cut(lists.groupBy("gram").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("gram"))
    return rooted, spread, cut(lists.join(apart, "gram").join(size_of, "grp"))


def _texts(d: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, text) of the classes in the pairs, without moving the other texts."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    keys = cut(reps.join(wanted, "cls", "left_semi").select("cls", "key"))
    return through_filter(d.select("key", "text"), keys, "key").join(keys, "key").dropDuplicates(["cls"]).select("cls", "text")


def op5_prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read(spark, sf_dir, "documents"))
