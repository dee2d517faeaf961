"""Operator 2, benchmark decontamination with suffix arrays of the training text.

Documents are cut into shards of whole texts. A shard's words become numbers of the benchmark's vocabulary (any other word is a
wall that no match crosses), and a suffix array orders the places where a match of the asked length can begin, by prefix doubling
up to the longest item. Every suffix of every benchmark item is then binary-searched in every shard's array, but for those whose
first two words stand nowhere in the shard one after the other: its interval gives all places of matches. Items go through in
blocks of bounded size; rows pass one block after the other, and take with them what they have been found to hold, so the benchmark
may grow. For the longest match of each text, every place is met with the suffixes next to it in the order, so what other texts the
shard holds plays no part. A text longer than a shard comes in pieces, each with as many words before it as the longest item has.

Words: A-Z in lower case; runs of letters and digits of ASCII and of all characters beyond ASCII.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, WORD, hash_runs, need, read, runs, text_pieces, written

WINDOW = 10
#: Words of benchmark items that go through together.
BLOCK_WORDS = 1_000_000
#: Bytes of text of a shard, about.
SHARD_BYTES = 2 << 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, and for each text the number of the first of its words (one more number than texts)."""
    starts, ends = runs(data, offsets, WORD)
    return hash_runs(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


class Block:
    """Items with words: their ids, words as numbers from 1 of the block's vocabulary, and where each item begins."""

    def __init__(self, ids: list[str | None], hashes: list[np.ndarray]):
        self.ids = ids
        self.bounds = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
        flat = np.concatenate(hashes)
        self.vocabulary, inverse = np.unique(flat, return_inverse=True)
        self.words = inverse.astype(np.int64) + 1
        self.item = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        self.left = self.bounds[1:][self.item] - np.arange(len(flat))  # words from here to the item's end
        self.longest = int(np.diff(self.bounds).max())


def blocks(items: DataFrame, id_column: str, text_column: str, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The items, read one partition at a time, in blocks. Items without words are in none; a null id is kept as it is."""
    ids: list[str | None] = []
    hashes: list[np.ndarray] = []
    size = 0
    rows = items.select(F.col(f"`{id_column}`").cast("string").alias("i"), F.col(f"`{text_column}`").alias("t"))
    for row in rows.where("t is not null").toLocalIterator():
        data = np.frombuffer(row.t.encode(), np.uint8)
        h, _ = words_of(data, np.array([0, len(data)]))
        if len(h):
            if ids and size + len(h) > block_words:
                yield Block(ids, hashes)
                ids, hashes, size = [], [], 0
            ids.append(row.i)
            hashes.append(h)
            size += len(h)
    if ids:
        yield Block(ids, hashes)


def suffix_array(words: np.ndarray, reach: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places `at`, ordered by the words that follow, up to `depth` of them and no further than the wall (a 0). Prefix
    doubling: the order by 2^k words gives ranks, and pairs of ranks the order by 2^(k+1) words. reach: words up to the wall."""
    n = len(words)
    rank = words
    k = 1
    while k < depth:
        after = np.zeros(n, np.int64)
        if k < n:
            after[: n - k] = rank[k:]
        after[reach <= k] = 0
        # suffixes that do not begin at a wall need a rank, the wall keeps 0
        live = np.flatnonzero(words)
        key = rank[live] * (int(rank.max()) + 1) + after[live]
        _, inverse = np.unique(key, return_inverse=True)
        rank = np.zeros(n, np.int64)
        rank[live] = inverse + 1
        k *= 2
    return at[np.argsort(rank[at], kind="stable")]


def search(words: np.ndarray, reach: np.ndarray, array: np.ndarray, block: Block, suffixes: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
    """For each of the block's suffixes, cut to its `length` in words, the lower or upper bound among the suffix array's places."""
    low, high = np.zeros(len(suffixes), np.int64), np.full(len(suffixes), len(array), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        sign = _compare(words, reach, array[middle], block, suffixes[open_], length[open_])
        goes_right = sign <= 0 if upper else sign < 0  # the place's words are smaller (or, for the upper bound, equal)
        low[open_[goes_right]] = middle[goes_right] + 1
        high[open_[~goes_right]] = middle[~goes_right]
    return low


def _compare(words: np.ndarray, reach: np.ndarray, places: np.ndarray, block: Block, suffixes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """-1, 0 or 1 as the words at each place are below, equal to (in all `length` words) or above the suffix's."""
    sign = np.zeros(len(places), np.int64)
    active = np.arange(len(places))
    step = 0
    while active.size:
        active = active[length[active] > step]
        if not active.size:
            break
        here = np.where(reach[places[active]] > step, words[np.minimum(places[active] + step, len(words) - 1)], 0)
        there = block.words[suffixes[active] + step]
        sign[active] = np.sign(here - there)
        active = active[here == there]
        step += 1
    return sign


def match_lengths(words: np.ndarray, reach: np.ndarray, array: np.ndarray, block: Block, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the suffix array the longest verbatim match of the block that begins there, in words, and a suffix that
    has it: one of the two next to the place in the order. suffixes: all of the block's, in their order."""
    where = search(words, reach, array, block, suffixes, block.left[suffixes], False)
    after = np.searchsorted(where, np.arange(len(array)), "right")  # suffixes that are not above the place
    best, suffix = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
    for neighbour in (after - 1, after):
        ok = np.flatnonzero((neighbour >= 0) & (neighbour < len(suffixes)))
        at, of, active, step = array[ok], suffixes[neighbour[ok]], np.arange(len(ok)), 0
        common = np.zeros(len(ok), np.int64)
        while active.size:
            active = active[(block.left[of[active]] > step) & (reach[at[active]] > step)]
            active = active[words[at[active] + step] == block.words[of[active] + step]]
            step += 1
            common[active] = step
        better = common > best[ok]
        best[ok[better]], suffix[ok[better]] = common[better], of[better]
    return best, suffix


class Shard:
    """A shard's words and suffix array for one block. first: number of the first word of each text, and the end."""

    def __init__(self, hashes: np.ndarray, first: np.ndarray, block: Block, window: int):
        self.first = first
        near = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
        known = np.where(block.vocabulary[near] == hashes, near + 1, 0)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.text_of = text
        n = len(known)
        # words up to the next wall or to the text's end
        stop = np.where(known == 0, np.arange(n), n)
        stop = np.minimum.accumulate(stop[::-1])[::-1] if n else stop
        self.reach = np.minimum(stop, first[1:][text] if n else 0) - np.arange(n)
        shortest = int(np.minimum(np.diff(block.bounds), window).min())
        self.words = known
        # only these places can begin a match of the shortest window; what lies between two of them belongs to some match too
        begin = np.flatnonzero(self.reach >= shortest)
        keep = np.zeros(n + 1, np.int64)
        np.add.at(keep, begin, 1)
        np.add.at(keep, begin + self.reach[begin], -1)
        inside = np.cumsum(keep[:-1]) > 0
        # the others are walls: this shrinks what the doubling has to rank
        self.live = np.flatnonzero(inside)
        self.position = np.concatenate([self.live, [n]])
        self.words = np.append(known[self.live], 0)
        self.reach = np.append(self.reach[self.live], 0)
        small = np.flatnonzero(self.reach >= shortest)
        self.array = suffix_array(self.words, self.reach, small, block.longest)

    def matches(self, block: Block, windows: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(number of a window, places of its matches), for the windows that occur: binary search of both ends of their intervals."""
        if not len(self.array):
            return
        # a window whose first two words follow each other nowhere needs no search
        base = len(block.vocabulary) + 1
        after = lambda words, at, inside: words[at] * base + np.where(inside, words[np.minimum(at + 1, len(words) - 1)], 0)
        here = np.unique(after(self.words, self.array, self.reach[self.array] > 1))
        some = np.flatnonzero((length == 1) | np.isin(after(block.words, windows, length > 1), here))
        low, high = (search(self.words, self.reach, self.array, block, windows[some], length[some], upper) for upper in (False, True))
        for k in np.flatnonzero(high > low).tolist():
            yield int(some[k]), np.unique(self.position[self.array[low[k] : high[k]]]).tolist()


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (id, n_words, item_ids array<string>, hits array<struct<begin, end>>, longest, longest_item): for each document the
    items of which a window of `window` words (the whole item, where it is shorter) occurs, the words hit, as spans of word
    numbers that do not overlap, and the longest verbatim match of any item's suffix with its item: of equally long ones the one
    that begins first in the text, and of those the item that is in the first block and comes first in the order of suffixes. A null
    or empty text, or one without words, has none; an empty benchmark hits nothing; an item that occurs twice in the benchmark counts
    once, and an id with several texts counts once, whichever of them occur. An item with a null id hits words and can be the longest
    match, but has no id to list. Blocks pass one after the other, each written before the next. Repeated documents and ids are each judged; further columns, whatever their names, play no part."""
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    nothing = "array<struct<begin:bigint,end:bigint>>"
    rows = docs.select(F.col(f"`{id_column}`").alias("doc"), F.col(f"`{text_column}`").alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<string>").alias("item_ids"), F.array().cast(nothing).alias("hits"), F.lit(0).cast("bigint").alias("longest"), F.lit(None).cast("string").alias("longest_item"))
    schema = f"doc {kind}, text string, n_words bigint, item_ids array<string>, hits {nothing}, longest bigint, longest_item string"
    passed = False
    for block in blocks(need(items, item_id_column, item_text_column), item_id_column, item_text_column, block_words):
        if passed:  # one block and its workers at a time
            rows = written(rows, "suffix_decontamination")
        rows, passed = rows.mapInArrow(_found(spark.sparkContext.broadcast(block), window), schema), True
    if not passed:
        rows = rows.mapInArrow(_found(None, window), schema)
    return rows.select(F.col("doc").alias(id_column), "n_words", "item_ids", "hits", "longest", "longest_item")


def _shards(batch: pa.RecordBatch, column: int, keep: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, int]]:
    """(first row, end row, words, first word of each text, number of the first word in its text, words met before) of a batch's
    shards; a long text comes in pieces, each with the last `keep` words before it."""
    last, carry, seen = -1, np.zeros(0, np.uint64), 0
    for row, end, data, offsets in text_pieces(batch, column, SHARD_BYTES):
        hashes, first = words_of(data, offsets)
        before = 0
        if row == last:
            before = len(carry)
            hashes = np.concatenate([carry, hashes])
            first = np.array([0, len(hashes)])
        else:
            seen = 0
        yield row, end, hashes, first, seen - before, before
        seen += len(hashes) - before
        last, carry = row, hashes[len(hashes) - min(keep, len(hashes)) :]


def _found(sent, window: int):
    """The pass of a block: rows with what they hold of the blocks before and of this one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = sent.value if sent is not None else None
        if block is not None:
            windows, length = _windows(block, window)
            everything = suffix_array(block.words, block.left, np.arange(len(block.words)), block.longest)
        for batch in batches:
            n = batch.num_rows
            n_words, longest, longest_item = np.zeros(n, np.int64), batch.column(5).to_numpy().copy(), batch.column(6).to_pylist()
            found = [set(x) for x in batch.column(3).to_pylist()]
            hits = [[(s["begin"], s["end"]) for s in x] for x in batch.column(4).to_pylist()]
            for row, end, hashes, first, at, before in _shards(batch, 1, block.longest if block is not None else 0):
                n_words[row:end] += np.diff(first) - before
                if block is None or not len(hashes):
                    continue
                shard = Shard(hashes, first, block, window)
                if not len(shard.array):
                    continue
                for w, places in shard.matches(block, windows, length):
                    for place in places:
                        t = int(shard.text_of[place])
                        if (item := block.ids[block.item[windows[w]]]) is not None:
                            found[row + t].add(item)
                        hits[row + t].append((at + place - int(first[t]), at + place - int(first[t]) + int(length[w])))
                size, suffix = match_lengths(shard.words, shard.reach, shard.array, block, everything)
                texts = shard.text_of[shard.position[shard.array]]
                order = np.lexsort((shard.array, -size, texts))  # of each text the longest match, then the first
                for k in order[np.unique(texts[order], return_index=True)[1]].tolist():
                    if size[k] > longest[row + int(texts[k])]:
                        longest[row + int(texts[k])], longest_item[row + int(texts[k])] = size[k], block.ids[block.item[suffix[k]]]
            spans = [[{"begin": b, "end": e} for b, e in _united(h)] for h in hits]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(spans, _SPANS), pa.array(longest), pa.array(longest_item, pa.string())], ["doc", "text", "n_words", "item_ids", "hits", "longest", "longest_item"])

    return work


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without overlaps."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(set(spans)):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_column: str = "text", item_id_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, with all their columns, of which no window of an item occurs, whether or not the item has an id. The rows pass
    through; each block of items is one more pass of what the one before kept and wrote."""
    column, passed = docs.columns.index(text_column), False
    for block in blocks(need(items, item_id_column, item_text_column), item_id_column, item_text_column, block_words):
        if passed:
            docs = written(docs, "suffix_decontamination")
        passed = True
        docs = docs.mapInArrow(_clean_rows(docs.sparkSession.sparkContext.broadcast(block), column, window), docs.schema)
    return docs


def _windows(block: Block, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at which a window of an item begins, and the windows' lengths."""
    sizes = np.diff(block.bounds)[block.item]
    at = np.flatnonzero((block.left >= window) | ((block.left == sizes) & (sizes < window)))
    return at, np.minimum(block.left, window)[at]


def _clean_rows(sent, column: int, window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        windows, length = _windows(block, window)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, _, hashes, first, _, _ in _shards(batch, column, window):
                shard = Shard(hashes, first, block, window)
                for _, places in shard.matches(block, windows, length):
                    keep[row + shard.text_of[places]] = False
            yield batch.filter(pa.array(keep))

    return work


def op2_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    spans = F.array_sort("hits")
    # spans of several blocks may overlap: count each word once
    state = F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("at")), lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.end - F.greatest(s.begin, a.at))).cast("bigint").alias("n"), F.greatest(a.at, s.end).alias("at")), lambda a: a.n)
    return found.select("doc_id", "n_words", state.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), F.col("longest").alias("longest_match"), "longest_item")
