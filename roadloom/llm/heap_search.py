"""Operator 12, ranked lexical search by a document-at-a-time merge of compressed postings.

The index: each task cuts its documents into shards of bounded text and makes one row of each: the shard's documents in the order of
their ids, its terms by hash, and for each term a list of postings (document, occurrences) in blocks of `BLOCK`, as differences in a
variable number of bytes. Nothing is shuffled for that. Counts over all shards give each term its weight.

The search: an item's terms are looked up in a shard, and their lists merge in the order of the documents. A heap has each list's
current block under its last document; the smallest one is the document up to which all lists are known, so the postings up to it
merge, a document's own next to each other, and the heap goes on to the next blocks. A block is unpacked once for all items of a
shard. Scores enter a heap of the k best of the item, under (score, document); later shards of the task go on with it. What the tasks
found merges by one window.

Items are dealt to blocks of bounded size, and each block is a job of its own over the shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, SLICE_BYTES, WORD, cut, hash_runs, need, read, runs, text_pieces, through_filter, written

TOP = 50
#: Postings of a block.
BLOCK = 1024
#: A shard has about so many bytes of text; one longer text is a shard by itself.
SHARD_BYTES = 8 << 20
#: Pairs of item and term of a block of items, which is sent to all tasks (16 bytes each); one item with more is a block by itself.
BLOCK_TERMS = 1 << 16


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 in as many bytes as they need, seven bits each, low ones first, the last byte below 128; and where each begins."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    rest = values >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest >>= np.uint64(7)
    begins = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begins[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        byte = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[begins[:-1][has] + k] = byte.astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, begins


def unpacked(data: np.ndarray) -> np.ndarray:
    last = data < 128
    ends = np.flatnonzero(last) + 1
    begins = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(begins, ends - begins)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begins) if len(data) else np.zeros(0, np.int64)


def make_shard(ids: pa.Array, texts: list[tuple[np.ndarray, np.ndarray]]) -> dict:
    """The row of a shard. ids: its documents' ids; texts: (document's number, hash) of all their terms, in parts."""
    doc = np.concatenate([d for d, _ in texts]) if texts else np.zeros(0, np.int64)
    h = np.concatenate([x for _, x in texts]).view(np.int64) if texts else np.zeros(0, np.int64)
    length = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    turn = pc.sort_indices(ids).to_numpy()  # null ids last
    place = np.empty(len(ids), np.int64)
    place[turn] = np.arange(len(ids))
    doc = place[doc]
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times, doc, h = np.diff(np.concatenate([at, [len(h)]])), doc[at], h[at]
    terms, first, df = np.unique(h, return_index=True, return_counts=True)
    rank = np.arange(len(h)) - np.repeat(first, df)
    block_first = np.flatnonzero(rank % BLOCK == 0)
    block_end = np.concatenate([block_first[1:], [len(h)]]).astype(np.int64)
    gap = np.diff(doc, prepend=0)
    gap[block_first] = doc[block_first]
    # a block: its differences, then its occurrences
    size = block_end - block_first
    mine = np.repeat(block_first, size) + np.arange(len(h)) - np.repeat(block_first, size)  # all postings, block by block
    target = np.repeat(2 * block_first, size) + (mine - np.repeat(block_first, size))
    values = np.zeros(2 * len(h), np.int64)
    values[target] = gap
    values[target + np.repeat(size, size)] = times
    data, begins = packed(values)
    blocks = np.concatenate([np.searchsorted(block_first, first), [len(block_first)]]) if len(h) else np.zeros(1, np.int64)
    return {
        "docs": int((length > 0).sum()),
        "tokens": int(length.sum()),
        "ids": ids.take(pa.array(turn)).cast(pa.int64()).to_pylist(),
        "length": length[turn].tolist(),
        "terms": terms,
        "df": df.astype(np.int64),
        "blocks": blocks.tobytes(),
        "last": (doc[block_end - 1] if len(h) else doc).astype(np.int64).tobytes(),
        "begin": begins[np.append(2 * block_first, 2 * len(h))].tobytes(),
        "postings": data.tobytes(),
    }


SHARD_SCHEMA = "docs long, tokens long, ids array<long>, length array<long>, terms array<long>, df array<long>, blocks binary, last binary, begin binary, postings binary"
_TYPES = [pa.field("docs", pa.int64()), pa.field("tokens", pa.int64()), *[pa.field(n, pa.list_(pa.int64())) for n in ("ids", "length", "terms", "df")], *[pa.field(n, pa.binary()) for n in ("blocks", "last", "begin", "postings")]]


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of each term of a piece: runs of ASCII letters and digits and all that is not ASCII, A-Z in lower case."""
    starts, ends = runs(data, offsets, WORD)
    return np.searchsorted(offsets, starts, "right") - 1, hash_runs(LOWER[data], starts, ends)


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of (doc, text), one a row, written below the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        ids, texts, held, rows = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            made = make_shard(pa.concat_arrays(ids), texts)
            return pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in _TYPES], schema=pa.schema(_TYPES))

        for batch in batches:
            before = -1
            for row, end, data, offsets in text_pieces(batch, 1, min(SLICE_BYTES, shard_bytes)):
                if row != before and held and held + len(data) > shard_bytes:
                    yield shard()
                    ids, texts, held, rows = [], [], 0, 0
                if row != before:  # a further piece of a text belongs to the document that was begun
                    ids.append(batch.column(0).slice(row, end - row))
                    first = rows
                    rows += end - row
                before = row
                text, h = term_runs(data, offsets)
                texts.append((first + text, h))
                held += len(data)
        if rows:
            yield shard()

    return written(docs.mapInArrow(work, SHARD_SCHEMA), "heap_search", "shards")


class Shard:
    """A shard's lists, as they are asked for. `impact` of a posting is its score for the weight 1."""

    def __init__(self, row: dict, n_docs: int, n_tokens: int):
        self.terms = row["terms"]
        self.ids, length = row["ids"], row["length"].to_numpy()
        self._blocks, self._last, self._begin = (np.frombuffer(row[c], np.int64) for c in ("blocks", "last", "begin"))
        self._data = np.frombuffer(row["postings"], np.uint8)
        self._m = 50 + (50 * length * n_docs) // n_tokens
        self._kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms in the shard's table, -1 for those that it doesn't have."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of a block."""
        if k not in self._kept:
            values = unpacked(self._data[self._begin[k] : self._begin[k + 1]])
            doc, times = np.cumsum(values[: len(values) // 2]), values[len(values) // 2 :]
            self._kept[k] = (doc, 1_000_000_000 * times // (1000 * times + 20 * self._m[doc]))
        return self._kept[k]

    def merge(self, places: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents in order, scores), some at a time, of the documents with one of the terms."""
        heap = [(int(self._last[self._blocks[p]]), n, int(self._blocks[p]), 0) for n, p in enumerate(places.tolist())]
        heapq.heapify(heap)
        while heap:
            known = heap[0][0]  # no list's current block ends before this document
            docs, scores, later = [], [], []
            for last, n, k, at in heap:
                doc, impact = self.block(k)
                end = int(np.searchsorted(doc, known, "right"))
                docs.append(doc[at:end])
                scores.append(weights[n] * impact[at:end])
                later.append((last, n, k, end))
            doc, score = np.concatenate(docs), np.concatenate(scores)
            order = np.argsort(doc, kind="stable")  # merges runs that are in order
            doc, score = doc[order], score[order]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            yield doc[first], np.add.reduceat(score, first)
            heap = later
            for i, (last, n, k, _) in enumerate(heap):
                if last == known:  # this block is used up
                    more = k + 1 < self._blocks[places[n] + 1]
                    heap[i] = (int(self._last[k + 1]), n, k + 1, 0) if more else (-1, n, k, 0)
            heap = [x for x in heap if x[0] >= 0]
            heapq.heapify(heap)


class Top:
    """The k best documents of an item: a heap with the worst one on top, under (score, id): of equal scores the larger id is the
    worse, a null id the worst. Documents with the same id count each by itself."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def add(self, ids: np.ndarray, scores: np.ndarray, null: np.ndarray) -> None:
        good = scores > 0
        if len(self.heap) == self.k:
            good &= scores >= self.heap[0][0]
        at = np.flatnonzero(good)
        if len(at) > self.k:
            at = at[np.lexsort((ids[at], null[at], -scores[at]))[: self.k]]
        for i in at.tolist():
            entry = (int(scores[i]), -int(null[i]), -int(ids[i]))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, id, h): the distinct terms of each item of (item, id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_pieces(batch, 2):
                text, h = term_runs(data, offsets)
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                own = batch.slice(row, end - row).take(pa.array(text[new]))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(h[new].view(np.int64))], ["item", "id", "h"])

    kind = items.schema["id"].dataType.simpleString()
    return items.mapInArrow(work, f"item long, id {kind}, h long").distinct()  # pieces of one text share terms


def search(shards: DataFrame, items: DataFrame, id_column: str = "item_id", text_column: str = "text", k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's k documents with the highest scores above 0, equal scores by ascending id.
    shards: as `build` gives them. Items and documents without terms have no rows and don't count. Rows of items equal in id and text
    are one item; rows with the same id and another text are an item of their own. A null id, of an item or a document, is an id,
    after all others. Documents that repeat come each by itself. Further columns play no part."""
    total = shards.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("l")).first()
    n, tokens = total.n, max(1, total.l)
    kind = items.schema[id_column].dataType.simpleString()
    asked = need(items, id_column, text_column).select(F.xxhash64(id_column, text_column).alias("item"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    asked = written(item_terms(asked), "heap_search", "terms")
    wanted = cut(asked.select("h").distinct())
    own = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).select(F.col("t.terms").alias("h"), "t.df")
    df = through_filter(own, wanted).groupBy("h").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1)))
    weighed = asked.join(df, "h").select("item", "id", "h", weight.alias("w")).where("w > 0")
    lists = weighed.groupBy("item").agg(F.first("id").alias("id"), F.collect_list(F.struct("h", "w")).alias("terms"))
    lists = written(lists, "heap_search", "items")
    blocks = max(1, -(-(lists.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    grouped = written(lists.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("item", "terms")).alias("items")), "heap_search", "blocks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Top] = {}
        asks = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                if asks is None:  # the same on all rows
                    terms = row["items"].values.field("terms")
                    pairs, at = terms.values, terms.offsets.to_numpy()
                    h, w = pairs.field("h").to_numpy(), pairs.field("w").to_numpy()
                    asks = [(item, h[a:b], w[a:b]) for item, a, b in zip(row["items"].values.field("item").to_pylist(), at[:-1], at[1:], strict=True)]
                shard = Shard({c: row[c].values.to_numpy() if c == "terms" else row[c].values if c in ("ids", "length") else row[c].as_buffer() for c in ("terms", "ids", "length", "blocks", "last", "begin", "postings")}, n, tokens)
                null = shard.ids.is_null().to_numpy(zero_copy_only=False)
                ids = shard.ids.fill_null(0).to_numpy()
                for item, h, w in asks:
                    places = shard.find(h)
                    has = places >= 0
                    for doc, score in shard.merge(places[has], w[has]):
                        best.setdefault(item, Top(k)).add(ids[doc], score, null[doc])
        rows = [(item, None if worse else -name, score) for item, top in best.items() for score, worse, name in top.heap]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["item", "doc", "score"])

    found = []
    for b in range(blocks):
        # one row, of block_terms pairs or one item
        here = shards.drop("docs", "tokens", "df").withColumn("block", F.lit(b)).join(F.broadcast(grouped.where(F.col("block") == b)), "block").drop("block")
        found.append(written(here.mapInArrow(work, "item long, doc long, score long"), "heap_search", "found"))
    found = reduce(DataFrame.union, found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))  # Spark keeps k of a group before the shuffle
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(lists.select("item", "id"), "item").select(F.col("id").cast(kind).alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op12_heap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return search(build(docs), read(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
t AS (SELECT r, unnest(terms) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
m AS (SELECT r, doc_id, 100 - 50 + ((50 * len(terms) * s.n) // s.l) AS m FROM d CROSS JOIN s WHERE len(terms) > 0),
w AS (SELECT term, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf CROSS JOIN s GROUP BY term, s.n),
i AS (SELECT DISTINCT item_id, text, unnest({_TERMS.format("text")}) AS term FROM benchmark),
scored AS (
  SELECT i.item_id, i.text, m.r, m.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m)))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL
),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
