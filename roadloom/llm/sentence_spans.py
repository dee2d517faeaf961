"""Operator 3, substring dedup by sliding sentence spans.

Every run of `sentences` consecutive sentences is a span, whatever their length, and so is every run of two whose words are
`enough_words` or more; longer runs that repeat are covered by the spans inside them, to their last sentence. A single sentence is
no span. Spans are hashed (words without case, whatever the white space) and met globally by hash; of each repeated span the
occurrence with the smallest (id, place) is the first, and sentences that any other occurrence covers are removed from their
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import Sentences, cut, need, read, text_slices

SENTENCES, ENOUGH_WORDS = 3, 40


def spans_of(s: Sentences, sentences: int, enough_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the sentences at which a span begins, and of the sentence after its end; none that would leave its text."""
    begin = np.arange(len(s.first_word))
    stop = s.first_sentence[1:][s.text]
    whole = begin[begin + sentences <= stop]
    two = begin[begin + 2 <= stop] if sentences > 2 else begin[:0]
    two = two[s.end_word[two + 1] - s.first_word[two] >= enough_words]
    return np.concatenate([whole, two]), np.concatenate([whole + sentences, two + 2])


def span_rows(docs: DataFrame, sentences: int, enough_words: int) -> DataFrame:
    """(h, doc, key, place, size) for every span of (doc, key, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in text_slices(batch, 2):
                s = Sentences(data, offsets)
                begin, end = spans_of(s, sentences, enough_words)
                if not len(begin):
                    continue
                h = s.hash_words(s.first_word[begin], s.end_word[end - 1]).view(np.int64)
                rows = pa.array(row + s.text[begin])
                place = (begin - s.first_sentence[s.text[begin]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place), pa.array((end - begin).astype(np.int32))], ["h", "doc", "key", "place", "size"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(work, f"h long, doc {kind}, key long, place int, size int")


def dedup_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sentences: int = SENTENCES, enough_words: int = ENOUGH_WORDS) -> DataFrame:
    """Rows (id, n_sentences, removed array<int>, text): the numbers of the sentences removed, from 0, and the text without them.

    A null text stays null and an empty one empty, with no sentences. Rows equal in id and text are one document: each comes out
    with the same result. Rows with the same id and other texts are documents of their own, ordered by a hash of the text; null
    ids come first. Further columns play no part."""
    d = need(docs, id_column, text_column)
    d = d.select(F.col(id_column).alias("doc"), F.xxhash64(id_column, text_column).alias("key"), F.col(text_column).alias("text"))
    spans = span_rows(d, sentences, enough_words)
    place = F.struct("doc", "key", "place")
    repeated = spans.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("not (first <=> last)").select("h", "first")
    repeated = cut(repeated)  # so that both sides of the join come from an exchange, and Spark can split a hot span's part
    later = spans.join(repeated, "h").where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("key").agg(F.collect_set(F.struct("place", "size")).alias("covered"))  # spans of one document
    kind = d.schema["doc"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, texts = np.zeros(batch.num_rows, np.int32), [[] for _ in range(batch.num_rows)], [None] * batch.num_rows
            present = batch.column(1).is_valid()
            for row, end, data, offsets in text_slices(batch, 1):
                s = Sentences(data, offsets)
                n[row:end] = np.diff(s.first_sentence)
                for i in range(row, end):
                    begin, stop = int(offsets[i - row]), int(offsets[i - row + 1])
                    listed = batch.column(2)[i].as_py()
                    if not listed:
                        texts[i] = data[begin:stop].tobytes().decode() if present[i].as_py() else None
                        continue
                    gone = sorted({p for x in listed for p in range(x["place"], x["place"] + x["size"])})
                    removed[i] = gone
                    keep = np.ones(stop - begin, bool)
                    base = int(s.first_sentence[i - row])
                    # a sentence goes with the white space up to the next word
                    edges = np.append(s.starts[s.first_word[base : int(s.first_sentence[i - row + 1])]], stop) - begin
                    for p in gone:
                        keep[edges[p] : edges[p + 1]] = False
                    texts[i] = data[begin:stop][keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(removed, pa.list_(pa.int32())), pa.array(texts, pa.string())], [id_column, "n_sentences", "removed", "text"])

    return d.join(covered, "key", "left").select("doc", "text", "covered").mapInArrow(work, f"{id_column} {kind}, n_sentences int, removed array<int>, text string")


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_spans(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", F.size("removed").alias("n_removed"), "removed", "text")
