"""Operator 7, language ID by prediction by partial matching: a variable-order context tree of bytes for each language.

A tree holds, for each context of up to `max_order` bytes, how often each byte followed. A byte that a context has not seen costs
the context's escape probability (method C: distinct successors / (occurrences + distinct successors)) and is looked up in the next
shorter context, at last among all 256 bytes alike; a context that the tree lacks costs nothing. After training the counts stay as
they are, so every byte has one exact code length in bits after its context, and a text's code length in each language is the sum.
The shortest code wins; ties go to the language that sorts first.

Trees are sorted arrays of byte sequences with their bits, one set for each length, so they hold what the sample has and no more:
the order and the bytes are the same for two languages and for a hundred. ASCII letters count without case, digits as one byte and
white space as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, crc_mod, need, read, text_pieces

UNDETERMINED = "und"
MAX_ORDER = 3

_FOLD = LOWER.copy()
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13]] = 32


def sequence_codes(data: np.ndarray, offsets: np.ndarray, order: int, before: bytes = b"") -> np.ndarray:
    """For each byte the number that it makes with the `order` bytes before it, the oldest first. Before a text's begin there is
    white space, or, for the first text, what is given."""
    lead = np.frombuffer((b" " * order + before)[len(before) :] if order else b"", np.uint8)
    own = _FOLD[np.concatenate([lead, data])].astype(np.int64)
    n = len(data)
    position = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    position[: offsets[1] if len(offsets) > 1 else 0] += order  # the first text has its lead
    codes = own[order:].copy()
    for back in range(1, order + 1):
        earlier = own[order - back : order - back + n].copy()
        earlier[position < back] = 32
        codes |= earlier << (8 * back)
    return codes


class Tree:
    """One language's contexts. For each order k: sequences of k + 1 bytes with the bits of the last one after the others, and
    contexts of k bytes with the bits of their escape; both sorted."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.levels = []
        for k in range(order, -1, -1):
            keys, inverse = np.unique(codes & ((1 << (8 * (k + 1))) - 1), return_inverse=True)
            c = np.bincount(inverse, counts, len(keys))
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            seen = np.bincount(of, minlength=len(contexts))
            whole = np.bincount(of, c, len(contexts)) + seen
            self.levels.append((keys, -np.log2(c / whole[of]), contexts, -np.log2(seen / whole)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each sequence."""
        out = np.zeros(len(codes))
        left = np.arange(len(codes))
        for k, (keys, cost, contexts, escape) in zip(range(len(self.levels) - 1, -1, -1), self.levels, strict=True):
            own = codes[left] & ((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            out[left[hit]] += cost[at[hit]]
            left, own = left[~hit], own[~hit] >> 8
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            known = contexts[at] == own
            out[left[known]] += escape[at[known]]
        out[left] += 8
        return out


class Trees:
    """Frozen statistics: the languages and a tree for each."""

    def __init__(self, languages: list[str], trees: list[Tree], order: int):
        self.languages, self.trees, self.order = languages, trees, order


def train(labelled: DataFrame, lang_column: str = "lang", text_column: str = "text", id_column: str = "doc_id", per_language: int = 600, max_order: int = MAX_ORDER, most_languages: int = 1000) -> Trees:
    """Trees from about `per_language` documents of each language: the bound of the sample. A row is in it by a hash of its id and
    text, whatever the id, so that no sort is needed, and rows equal in both are in it once; rows with null text or language are
    left out. Of more than `most_languages` values those with the most rows are learned, ties by name: one row for each comes to
    the driver, and then one for each sequence of `max_order` + 1 bytes that its sample has."""
    labelled = need(labelled, id_column, lang_column, text_column).where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    keyed = labelled.select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(F.lit("sample"), id_column, text_column).alias("h"))
    # different rows, so that a language of few texts that repeat is still drawn
    sizes = {r.lang: max(1, r.n) for r in keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Trees([], [], max_order)
    languages, ring = sorted(sizes), 1 << 30
    share = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(ring, ring * per_language // sizes[name] + 1)))])
    sample = keyed.where(F.pmod("h", F.lit(ring)) < share[F.col("lang")]).dropDuplicates(["lang", "h"]).select("lang", "text")
    number = {name: i for i, name in enumerate(languages)}

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for row, end, codes, offsets in _codes(batch, 1, max_order):
                language = np.repeat(own[row:end], np.diff(offsets))
                for i in np.unique(language).tolist():
                    code, n = np.unique(codes[language == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i)), pa.array(code), pa.array(n)], ["language", "code", "n"])

    rows = sample.mapInArrow(sequences, "language long, code long, n long").groupBy("language", "code").agg(F.sum("n").alias("n")).toArrow()
    language, code, n = (rows.column(i).to_numpy() for i in range(3))
    trees = [Tree(code[language == i], n[language == i], max_order) for i in range(len(languages))]
    # a language whose sampled texts are all empty has no tree
    named = [(name, t) for name, t in zip(languages, trees, strict=True) if len(t.levels[0][0])]
    return Trees([name for name, _ in named], [t for _, t in named], max_order)


def _codes(batch: pa.RecordBatch, column: int, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Sequences of a batch's texts, in slices of bounded size; a long text comes in pieces, each with the bytes before it."""
    last, before = -1, b""
    for row, end, data, offsets in text_pieces(batch, column):
        yield row, end, sequence_codes(data, offsets, order, before if row == last else b""), offsets
        last = row
        before = (before + data[-order:].tobytes())[-order:] if order else b""


def predict(docs: DataFrame, trees: Trees, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score): the language with the shortest code for the whole text, and its share of the probability
    when all languages are as likely before. A text that is null or has no letter gets `und` and 0, and so does every text when
    nothing was learned. Each row counts by itself; columns beyond id and text play no part."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)  # what per_language documents of each language have
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Trees = sent.value
        for batch in batches:
            best, score, known = judge(batch, 1, t)
            names = pa.array([t.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(np.where(known, score, 0.0))], [id_column, "lang_pred", "score"])

    return need(docs, id_column, text_column).mapInArrow(work, f"{id_column} {kind}, lang_pred string, score double")


def _has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def code_lengths(batch: pa.RecordBatch, column: int, t: Trees) -> np.ndarray:
    """Bits of each text in each language. A slice's distinct sequences are looked up once."""
    bits = np.zeros((batch.num_rows, len(t.languages)))
    for row, end, codes, offsets in _codes(batch, column, t.order):
        if not len(codes):
            continue
        distinct, inverse = np.unique(codes, return_inverse=True)
        full = np.flatnonzero(np.diff(offsets))
        for i, tree in enumerate(t.trees):
            bits[row + full, i] += np.add.reduceat(tree.bits(distinct)[inverse], offsets[full])
    return bits


def judge(batch: pa.RecordBatch, column: int, t: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language, its score, and whether the text has a letter, for each row."""
    letters = _has_letter(batch.column(column))
    if not t.languages:
        return np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), letters & False
    bits = code_lengths(batch, column, t)
    return bits.argmin(axis=1), 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1), letters


def keep_known(docs: DataFrame, trees: Trees, text_column: str = "text", least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose language is known with a score of `least` or more. Texts that are null or
    have no letter go; with nothing learned, all others stay."""
    sent, column = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, score, known = judge(batch, column, sent.value)
            if not sent.value.languages:
                known, score = _has_letter(batch.column(column)), score + 1
            yield batch.filter(pa.array(known & (score >= least)))

    return docs.mapInArrow(work, docs.schema)


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is not held out."""
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
