"""Operator 1, toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents of which nothing is assumed are the unlabelled ones, a mixture that holds
a known share of toxic text, the class prior. Linear classifiers over words and beginnings of words minimise, in numpy, the
risk prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)); where a batch's second term turns negative, the step
goes up on that term alone, which keeps the classifier from explaining away its positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import LOWER, WORD, crc_mod, cut, hash_runs, mix, need, read, runs, text_pieces

THRESHOLD = 0.7
#: A feature is a whole word or its first so many bytes.
BEGINNINGS = (3, 4, 5, 6)
#: Buckets of the counts from which features are chosen.
BUCKETS = 1 << 19


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and of its beginnings, with repeats."""
    lower = LOWER[data]
    starts, ends = runs(data, offsets, WORD)
    text = np.searchsorted(offsets, starts, "right") - 1
    rows, values = [text], [hash_runs(lower, starts, ends)]
    for size in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > size)
        rows.append(text[longer])
        values.append(mix(hash_runs(lower, starts[longer], starts[longer] + size) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(values)


class Classifiers:
    """Chosen features (sorted), and weights and biases with a column for each classifier."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, biases: np.ndarray):
        self.chosen, self.weights, self.biases = chosen, weights, biases


def choose(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int, most: int) -> np.ndarray:
    """Buckets that are at least twice as frequent among the positives, by far more than chance; the clearest `most`."""
    p, u = positive / max(n_positive, 1), unlabelled / max(n_unlabelled, 1)
    z = (p - u) / np.sqrt((u * (1 - u) + 1 / max(n_unlabelled, 1)) / max(n_positive, 1))
    good = np.flatnonzero((p >= 2 * u) & (z >= 5))
    return np.sort(good[np.lexsort((good, -z[good]))[:most]])


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, seed: int, epochs: int = 80, warm_up: int = 20, batch: int = 1024, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias, by Adam over batches that hold positives and unlabelled rows in proportion: first under the logistic
    loss, which has no flat parts, then under the sigmoid loss, whose bound keeps single rows from ruling the risk."""
    rng = np.random.default_rng(seed)
    w = np.zeros(xp.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    parts = max(1, -(-len(xu) // batch))

    def slope(x: np.ndarray, sign: int, logistic: bool) -> tuple[float, np.ndarray]:
        """Mean loss of rows taken as of class `sign`, and its gradient."""
        z = np.clip(sign * (x @ w[:-1] + w[-1]), -60, 60)
        wrong = 1 / (1 + np.exp(z))
        pull = -sign * (wrong if logistic else 4 * wrong * (1 - wrong)) / len(x)
        return float((np.logaddexp(0, -z) if logistic else 4 * wrong).mean()), np.append(pull @ x, pull.sum())

    for epoch in range(epochs):
        logistic = epoch < warm_up
        for bp, bu in zip(np.array_split(rng.permutation(len(xp)), parts), np.array_split(rng.permutation(len(xu)), parts), strict=True):
            if not len(bp) or not len(bu):
                continue
            _, up = slope(xp[bp], 1, logistic)
            loss_n, down_p = slope(xp[bp], -1, logistic)
            loss_u, down_u = slope(xu[bu], -1, logistic)
            gradient = prior * up + down_u - prior * down_p if loss_u - prior * loss_n >= 0 else prior * down_p - down_u
            gradient[:-1] += decay * w[:-1]
            step += 1
            m = 0.9 * m + 0.1 * gradient
            v = 0.999 * v + 0.001 * gradient**2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", positives: int = 4000, unlabelled: int = 12000, most_features: int = 1024, classifiers: int = 3, prior: float | None = None) -> Classifiers:
    """Classifiers from about `positives` documents labelled 1 and about `unlabelled` documents of `docs`, whatever their label:
    both bounds of the sample. Positives are drawn by the hash of the label's id, the others by a hash of id and text, so that null
    and repeated ids are no more likely than others; no layout of the rows changes the sample. The class prior is the share of 1 among the labels, unless
    it is given. `docs` and `labels` hold only what may be learned from. Without positives or documents the score is 0."""
    spark = docs.sparkSession
    docs, labels = need(docs, id_column, text_column), need(labels, id_column, label_column).where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).alias(label_column))
    known = labels.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col(label_column) == 1).cast("long")), F.lit(0)).alias("p")).first()
    total = docs.count()
    if not known.p or not total:
        return Classifiers(np.zeros(0, np.uint64), np.zeros((0, 1)), np.full(1, -60.0))
    prior = min(0.5, max(1e-4, prior if prior is not None else known.p / known.n))
    ring = 1 << 30
    drawn = lambda h, most, of: F.pmod(h, F.lit(ring)) < int(min(ring, ring * most // of + 1))
    chosen_ids = labels.where((F.col(label_column) == 1) & drawn(F.xxhash64(F.col(id_column)), positives, known.p)).select(F.col(id_column).alias("id"))  # about `positives` ids
    keyed = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(F.lit("sample"), id_column, text_column).alias("h"))
    # rows equal in id and text are one; texts that share an id may exceed the bound, then those with the smallest hashes are taken
    first = lambda rows, positive, most: rows.dropDuplicates(["h"]).orderBy("h").limit(2 * most).select(F.lit(positive).alias("positive"), F.col("text").alias(text_column))
    p = first(keyed.join(F.broadcast(chosen_ids), "id", "left_semi"), 1, positives)
    u = first(keyed.where(drawn(F.col("h"), unlabelled, total)), 0, unlabelled)
    sample = cut(p.unionAll(u))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS + 1), np.int64)  # the last one counts documents
        for batch in batches:
            kinds = np.array(batch.column(0).to_pylist(), np.int64)
            np.add.at(n[:, BUCKETS], kinds, 1)
            found = []
            for row, _, data, offsets in text_pieces(batch, 1):
                text, value = features(data, offsets)
                found.append(np.unique((row + text) * BUCKETS + (value % np.uint64(BUCKETS)).astype(np.int64)))
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)  # pieces of one text share features
            np.add.at(n, (kinds[pairs // BUCKETS], pairs % BUCKETS), 1)
        where = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*where, n[where])], ["positive", "bucket", "n"])

    rows = sample.mapInArrow(count, "positive long, bucket long, n long").groupBy("positive", "bucket").agg(F.sum("n").alias("n")).toArrow()  # 2 * BUCKETS at most
    kinds, bucket, number = (rows.column(i).to_numpy() for i in range(3))
    counts = np.zeros((2, BUCKETS + 1), np.int64)
    counts[kinds, bucket] = number
    chosen = choose(counts[1, :-1], counts[0, :-1], counts[1, -1], counts[0, -1], most_features)

    def matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, lists = batch.column(0), [[] for _ in range(batch.num_rows)]
            for row, _, data, offsets in text_pieces(batch, 1):
                for i, own in enumerate(present(data, offsets, chosen), row):
                    lists[i] = sorted({*lists[i], *own}) if lists[i] else own
            yield pa.RecordBatch.from_arrays([kinds.cast(pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["positive", "own"])

    table = sample.mapInArrow(matrix_rows, "positive long, own array<int>").toArrow()  # as many short lists as the sample has rows
    x = np.zeros((table.num_rows, len(chosen)), np.float32)
    for i, own in enumerate(table.column(1).to_pylist()):
        x[i, own] = 1
    positive = table.column(0).to_numpy() == 1
    fits = [fit_nnpu(x[positive], x[~positive], prior, seed) for seed in range(classifiers)] if positive.any() and not positive.all() else [(np.zeros(len(chosen)), -60.0)]
    return Classifiers(chosen, np.stack([w for w, _ in fits], axis=1), np.array([b for _, b in fits]))


def present(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> list[list[int]]:
    """For each text the numbers of the chosen features that occur in it."""
    out: list[list[int]] = [[] for _ in range(len(offsets) - 1)]
    for pair in _pairs(data, offsets, chosen).tolist():
        out[pair // max(len(chosen), 1)].append(pair % max(len(chosen), 1))
    return out


def _pairs(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    if not len(chosen):
        return np.zeros(0, np.int64)
    number = np.full(BUCKETS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    text, value = features(data, offsets)
    own = number[(value % np.uint64(BUCKETS)).astype(np.int64)]
    return np.unique(text[own >= 0] * len(chosen) + own[own >= 0])


def score(docs: DataFrame, model: Classifiers, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, score): the classifiers' mean probability for each whole text. Null and empty texts and texts without words have
    the score of a text without any feature. Long texts are looked at in pieces, cut before white space, and a feature counts once for a text. Each row is scored; columns beyond id and text play no part."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # most_features rows
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classifiers = sent.value
        for batch in batches:
            margin, width = np.tile(m.biases, (batch.num_rows, 1)), max(len(m.chosen), 1)
            found = [row * width + _pairs(data, offsets, m.chosen) for row, _, data, offsets in text_pieces(batch, 1)]
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)  # pieces of one text share features
            np.add.at(margin, pairs // width, m.weights[pairs % width])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((1 / (1 + np.exp(-np.clip(margin, -60, 60)))).mean(axis=1))], [id_column, "score"])

    return need(docs, id_column, text_column).mapInArrow(work, f"{id_column} {kind}, score double")


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))  # a null id is not held out


def op1_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
