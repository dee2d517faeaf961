"""Boosted trees over binned features, with nulls, categories and exact contributions.

A feature is a number from 0 below its number of bins: numbers by quantiles of the training rows, categories by their names. What is
missing (null, NaN, a name that wasn't seen) has a bin of its own, and each split learns to which side it goes. Training rows of equal
bins and label are one row with a weight. A level of a tree is one pass: every task sums gradients over its rows into histograms, Spark
adds them up by (node, feature, bin), and the driver, which sees no rows but at most nodes x features x bins sums, chooses the splits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructType

from roadloom.sources.tables import checkpointed


@dataclass
class Tree:
    """Nodes in arrays; feature -1 is a leaf. goes_left[node][bin]: where a row with that bin of the node's feature goes; the last
    bin is what is missing. cover: training rows at the node."""

    feature: list[int] = field(default_factory=lambda: [-1])
    goes_left: list[list[bool] | None] = field(default_factory=lambda: [None])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, goes_left: np.ndarray, sides: list[tuple[float, float]]) -> list[int]:
        """Turns a leaf into a node with two leaves, of the given (value, cover)."""
        children = [len(self.feature), len(self.feature) + 1]
        for value, cover in sides:
            for name, x in (("feature", -1), ("goes_left", None), ("left", -1), ("right", -1), ("value", value), ("cover", cover)):
                getattr(self, name).append(x)
        self.feature[node], self.goes_left[node], (self.left[node], self.right[node]) = feature, [bool(x) for x in goes_left], children
        return children

    def place(self, codes: np.ndarray, bins: int) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        table = np.array([g or [False] * (bins + 1) for g in self.goes_left])
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while (inner := feature[at] >= 0).any():
            go = table[at, codes[rows, np.maximum(feature[at], 0)]]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        return at

    def leaves(self) -> Iterator[tuple[float, list[int], np.ndarray, np.ndarray]]:
        """(value, features on the way, the bins of each that lead here, the share of each feature's splits in the cover) of a leaf."""
        stack = [(0, {})]
        while stack:
            node, way = stack.pop()
            if self.feature[node] < 0:
                yield self.value[node], list(way), np.array([w[0] for w in way.values()]), np.array([w[1] for w in way.values()])
                continue
            f, go = self.feature[node], np.array(self.goes_left[node])
            for child, takes in ((self.left[node], go), (self.right[node], ~go)):
                before, share = way.get(f, (np.ones(len(go), bool), 1.0))
                stack.append((child, {**way, f: (before & takes, share * self.cover[child] / self.cover[node])}))

    def mean(self) -> float:
        """The tree's value over the training rows."""
        leaves = [i for i, f in enumerate(self.feature) if f < 0]
        return sum(self.value[i] * self.cover[i] for i in leaves) / max(self.cover[0], 1e-300) if self.cover[0] else self.value[0]


def _sum_of(trees: list[Tree], codes: np.ndarray, bins: int) -> np.ndarray:
    total = np.zeros(len(codes))
    for t in trees:
        total += np.array(t.value)[t.place(codes, bins)]
    return total


@dataclass
class BoostedTrees:
    """A model: log odds `base` plus the trees' values. edges: upper bounds of a number's bins; names: those of a category's."""

    columns: list[str]
    edges: dict[str, list[float]]
    names: dict[str, list[str]]
    bins: int
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def codes(self, columns: list[pa.Array]) -> np.ndarray:
        """Bins of rows, given the model's columns in order: numbers as doubles, categories as strings."""
        out = np.full((len(columns[0]) if columns else 0, len(columns)), self.bins, np.uint8)
        for i, (name, x) in enumerate(zip(self.columns, columns, strict=True)):
            if name in self.names:
                found = pc.index_in(x, pa.array(self.names[name], pa.string()))
                out[:, i] = found.fill_null(self.bins).to_numpy(zero_copy_only=False)
            else:
                v = x.to_numpy(zero_copy_only=False).astype(np.float64)
                known = ~np.isnan(v)
                out[known, i] = np.searchsorted(self.edges[name], v[known], "left")
        return out

    def margin(self, codes: np.ndarray) -> np.ndarray:
        """Log odds of rows of bins."""
        return self.base + self.sum_of_trees(codes)

    def sum_of_trees(self, codes: np.ndarray) -> np.ndarray:
        return _sum_of(self.trees, codes, self.bins)

    def expected(self) -> float:
        """The margin over the training rows; contributions add to it."""
        return self.base + sum(t.mean() for t in self.trees)

    def contributions(self, codes: np.ndarray) -> np.ndarray:
        """Shapley values of each row's features, with what a row doesn't tell replaced by the shares of the training rows that went
        each way. For a leaf of value v, let o say whether a feature's bin leads there and z be the share of rows that its splits let
        through. A feature's value is v (o - z) times the integral over t from 0 to 1 of the product, over the other features on the way,
        of z (1 - t) + o t: a polynomial, which Gauss' rule integrates exactly."""
        phi = np.zeros((len(codes), len(self.columns)))
        for tree in self.trees:
            for value, features, allowed, share in tree.leaves():
                if not features:
                    continue
                x, w = np.polynomial.legendre.leggauss((len(features) + 1) // 2)
                t, w = (x + 1) / 2, w / 2
                o = np.stack([allowed[k][codes[:, f]] for k, f in enumerate(features)], axis=1).astype(np.float64)
                each = share[None, :, None] * (1 - t) + o[:, :, None] * t
                others = (each.prod(axis=1)[:, None, :] / each) @ w
                phi[:, features] += value * (o - share) * others
        return phi

    def save(self, path: str) -> None:
        text = json.dumps({**self.__dict__, "trees": [t.__dict__ for t in self.trees]})
        SparkSession.active().createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        values = json.loads(SparkSession.active().read.text(path).first()[0])
        return cls(**{**values, "trees": [Tree(**t) for t in values["trees"]]})


def bounds(rows: DataFrame, columns: list[str], categorical: list[str], bins: int) -> BoostedTrees:
    """A model without trees: at most bins - 1 quantiles of each number, in one aggregation, and the `bins` most frequent names of each
    category, ties by name."""
    numbers = [c for c in columns if c not in categorical]
    edges, names = {}, {}
    if numbers:
        known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        got = rows.agg(*[F.percentile_approx(known(c), F.lit([i / bins for i in range(1, bins)])).alias(f"_{i}") for i, c in enumerate(numbers)]).first()
        edges = {c: sorted(set(got[f"_{i}"] or [])) for i, c in enumerate(numbers)}
    for c in categorical:
        top = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("x")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "x").limit(bins)
        names[c] = sorted(r.x for r in top.collect())  # `bins` names
    return BoostedTrees(list(columns), edges, names, bins)


def _inputs(model: BoostedTrees) -> list:
    return [F.col(c).cast("string" if c in model.names else "double").alias(f"_x{i}") for i, c in enumerate(model.columns)]


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, categories: np.ndarray, l2: float, least_rows: int) -> tuple[float, int, np.ndarray] | None:
    """(gain, feature, goes_left) of the split of a node that gains most, None where none gains. g, h, n: sums over the node's rows by
    (feature, bin), the last bin for what is missing. Numbers are split between neighbouring bins, categories, in the order of their
    gradients over their weights, between neighbours in that order; what is missing goes to either side. Ties: the first feature, then
    the first split, then missing to the right, and where nothing is missing, to the side with more rows."""
    score = lambda x: np.where(x[..., 1] + l2 > 0, x[..., 0] * x[..., 0] / np.maximum(x[..., 1] + l2, 1e-300), 0.0)
    best, total = None, np.array([g[0].sum(), h[0].sum(), n[0].sum()])
    for f in range(len(g)):
        order = np.arange(g.shape[1] - 1)
        if categories[f]:
            order = order[n[f, order] > 0]
            order = order[np.argsort(g[f, order] / np.maximum(h[f, order] + l2, 1e-12), kind="stable")]
        at = np.cumsum(np.stack([g[f, order], h[f, order], n[f, order]]), axis=1)
        missing = np.array([g[f, -1], h[f, -1], n[f, -1]])
        ways = np.array([False, True] if missing[2] else [False])
        side = at[:, : at.shape[1] if missing[2] else max(at.shape[1] - 1, 0)].T[:, None] + missing * ways[:, None]  # [split, way, sum]
        other = total - side
        gain = score(side) + score(other) - score(total)
        gain = np.where((np.minimum(side[..., 2], other[..., 2]) >= max(least_rows, 1)) & (gain > 1e-9), gain, -np.inf).ravel()
        k = -1
        while len(more := np.flatnonzero(gain[k + 1 :] > (best[0] * (1 + 1e-9) if best else -np.inf))):  # sums come in any order
            k += 1 + int(more[0])
            split, way = divmod(k, len(ways))
            goes = np.zeros(g.shape[1], bool)
            goes[order[: split + 1]] = True
            goes[-1] = ways[way] if missing[2] else side[split, way, 2] > other[split, way, 2]
            best = (float(gain[k]), f, goes)
    return best


def fit(rows: DataFrame, columns: list[str], label: str, categorical: list[str] = [], held: str | None = None, iterations: int = 40, depth: int = 3, bins: int = 63, rate: float = 0.2, l2: float = 1.0, least_rows: int = 5, patience: int = 5) -> BoostedTrees:  # noqa: B006
    """Trees for the log odds of a 0/1 label. held: a boolean column; its rows aren't learned from, and when their loss hasn't fallen
    for `patience` trees, the trees after the best one go. Rows with a null label take no part; without rows of both labels the model
    has no trees. Margins are made anew every eight trees, so that a pass looks at eight trees at most."""
    rows = rows.where(F.col(label).isNotNull()).withColumn("_held", F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False))
    train = rows.where("not _held")
    model = bounds(train, columns, categorical, bins)
    sums = train.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("p")).first()
    if not 0 < sums.p < sums.n:
        model.base, model.gain = -30.0 if not sums.p else 30.0, [0.0] * len(columns)
        return model
    model.base = float(np.log(sums.p / (sums.n - sums.p)))
    width, categories = len(columns), np.array([c in categorical for c in columns])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = model.codes(b.columns[2:])
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(max(width, 1)), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed.cast(pa.binary())], ["y", "held", "codes"])

    equal = rows.select(F.col(label).cast("double"), "_held", *_inputs(model)).mapInArrow(encode, "y double, held boolean, codes binary").groupBy("y", "held", "codes").agg(F.count("*").alias("n"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                parts = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(3).to_numpy().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (*(x.tobytes() for x in parts), b"".join(b.column(2).to_pylist()))], ["y", "held", "n", "codes"])

    base = model.base

    def opened(r) -> tuple[np.ndarray, ...]:
        y = np.frombuffer(r.y)
        return y, np.frombuffer(r.held, bool), np.frombuffer(r.codes, np.uint8).reshape(len(y), -1), np.frombuffer(r.n), np.full(len(y), base)

    # blocks of rows: bins stay where they are read, and a pass is one job without a plan of its own
    blocks = checkpointed(equal.mapInArrow(packed, "y binary, held binary, n binary, codes binary")).rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    depth_of_sums = 1 if blocks.getNumPartitions() <= 32 else 2  # the driver adds up those of so many tasks itself

    def sums_of(tree: Tree, nodes: list[int], recent: list[Tree]) -> tuple[np.ndarray, float]:
        """Histograms [sum, node, feature, bin] of the open nodes, and the held rows' loss."""
        number = np.array([nodes.index(i) if i in nodes else -1 for i in range(len(tree.feature))])
        size, count = width * (bins + 1), len(nodes)

        def work(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
            total, loss = np.zeros((3, count * size)), 0.0
            for y, held_, codes, weight, margin in blocks:
                margin = margin + _sum_of(recent, codes, bins)
                loss += (weight * np.logaddexp(0, -(2 * y - 1) * margin))[held_].sum()
                p = 1 / (1 + np.exp(-margin))
                node = number[tree.place(codes, bins)]
                own = np.flatnonzero((node >= 0) & ~held_)
                at = (node[own, None] * size + np.arange(width) * (bins + 1) + codes[own]).ravel()
                for k, x in enumerate((weight * (p - y), weight * p * (1 - p), weight)):
                    total[k] += np.bincount(at, np.repeat(x[own], width), count * size)
            yield np.append(total, loss)

        got = blocks.mapPartitions(work).treeReduce(np.add, depth_of_sums)  # nodes * size, three times
        return got[:-1].reshape(3, count, width, bins + 1), float(got[-1])

    def moved(recent: list[Tree]):
        return lambda x: (*x[:4], x[4] + _sum_of(recent, x[2], bins))

    best_loss, best_trees, first, gains = np.inf, 0, 0, []
    while len(model.trees) < iterations and width:
        if len(model.trees) - first == 8:
            earlier, blocks = blocks, blocks.map(moved(model.trees[first:])).persist(StorageLevel.MEMORY_AND_DISK)
            blocks.count()
            earlier.unpersist()
            first = len(model.trees)
        tree, open_, gained = Tree(), [0], np.zeros(width)
        for level in range(depth):
            (g, h, n), loss = sums_of(tree, open_, model.trees[first:])
            if level == 0:
                if held and loss < best_loss - 1e-9:
                    best_loss, best_trees = loss, len(model.trees)
                tree.cover[0], tree.value[0] = float(n[0, 0].sum()), float(-rate * g[0, 0].sum() / (h[0, 0].sum() + l2))
            deeper = []
            for i, node in enumerate(open_):
                found = best_split(g[i], h[i], n[i], categories, l2, least_rows)
                if found is not None:
                    gain, f, goes = found
                    gained[f] += gain
                    sides = [(float(-rate * g[i, f, go].sum() / (h[i, f, go].sum() + l2)), float(n[i, f, go].sum())) for go in (goes, ~goes)]
                    deeper += tree.split(node, f, goes, sides)
            open_ = deeper
            if not open_:
                break
        if held and len(model.trees) - best_trees >= patience:
            break
        if len(tree.feature) == 1:
            break
        model.trees.append(tree)
        gains.append(gained)
    blocks.unpersist()
    # the loss with a tree is known when the next one is begun
    if held and best_trees < len(model.trees) - 1:
        model.trees = model.trees[:best_trees]
    model.gain = np.sum(gains[: len(model.trees)], axis=0).tolist() if model.trees else [0.0] * width
    return model


def _mapped(rows: DataFrame, model: BoostedTrees, made, columns: list[tuple[str, DataType]]) -> DataFrame:
    """The rows with further columns: made(codes) gives their values."""
    kept = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = model.codes(b.columns[len(kept) :])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *made(codes)], [*kept, *[c for c, _ in columns]])

    schema = StructType(list(rows.schema.fields))
    for name, kind in columns:
        schema = schema.add(name, kind)
    return rows.select("*", *_inputs(model)).mapInArrow(work, schema)


def scored(rows: DataFrame, model: BoostedTrees, margin: str = "margin") -> DataFrame:
    """The rows with their log odds. Null, NaN and names that weren't seen take the way that the splits learned for what is missing."""
    return _mapped(rows, model, lambda codes: [pa.array(model.margin(codes))], [(margin, DoubleType())])


def explained(rows: DataFrame, model: BoostedTrees, name: str = "contributions") -> DataFrame:
    """The rows with the contribution of each of the model's columns to the log odds, in their order; with `expected()` they add up to
    the margin."""
    return _mapped(rows, model, lambda codes: [pa.array(list(model.contributions(codes)), pa.list_(pa.float64()))], [(name, ArrayType(DoubleType()))])


def factors(rows: DataFrame, model: BoostedTrees, k: int = 3) -> DataFrame:
    """The rows with `factors`: the k features that push a row's odds up most, as structs (feature, value as text, contribution), ties by
    name; only what pushes up counts."""
    each = F.array(*[F.struct((-F.get("_phi", F.lit(i))).alias("order"), F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for i, c in enumerate(model.columns)])
    best = F.slice(F.array_sort(F.filter(each, lambda x: x["order"] < 0)), 1, k)
    named = F.transform(best, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), F.round(-x["order"], 3).alias("contribution")))
    return explained(rows, model, "_phi").select(*rows.columns, named.alias("factors"))


def gain_ranking(model: BoostedTrees) -> list[tuple[str, float]]:
    """(feature, gain) of the features that some split uses, most gain first, ties by name."""
    return sorted(((c, g) for c, g in zip(model.columns, model.gain, strict=True) if g > 0), key=lambda x: (-x[1], x[0]))
