"""Operator 9, exact top-k search by inner product in M-trees.

Vectors of integers are dealt to shards, and each shard's go into an M-tree: pages of metric entries, each with a routing vector,
a covering radius, the distance to its parent's routing vector, and the largest norm below it. With q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2
a distance that d(q, x) cannot fall below, and a norm that |x| cannot exceed, bound the inner product of all that lies below an
entry. A query takes pages in the order of their bounds until no page can still hold one of its k best; all queries of a block go on
together, each with its own order, and those that have come to the same page meet it as one product of matrices. Distances to the
entries of a page are bounded first by the triangle inequality from the stored distances to the parent, which leaves many
uncomputed. What a task has found in one tree bounds its search in the next.

The trees are built once and written. Queries are dealt to blocks of bounded size; a block meets a tree by a join of the two, so
neither queries nor vectors pass through the driver, and the k best of each shard are merged by one window.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.llm.common import read, written

PAGE = 64
#: What bounds may be off by, as their numbers are rounded.
SLACK = 1e-3
SHARD_ROWS = 4096
QUERY_BLOCK = 8192


class MTree:
    """A tree over integer vectors. Level 0 has the vectors themselves, with their ids, the last level is the root page. Of equal
    vectors only the `keep` smallest ids are kept: no more of them can be among the best."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        few = np.arange(len(ids)) - first[np.cumsum(new) - 1] < keep
        ids, points = ids[few], vectors[few].astype(np.float64)
        norms, radius = np.sqrt((points**2).sum(axis=1)), np.zeros(len(points))
        self.levels: list[dict] = []
        rng = np.random.default_rng(0)
        names = ids
        while True:
            route, page_of = self._assign(points, max(1, -(-len(points) // PAGE)), rng)
            to_parent = np.sqrt(((points - route[page_of]) ** 2).sum(axis=1))
            order = np.lexsort((names, page_of))  # within a page by id: ties go to the smaller one
            bounds = np.searchsorted(page_of[order], np.arange(len(route) + 1))
            self.levels.append({"points": points[order], "norm": norms[order], "radius": radius[order], "parent": to_parent[order], "name": names[order], "bounds": bounds})
            if len(route) == 1:
                self.root = route[0]
                return
            reach, top = np.zeros(len(route)), np.zeros(len(route))
            np.maximum.at(reach, page_of, to_parent + radius)
            np.maximum.at(top, page_of, norms)
            points, radius, norms, names = route, reach, top, np.arange(len(route))

    @staticmethod
    def _assign(points: np.ndarray, n_pages: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Routing vectors, chosen among the points and improved a little, and the page of each point; pages are not empty."""
        if n_pages == 1:
            return points[:1] * 0 + points.mean(axis=0), np.zeros(len(points), np.int64)
        route = points[rng.choice(len(points), n_pages, replace=False)]
        for _ in range(4):
            near = ((points**2).sum(axis=1)[:, None] - 2 * points @ route.T + (route**2).sum(axis=1)).argmin(axis=1)
            used, near = np.unique(near, return_inverse=True)
            total = np.zeros((len(used), points.shape[1]))
            np.add.at(total, near, points)
            route = total / np.bincount(near)[:, None]
        return route, near

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
        """The best of each query, bettered by what this tree has; the row of the id `own` with the query's vector is left out."""
        q = queries.astype(np.float64)
        square = (q**2).sum(axis=1)
        # pages of a level with an upper bound and the distance to their routing vector, for each query; -inf where it is pruned
        bound, distance = np.full((len(q), 1), np.inf), np.sqrt(((q - self.root) ** 2).sum(axis=1))[:, None]
        for here in self.levels[:0:-1]:
            n = len(here["points"])
            page = np.repeat(np.arange(len(here["bounds"]) - 1), np.diff(here["bounds"]))
            least = np.maximum(np.abs(distance[:, page] - here["parent"]) - here["radius"], 0)
            upper = (square[:, None] + here["norm"] ** 2 - least**2) / 2 + SLACK
            upper[~((bound[:, page] >= best.worst[:, None]) & (upper >= best.worst[:, None]))] = -np.inf
            far = np.full((len(q), n), np.inf)
            for k in np.flatnonzero((upper > -np.inf).any(axis=0)).tolist():  # entries that some query still asks for
                asks = np.flatnonzero(upper[:, k] > -np.inf)
                far[asks, k] = np.sqrt(np.maximum(square[asks] - 2 * q[asks] @ here["points"][k] + (here["points"][k] ** 2).sum(), 0))
            tight = (square[:, None] + here["norm"] ** 2 - np.maximum(far - here["radius"], 0) ** 2) / 2 + SLACK
            upper = np.where(upper > -np.inf, np.minimum(upper, tight), -np.inf)
            back = np.argsort(here["name"])  # entries in the order of the pages that they stand for
            bound, distance = upper[:, back], far[:, back]
        leaf = self.levels[0]
        turn = np.argsort(-bound, axis=1, kind="stable")
        for r in range(turn.shape[1]):
            page = turn[:, r]
            live = np.flatnonzero((bound[np.arange(len(q)), page] >= best.worst) & (bound[np.arange(len(q)), page] > -np.inf))
            if not len(live):
                break
            live = live[np.argsort(page[live], kind="stable")]
            pages, first = np.unique(page[live], return_index=True)
            for k, asks in zip(pages.tolist(), np.split(live, first[1:]), strict=True):
                at = slice(leaf["bounds"][k], leaf["bounds"][k + 1])
                least = np.abs(distance[asks, k][:, None] - leaf["parent"][at])
                some = ((square[asks, None] + leaf["norm"][at] ** 2 - least**2) / 2 + SLACK >= best.worst[asks, None]).any(axis=1)
                if (asks := asks[some]).size:
                    score = np.rint(q[asks] @ leaf["points"][at].T)
                    # equal norms and the norm's square as product: the query's own vector
                    itself = (leaf["name"][at] == own[asks, None]) & (score == square[asks, None]) & (np.rint(leaf["norm"][at] ** 2) == square[asks, None])
                    best.add(asks, np.where(itself, -np.inf, score), leaf["name"][at])


class Best:
    """The k best (score, id) of each query, ties to the smaller id; `worst` is the last one's score, -inf while there are fewer."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.worst = self.score[:, -1].copy()

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Further candidates of some queries: a matrix of scores, with the ids of its columns in order."""
        top = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        score = np.concatenate([self.score[rows], np.take_along_axis(score, top, 1)], axis=1)
        ids = np.concatenate([self.id[rows], ids[top]], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        self.worst[rows] = self.score[rows, -1]


def scaled(vector: str, scale: float = 256.0) -> Column:
    """The vector with each component x as floor(scale * x); null if it is null or holds a null, NaN or infinite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def search(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "v", k: int = 5, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, rank, id, score): for each query row its k highest inner products with the other rows, ties to the smaller
    id; all other rows, where there are fewer than k. vector_column: array<bigint>, with products that a double holds exactly.
    Rows with a null id or vector take no part; vectors of another length than the query's are no candidates. Rows equal in id and
    vector are one row. Rows with the same id and other vectors are rows of their own: each is a candidate for all others, and, where
    it is a query, has its own k best, which leave out that row alone. Further columns play no part.

    Rows are dealt to shards by a hash, so that no vector's copies meet in one shard."""
    v = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    v = v.where("id is not null and v is not null").withColumn("h", F.xxhash64("v")).groupBy("id", "h").agg(F.first("v").alias("v"), F.max("asks").alias("asks"))
    v = written(v, "metric_tree", "rows")
    sizes = v.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0)).alias("q")).first()
    shards, blocks = max(1, -(-sizes.n // shard_rows)), max(1, -(-sizes.q // query_block))
    parts = max(1, min(shards, -(-shards // 8)))  # a block goes to so many tasks, with some eight trees each

    def build(table: pa.Table) -> pa.Table:
        ids, own, by_size = table.column("id").to_numpy(), table.column("v").to_pylist(), {}
        for i, x in enumerate(own):
            by_size.setdefault(len(x), []).append(i)
        trees = {size: MTree(ids[members], np.array([own[i] for i in members], np.int64).reshape(len(members), size), k + 1) for size, members in by_size.items()}
        return pa.table({"shard": table.column("shard").slice(0, 1), "trees": pa.array([pickle.dumps(trees)], pa.binary())})

    dealt = v.select(F.pmod(F.xxhash64("id", "h"), F.lit(shards)).alias("shard"), "id", "v")
    trees = written(dealt.groupBy("shard").applyInArrow(build, "shard long, trees binary"), "metric_tree", "trees")
    cells = trees.select("shard", "trees", F.pmod("shard", F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = v.where("asks").groupBy(F.pmod(F.xxhash64("h", "id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "h", "v")).alias("queries"))  # about query_block rows
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # what a block's queries have found in the trees so far, by block: there are few in a task
        for batch in batches:
            for block, packed, queries in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if block not in held:
                    v = queries.values.field("v")
                    size = np.diff(v.offsets.to_numpy())
                    flat, at = v.values.to_numpy(), v.offsets.to_numpy()[:-1]
                    groups = {n: np.flatnonzero(size == n) for n in np.unique(size).tolist()}
                    ids, h = (queries.values.field(c).to_numpy() for c in ("id", "h"))
                    held[block] = {n: (ids[rows], h[rows], flat[at[rows][:, None] + np.arange(n)].reshape(len(rows), n), Best(len(rows), k)) for n, rows in groups.items()}
                for n, tree in pickle.loads(packed.as_buffer()).items():
                    if n in held[block]:
                        ids, _, q, best = held[block][n]
                        tree.search(q, ids, best)
        for groups in held.values():
            for ids, h, _, best in groups.values():
                row, rank = np.nonzero(best.score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], h[row], best.id[row, rank], best.score[row, rank].astype(np.int64))], ["query_id", "h", "id", "score"])

    found = cells.join(asked, ["block", "part"]).select("block", "trees", "queries").mapInArrow(work, "query_id long, h long, id long, score long")
    order = Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "id")  # k rows from each shard
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")


def op9_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", scaled("embedding").alias("v"))
    return search(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
