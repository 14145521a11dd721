"""Nearest neighbours by cosine with vantage-point trees, one tree per shard and task.

A small vantage-point tree over a bounded sample (``SAMPLE`` vectors, by a hash of the id) deals all vectors to
shards: inside or outside a radius around each vantage point. It is broadcast, its size is bounded, and every
vector is shuffled once, to its shard. In a shard, a vantage-point tree splits its vectors at the
median distance (on the unit sphere) from a vantage point. All queries of a block walk the tree together:
at each node those nearer to the inside go there first, then the other side is visited by the queries
that the triangle inequality does not rule out. A side is skipped if the gap to it exceeds ``factor``
times the query's current k-th distance: factor 1 is exact, smaller factors prune more and may miss.
The same rule on the small tree, with the k-th distance within the sample, decides which shards a query visits.

Shards of more than ``shard_rows`` vectors (many equal ones, say) are searched in slices; a shard that
more than ``block_queries`` queries visit is sent once for each such block of them.

Bounds allow for the rounding of squared distances, so equal directions of unequal lengths are not told apart by it.
Leaves rank by the cosine itself, summed in component order in double precision, ties to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawlake.llm.common import materialize

LEAF = 256
SAMPLE = 4096
SAMPLE_BYTES = 16 << 20
MOST_SHARDS = 1024
SLACK = 1e-9  # beyond rounding of cosines


def exact_cosine(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Row-wise cosine, components summed from first to last."""
    return np.cumsum(a * b, axis=1)[:, -1] / (norm_a * norm_b)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


class Tree:
    """A vantage-point tree over rows of ``unit``; nodes are (vantage row, radius, inside, outside) or row arrays."""

    def __init__(self, unit: np.ndarray, seed: int = 7):
        self.unit, self.rng = unit, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        point = int(self.rng.choice(rows))
        away = distance(self.unit[rows], self.unit[point][None])[:, 0]
        radius = float(np.median(away))
        inside = away <= radius
        if inside.all():
            inside = away < radius
        if min(inside.sum(), (~inside).sum()) < len(rows) // 8:  # many equal distances: nothing to split by, and splitting off a few would nest too deep
            return rows
        return point, float(away[inside].max()), float(away[~inside].min()), self._build(rows[inside]), self._build(rows[~inside])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit rows."""
    return np.sqrt(np.maximum(2 - 2 * products(a, b), 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, without the threads of a linear-algebra library, which can block in forked workers."""
    return np.einsum("ik,jk->ij", a, b)


def error(dim: int) -> float:
    """More than rounding can change a squared distance of unit vectors, or a cosine."""
    return 32 * (dim + 8) * 2.0**-52


def least(away, dim: int):
    """No more than the true distance; near 0 a distance is known to some 1e-7 only, as its square is rounded."""
    return np.sqrt(np.maximum(np.square(away) - error(dim), 0))


def most(away, dim: int):
    """No less than the true distance."""
    return np.sqrt(np.square(away) + error(dim))


class Search:
    """The k nearest of each query in one tree; ``reach`` is a distance within which k others are known to be."""

    def __init__(self, tree: Tree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, reach: np.ndarray | None = None):
        self.tree, self.vectors, self.ids, self.norm = tree, vectors, ids, norms(vectors)
        self.q, self.q_ids, self.q_norm = queries, query_ids, norms(queries)
        self.q_unit = queries / self.q_norm[:, None]
        self.k, self.factor = k, factor
        self.distinct = len(np.unique(ids)) == len(ids)
        self.reach = np.full(len(queries), np.inf) if reach is None else reach.copy()
        self.best_score = np.full((len(queries), k), -np.inf)
        self.best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
        if len(queries) and len(vectors):
            self._walk(tree.root, np.arange(len(queries)))

    def _walk(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, active)
            return
        point, inner, outer, inside, outside = node
        away = distance(self.q_unit[active], self.tree.unit[point][None])[:, 0]
        near_in, dim = away <= (inner + outer) / 2, self.q_unit.shape[1]
        for first, gap, a, b in ((near_in, least(outer, dim) - most(away, dim), inside, outside), (~near_in, least(away, dim) - most(inner, dim), outside, inside)):
            self._walk(a, active[first])
            rest = active[first]
            self._walk(b, rest[gap[first] <= self.factor * most(self.reach[rest], dim)])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        rough = products(self.q_unit[active], self.tree.unit[rows])
        floor = np.maximum(self.best_score[active, -1], 1 - np.minimum(self.reach[active], 2) ** 2 / 2)
        if self.distinct and len(rows) > self.k:
            floor = np.maximum(floor, np.partition(rough, -self.k - 1, axis=1)[:, -self.k - 1])  # one more: the query itself may be there
        q, c = np.nonzero(rough >= (floor - SLACK)[:, None])
        q, c = active[q], rows[c]
        other = self.ids[c] != self.q_ids[q]
        q, c = q[other], c[other]
        exact = np.concatenate([exact_cosine(self.q[x], self.vectors[y], self.q_norm[x], self.norm[y]) for x, y in zip(np.array_split(q, len(q) // 20_000 + 1), np.array_split(c, len(q) // 20_000 + 1))])
        who = np.concatenate([q, np.repeat(active, self.k)])
        score = np.concatenate([exact, self.best_score[active].ravel()])
        ids = np.concatenate([self.ids[c], self.best_id[active].ravel()])
        order = np.lexsort((ids, -score, who))
        who, score, ids = who[order], score[order], ids[order]
        # of rows that share an id, the best one counts
        first = np.ones(len(who), bool)
        seen = np.lexsort((-score, ids, who))
        first[seen[1:]] = (who[seen[1:]] != who[seen[:-1]]) | (ids[seen[1:]] != ids[seen[:-1]]) | ~np.isfinite(score[seen[1:]])
        who, score, ids = who[first], score[first], ids[first]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < self.k
        self.best_score[who[keep], rank[keep]] = score[keep]
        self.best_id[who[keep], rank[keep]] = ids[keep]
        self.reach[active] = np.minimum(self.reach[active], np.sqrt(np.maximum(2 - 2 * self.best_score[active, -1], 0)))


def _search(k: int, factor: float):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(vectors) or not len(queries):
            return pd.DataFrame({n: np.zeros(0, t) for n, t in zip(names, ("int64", "int64", "float64"))})
        v, q = np.stack(vectors["v"].to_list()).astype(np.float64), np.stack(queries["v"].to_list()).astype(np.float64)
        unit = v / norms(v)[:, None]
        found = Search(Tree(unit), v, vectors["vec_id"].to_numpy(), q, queries["vec_id"].to_numpy(), k, factor, queries["reach"].to_numpy())
        real = found.best_score > -np.inf
        return pd.DataFrame({"query_id": np.repeat(queries["vec_id"].to_numpy(), k)[real.ravel()], "vec_id": found.best_id[real], "score": found.best_score[real]})

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, v array<double>)`` of the rows that take part, of any one dimension each."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    read = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return read.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


class Top:
    """The small tree of one dimension: nodes are (vantage vector, radius, inside, outside) or numbers of shards."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, shards: int):
        self.unit, self.ids, self.shards = unit, ids, 0
        self.rng = np.random.default_rng(11)
        self.root = self._build(np.arange(len(unit)), shards)

    def _build(self, rows: np.ndarray, shards: int):
        if shards > 1 and len(rows) >= 16:
            point = self.unit[int(self.rng.choice(rows))]
            away = distance(self.unit[rows], point[None])[:, 0]
            radius = float(np.median(away))
            inside = away <= radius
            if 0 < inside.sum() < len(rows):
                return point, radius, self._build(rows[inside], shards // 2), self._build(rows[~inside], shards - shards // 2)
        self.shards += 1
        return self.shards - 1

    def route(self, unit: np.ndarray) -> np.ndarray:
        """The shard of each vector."""
        out = np.zeros(len(unit), np.int64)

        def walk(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                inside = distance(unit[rows], node[0][None])[:, 0] <= node[1]
                walk(node[2], rows[inside])
                walk(node[3], rows[~inside])

        walk(self.root, np.arange(len(unit)))
        return out

    def visits(self, unit: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, shard) for all shards that may hold something within ``reach`` of a query."""
        found: list[tuple[np.ndarray, int]] = []
        dim, reach = unit.shape[1], most(reach, unit.shape[1])

        def walk(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                found.append((rows, node))
            elif len(rows):
                away = distance(unit[rows], node[0][None])[:, 0]
                walk(node[2], rows[least(away, dim) - most(node[1], dim) <= reach[rows]])
                walk(node[3], rows[least(node[1], dim) - most(away, dim) <= reach[rows]])

        walk(self.root, np.arange(len(unit)))
        return np.concatenate([r for r, _ in found]), np.concatenate([np.full(len(r), n) for r, n in found])

    def reach(self, unit: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """Distance of the k-th nearest other id of the sample; infinite if it has fewer."""
        out = np.full(len(unit), np.inf)
        for rows in np.array_split(np.arange(len(unit)), len(unit) // 256 + 1):
            away = distance(unit[rows], self.unit)
            away[ids[rows, None] == self.ids[None]] = np.inf
            if away.shape[1] >= k:
                out[rows] = np.partition(away, k - 1, axis=1)[:, k - 1]
        return out


def _by_dimension(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, their vectors) of a list column."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, values[offsets[rows][:, None] + np.arange(dim)]


def _route(tops):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, dims = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for dim, rows, v in _by_dimension(batch.column(1)):
                dims[rows] = dim
                if dim in tops.value:
                    shard[rows] = tops.value[dim].route(v / norms(v)[:, None])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(shard)], ["vec_id", "v", "dim", "shard"])

    return run


def _visit(tops, k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for dim, rows, v in _by_dimension(batch.column(1)):
                query, shard, reach = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
                if dim in tops.value:
                    top, unit = tops.value[dim], v / norms(v)[:, None]
                    reach = top.reach(unit, ids[rows], k)
                    query, shard = top.visits(unit, factor * reach)
                for part in np.array_split(np.arange(len(query)), len(query) // 20_000 + 1):
                    own = pa.array(rows[query[part]])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(np.full(len(part), dim, np.int32)), pa.array(shard[part]), pa.array(reach[query[part]])], ["vec_id", "v", "dim", "shard", "reach"])

    return run


def _tops(ready: DataFrame, shard_rows: int):
    """The small tree of each dimension of the sample, as a broadcast."""
    n, longest = ready.agg(F.count("*"), F.max(F.size("v"))).first()
    tops = {}
    if n:
        size = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest)))
        rows = ready.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "v").limit(size).toArrow()
        ids, column = rows.column("vec_id").to_numpy(), rows.column("v").combine_chunks()
        for dim, at, v in _by_dimension(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column):
            _, first = np.unique(ids[at], return_index=True)  # an id counts once
            shards = min(MOST_SHARDS, math.ceil(n * len(at) / len(ids) / shard_rows))
            unit = v / norms(v)[:, None]
            tops[dim] = Top(unit[first], ids[at][first], shards)
    return ready.sparkSession.sparkContext.broadcast(tops)


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, factor: float = 1.0, shard_rows: int = 8192, block_queries: int = 4096) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest others of each row whose vec_id is divisible by ``every``.

    Vectors that are null, all zero or hold null or non-finite parts take no part; vectors are compared
    with those of their own dimension; rows that share a vec_id are never each other's neighbours, and a
    vec_id is returned at most once per query (its best row). Repeated rows change nothing, no rows give no rows.
    Other columns are ignored, whatever their names.
    """
    ready = usable(embeddings)
    tops = _tops(ready, shard_rows)
    routed = materialize(ready.mapInArrow(_route(tops), "vec_id long, v array<double>, dim int, shard long"), "vectors")
    asked = routed.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    asked = materialize(asked.mapInArrow(_visit(tops, k, factor), "vec_id long, v array<double>, dim int, shard long, reach double"), "queries")

    parts = lambda column, most: F.ceil(F.count("*") / most).alias(column)
    sizes = routed.groupBy("dim", "shard").agg(parts("slices", shard_rows)).join(asked.groupBy("dim", "shard").agg(parts("blocks", block_queries)), ["dim", "shard"])
    dealt = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    vectors = routed.join(sizes, ["dim", "shard"]).withColumn("slice", dealt(2, "slices")).withColumn("block", each("blocks"))
    queries = asked.join(sizes, ["dim", "shard"]).withColumn("block", dealt(3, "blocks")).withColumn("slice", each("slices"))
    keys = ["dim", "shard", "slice", "block"]
    vectors, queries = vectors.select(*keys, "vec_id", "v"), queries.select(*keys, "vec_id", "v", "reach")
    found = vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(_search(k, factor), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
