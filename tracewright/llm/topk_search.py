"""Exact top-k search by inner product with dual cover trees.

A cover tree over a bounded sample of the vectors deals all rows into cells (nearest leaf
centre); each cell's centre, covering radius and largest norm are known to every task. A
first round meets the queries with one block of their own cell, which bounds each query's
k-th score from below. A query is then sent only to cells that can reach its bound, cut
into blocks of bounded size. A task indexes its queries and its data in cover trees and
walks them together: a pair of nodes is pruned when no product of its points can reach the
worst k-th score of the query node, by both covering radii. The best k of each query over
all blocks remain.

A node's children cover its points within half its radius and are apart from one another
by more than that. A node whose children would hold fewer than ``BRANCH`` points each stays
a leaf, whose points are compared by one matrix product: vectors without structure, in many
dimensions, defy pruning by radii.

Defined results: vectors that are null, empty or hold null or non-finite components take
no part, nor do rows without an id; rows that repeat an id each count, as candidates of one
another too; vectors of different length do not meet; equal scores rank by smaller id; with
fewer than k candidates, all are returned; an empty table gives no rows; other columns,
whatever their names, are ignored. Scores must fit into 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm._common import cut, small_enough

#: Points of a node's child on average at least, of a node with children at least; rows of the sample, and cells, at most.
BRANCH, LEAF, SAMPLE, CELLS = 16, 32, 8192, 1024
_CELLS_AT_ONCE = 1 << 22  # of a matrix product
_NONE = np.iinfo(np.int64).min


@dataclass
class CoverTree:
    """Nodes as arrays; a node's points are ``order[first:last]``, its children come later."""

    points: np.ndarray
    order: np.ndarray
    centers: np.ndarray
    radii: np.ndarray
    norms: np.ndarray  # of the centres
    longest: np.ndarray  # norm of any point
    first: np.ndarray
    last: np.ndarray
    children: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> CoverTree:
        """Centres among the points not covered yet, until all are within half the radius of one; a point belongs to its nearest one."""
        order, squares = np.arange(len(points)), (points**2).sum(axis=1)
        centers, radii, longest, first, last, children = [0], [], [], [0], [len(points)], []

        def distances(own: np.ndarray, center: int) -> np.ndarray:
            return np.sqrt(np.maximum(squares[own] + squares[center] - 2 * (points[own] @ points[center]), 0))

        at = 0
        while at < len(centers):
            lo, hi = first[at], last[at]
            own = order[lo:hi]
            near = distances(own, centers[at])
            reach = float(near.max())
            radii.append(reach)
            longest.append(float(np.sqrt(squares[own].max())))
            kids: list[int] = []
            if hi - lo > leaf and reach > 0:
                picked, of = [centers[at]], np.zeros(hi - lo, np.int64)
                worth = True
                while worth and len(bare := np.flatnonzero(near > reach / 2)):
                    center = int(own[bare[len(bare) // 2]])
                    d = distances(own, center)
                    closer = d < near
                    of[closer] = len(picked)
                    near = np.minimum(near, d)
                    picked.append(center)
                    worth = len(picked) % BRANCH > 0 or hi - lo - len(bare) >= BRANCH * len(picked)
                if worth:
                    order[lo:hi] = own[np.argsort(of, kind="stable")]
                    start = lo
                    for c, n in zip(picked, np.bincount(of, minlength=len(picked)).tolist(), strict=True):
                        kids.append(len(centers))
                        centers.append(c)
                        first.append(start)
                        last.append(start + n)
                        start += n
            children.append(np.array(kids, np.int64))
            at += 1
        middle = points[np.array(centers)]
        return cls(points, order, middle, np.array(radii), np.sqrt((middle**2).sum(axis=1)), np.array(longest), np.array(first), np.array(last), children)

    def leaves(self) -> list[int]:
        return [i for i, kids in enumerate(self.children) if not len(kids)]


def upper_bounds(center: np.ndarray, radius: float, norm: float, longest: float, centers: np.ndarray, radii: np.ndarray, far: np.ndarray) -> np.ndarray:
    """No product of a point of the ball at ``center`` and one of the balls at ``centers`` is above these."""
    by_centers = centers @ center + norm * radii + radius * far
    by_norms = longest * far
    return np.minimum(by_centers, by_norms) + 1e-9 * (np.abs(by_norms) + norm * radii + 1)  # rounding never prunes


class DualSearch:
    """Best ``k`` data points of every query but its own row, ties to the smaller id.

    ``queries`` and ``data`` are whole numbers; ``rows`` tell rows apart, ``ids`` rank ties.
    """

    def __init__(self, queries: np.ndarray, q_rows: np.ndarray, data: np.ndarray, d_rows: np.ndarray, d_ids: np.ndarray, k: int, known: np.ndarray | None = None) -> None:
        most = float(np.abs(queries).max()) * float(np.abs(data).max()) * queries.shape[1]
        kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**52 else np.int64  # sums are exact
        self.left, self.right, self.ids, self.k = queries.astype(kind), data.astype(kind), d_ids, k
        self.q, self.d = CoverTree.build(queries.astype(np.float64)), CoverTree.build(data.astype(np.float64))
        n = len(queries)
        self.scores, self.best = np.full((n, k), _NONE), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, _NONE) if known is None else known.copy()  # k-th scores are no lower
        place = np.empty(len(data), np.int64)
        place[self.d.order] = np.arange(len(data))
        by_row = np.argsort(d_rows)
        at = np.minimum(np.searchsorted(d_rows, q_rows, sorter=by_row), len(data) - 1)
        self.own = np.where(d_rows[by_row[at]] == q_rows, place[by_row[at]], -1)  # where a query's own row stands
        self.norms = np.sqrt((self.q.points**2).sum(axis=1))
        self.parent = np.full(len(self.q.radii), -1)
        for i, kids in enumerate(self.q.children):
            self.parent[kids] = i
        self.worst = np.array([self.floor[self.q.order[a:b]].min() for a, b in zip(self.q.first, self.q.last, strict=True)])
        self.seeded = np.full(n, -1)  # the leaf that a query met first
        self.compared = 0

    def bounds(self, a: int, nodes: np.ndarray) -> np.ndarray:
        q, d = self.q, self.d
        return upper_bounds(q.centers[a], q.radii[a], q.norms[a], q.longest[a], d.centers[nodes], d.radii[nodes], d.longest[nodes])

    def single_bounds(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The same for queries as points, (rows, nodes)."""
        d, norms = self.d, self.norms[rows][:, None]
        by_norms = norms * d.longest[nodes]
        return np.minimum(self.q.points[rows] @ d.centers[nodes].T + norms * d.radii[nodes], by_norms) + 1e-9 * (by_norms + norms * d.radii[nodes] + 1)

    def seed(self) -> None:
        """Every query meets its most promising data leaf first, so that pruning can begin."""
        work = [(np.arange(len(self.left)), 0)]
        while work:
            rows, b = work.pop()
            kids = self.d.children[b]
            if not len(kids):
                self.seeded[rows] = b
                self.leaf(rows, b)
                continue
            for at in range(0, len(rows), 1024):
                some = rows[at : at + 1024]
                best = self.single_bounds(some, kids).argmax(axis=1)
                work += [(some[best == j], int(kids[j])) for j in np.unique(best).tolist()]

    def leaf(self, rows: np.ndarray, b: int) -> None:
        """Compare queries with all points of a data leaf."""
        lo, hi = self.d.first[b], self.d.last[b]
        theirs = self.d.order[lo:hi]
        right = self.right[theirs].T
        step = max(1, _CELLS_AT_ONCE // len(theirs))
        for at in range(0, len(rows), step):
            self._compare(rows[at : at + step], theirs, right, lo)

    def under(self, a: int, b: int) -> None:
        """A query leaf and a data node: queries go on alone, each to the children that it can use."""
        work = [(self.q.order[self.q.first[a] : self.q.last[a]], b, None)]
        while work:
            rows, b, top = work.pop()
            if top is not None:
                rows = rows[top >= self.floor[rows]]
            kids = self.d.children[b]
            if not len(kids):
                rows = rows[self.seeded[rows] != b]
                if len(rows):
                    self.leaf(rows, b)
            elif len(rows):
                tops = self.single_bounds(rows, kids)
                for j in np.argsort(tops.max(axis=0), kind="stable").tolist():  # the most promising is popped first
                    if (use := tops[:, j] >= self.floor[rows]).any():
                        work.append((rows[use], int(kids[j]), tops[use, j]))
        self.worst[a] = self.floor[self.q.order[self.q.first[a] : self.q.last[a]]].min()
        up = self.parent[a]
        while up >= 0 and (now := self.worst[self.q.children[up]].min()) > self.worst[up]:
            self.worst[up] = now
            up = self.parent[up]

    def _compare(self, rows: np.ndarray, theirs: np.ndarray, right: np.ndarray, lo: int) -> None:
        product = self.left[rows] @ right
        n, c = product.shape
        self.compared += n * c
        none = _NONE if product.dtype == np.int64 else -np.inf
        own = self.own[rows] - lo
        mine = np.flatnonzero((own >= 0) & (own < c))
        product[mine, own[mine]] = none
        floor = self.floor[rows]
        if (strips := min(64, c)) >= self.k:  # the k-th of the strips' largest is no more than the k-th of all
            width = c // strips
            largest = product[:, : strips * width].reshape(n, strips, width).max(axis=2)
            kth = np.partition(largest, strips - self.k, axis=1)[:, strips - self.k]
            real = kth != none
            floor = np.where(real, np.maximum(floor, np.where(real, kth, 0).astype(np.int64)), floor)
        limit = floor if product.dtype == np.int64 else np.where(floor == _NONE, -np.inf, floor).astype(product.dtype)
        i, j = np.nonzero(product >= limit[:, None])
        scores = product[i, j]
        fair = scores != none
        i, j, scores = i[fair], j[fair], scores[fair].astype(np.int64)
        if not len(i):
            return
        some = np.unique(i)
        owner = np.concatenate([i, np.repeat(some, self.k)])
        scores = np.concatenate([scores, self.scores[rows[some]].ravel()])
        ids = np.concatenate([self.ids[theirs[j]], self.best[rows[some]].ravel()])
        order = np.lexsort((ids, -np.maximum(scores, _NONE + 1), owner))
        owner, scores, ids = owner[order], scores[order], ids[order]
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = nth < self.k
        self.scores[rows[owner[keep]], nth[keep]], self.best[rows[owner[keep]], nth[keep]] = scores[keep], ids[keep]
        self.floor[rows] = np.maximum(self.floor[rows], self.scores[rows, -1])

    def run(self) -> DualSearch:
        """Walk both trees."""
        self.seed()
        self.worst = np.array([self.floor[self.q.order[a:b]].min() for a, b in zip(self.q.first, self.q.last, strict=True)])
        work = [(0, 0, np.inf)]
        while work:
            a, b, bound = work.pop()
            if bound < self.worst[a]:
                continue
            mine, theirs = self.q.children[a], self.d.children[b]
            if not len(mine):
                self.under(a, b)
            elif not len(theirs) or self.q.radii[a] >= self.d.radii[b]:
                one = np.array([b])
                work += [(int(x), b, float(self.bounds(int(x), one)[0])) for x in mine]
            else:
                top = self.bounds(a, theirs)
                keep = np.flatnonzero(top >= self.worst[a])
                work += [(a, int(theirs[i]), float(top[i])) for i in keep[np.argsort(top[keep], kind="stable")]]  # the most promising is popped first
        return self


def quantised(vec: Column, factor: int = 256) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * factor))


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def cell_centers(sample: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Centres of the cells of each vector length, from the leaves of a cover tree over at most ``SAMPLE`` rows of ``sample`` (v)."""
    share = min(1.0, 2 * SAMPLE / max(1, n))
    drawn = sample.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, vectors in by_dim.items():
        tree = CoverTree.build(np.array(vectors, np.float64), max(LEAF, len(vectors) * 4 // CELLS))
        nodes, open_ = [0], [0]
        while open_:  # as many levels as there is room for, the wide nodes first
            at = max(open_, key=lambda i: tree.radii[i])
            open_.remove(at)
            if len(kids := tree.children[at]) and len(nodes) + len(kids) <= CELLS:
                nodes.remove(at)
                nodes += kids.tolist()
                open_ += kids.tolist()
        out[dim] = tree.centers[nodes]
    return out


def dealt(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` (vec_id, v) with vector length, cell, distance to its centre and norm."""

    def run(batches):
        for batch in batches:
            lengths = np.diff(batch.column("v").offsets.to_numpy())
            cell, dist, norm = np.zeros(len(lengths), np.int32), np.zeros(len(lengths)), np.zeros(len(lengths))
            for dim in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == dim)
                x = _matrix(batch.column("v").take(pa.array(own)), dim).astype(np.float64)
                squares = (x**2).sum(axis=1)
                middle = centers.get(dim, np.zeros((1, dim)))
                d = squares[:, None] + (middle**2).sum(axis=1) - 2 * (x @ middle.T)
                cell[own] = d.argmin(axis=1)
                dist[own] = np.sqrt(((x - middle[cell[own]]) ** 2).sum(axis=1)) * (1 + 1e-9)
                norm[own] = np.sqrt(squares) * (1 + 1e-9)
            arrays = [*batch.columns, pa.array(lengths, pa.int32()), pa.array(cell), pa.array(dist), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "v", "dim", "cell", "dist", "norm"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, dim int, cell int, dist double, norm double")


_FOUND = "query_row long, query_id long, vec_id long, score long"
_KEYS = ["dim", "ask_cell", "ask_part", "cell", "part"]


def _met(asks: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """``_FOUND`` rows: the best ``k`` of each query in each block that it meets."""

    def meet(asked: pa.Table, given: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not asked.num_rows or not given.num_rows:
            return kinds.empty_table()
        dim = asked.column("dim")[0].as_py()
        rows, ids = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
        both = DualSearch(_matrix(asked.column("v"), dim), rows, _matrix(given.column("v"), dim), given.column("row").to_numpy(), given.column("vec_id").to_numpy(), k, asked.column("known").to_numpy()).run()
        i, j = np.nonzero(both.scores != _NONE)
        return pa.Table.from_arrays([pa.array(rows[i]), pa.array(ids[i]), pa.array(both.best[i, j]), pa.array(both.scores[i, j])], schema=kinds)

    # the blocks of the data come from the queries: under names of its own, the second side is another frame
    own = data.select(*[F.col(c).alias(f"d_{c}") for c in _KEYS], F.col("row").alias("row"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))
    return asks.groupBy(*_KEYS).cogroup(own.groupBy(*[f"d_{c}" for c in _KEYS])).applyInArrow(meet, _FOUND)


def _parts(summary: list, column: str, rows: int, spark) -> DataFrame:
    """(dim, cell, parts): how many blocks of ``rows`` rows each cell is cut into; at most one row a cell."""
    return F.broadcast(spark.createDataFrame([(r["dim"], r["cell"], max(1, -(-r[column] // rows))) for r in summary], "dim int, cell int, parts long"))


def _reachable(asks: DataFrame, centers: dict[int, np.ndarray], summary: list) -> DataFrame:
    """``asks`` with ``cells``: those that can hold a score of at least ``known``."""
    known = {d: sorted((r["cell"], r["radius"], r["longest"]) for r in summary if r["dim"] == d) for d in {r["dim"] for r in summary}}

    def run(batches):
        for batch in batches:
            dims, floors = batch.column("dim").to_numpy(), batch.column("known").to_numpy()
            cells: list[list[int]] = []
            for i, v in enumerate(batch.column("v").to_pylist()):
                numbers, radii, far = (np.array(x) for x in zip(*known[int(dims[i])], strict=True))
                q = np.array(v, np.float64)
                norm = float(np.sqrt(q @ q))
                middle = centers.get(int(dims[i]), np.zeros((1, len(q))))[numbers]
                cells.append(numbers[upper_bounds(q, 0.0, norm, norm, middle, radii, far) >= floors[i]].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in asks.schema]
    return asks.mapInArrow(run, ", ".join([*kinds, "cells array<int>"]))


def topk_search(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", data_rows: int = 16_384, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    usable = F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable_rows = vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vec_col)).alias("v"))
    centers = cell_centers(usable_rows, vectors.count())
    rows = cut(dealt(usable_rows, centers).withColumn("row", F.monotonically_increasing_id()))
    asking = F.col("vec_id") % query_every == 0
    # a row a cell: at most CELLS for each length of vectors
    summary = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count(F.when(asking, 1)).alias("n_ask"), F.max("dist").alias("radius"), F.max("norm").alias("longest")).collect()
    part = lambda name: F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias(name)
    data = rows.join(_parts(summary, "n", data_rows, spark), ["dim", "cell"]).select("dim", "cell", part("part"), "parts", "row", "vec_id", "v")
    asks = rows.filter(asking).join(_parts(summary, "n_ask", query_rows, spark), ["dim", "cell"]).select("dim", F.col("cell").alias("ask_cell"), part("ask_part"), "row", "vec_id", "v", F.lit(_NONE).alias("known"))

    if len(summary) > 1:
        # first round: each query against one block of its own cell
        first = data.filter("part = 0").join(asks.select("dim", F.col("ask_cell").alias("cell"), "ask_part").distinct(), ["dim", "cell"]).withColumn("ask_cell", F.col("cell"))
        met = _met(asks.withColumn("cell", F.col("ask_cell")).withColumn("part", F.lit(0)), first, k)
        floors = met.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select(F.col("query_row").alias("row"), "least")
        asks = cut(asks.drop("known").join(floors, "row", "left").withColumn("known", F.coalesce("least", F.lit(_NONE))).drop("least"))
    asks = _reachable(asks, centers, summary)
    wants = asks.select("dim", "ask_cell", "ask_part", F.explode("cells").alias("cell")).distinct()
    if small_enough(wants, 64):
        wants = F.broadcast(wants)
    sent = data.join(wants, ["dim", "cell"])
    parts = _parts(summary, "n", data_rows, spark)
    every = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part")
    asked = asks.select("dim", "ask_cell", "ask_part", "row", "vec_id", "v", "known", F.explode("cells").alias("cell")).join(parts, ["dim", "cell"]).select("*", every)
    found = _met(asked, sent, k)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
