"""Exact k nearest neighbours, classification and regression by neighbours.

Of training rows with the same vector only the few with the smallest keys can be among the
nearest; the others are left out first. The rest lie in metric cells: each belongs to the
nearest of a bounded number of centres, and a cell knows its radius. By the triangle
inequality a cell whose rows are all farther than the k-th neighbour found so far is not
looked at, nor are rows of a cell whose distance to the centre differs too much from the
query's. So tables of few dimensions or of clusters are searched in a small part of their
rows. Vectors without structure in many dimensions keep most of them; there a matrix product
with a proven error bound tells which pairs can matter, and only these are measured exactly.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import named
from ..storage import materialize, spread_out

# training vectors up to this size are broadcast; measured before
BROADCAST_BYTES = 32 << 20
# training vectors that one task holds beyond that, and queries that meet them there
SHELF_BYTES = 32 << 20
SLICE_ROWS = 65_536
# distances held at once inside a task
TILE = 1_000_000
# products held at once; larger ones leave the cache, smaller ones call too often
PRODUCTS = 2_000_000
# centres, at most; about the square root of the training rows is best
CENTRES = 512
# queries that are searched together
BATCH = 512
# up to so many dimensions, differences are as fast as products
FEW_DIMENSIONS = 8
# pairs measured at once after a product has picked them
PICKED = 20_000
# squares between which products may be taken in single precision
SINGLE = (1e-20, 1e30)
HITS = "_id bigint, neighbor bigint, d2 double"


def _squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):  # one dimension at a time: exact differences, bounded memory
        diff = q[:, j, None] - x[None, :, j]
        d += diff * diff
    return d


def _squared_pairs(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As ``_squared``, row against row, with the same rounding."""
    d = np.zeros(len(q))
    for j in range(q.shape[1]):
        diff = q[:, j] - x[:, j]
        d += diff * diff
    return d


def _distances(q: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest distance of each row to each centre: the same in few dimensions, else a product and its error."""
    dims = q.shape[1]
    if dims <= FEW_DIMENSIONS:
        d = np.sqrt(_squared(q, centres))
        return d, d
    middle = centres.mean(axis=0)
    a, c = q - middle, centres - middle
    size = (a * a).sum(axis=1)[:, None] + (c * c).sum(axis=1)
    d2 = size - 2 * (a @ c.T)
    error = 4 * (dims + 4) * np.finfo("float64").eps * size
    top = d2 + error
    return np.sqrt(np.fmax(d2 - error, 0)), np.sqrt(np.where(np.isnan(top), np.inf, np.maximum(top, 0)))


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy()


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    sizes = pc.min_max(pc.list_value_length(column)).as_py()
    if sizes["min"] != sizes["max"] or column.null_count:
        raise ValueError("vectors must be present and of one length")
    return pc.list_flatten(column).to_numpy().astype("float64", copy=False).reshape(len(column), sizes["max"])


def _hits(ids: np.ndarray, neighbors: np.ndarray, d2: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(neighbors, pa.int64()), pa.array(d2, pa.float64())], ["_id", "neighbor", "d2"])


@dataclass
class _Best:
    """The k smallest (squared distance, id) of each query so far, none beyond its limit."""

    d2: np.ndarray
    ids: np.ndarray
    limit: np.ndarray

    @staticmethod
    def none(limit: np.ndarray, k: int) -> _Best:
        n = len(limit)
        beyond = np.repeat(np.nextafter(limit, np.inf)[:, None], k, axis=1)
        return _Best(beyond, np.full((n, k), np.iinfo(np.int64).max), limit)

    def reach(self) -> np.ndarray:
        """How far a better neighbour may lie; a little more, as distances are rounded."""
        return np.sqrt(self.d2[:, -1]) * (1 + 1e-9) + 1e-12

    def look(self, rows: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Takes in the training rows ``x`` for the queries at ``rows``."""
        k = self.d2.shape[1]
        wide = max(1, TILE // max(1, len(rows)))
        for at_x in range(0, len(x), wide):
            some, some_ids = x[at_x : at_x + wide], ids[at_x : at_x + wide]
            step = max(1, TILE // len(some))
            for start in range(0, len(rows), step):
                at = rows[start : start + step]
                d = _squared(q[at], some)
                if d.shape[1] > 4 * k:  # all that may be among the k nearest
                    near = d <= np.fmin(np.partition(d, k - 1, axis=1)[:, k - 1], self.d2[at, -1])[:, None]
                    row, col = np.nonzero(near)
                else:
                    row, col = (a.ravel() for a in np.indices(d.shape))
                self.take(at[row], d[row, col], some_ids[col])

    def take(self, rows: np.ndarray, d2: np.ndarray, ids: np.ndarray) -> None:
        """Merges measured pairs, given by the query's row."""
        k = self.d2.shape[1]
        better = (d2 < self.d2[rows, -1]) | ((d2 == self.d2[rows, -1]) & (ids < self.ids[rows, -1]))
        rows, d2, ids = rows[better], d2[better], ids[better]
        if not len(rows):
            return
        changed = np.unique(rows)
        rows = np.r_[np.repeat(changed, k), rows]
        d2, ids = np.r_[self.d2[changed].ravel(), d2], np.r_[self.ids[changed].ravel(), ids]
        order = np.lexsort((ids, d2, rows))
        rows, d2, ids = rows[order], d2[order], ids[order]
        first = np.searchsorted(rows, changed)
        kept = (first[:, None] + np.arange(k)).ravel()
        self.d2[changed], self.ids[changed] = d2[kept].reshape(-1, k), ids[kept].reshape(-1, k)

    def pick(self, rows: np.ndarray, q: np.ndarray, held: _Held, at: np.ndarray, skip: np.ndarray | None = None) -> None:
        """Takes in the training rows ``at`` for the queries at ``rows``: a product finds the pairs within reach, up to its error, and these are measured.

        ``skip`` marks the (query, cell) pairs that were looked at before. Without a reach so far,
        the k nearest by the product, and what its error leaves beside them, bound the others.
        """
        k, dims, mid = self.d2.shape[1], q.shape[1], q[rows] - held.middle
        nq = (mid * mid).sum(axis=1)
        step = max(1, PRODUCTS // max(1, len(rows)))
        lefts: dict[str, np.ndarray] = {}
        # products use the same memory again
        space: dict[str, np.ndarray] = {}
        for tile in (at[start : start + step] for start in range(0, len(at), step)):
            nx = held.norms[tile]
            top = float(np.fmax.reduce(nx))  # a row with a NaN is nobody's neighbour
            within = self.reach()[rows] ** 2
            blind = not np.isfinite(within).all() and len(tile) > k
            size = 2 * np.sqrt(nq * top) + top
            # squares must be normal numbers in single precision
            single = not blind and top > SINGLE[0] and float(np.fmax.reduce(size + nq)) < SINGLE[1]
            for kind in ("float32", "float64") if single else ("float64",):
                eps = float(np.finfo(kind).eps)
                error = 2 * (dims + 4) * eps * (size + nq) + 2 * eps * np.where(np.isfinite(within), within, 0)
                if kind == "float64" or (error <= 0.01 * within).mean() > 0.9:
                    break
            if kind not in lefts:
                lefts[kind] = np.concatenate([-2 * mid, np.ones((len(mid), 1))], axis=1).astype(kind)
                space[kind] = np.empty(len(mid) * min(step, len(at)), kind)
            right = held.single[tile] if kind == "float32" else np.concatenate([held.x[tile] - held.middle, nx[:, None]], axis=1)
            product = np.matmul(lefts[kind], right.T, out=space[kind][: len(mid) * len(tile)].reshape(len(mid), len(tile)))
            bound = within - nq + error
            if blind:
                bound = np.fmin(bound, np.partition(product, k - 1, axis=1)[:, k - 1] + 2 * error)
            near = product <= bound.astype(kind)[:, None]
            some = np.flatnonzero(near.any(axis=1))  # most queries have none
            row, col = np.divmod(np.flatnonzero(near[some]), len(tile))
            row, col = rows[some[row]], tile[col]
            if skip is not None:
                fresh = ~skip[row, held.cell[col]]
                row, col = row[fresh], col[fresh]
            for start in range(0, len(row), PICKED):
                r, c = row[start : start + PICKED], col[start : start + PICKED]
                self.take(r, _squared_pairs(q[r], held.x[c]), held.ids[c])

    def hits(self, queries: np.ndarray) -> pa.RecordBatch:
        found = np.isfinite(self.d2) & (self.d2 <= self.limit[:, None])
        return _hits(np.repeat(queries, self.d2.shape[1])[found.ravel()], self.ids[found], self.d2[found])


@dataclass
class _Cells:
    """Centres, and for each the number of its rows and the range of their distances to it."""

    centres: np.ndarray
    rows: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least distance that a row of each cell can have, given the bounds of the distances to the centres."""
        out = np.fmax(np.fmax(lo - self.outer, self.inner - hi), 0)
        return np.where(self.rows > 0, out, np.inf)

    def homes(self, d: np.ndarray, k: int) -> np.ndarray:
        """The nearest cells that have k rows together, for each query."""
        order = np.argsort(np.where(self.rows > 0, d, np.inf), axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        mark = np.zeros(d.shape, bool)
        np.put_along_axis(mark, order, (before < k) & (self.rows[order] > 0), axis=1)
        return mark


def _drawn(train: DataFrame, n: int) -> np.ndarray:
    """The centres: rows drawn by a hash."""
    wanted = min(CENTRES, max(1, int(np.sqrt(n))))
    drawn = train.orderBy(F.xxhash64("_tid", F.lit(5)), "_tid").limit(wanted).collect()
    if not drawn:
        return np.zeros((0, 0))
    rows = np.unique(np.array([r["_x"] for r in drawn], dtype="float64"), axis=0)
    finite = rows[np.isfinite(rows).all(axis=1)]
    return finite if len(finite) else np.zeros((1, rows.shape[1]))


def _assigned(train: DataFrame, centres: np.ndarray, kind: str) -> DataFrame:
    """``(_tid, _x, _cell, _d)`` of all training rows."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part["_x"])
                cell = _distances(x, centres)[0].argmin(axis=1)  # about the nearest is enough, its distance must be right
                d = np.sqrt(_squared_pairs(x, centres[cell]))
                yield pa.RecordBatch.from_arrays([part["_tid"], part["_x"], pa.array(cell, pa.int32()), pa.array(d)], ["_tid", "_x", "_cell", "_d"])

    return train.mapInArrow(nearest, f"_tid bigint, _x {kind}, _cell int, _d double")


def _measured(assigned: DataFrame, centres: np.ndarray) -> _Cells:
    m = len(centres)
    cells = _Cells(centres, np.zeros(m, np.int64), np.zeros(m), np.zeros(m))
    for r in assigned.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("lo"), F.max("_d").alias("hi")).collect():
        cells.rows[r["_cell"]], cells.inner[r["_cell"]], cells.outer[r["_cell"]] = r["n"], r["lo"], r["hi"]
    return cells


class _Held:
    """Training rows at hand, in order of cell and id."""

    def __init__(self, centres: np.ndarray, tid: np.ndarray, x: np.ndarray, cell: np.ndarray, d: np.ndarray):
        order = np.lexsort((tid, cell))
        self.ids, self.x, self.d = tid[order], x[order], d[order]
        numbers, self.cell = np.unique(cell[order], return_inverse=True)
        self.start = np.r_[np.searchsorted(self.cell, np.arange(len(numbers))), len(tid)]
        first = self.start[:-1]
        self.cells = _Cells(centres[numbers], np.diff(self.start), np.minimum.reduceat(self.d, first), np.maximum.reduceat(self.d, first))
        # products of rows near the origin have smaller errors
        self.middle = centres[numbers].mean(axis=0)
        if self.x.shape[1] > FEW_DIMENSIONS:  # made once for all products
            self.norms, self.single = np.zeros(len(tid)), np.zeros((len(tid), self.x.shape[1] + 1), "float32")
            for at in range(0, len(tid), 4096):
                some = self.x[at : at + 4096] - self.middle
                self.norms[at : at + 4096] = square = (some * some).sum(axis=1)
                with np.errstate(over="ignore"):
                    self.single[at : at + 4096, :-1], self.single[at : at + 4096, -1] = some, square

    def rows(self, c: int) -> slice:
        return slice(self.start[c], self.start[c + 1])

    def near(self, c: int, lo: np.ndarray, hi: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Rows of a cell that at least one of the queries, from ``lo`` to ``hi`` from the centre, may have in reach."""
        dist = self.d[self.rows(c)]
        return self.start[c] + np.flatnonzero((dist >= np.fmin.reduce(lo - reach)) & (dist <= np.fmax.reduce(hi + reach)))

    def search(self, ids: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, pairs: Accumulator | None) -> Iterator[pa.RecordBatch]:
        """The k nearest of these rows for each query, none whose squared distance is above the query's limit."""
        # queries of one region go together; about the nearest centre is enough for that
        centres = self.cells.centres - self.middle
        square = (centres * centres).sum(axis=1) / 2
        regions = np.concatenate([(square - (q[at : at + BATCH] - self.middle) @ centres.T).argmin(axis=1) for at in range(0, len(q), BATCH)])
        order = np.argsort(regions, kind="stable")
        for at in range(0, len(q), BATCH):
            some = order[at : at + BATCH]
            best, compared = self._batch(q[some], limit[some], k)
            if pairs is not None:
                pairs.add(compared)
            yield best.hits(ids[some])

    def _batch(self, q: np.ndarray, limit: np.ndarray, k: int) -> tuple[_Best, int]:
        best, compared = _Best.none(limit, k), 0
        lo, hi = _distances(q, self.cells.centres)
        least = self.cells.least(lo, hi)
        homes = self.cells.homes(lo, k) & np.isinf(limit)[:, None]
        for c in np.flatnonzero(homes.any(axis=0)).tolist():
            rows, here = np.flatnonzero(homes[:, c]), self.rows(c)
            compared += len(rows) * len(self.ids[here])
            if q.shape[1] > FEW_DIMENSIONS:
                best.pick(rows, q, self, np.arange(here.start, here.stop))
            else:
                best.look(rows, q, self.x[here], self.ids[here])
        alive = ~homes & (least <= best.reach()[:, None])
        common = np.flatnonzero(alive.mean(axis=0) >= 0.25) if q.shape[1] > FEW_DIMENSIONS else np.zeros(0, int)
        if len(common):
            at = np.concatenate([np.arange(self.start[c], self.start[c + 1]) for c in common[np.argsort(least[:, common].min(axis=0), kind="stable")]])
            compared += len(q) * len(at)
            best.pick(np.arange(len(q)), q, self, at, homes)
        rest = np.setdiff1d(np.flatnonzero(alive.any(axis=0)), common)
        for c in rest[np.argsort(least[:, rest].min(axis=0), kind="stable")].tolist():
            rows = np.flatnonzero(~homes[:, c] & (least[:, c] <= best.reach()))
            if len(rows):
                near = self.near(c, lo[rows, c], hi[rows, c], best.reach()[rows])
                compared += len(rows) * len(near)
                best.look(rows, q, self.x[near], self.ids[near])
        return best, compared


def _vector(df: DataFrame, name: str) -> tuple[Column, str]:
    """Single precision stays as it is and takes half the room; a task computes in double precision."""
    kind = "array<float>" if dict(df.dtypes)[name] == "array<float>" else "array<double>"
    return named(name).cast(kind), kind


def nearest_neighbors(
    queries: DataFrame, train: DataFrame, key: str, vector: str, k: int = 5, itself: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES, pairs: Accumulator | None = None,
) -> DataFrame:
    """``(key, neighbor, distance, rank)``: the exact k nearest training rows of every query.

    ``itself`` leaves out the row with the query's own key. ``key`` is a bigint.
    Ties go to the smaller key. A training set that is measured to fit is
    broadcast. A larger one lies on shelves of neighbouring cells: a query first meets the
    shelf of its nearest cell, then those that can hold a nearer row, in tasks of bounded
    size that pass on at most k rows per query. ``pairs`` adds up the distances that were computed.
    """
    (qv, qkind), (tv, tkind) = _vector(queries, vector), _vector(train, vector)
    q = queries.select(named(key).cast("bigint").alias("_id"), qv.alias("_q"))
    most = k + int(itself)
    # of equal vectors only the smallest keys can be among the nearest
    equal = Window.partitionBy(F.xxhash64("_x"), "_x").orderBy("_tid")
    t = train.select(named(key).cast("bigint").alias("_tid"), tv.alias("_x"))
    t = materialize(t.withColumn("_nth", F.row_number().over(equal)).where(F.col("_nth") <= most).drop("_nth"))
    size = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("_x")), F.lit(0)).alias("cells")).first()
    asked = q.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("_q")).alias("vectors")).first()
    bytes_needed = size["cells"] * 8 + size["n"] * 8
    centres = _drawn(t, size["n"])
    assigned = _assigned(t, centres, tkind)
    # where most queries repeat a vector, each vector is searched once
    repeated = asked["vectors"] * 2 < asked["n"]
    found = q.groupBy("_q").agg(F.min("_id").alias("_id")).select("_id", "_q") if repeated else q
    if repeated:
        found = materialize(found)
    number = asked["vectors"] if repeated else asked["n"]
    if not size["n"]:
        hits = queries.sparkSession.createDataFrame([], HITS)
    elif bytes_needed <= broadcast_bytes:
        table = assigned.toArrow()
        # plain arrays: a broadcast value travels without the classes of this package
        arrays = (centres, _numbers(table["_tid"]), _matrix(table["_x"]), _numbers(table["_cell"]), _numbers(table["_d"]))
        shared = queries.sparkSession.sparkContext.broadcast(arrays)

        def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for part in batches:
                if part.num_rows:
                    held = held or _Held(*shared.value)
                    yield from held.search(_numbers(part["_id"]), _matrix(part["_q"]), np.full(part.num_rows, np.inf), most, pairs)

        # use all cores, whatever the number of files
        hits = spread_out(found, number).mapInArrow(lookup, HITS)
    else:
        hits = _shelf_search(spread_out(found, number), qkind, assigned, centres, most, max(1, bytes_needed // size["n"]), pairs)
    if repeated:
        nth = F.row_number().over(Window.partitionBy("_id").orderBy("d2", "neighbor"))
        few = hits.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")
        names = q.join(found.select(F.col("_id").alias("_first"), "_q"), "_q").select("_id", "_first")
        hits = names.join(few.withColumnRenamed("_id", "_first"), "_first").drop("_first")
    if itself:
        hits = hits.where("neighbor <> _id")
    # at most a few rows per query and block
    w = Window.partitionBy("_id").orderBy("d2", "neighbor")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("_id").alias(key), "neighbor", F.sqrt("d2").alias("distance"), F.col("rank").cast("bigint").alias("rank")
    )


def _shelves(cells: _Cells, rows_per_shelf: int) -> list[tuple[int, int, int]]:
    """(cell, part of it, shelf): neighbouring cells share a shelf of bounded size, a cell too large for one is cut in parts."""
    held = np.flatnonzero(cells.rows > 0)
    middle = cells.centres[held] - cells.centres[held].mean(axis=0)
    line = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]  # order along the direction of the largest spread
    out, shelf, filled = [], 0, 0
    for c in held[np.argsort(line, kind="stable")].tolist():
        parts = -(-int(cells.rows[c]) // rows_per_shelf)
        for part in range(parts):
            rows = cells.rows[c] / parts
            if filled and filled + rows > rows_per_shelf:
                shelf, filled = shelf + 1, 0
            out.append((c, part, shelf))
            filled += rows
    return out


def _dealing(spark: SparkSession, weights: list[float], parts: int) -> list[int]:
    """A key for each group, so that ``repartition(parts, key)`` loads its partitions alike: the heaviest first, each to the least loaded.

    Keys that are only numbered would meet in a few partitions and leave others empty.
    """
    free: dict[int, list[int]] = {p: [] for p in range(parts)}
    for r in spark.range(20 * len(weights) + 1000).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).collect():
        free[r["p"]].append(r["id"])
    loads = [(0.0, p) for p in range(parts)]
    keys = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: -weights[i]):
        load, p = heapq.heappop(loads)
        keys[i] = free[p].pop() if free[p] else -1 - i  # any other key is right, too
        heapq.heappush(loads, (load + weights[i], p))
    return keys


def _shelf_search(q: DataFrame, qkind: str, assigned: DataFrame, centres: np.ndarray, k: int, row_bytes: int, pairs: Accumulator | None) -> DataFrame:
    """Queries go to the shelves they need, in two rounds; shelves and slices of their queries have bounded size."""
    spark = q.sparkSession
    assigned = materialize(assigned)
    cells = _measured(assigned, centres)
    # a square of shelves and slices gives all cores work with the fewest copies
    tasks = 4 * spark.sparkContext.defaultParallelism
    n = int(cells.rows.sum())
    placed = _shelves(cells, max(1, min(SHELF_BYTES // row_bytes, -(-n // int(np.ceil(np.sqrt(tasks)))))))
    shelves = placed[-1][2] + 1
    holds = np.zeros((len(centres), shelves), bool)
    first_shelf = np.zeros(len(centres), np.int64)
    for c, part, shelf in reversed(placed):
        holds[c, shelf], first_shelf[c] = True, shelf
    cuts = Counter(c for c, _, _ in placed)
    filled = Counter()
    for c, _, shelf in placed:
        filled[shelf] += cells.rows[c] / cuts[c]
    parts = spark.createDataFrame([(c, part, shelf) for c, part, shelf in placed], "_cell int, _part bigint, _shelf int")
    cut = F.broadcast(parts.groupBy("_cell").agg(F.count(F.lit(1)).alias("_parts")))
    train = assigned.join(cut, "_cell").withColumn("_part", F.pmod(F.xxhash64("_tid"), F.col("_parts"))).join(F.broadcast(parts), ["_cell", "_part"])
    train = train.select("_tid", "_x", "_cell", "_d", "_shelf")

    def visits(first: bool):
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    lo, hi = _distances(_matrix(part["_q"]), cells.centres)
                    home = first_shelf[np.where(cells.rows > 0, lo, np.inf).argmin(axis=1)]
                    if first:
                        needed = np.zeros((len(lo), shelves), bool)
                        needed[np.arange(len(lo)), home] = True
                    else:
                        near = cells.least(lo, hi) <= _numbers(part["_reach"])[:, None]
                        # a shelf is needed if one of its cells is
                        needed = near.astype("float32") @ holds.astype("float32") > 0
                        needed[np.arange(len(lo)), home] = False
                    ends = np.r_[0, np.cumsum(needed.sum(axis=1))]
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(needed)[1], pa.int32()))
                    yield pa.RecordBatch.from_arrays([part["_id"], part["_q"], part["_reach"], lists], ["_id", "_q", "_reach", "_shelves"])

        return choose

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            held = _Held(centres, _numbers(b["_tid"]), _matrix(b["_x"]), _numbers(b["_cell"]), _numbers(b["_d"]))
            found = list(held.search(_numbers(a["_id"]), _matrix(a["_q"]), _numbers(a["_reach"]) ** 2, k, pairs))
        return pa.Table.from_batches(found, _hits([], [], []).schema)

    def round_(asked: DataFrame, first: bool) -> DataFrame:
        wanted = materialize(asked.mapInArrow(visits(first), f"_id bigint, _q {qkind}, _reach double, _shelves array<int>"))
        sent = wanted.withColumn("_shelf", F.explode("_shelves")).drop("_shelves")
        counts = {r["_shelf"]: r["count"] for r in sent.groupBy("_shelf").count().collect()}
        if not counts:
            return spark.createDataFrame([], HITS)
        share = max(1, sum(counts.values()) // tasks)
        slices = {s: max(round(c / share) if shelves < tasks else 1, -(-c // SLICE_ROWS), 1) for s, c in counts.items()}
        groups = [(s, i) for s, n in slices.items() for i in range(n)]
        parts = min(len(groups), 10 * tasks)
        dealt = _dealing(spark, [counts[s] / slices[s] * filled[s] for s, _ in groups], parts)
        plan = [(s, i, key) for (s, i), key in zip(groups, dealt)]
        to_left, to_right = (F.broadcast(spark.createDataFrame(plan, "_shelf int, _slice bigint, _task bigint")) for _ in range(2))
        number = F.broadcast(spark.createDataFrame(list(slices.items()), "_shelf int, _slices bigint"))
        left = sent.join(number, "_shelf").withColumn("_slice", F.pmod(F.xxhash64("_id"), F.col("_slices"))).join(to_left, ["_shelf", "_slice"])
        left = left.select("_id", "_q", "_reach", "_task").repartition(parts, "_task")
        right = train.join(to_right, "_shelf").select("_tid", "_x", "_cell", "_d", "_task").repartition(parts, "_task")
        return left.groupBy("_task").cogroup(right.groupBy("_task")).applyInArrow(meet, HITS)

    first = materialize(round_(q.withColumn("_reach", F.lit(float("inf"))), True))
    w = Window.partitionBy("_id").orderBy("d2", "neighbor")
    kth = first.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") == k).select("_id", (F.sqrt("d2") * (1 + 1e-9) + 1e-12).alias("_reach"))
    rest = q.join(kth, "_id", "left").withColumn("_reach", F.coalesce("_reach", F.lit(float("inf"))))
    return first.unionByName(round_(rest, False))


def _labelled(hits: DataFrame, train: DataFrame, key: str, label: str) -> DataFrame:
    known = train.select(named(key).cast("bigint").alias("neighbor"), named(label).alias("_label"))
    return hits.join(known, "neighbor")


def knn_classify(
    queries: DataFrame, train: DataFrame, key: str, vector: str, label: str, k: int = 5, itself: bool = False, **kw
) -> DataFrame:
    """``(key, prediction, votes)``: majority of the k neighbours; ties go to the smaller label."""
    hits = _labelled(nearest_neighbors(queries, train, key, vector, k, itself, **kw), train, key, label)
    votes = hits.groupBy(key, "_label").agg(F.count(F.lit(1)).alias("v"))
    best = votes.groupBy(key).agg(F.min(F.struct((-F.col("v")).alias("v"), F.col("_label").alias("l"))).alias("b"))
    return best.select(key, F.col("b.l").alias("prediction"), (-F.col("b.v")).alias("votes"))


def knn_regress(
    queries: DataFrame, train: DataFrame, key: str, vector: str, target: str, k: int = 5, itself: bool = False, **kw
) -> DataFrame:
    """``(key, prediction)``: mean of the k neighbours."""
    hits = _labelled(nearest_neighbors(queries, train, key, vector, k, itself, **kw), train, key, target)
    return hits.groupBy(key).agg(F.avg("_label").alias("prediction"))
