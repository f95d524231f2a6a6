"""Approximate nearest neighbours: few stable projections indexed by kd-trees, with a chi-square test that ends the search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanweave.llm.staging import discard, sized, staged

#: Projected dimensions (even), points of a leaf, points verified at a time.
PROJECTED, LEAF, STEP = 32, 64, 128
#: The cells' split planes are fitted on a sample of about so many vectors; every vector is indexed.
SAMPLE = 20_000
#: Vectors and queries that one task searches at a time.
BLOCK, QUERIES = 8192, 8192
#: The first level has so many cells at most, as many as its sample can tell apart; larger cells are split into
#: blocks of BLOCK vectors with trees of their own, without a limit.
CELLS = 4096


def chi_square_quantile(p: float, freedom: int) -> float:
    """Where the chi-square distribution with an even number of degrees of freedom reaches p."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(size: int, seed: int) -> np.ndarray:
    """Gaussian directions: a projected squared distance over the true one has the chi-square distribution."""
    return np.random.default_rng([seed, size]).standard_normal((size, PROJECTED))


class Tree:
    """A kd-tree over projected points: leaves as runs of an order, each with the box of its points."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        order, todo, runs = np.arange(len(points)), [(0, len(points))], []
        while todo:
            a, z = todo.pop()
            own = points[order[a:z]]
            if z - a <= leaf or (wide := np.ptp(own, axis=0)).max() == 0:
                runs.append((a, z))
                continue
            mid = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(own[:, wide.argmax()], mid)]
            todo += [(a, a + mid), (a + mid, z)]
        self.order, self.runs = order, sorted(runs)
        self.low = np.array([points[order[a:z]].min(axis=0) for a, z in self.runs])
        self.high = np.array([points[order[a:z]].max(axis=0) for a, z in self.runs])


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(axis=-1)


class Planes:
    """The split planes of a kd-tree over a sample; they deal all points to cells."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.splits: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self.root = self._grow(sample, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        """A split's number, or -1 - cell."""
        wide = np.ptp(points, axis=0) if len(points) > 1 else np.zeros(1)
        if cells < 2 or wide.max() == 0:
            self.cells += 1
            return -self.cells
        d = int(wide.argmax())
        at = float(np.median(points[:, d]))
        left = points[:, d] < at
        if not left.any():
            at = float(np.nextafter(at, np.inf))
            left = points[:, d] < at
        if left.all():
            self.cells += 1
            return -self.cells
        here = len(self.splits)
        self.splits.append((d, at, 0, 0))
        self.splits[here] = (d, at, self._grow(points[left], cells // 2), self._grow(points[~left], cells - cells // 2))
        return here

    def cell(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), dtype=np.int32), [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                d, at, a, z = self.splits[node]
                left = points[rows, d] < at
                todo += [(a, rows[left]), (z, rows[~left])]
        return out


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _floats(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _celled(seed: int, planes: Planes) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Projections and cells of vectors; vectors of each length are projected and searched by themselves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.diff(whole.column("embedding").offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                b = whole.filter(pa.array(sizes == size))
                x = _matrix(b.column("embedding"), b.num_rows) @ directions(size, seed)
                same = pa.array(np.full(b.num_rows, size, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("first"), b.column("embedding"), _floats(x), same, pa.array(planes.cell(x))], names=["cid", "first", "embedding", "proj", "size", "cell"])

    return run


def nearest_first(point: np.ndarray, query: np.ndarray, tree: Tree, proj: np.ndarray, data: np.ndarray, firsts: np.ndarray, k: int, bound: float, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, distances, verified) of a query's k nearest in one tree, by incremental projected neighbours.

    Leaves are opened nearest first. A point whose projected distance is below the next leaf's is next in order
    and is verified on its original vector. The search ends when the next projected distance is so far from
    bound, the k-th verified distance, that by the chi-square test no nearer vector is to be expected there.
    """
    far = box_distances(point, tree.low, tree.high)
    leaves = np.argsort(far, kind="stable")
    best, rows, verified = np.empty(0), np.empty(0, dtype=np.int64), 0
    waiting, waiting_far = np.empty(0, dtype=np.int64), np.empty(0)
    opened, more = 0, 4
    while True:
        if opened < len(leaves) and far[leaves[opened]] <= limit * bound * bound:
            new = np.concatenate([tree.order[a:z] for a, z in (tree.runs[i] for i in leaves[opened : opened + more])])
            opened, more = opened + more, 2 * more
            waiting, waiting_far = np.concatenate([waiting, new]), np.concatenate([waiting_far, ((proj[new] - point) ** 2).sum(axis=1)])
        reach = far[leaves[opened]] if opened < len(leaves) else np.inf
        order = np.argsort(waiting_far, kind="stable")
        waiting, waiting_far = waiting[order], waiting_far[order]
        ready, at = int(np.searchsorted(waiting_far, reach, side="right")), 0
        while at < ready and waiting_far[at] <= limit * bound * bound:
            stop = min(at + STEP, ready)
            own = waiting[at:stop]
            best, rows = np.concatenate([best, np.sqrt(((data[own] - query) ** 2).sum(axis=1))]), np.concatenate([rows, own])
            keep = np.lexsort((firsts[rows], best))[:k]
            best, rows, verified, at = best[keep], rows[keep], verified + stop - at, stop
            if len(best) == k:
                bound = min(bound, best[-1])
        if at < ready or reach > limit * bound * bound or opened >= len(leaves):
            return rows, best, verified
        waiting, waiting_far = waiting[at:], waiting_far[at:]


_FOUND = "qid long, cid long, dist double, verified long"


def _search(k: int, limit: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The points found for each query in one block of a cell; the first row of a query has the number verified."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        qid, cid, dist, seen = [], [], [], []
        if queries.num_rows and vectors.num_rows:
            ids, firsts = vectors.column("cid").to_numpy(), vectors.column("first").to_numpy()
            proj, data = _matrix(vectors.column("proj"), vectors.num_rows), _matrix(vectors.column("embedding"), vectors.num_rows)
            tree = Tree(proj, LEAF)
            q, p = _matrix(queries.column("embedding"), queries.num_rows), _matrix(queries.column("proj"), queries.num_rows)
            for i, (own, bound) in enumerate(zip(queries.column("cid").to_pylist(), queries.column("bound").to_pylist(), strict=True)):
                rows, best, verified = nearest_first(p[i], q[i], tree, proj, data, firsts, k, bound, limit)
                n = max(1, len(rows))
                qid += [own] * n
                cid += ids[rows].tolist() or [None]
                dist += best.tolist() or [None]
                seen += [verified] + [0] * (n - 1)
        return pa.table({"qid": pa.array(qid, pa.int64()), "cid": pa.array(cid, pa.int64()), "dist": pa.array(dist, pa.float64()), "verified": pa.array(seen, pa.int64())})

    return run


def _elsewhere(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], limit: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cells other than its own that a query's test doesn't rule out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, home, bound, size = _matrix(b.column("proj"), b.num_rows), b.column("cell").to_numpy(), b.column("bound").to_numpy(), b.column("size").to_pylist()
            for i in range(b.num_rows):
                cells, low, high = boxes[size[i]]
                near = cells[(box_distances(p[i], low, high) <= limit * bound[i] * bound[i]) & (cells != home[i])]
                if len(near):
                    rows = pa.array(np.full(len(near), i))
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(rows) for c in ("cid", "first", "embedding", "proj", "size", "bound")], pa.array(near.astype(np.int32))], names=["cid", "first", "embedding", "proj", "size", "bound", "cell"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): the rows with an id and a finite, non-zero vector."""
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, certainty: float = 0.9, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score, n_verified): for each row whose vec_id every divides, the k nearest other rows found.

    score: Euclidean distance in double precision on the original vectors; rank from 1, ties to the smaller vec_id.
    n_verified: original vectors that were compared with the query's.

    Equal vectors are one point with its k + 1 smallest ids, more can't be among k nearest. Points are projected
    on PROJECTED Gaussian directions and dealt to cells by the planes of a kd-tree; a cell's blocks of about
    block vectors have kd-trees of their own. A query goes through a block's projected neighbours in order, each
    verified on its original vector, until the chi-square test says that a point with the k-th distance found
    would have been met with probability certainty. It starts with a block of its own cell; the same test then
    names the blocks of all cells that it must search. Each true neighbour is found with about that probability.

    Rows with a null vec_id, or a vector that is null, zero or with null or non-finite components take no part.
    Vectors are compared with those of their own length. Every row is a candidate but the query's own: repeated
    rows and rows that share a vec_id count each, and each query row has its result. A query without candidates
    gives no row. Empty tables give empty results; other columns are left out.
    """
    limit = chi_square_quantile(certainty, PROJECTED)
    v = staged(usable(vectors), "vectors")
    same = Window.partitionBy("embedding").orderBy("vec_id")
    points = v.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = staged(points.withColumn("cid", F.xxhash64("embedding")).withColumn("first", F.get("ids", F.lit(0))), "points")
    n = points.count()
    sample = [np.array(r[0], dtype=float) for r in points.sample(min(1.0, SAMPLE / max(n, 1)), seed).select("embedding").limit(2 * SAMPLE).collect()]
    fitted = np.array([x @ directions(len(x), seed) for x in sample]).reshape(-1, PROJECTED)
    planes = Planes(fitted, min(CELLS, math.ceil(n / block)))
    number = "float" if dict(points.dtypes)["embedding"] == "array<float>" else "double"  # floats are moved as they are
    kept = f"cid long, first long, embedding array<{number}>, proj array<double>, size int, cell int"
    celled = lambda d: d.select("cid", "first", F.col("embedding").cast(f"array<{number}>").alias("embedding")).mapInArrow(_celled(seed, planes), kept)
    cells = staged(celled(points), "cells")
    queries = v.where(F.col("vec_id") % every == 0)
    asked = staged(celled(queries.select("embedding").distinct().withColumn("cid", F.xxhash64("embedding")).withColumn("first", F.lit(0).cast("long"))), "queries")

    # At most CELLS rows of each length: counts and boxes.
    edges = [f(F.get("proj", F.lit(i))).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]
    found_boxes = cells.groupBy("size", "cell").agg(F.count("*").alias("n"), *edges).orderBy("size", "cell").collect()
    boxes = {s: tuple(np.array(x) for x in zip(*[(r["cell"], [r[f"low{i}"] for i in range(PROJECTED)], [r[f"high{i}"] for i in range(PROJECTED)]) for r in found_boxes if r["size"] == s], strict=True)) for s in {r["size"] for r in found_boxes}}
    blocks = vectors.sparkSession.createDataFrame([(r["size"], r["cell"], math.ceil(r["n"] / block)) for r in found_boxes], "size int, cell int, blocks int")
    blocked = cells.join(F.broadcast(blocks), ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "cid"), "blocks").cast("int")).drop("blocks")
    keys = ["size", "cell", "block", "chunk"]

    def meet(q: DataFrame) -> DataFrame:
        """Queries (with block) against the vectors of their blocks, so many of either side in a task at most."""
        q = staged(q, "asked")
        chunks = q.groupBy("size", "cell", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))
        chunks = staged(chunks, "chunks")
        own = q.join(sized(chunks), ["size", "cell", "block"]).withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), F.lit(1), "cid"), "chunks").cast("int")).drop("chunks")
        against = blocked.join(sized(chunks), ["size", "cell", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        out = staged(own.groupBy(*keys).cogroup(against.groupBy(*keys)).applyInArrow(_search(k + 1, limit), _FOUND), "found")
        discard(q, chunks)
        return out

    home = meet(asked.withColumn("bound", F.lit(float("inf"))).withColumn("block", F.lit(0)))
    bounds = home.groupBy("qid").agg(F.sort_array(F.collect_list("dist")).alias("d")).select(F.col("qid").alias("cid"), F.coalesce(F.get("d", F.lit(k)), F.lit(float("inf"))).alias("bound"))
    more = asked.join(bounds, "cid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    others = more.mapInArrow(_elsewhere(boxes, limit), f"cid long, first long, embedding array<{number}>, proj array<double>, size int, bound double, cell int")
    others = others.join(F.broadcast(blocks), ["size", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    rest = more.join(F.broadcast(blocks), ["size", "cell"]).where("blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks") - 1))).drop("blocks")
    found = home.unionByName(meet(others.unionByName(rest)))

    work = found.groupBy("qid").agg(F.sum("verified").alias("n_verified"))
    nearer = Window.partitionBy("qid").orderBy("dist", "first")
    found = found.where("cid is not null").join(points.select("cid", "ids", "first"), "cid")
    found = found.withColumn("_r", F.row_number().over(nearer)).where(F.col("_r") <= k + 1)
    best = found.select("qid", F.explode("ids").alias("vec_id"), "dist").groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "vec_id"))), 1, k + 1).alias("best"))
    best = staged(best.join(work, "qid"), "best")
    # One row of the query's own point with its own id is the query itself.
    q = queries.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("qid")).join(sized(best), "qid")
    itself = F.array_position("best", F.struct(F.lit(0.0).alias("dist"), F.col("query_id").alias("vec_id"))).cast("int")
    ranked = F.slice(F.when(itself > 0, F.concat(F.slice("best", F.lit(1), itself - 1), F.slice("best", itself + 1, F.lit(k + 1)))).otherwise(F.col("best")), 1, k)
    discard(cells, asked)
    return q.select("query_id", "n_verified", F.posexplode(ranked).alias("_i", "_n")).select("query_id", (F.col("_i") + 1).alias("rank"), F.col("_n.vec_id").alias("vec_id"), F.col("_n.dist").alias("score"), "n_verified")
