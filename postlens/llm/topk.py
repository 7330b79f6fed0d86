"""Exact top-k inner products by dual-tree search over cover trees.

The top level of the trees is a set of pivots; every vector belongs to its nearest pivot's cell,
and a pair of cells is pruned when no inner product between them can reach the worst kth score
of the queries in it. Cells are cut into blocks of bounded size. Within a pair of blocks, both
sides are indexed by a cover tree and searched together under the same bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from postlens.operators.materialize import cut

SAMPLE = 2048  # vectors that pivots are chosen from and that give every query its first bound
PIVOTS = 32
BLOCK = 512  # candidates in a block
QUERY_BLOCK = 1024
LEAF = 64
BASE = 1.3  # a node's radius over that of its children
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def _floor(x: Column) -> Column:
    """Floor that stays a double, as a long would end at 2**63."""
    return x - F.pmod(x, F.lit(1.0))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows; outside 64 bits they stop at the ends of the range."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[int(v) for v in row] for row in b]
    rows = [[max(-LONG - 1, min(LONG, sum(int(x) * y for x, y in zip(q, w, strict=True)))) for w in whole] for q in a]
    return np.array(rows, np.int64).reshape(len(a), len(b))


class Tree:
    """A cover tree: every node has a center among its points, a radius that covers them, and children.

    Children's centers are chosen farthest first until all points lie within radius / BASE of
    one, so they are at least that far apart. Where that takes so many centers that children
    would hold a few points each, distances say nothing and the node stays a leaf.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, float, list[int]]] = []  # begin, end, center, radius, children
        if len(points):
            self._build(0, len(points), 0)

    def _distance(self, center: int, which: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[which] - self.points[center]) ** 2).sum(1))

    def _build(self, begin: int, end: int, center: int) -> int:
        stack = [(begin, end, center, -1)]
        while stack:
            begin, end, center, parent = stack.pop()
            mine = self.order[begin:end].copy()
            far = self._distance(center, mine)
            radius = float(far.max())
            node = len(self.nodes)
            self.nodes.append((begin, end, center, radius, []))
            if parent >= 0:
                self.nodes[parent][4].append(node)
            if len(mine) <= LEAF or radius == 0:
                continue
            centers, owner = [center], np.zeros(len(mine), int)
            while far.max() > radius / BASE and len(centers) <= len(mine) // 8:
                new = int(mine[far.argmax()])
                d = self._distance(new, mine)
                closer = d < far
                owner[closer] = len(centers)
                far = np.minimum(far, d)
                centers.append(new)
            if far.max() > radius / BASE:
                continue
            self.order[begin:end] = mine[np.argsort(owner, kind="stable")]
            at = begin
            for c, n in zip(centers, np.bincount(owner, minlength=len(centers)).tolist(), strict=True):
                if n:
                    stack.append((at, at + n, c, node))
                at += n
        return 0


class Best:
    """The k best (score, id) of each query so far; ``floor`` is a score that k candidates are known to reach."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k, self.worst = ids, k, floor.astype(np.float64).copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.top = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        q, s, i = (np.concatenate(x) for x in zip(self.top, (query, score, ids), strict=True))
        order = np.lexsort((i, -s.astype(object) if len(s) and s.min() == -LONG - 1 else -s, q))
        q, s, i = q[order], s[order], i[order]
        begin = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0)) if len(q) else q
        keep = rank < self.k
        self.top = (q[keep], s[keep], i[keep])
        full = keep & (rank == self.k - 1)
        self.worst[q[full]] = np.maximum(self.worst[q[full]], s[full].astype(np.float64))


def bound(q_center: np.ndarray, q_radius: float, c_center: np.ndarray, c_radius: float) -> float:
    """No inner product between two balls is larger."""
    a, b = float(np.sqrt(q_center @ q_center)), float(np.sqrt(c_center @ c_center))
    top = float(q_center @ c_center) + a * c_radius + b * q_radius + q_radius * c_radius
    return top + 1e-9 * (a + q_radius) * (b + c_radius) + 1.0


def search(
    queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, ties: np.ndarray | None = None
) -> Best:
    """Dual-tree search: node pairs in order of their bounds, pruned by the worst kth score in the query node.

    No query meets the point that has its own id. Of equal scores the smaller of ``ties`` is
    better (the ids, by default), and this is how the best are named.
    """
    best = Best(query_ids, floor, k)
    ties = ids if ties is None else ties
    left, right = Tree(queries), Tree(points)
    if not left.nodes or not right.nodes:
        return best
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        qb, qe, qc, qr, qk = left.nodes[a]
        cb, ce, cc, cr, ck = right.nodes[b]
        rows = left.order[qb:qe]
        if bound(queries[qc], qr, points[cc], cr) < best.worst[rows].min():
            continue
        if not qk and not ck:
            which = right.order[cb:ce]
            score = inner(queries[rows], points[which])
            good = (score >= best.worst[rows][:, None]) & (query_ids[rows][:, None] != ids[which][None, :])
            i, j = np.nonzero(good)
            if len(i):
                best.add(rows[i], score[i, j], ties[which[j]])
            continue
        if qk and (not ck or qr >= cr):
            pairs = [(x, b) for x in qk]
        else:
            pairs = [(a, y) for y in ck]
        reach = [bound(queries[left.nodes[x][2]], left.nodes[x][3], points[right.nodes[y][2]], right.nodes[y][3]) for x, y in pairs]
        stack += [pairs[i] for i in np.argsort(reach)]
    return best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _assign(pivots: dict[int, np.ndarray], sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Adds the nearest pivot (-1 without any), the distance to it, and for queries a score that k candidates reach."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dim(batch):
                part = batch.take(pa.array(rows))
                x = _matrix(part.column("v"), dim)
                ids = part.column("row").to_numpy()
                p = pivots.get(dim)
                if p is None:
                    cell, far = np.full(len(x), -1), np.sqrt((x**2).sum(1))
                else:
                    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1)))
                    cell = d.argmin(1)
                    far = np.sqrt(((x - p[cell]) ** 2).sum(1))
                floor = np.full(len(x), -np.inf)
                asks = np.flatnonzero(part.column("is_query").to_numpy(zero_copy_only=False))
                known = sample.get(dim)
                if len(asks) and known is not None:
                    score = inner(x[asks], known[0]).astype(np.float64)
                    score[ids[asks][:, None] == known[1][None, :]] = -np.inf
                    if score.shape[1] >= k:
                        floor[asks] = np.partition(score, score.shape[1] - k, 1)[:, score.shape[1] - k]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(cell.astype(np.int32)), pa.array(far), pa.array(floor)],
                    [*part.schema.names, "cell", "far", "floor"],
                )

    return assign


def _search_block(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query", "query_id", "vec_id", "row", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        dim = left.column("q_dim")[0].as_py()
        right = right.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        queries, points = (_matrix(t.column(c).combine_chunks(), dim) for t, c in ((left, "q_v"), (right, "v")))
        asks, rows = left.column("q_row").to_numpy(), right.column("row").to_numpy()
        best = search(queries, asks, left.column("q_floor").to_numpy(), points, rows, k, np.arange(len(rows)))
        q, s, i = best.top
        columns = [asks[q], left.column("q_vec_id").to_numpy()[q], right.column("vec_id").to_numpy()[i], rows[i], s]
        return pa.table(dict(zip(names, columns, strict=True)))

    return run


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose vec_id is divisible by ``every``, its ``k`` best others.

    Components become floor(scale * x) and the score is the integer inner product, ties to
    the smaller vec_id. Vectors that are null or hold a null or non-finite component take no
    part, nor do rows without a vec_id. Rows that repeat a vec_id are queries and candidates of
    their own: only the query's own row is no candidate. Vectors are compared with those of
    the same length only; queries without any candidate return no row.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    usable = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    scaled = F.transform(x, lambda v: _floor(v.cast("double") * scale))
    rows = cut(
        usable.select(F.col("vec_id").cast("long"), scaled.alias("v")).select(
            "vec_id", "v", F.size("v").alias("dim"), (F.pmod("vec_id", F.lit(every)) == 0).alias("is_query"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "topk-rows",
    )
    drawn = rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "row").limit(SAMPLE).toArrow()
    sample, pivots = {}, {}
    for batch in drawn.combine_chunks().to_batches():
        for dim, which in _by_dim(batch):
            part = batch.take(pa.array(which))
            points = _matrix(part.column("v"), dim)
            sample[dim] = (points, part.column("row").to_numpy())
            chosen, far = [0], ((points - points[0]) ** 2).sum(1)
            while len(chosen) < PIVOTS and far.max() > 0:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
            pivots[dim] = points[chosen]
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType()), T.StructField("floor", T.DoubleType())])
    placed = cut(rows.mapInArrow(_assign(pivots, sample, k), schema), "topk-placed")
    cells = placed.groupBy("dim", "cell").agg(
        F.count("*").alias("n"), F.max("far").alias("radius"), F.count_if("is_query").alias("queries"),
        F.max(F.when(F.col("is_query"), F.col("far"))).alias("query_radius"), F.min(F.when(F.col("is_query"), F.col("floor"))).alias("worst"),
    ).collect()  # at most PIVOTS + 1 per length of vector
    pairs = []
    for q in cells:
        for c in cells if q["queries"] else ():
            if q["dim"] != c["dim"]:
                continue
            centers = [np.zeros(q["dim"]) if r["cell"] < 0 else pivots[r["dim"]][r["cell"]] for r in (q, c)]
            if bound(centers[0], q["query_radius"], centers[1], c["radius"]) >= q["worst"]:
                pairs.append((q["dim"], q["cell"], c["cell"], -(-c["n"] // BLOCK), -(-q["queries"] // QUERY_BLOCK)))
    spark = vectors.sparkSession
    names = "dim int, q_cell int, c_cell int, c_blocks long, q_blocks long"
    pair = F.broadcast(spark.createDataFrame(pairs, names))  # at most (PIVOTS + 1) ** 2 per length

    def spot(of: str, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.col(of)).cast("int")

    key = ["dim", "c_cell", "c_block", "q_block"]
    asks = placed.where("is_query").withColumnRenamed("cell", "q_cell").join(pair, ["dim", "q_cell"])
    asks = asks.withColumn("q_block", spot("q_blocks", 3)).withColumn("c_block", F.explode(F.sequence(F.lit(0), (F.col("c_blocks") - 1).cast("int"))))
    # Queries of several cells meet a block of candidates together, so it is indexed once per block of queries.
    most = pair.groupBy("dim", "c_cell", "c_blocks").agg(F.max("q_blocks").alias("q_most"))
    points = placed.withColumnRenamed("cell", "c_cell").join(F.broadcast(most), ["dim", "c_cell"])
    points = points.withColumn("c_block", spot("c_blocks", 2)).withColumn("q_block", F.explode(F.sequence(F.lit(0), (F.col("q_most") - 1).cast("int"))))
    left = asks.select(*[F.col(c).alias(f"q_{c}") for c in [*key, "vec_id", "row", "v", "floor"]]).groupBy(*[f"q_{c}" for c in key])
    right = points.select(*key, "vec_id", "row", "v").groupBy(*key)
    found = left.cogroup(right).applyInArrow(_search_block(k), "query long, query_id long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
