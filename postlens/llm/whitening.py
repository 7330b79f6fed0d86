"""PCA whitening of integer vectors: the covariance is learned from distinct vectors, each weighted.

Equal vectors are grouped first. Every task adds up the weighted products of its distinct
vectors, centred at whole numbers next to the means, by one matrix product a batch; the sums
are put together row by row. Each distinct vector is whitened once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.materialize import cut
from postlens.operators.skew import key_hash, lookup

SCALE = 256.0
COMPONENTS = 4
MOST_LENGTHS = 256  # lengths of vectors in one table, each with a model of its own
FLAT = 1e-12  # of the trace: an eigenvalue no larger is zero
_SAFE = float(1 << 62)
_FACTS = "k1 long, k2 long, w long, copies long, dim int, n long, deviation long, z array<double>"


@dataclass(frozen=True)
class Model:
    """What tasks need to whiten the vectors of one length.

    ``near`` are the whole numbers next to the means and ``rest`` is n * mean - n * near, so that
    n * (x - mean) = n * (x - near) - rest in whole numbers.
    """

    n: int
    near: np.ndarray
    rest: list[int]
    axes: np.ndarray | None = None  # a column per component
    values: np.ndarray | None = None  # eigenvalues, zero where flat
    trace: float = 0.0


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of each length in the batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        flat = batch.column("x").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield dim, rows, flat.reshape(len(rows), dim)


def _total(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Weighted sums of the columns, as whole numbers of any size."""
    if not x.size or float(np.abs(x.astype(float)).max()) * float(w.sum()) < _SAFE:
        return [int(v) for v in w @ x]
    return [sum(int(a) * int(b) for a, b in zip(column, w, strict=True)) for column in x.T]


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, totals): the weights of a task's vectors and their weighted sums, as decimal text."""
    held: dict[int, list[int]] = {}
    for batch in batches:
        w = batch.column("w").to_numpy()
        for dim, rows, x in _vectors(batch):
            total = [int(w[rows].sum()), *_total(x, w[rows])]
            held[dim] = [a + b for a, b in zip(held[dim], total, strict=True)] if dim in held else total
    totals = pa.array([[str(v) for v in t] for t in held.values()], pa.list_(pa.string()))
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), totals], ["dim", "totals"])


def _products(models: dict[int, Model]):
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(dim, i, row): row i of a task's weighted centred products, and as row -1 its weighted centred sums."""
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            w = batch.column("w").to_numpy().astype(float)
            for dim, rows, x in _vectors(batch):
                y = x.astype(float) - models[dim].near
                weighted = y * w[rows, None]
                sums = np.vstack((weighted.T @ y, weighted.sum(0)))
                held[dim] = held[dim] + sums if dim in held else sums
        for dim, sums in held.items():
            place = pa.array([*range(dim), -1], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([dim] * (dim + 1), pa.int32()), place, pa.array(list(sums))], ["dim", "i", "row"])

    return add_up


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.sum(rows.column("row").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), 0)
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "i": pa.array([key[1].as_py()], pa.int32()), "row": pa.array([total])})


def _fitted(model: Model, products: np.ndarray, shift: np.ndarray, components: int) -> Model:
    """The first axes of the covariance, each with its largest entry positive."""
    covariance = (products - np.outer(shift, shift) / model.n) / model.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    largest = axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]
    trace = float(np.trace(covariance))
    values = np.where(values > FLAT * trace, values, 0.0)
    return Model(model.n, model.near, model.rest, np.ascontiguousarray(axes * np.where(largest < 0, -1.0, 1.0)), values, trace)


def _deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) ** 2 in whole numbers; None beyond 64 bits."""
    rest = np.array([float(v) for v in model.rest])
    bound = np.abs(x.astype(float) - model.near).max(initial=0.0) * model.n + np.abs(rest).max(initial=0.0)
    if bound**2 * x.shape[1] < _SAFE and np.abs(model.near).max() < _SAFE:
        apart = model.n * (x - model.near.astype(np.int64)) - np.array(model.rest, np.int64)
        return (apart * apart).sum(1).tolist()
    total = [int(v) * model.n + r for v, r in zip(model.near, model.rest, strict=True)]
    exact = [sum((model.n * int(v) - t) ** 2 for v, t in zip(row, total, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def _whiten(models: dict[int, Model]):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in _vectors(batch):
                model = models[dim]
                middle = np.array([float(v) for v in model.rest]) / model.n
                flat = model.values == 0
                z = ((x.astype(float) - model.near - middle) @ model.axes) / np.sqrt(np.where(flat, 1.0, model.values))
                part = batch.take(pa.array(rows))
                ends = np.arange(len(rows) + 1, dtype=np.int32) * z.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in ("k1", "k2", "w", "copies", "dim")], pa.array([model.n] * len(rows), pa.int64()),
                        pa.array(_deviations(model, x), pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(z.ravel(), mask=np.tile(flat, len(rows)))),
                    ],
                    ["k1", "k2", "w", "copies", "dim", "n", "deviation", "z"],
                )

    return whiten


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of the vectors ``x`` with weights ``w``.

    The driver holds the sums of a length's components and their products, so d * d numbers for
    vectors of d components, however many vectors there are.
    """
    sums = distinct.mapInArrow(_sum_rows, "dim int, totals array<string>").select("dim", F.posexplode("totals").alias("i", "v"))
    placed = sums.groupBy("dim", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = placed.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("totals")).limit(MOST_LENGTHS + 1).collect()
    if len(found) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    models = {}
    for r in found:
        n, *total = (int(t["v"]) for t in r["totals"])
        near = np.array([float((2 * t + n) // (2 * n)) for t in total])
        models[r["dim"]] = Model(n, near, [t - n * int(v) for t, v in zip(total, near, strict=True)])
    if not models:
        return models
    parts = distinct.mapInArrow(_products(models), "dim int, i int, row array<double>")
    products = parts.groupBy("dim", "i").applyInArrow(_add, "dim int, i int, row array<double>").toArrow()
    dims, places = products.column("dim").to_numpy(), products.column("i").to_numpy()
    for dim, model in models.items():
        rows = np.flatnonzero(dims == dim)
        order = rows[np.argsort(places[rows])]
        matrix = products.column("row").take(pa.array(order)).combine_chunks().flatten().to_numpy().reshape(dim + 1, dim)
        models[dim] = _fitted(model, matrix[1:], matrix[0], components)
    return models


def identity_error(whitened: DataFrame, components: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the weighted covariance of ``z`` minus the identity; None where nothing is whitened."""
    z, w = [F.get("z", F.lit(i)) for i in range(components)], F.col("w")
    means = whitened.groupBy("dim").agg(*[(F.sum(w * z[i]) / F.sum("w")).alias(f"m{i}") for i in range(components)])
    centred = whitened.join(F.broadcast(means), "dim")  # a row per length of vector
    apart = [
        F.abs(F.sum(w * (z[i] - F.col(f"m{i}")) * (z[j] - F.col(f"m{j}"))) / F.sum("w") - (1.0 if i == j else 0.0)).alias(f"e{i}_{j}")
        for i in range(components) for j in range(i + 1)
    ]
    errors = centred.groupBy("dim").agg(*apart).collect()
    return max((e for r in errors for e in r.asDict().values() if isinstance(e, float)), default=None)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: float = SCALE, weigh_copies: bool = False) -> DataFrame:
    """``vectors`` with ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``; columns of these names are replaced.

    Entries become whole numbers x = floor(scale * entry), at the ends of 64 bits where they
    would go beyond. Rows are dropped whose ``embedding`` is null, empty or holds a null or non-finite entry.
    The fit takes each distinct x once, or with ``weigh_copies`` as often as it occurs; ``n``
    is the sum of these weights, S the weighted sum of x and the covariance has the divisor n.
    ``deviation`` is the sum over the dimensions of (n * x - S) ** 2, null beyond 64 bits.
    ``whitened`` holds the projections of x - S / n on the first unit eigenvectors, fewer where
    vectors are shorter, over the roots of the eigenvalues; null for an eigenvalue of zero (up
    to ``FLAT`` of the trace), and ``explained`` the eigenvalues over the trace (zero where
    the trace is). An eigenvector's largest entry is positive; equal eigenvalues leave their
    axes open, but all rows see the same ones. Vectors of each length have a model of their own,
    at most ``MOST_LENGTHS`` of them. Rows that repeat, or have no vec_id, all stay. An empty input
    gives an empty result. Equal vectors are told by 128 bits of hash when they are joined back.
    """
    names = ("n", "deviation", "whitened", "explained", "identity_error")
    rows = vectors.drop(*names)
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    usable = rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    counted = usable.select(x.alias("x")).groupBy("x").agg(F.count("*").alias("copies"))
    k1, k2 = key_hash(F.col("x"))
    weight = F.col("copies") if weigh_copies else F.lit(1).cast("long")
    distinct = cut(counted.select(k1.alias("k1"), k2.alias("k2"), "x", F.size("x").alias("dim"), weight.alias("w"), "copies"), "whitening-distinct")
    models = fit(distinct, components)
    facts = cut(distinct.mapInArrow(_whiten(models), _FACTS), "whitening-facts")
    error = identity_error(facts, components)
    shares = [(d, [float(e / m.trace) if m.trace > 0 else 0.0 for e in m.values]) for d, m in models.items()]
    told = F.broadcast(vectors.sparkSession.createDataFrame(shares, "dim int, explained array<double>"))  # MOST_LENGTHS rows at most
    known = facts.join(told, "dim").select("k1", "k2", "copies", "n", "deviation", F.col("z").alias("whitened"), "explained")
    key1, key2 = key_hash(x)
    keyed = usable.withColumns({"_wh_k1": key1, "_wh_k2": key2})
    known = known.withColumnsRenamed({"k1": "_wh_k1", "k2": "_wh_k2", "copies": "_wh_copies"})
    out = lookup(keyed, known, ["_wh_k1", "_wh_k2"], "_wh_copies", "vec_id")
    return out.drop("_wh_k1", "_wh_k2").withColumn("identity_error", F.lit(error).cast("double"))


def by_component(whitened: DataFrame) -> DataFrame:
    """A row per vector and component: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``."""
    each = F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), F.col("explained").alias("e"))).alias("at", "c")
    return whitened.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), "identity_error",
    )
