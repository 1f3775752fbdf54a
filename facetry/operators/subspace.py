"""Principal axes of sparse profiles by subspace iteration: no dense vectors, no feature-by-feature matrix.

A pass multiplies the centred rows with the current axes and their result with the rows
again; tasks return sums over blocks of features.  The driver holds features x axes numbers.
Iteration stops when what the covariance moves out of the subspace, relative to its greatest
eigenvalue, is within the tolerance; that residual is part of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.profiles import min_support
from facetry.runtime import reliable

#: Features of a block of sums.
FEATURES = 1024


@dataclass(frozen=True)
class Axes:
    """Axes as rows over the catalogue's features, their variances, the features' means, and how far the iteration came."""

    axes: np.ndarray
    variance: np.ndarray
    mean: np.ndarray
    residual: float
    rounds: int


def indexed_rows(profile: DataFrame, support: int = 1, unit: bool = False) -> tuple[DataFrame, DataFrame]:
    """((entity_id, at, weights), catalogue): each profile as the indices of its features and their scores.

    ``unit`` scales every row to length 1.  Entities without a supported feature have empty lists.
    """
    catalog = reliable(min_support(profile, support))
    cells = profile.join(catalog.select("kind", "feature", F.col("feature_index").cast("int").alias("_i")), ["kind", "feature"], "left")
    cell = F.when(F.col("_i").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("score").cast("double").alias("w")))
    rows = cells.groupBy("entity_id").agg(F.array_sort(F.collect_list(cell)).alias("_c"))  # bounded by the catalogue
    weights = F.col("_c.w")
    if unit:
        norm = F.sqrt(F.aggregate(F.col("_c.w"), F.lit(0.0), lambda s, v: s + v * v))
        weights = F.transform(F.col("_c.w"), lambda v: F.coalesce(F.try_divide(v, norm), F.lit(0.0)))
    return reliable(rows.select("entity_id", F.col("_c.i").alias("at"), weights.alias("weights"))), catalog


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("at")
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return row, lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()


def _sums(rows: DataFrame, work, features: int, width: int) -> np.ndarray:
    """``work(row, at, weight, n)`` gives (features x width) sums of a batch; added up by block of features in tasks, then put together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features, width))
        for batch in batches:
            if batch.num_rows:
                total += work(*_flat(batch), batch.num_rows)
        for b in range(0, features, FEATURES):
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([total[b:b + FEATURES].tobytes()], pa.binary())], ["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, float) for p in table.column("part").to_pylist()]
        return pa.table({"block": table.column("block").slice(0, 1), "part": pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())})

    got = rows.mapInArrow(run, "block long, part binary").groupBy("block").applyInArrow(add, "block long, part binary").orderBy("block").collect()
    return np.concatenate([np.frombuffer(r["part"], float).reshape(-1, width) for r in got]) if got else np.zeros((features, width))


def _added(to, weight, come, values, n) -> np.ndarray:
    """n rows: the weighted rows ``come`` of ``values``, added up by ``to``, a column at a time."""
    return np.stack([np.bincount(to, weight * column[come], n) for column in np.ascontiguousarray(values.T)], axis=1)


def _product(row, at, weight, n, basis) -> np.ndarray:
    """Coordinates of the rows on the basis, before centring."""
    return _added(row, weight, at, basis, n)


def principal_axes(rows: DataFrame, features: int, k: int, tolerance: float = 1e-4, rounds: int = 60, extra: int = 8, seed: int = 42) -> Axes:
    """First k principal axes of sparse rows (at, weights), signs fixed so that the largest loading is positive.

    The iteration carries ``extra`` more directions than asked; fewer rows or features than
    axes give axes of variance 0.
    """
    count = rows.count()
    width = min(features, k + extra)

    def moments(row, at, weight, n):
        return np.bincount(at, weight, features)[:, None]
    mean = _sums(rows, moments, features, 1)[:, 0] / max(1, count)
    if not width or not count:
        return Axes(np.zeros((k, features)), np.zeros(k), mean, 0.0, 0)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)))[0]
    residual, done = np.inf, 0
    values = np.zeros(width)
    for done in range(1, rounds + 1):
        now = basis
        shift = mean @ now

        def step(row, at, weight, n):
            y = _product(row, at, weight, n, now) - shift
            return _added(at, weight, row, y, features) - mean[:, None] * y.sum(0)
        moved = _sums(rows, step, features, width) / max(1, count)
        # the best axes inside the subspace, and what the covariance moves out of it
        values, turn = np.linalg.eigh((basis.T @ moved + moved.T @ basis) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        basis, moved = basis @ turn, moved @ turn
        top = min(k, width)
        gap = moved[:, :top] - basis[:, :top] * values[:top]
        spread = values[0] > 1e-12 * float(mean @ mean)  # rows that are all equal have no axes
        residual = float(np.sqrt((gap * gap).sum(0)).max() / values[0]) if spread else 0.0
        if residual <= tolerance:
            break
        basis = np.linalg.qr(moved)[0]
    axes = basis[:, :k].T
    peak = np.abs(axes).argmax(1)
    axes = axes * np.where(axes[np.arange(len(axes)), peak] < 0, -1.0, 1.0)[:, None]
    missing = k - len(axes)
    return Axes(np.pad(axes, ((0, missing), (0, 0))), np.pad(np.maximum(values[:k], 0.0), (0, missing)), mean, residual, done)


def coordinates(rows: DataFrame, found: Axes, out_col: str) -> DataFrame:
    """(entity_id, coordinates on the axes after centring)."""
    shared = rows.sparkSession.sparkContext.broadcast((np.ascontiguousarray(found.axes.T), found.axes @ found.mean))
    kind = rows.schema["entity_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, shift = shared.value
        for batch in batches:
            if batch.num_rows:
                y = _product(*_flat(batch), batch.num_rows, basis) - shift
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("entity_id"), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["entity_id", out_col])
    return rows.mapInArrow(run, f"entity_id {kind}, {out_col} array<double>")


def sparse_color_embed(profile: DataFrame, k: int = 3, support: int = 1, out_col: str = "color_raw", tolerance: float = 1e-4) -> tuple[DataFrame, Axes]:
    """Coordinates of cosine-kernel PCA straight from long profiles: principal axes of their unit rows."""
    rows, catalog = indexed_rows(profile, support, unit=True)
    found = principal_axes(rows, catalog.count(), k, tolerance)
    return coordinates(rows, found, out_col), found
