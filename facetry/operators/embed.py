"""Embeddings of profiles: principal axes (MLlib), neighbour graph, spectral coordinates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions import vectors as V
from facetry.operators import neighbours as nb
from facetry.operators.profiles import min_support
from facetry.runtime import reliable, scalar

#: Numbers of a batch of dense vectors.
CELLS = 1 << 20


def matrix_literal(rows: np.ndarray) -> Column:
    """A small matrix (axes x dimensions) as an ``array<array<double>>`` constant."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])


def principal_axes(vectors: DataFrame, k: int, vector_col: str = "vector") -> np.ndarray:
    """First k principal axes as rows, signs fixed so that the largest loading is positive.

    MLlib sums the m x m covariance in tasks; only that matrix, whose size
    depends on the features and not on the rows, reaches the driver.
    """
    dense = vectors.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("x"))
    axes = PCA(k=k, inputCol="x", outputCol="y").fit(dense).pc.toArray().T
    peak = np.abs(axes).argmax(1)
    return axes * np.where(axes[np.arange(len(axes)), peak] < 0, -1.0, 1.0)[:, None]


def mean_vector(vectors: DataFrame, vector_col: str = "vector") -> np.ndarray:
    """Mean per position, summed per position across tasks; one number a position reaches the driver."""
    cells = vectors.select(F.posexplode(F.col(vector_col).cast("array<double>")).alias("dim", "x"))
    means = cells.groupBy("dim").agg(F.avg("x").alias("mu")).orderBy("dim").collect()
    return np.array([r["mu"] if r["mu"] is not None else np.nan for r in means])


def project(vectors: DataFrame, axes: np.ndarray, out_col: str, vector_col: str = "vector") -> DataFrame:
    """Centred coordinates on the given axes; without a whole vector (null, of other length, with a null) they are null."""
    mean = mean_vector(vectors, vector_col)
    shared = vectors.sparkSession.sparkContext.broadcast((mean, np.ascontiguousarray(axes.T)))

    @F.arrow_udf("array<double>")
    def coordinates(x: pa.Array) -> pa.Array:
        mu, columns = shared.value
        sizes = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = x.flatten()
        whole = sizes == len(mu)
        if flat.null_count:
            holes = np.bincount(np.repeat(np.arange(len(x)), sizes), flat.is_null().to_numpy(zero_copy_only=False), len(x))
            whole &= holes == 0
        values = flat.to_numpy(zero_copy_only=False)[np.repeat(whole, sizes)].reshape(int(whole.sum()), len(mu))
        found = np.zeros((len(values), columns.shape[1]))
        for dim, axis in enumerate(columns):  # summed in the order of the positions
            found += (values[:, dim] - mu[dim])[:, None] * axis
        out = np.zeros((len(x), columns.shape[1]))
        out[whole] = found
        gone = np.repeat(~whole, columns.shape[1])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * columns.shape[1]), pa.array(out.ravel(), mask=gone))

    return vectors.withColumn(out_col, coordinates(F.col(vector_col).cast("array<double>")))


def dense_profile(profile: DataFrame, support: int = 1) -> DataFrame:
    """Dense vector per entity over the feature catalogue (a few hundred columns)."""
    catalog = min_support(profile, support)
    width = scalar(catalog, F.count(F.lit(1)))
    cells = profile.join(catalog.select("kind", "feature", "feature_index"), ["kind", "feature"])
    lists = cells.groupBy("entity_id").agg(F.collect_list(F.struct(
        F.col("feature_index").cast("int").alias("i"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"))).alias("_c"))
    kind = profile.schema["entity_id"].dataType.simpleString()
    rows = lists.select("entity_id", F.col("_c.i").alias("at"), F.col("_c.s").alias("score"), width.alias("width"))
    return rows.mapInArrow(_spread, f"entity_id {kind}, vector array<double>")


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores laid out by the indices of their features, zeros elsewhere."""
    for batch in batches:
        width = batch.column("width")[0].as_py() if batch.num_rows else 0
        step = max(1, CELLS // max(1, width))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            n = part.num_rows
            row = np.repeat(np.arange(n), part.column("at").value_lengths().to_numpy(zero_copy_only=False))
            place = row * width + part.column("at").flatten().to_numpy()
            if len(np.unique(place)) < len(place):
                raise ValueError("an entity has a feature twice")
            out = np.zeros(n * width)
            out[place] = part.column("score").flatten().to_numpy()
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([part.column("entity_id"), pa.ListArray.from_arrays(ends, pa.array(out))], ["entity_id", "vector"])


def pca_scores(vectors: DataFrame, k: int = 3, out_col: str = "scores", vector_col: str = "vector") -> tuple[DataFrame, np.ndarray]:
    axes = principal_axes(vectors, k, vector_col)
    return project(vectors, axes, out_col, vector_col), axes


def color_embed(vectors: DataFrame, k: int = 3, out_col: str = "color_raw", vector_col: str = "vector") -> tuple[DataFrame, np.ndarray]:
    """Coordinates of cosine-kernel PCA: principal axes of the unit rows, without an n x n matrix."""
    unit = reliable(vectors.withColumn("_unit", V.unit(F.col(vector_col).cast("array<double>"))))
    scored, axes = pca_scores(unit, k, out_col, "_unit")
    return scored.drop("_unit"), axes


def knn_graph(rows: DataFrame, k: int = 20, metric: str = "cosine", steps: int = 40) -> DataFrame:
    """Fuzzy neighbour graph (i, j, w): distances scaled per row, then w + w' - w w'.

    Per row the nearest distance is taken off and a bandwidth is found by
    halving such that the weights sum to log2(k).
    """
    near = nb.knn_join(rows, k, metric)
    d = (1 - F.col("value")) if metric == "cosine" else F.col("value")
    edges = reliable(near.select(F.col("id").alias("i"), F.col("neighbour_id").alias("j"), F.greatest(d, F.lit(0.0)).alias("d")))
    lists = edges.groupBy("i").agg(F.collect_list("d").alias("_ds"))  # k distances per row
    lists = lists.withColumn("_rho", F.coalesce(F.array_min(F.filter("_ds", lambda v: v > 0)), F.lit(0.0)))
    target = float(np.log2(max(k, 2)))

    def halve(acc, _):
        mid = F.when(acc["hi"].isNull(), acc["lo"] * 2).otherwise((acc["lo"] + acc["hi"]) / 2)
        mass = F.aggregate("_ds", F.lit(0.0), lambda s, v: s + F.exp(-F.greatest(v - F.col("_rho"), F.lit(0.0)) / mid))
        over = mass > target
        return F.struct(F.when(over, acc["lo"]).otherwise(mid).alias("lo"), F.when(over, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(1e-3).alias("lo"), F.lit(None).cast("double").alias("hi"))
    sigma = F.aggregate(F.array_repeat(F.lit(0), steps), start, halve, lambda acc: F.coalesce((acc["lo"] + acc["hi"]) / 2, acc["lo"]))
    bands = lists.select("i", "_rho", sigma.alias("_sigma"))
    w = F.exp(-F.greatest(F.col("d") - F.col("_rho"), F.lit(0.0)) / F.greatest(F.col("_sigma"), F.lit(1e-9)))
    directed = edges.join(bands, "i").select("i", "j", w.alias("w"))
    # union of both directions by aggregation: at most two weights meet per (i, j)
    both = directed.unionByName(directed.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy("i", "j").agg((F.sum("w") - F.when(F.count("w") > 1, F.max("w") * F.min("w")).otherwise(0.0)).alias("w"))


def structural_embed(graph: DataFrame, dims: int = 12, iterations: int = 10, *, tolerance: float = 1e-3) -> DataFrame:
    """Spectral coordinates of the neighbour graph: (entity_id, embedding, residual).

    Orthogonal iteration: one sparse product per step as join + partial aggregation, a
    dims x dims factorisation on the driver, a checkpoint each step.  The trivial constant
    direction is projected out by degree weights.  It ends when the part of a step that
    leaves the subspace is within ``tolerance`` per direction, or after ``iterations``;
    ``residual`` tells how far it came.
    """
    graph = reliable(graph)
    degree = reliable(graph.groupBy("i").agg(F.sum("w").alias("_deg")))
    scaled = (graph.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("_deg").alias("_dj")), "j")
              .select("i", "j", (F.col("w") / F.sqrt(F.col("_deg") * F.col("_dj"))).alias("w")))
    scaled = reliable(scaled)
    names = [f"v{c}" for c in range(dims)]
    seed = [(F.pmod(F.xxhash64("i", F.lit(c)), F.lit(1 << 20)) / float(1 << 19) - 1.0).alias(n) for c, n in enumerate(names)]
    state = degree.select("i", F.sqrt("_deg").alias("_root"), *seed)
    state = reliable(state)
    state = reliable(_orthonormal(state, names, _gram(state, ["_root", *names])))
    residual = float("inf")
    before = [f"b{n}" for n in names]
    for _ in range(iterations):
        step = scaled.join(state.select(F.col("i").alias("j"), *names), "j").groupBy("i").agg(
            *[F.sum(F.col("w") * F.col(n)).alias(f"_{n}") for n in names])
        # (A + I) / 2 keeps the order of eigenvalues and avoids sign flips
        moved = reliable(state.join(step, "i", "left").select(
            "i", "_root", *[((F.col(n) + F.coalesce(f"_{n}", F.lit(0.0))) / 2).alias(n) for n in names], *[F.col(n).alias(b) for n, b in zip(names, before, strict=True)]))
        gram = _gram(moved, ["_root", *names, *before])
        # what the step moved out of the subspace that it began with, root mean square over the directions
        inside = gram[1:dims + 1, dims + 1:]
        residual = float(np.sqrt(max(0.0, np.trace(gram[1:dims + 1, 1:dims + 1]) - (inside ** 2).sum()) / dims))
        state = reliable(_orthonormal(moved, names, gram[:dims + 1, :dims + 1]))
        if residual <= tolerance:
            break
    n = state.count()
    return state.select(F.col("i").alias("entity_id"), F.array(*[F.col(c) * float(np.sqrt(n)) for c in names]).alias("embedding"), F.lit(residual).alias("residual"))


def _gram(state: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Products of all pairs of columns, summed over the rows: one small matrix a task."""
    def run(batches):
        total = np.zeros((len(columns), len(columns)))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns]) if batch.num_rows else np.zeros((0, len(columns)))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = state.select(*columns).mapInArrow(run, "part binary").collect()
    return np.sum([np.frombuffer(r["part"], float).reshape(len(columns), -1) for r in parts], axis=0)


def _orthonormal(state: DataFrame, names: Sequence[str], gram: np.ndarray) -> DataFrame:
    """Orthonormal columns, free of the trivial direction, from the Gram matrix of ``_root`` and the columns."""
    every = ["_root", *names]
    gram = gram + np.eye(len(every)) * 1e-12 * max(1.0, np.trace(gram))
    inverse = np.linalg.inv(np.linalg.cholesky(gram)).T  # columns: combinations that are orthonormal
    out = []
    for c, name in enumerate(names, 1):
        out.append(sum((F.col(every[r]) * float(inverse[r, c]) for r in range(c + 1)), F.lit(0.0)).alias(name))
    return state.select("i", "_root", *out)


def pca_embed(vectors: DataFrame, dims: int = 12, vector_col: str = "vector") -> DataFrame:
    """The cheap structural embedding: principal coordinates of the weighted rows."""
    return pca_scores(vectors, dims, "embedding", vector_col)[0]
