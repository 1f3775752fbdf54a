"""k-means with all restarts in the same passes over the rows.

Vectors are packed into matrices once.  A pass multiplies them with the centres of every
restart that still moves and returns one small table of sums a task; the driver holds
restarts x k centres, whatever the number of rows.  Centres are chosen as k-means++ does:
one pass a centre draws the next one of all restarts in proportion to the squared distance
from the centres so far, by exponential keys, so the draw is exact and needs no second pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.runtime import reliable

#: Rows of a packed matrix.
PACK = 4096
#: Centres that are multiplied with a packed matrix at once.
COLUMNS = 256
#: Partial results that go to the driver as they are; more are added up in tasks first.
DIRECT = 64


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            part = batch.slice(at, PACK)
            keys = part.column("key").to_numpy()
            flat = part.column("x").flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], ["keys", "matrix"])


def uniform(key: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1) for each key, other ones for each seed and step."""
    x = key.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (step + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)


def gaps(x: np.ndarray, centres: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Squared distances of all rows to all centres; ``own``: the rows' squares, taken once for all restarts."""
    own = squares(x) if own is None else own
    return np.maximum(own[:, None] + (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T), 0.0)


def drawn(key: np.ndarray, x: np.ndarray, centres: np.ndarray, seed: int, step: int, own: np.ndarray | None = None,
          far: np.ndarray | None = None) -> tuple[float, np.ndarray] | None:
    """(draw, row) of the best row: the greatest draw of all rows is the next centre.  None where every row is a centre."""
    own = squares(x) if own is None else own
    if far is None and len(centres):
        far = gaps(x, centres, own).min(1)
    weight = np.ones(len(x)) if far is None else far
    weight[weight <= 1e-12 * max(1.0, float(own.max(initial=0.0)))] = 0.0
    if not weight.any():
        return None
    with np.errstate(divide="ignore"):
        draw = np.where(weight > 0, np.log(uniform(key, seed, step)) / weight, -np.inf)
    at = int(draw.argmax())
    return float(draw[at]), x[at]


def together(x: np.ndarray, centres: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(centres, squared distances as restarts x k x rows) of some restarts at once: one product for up to COLUMNS centres."""
    k, width = centres.shape[1:]
    some = max(1, COLUMNS // max(1, k))
    for at in range(0, len(centres), some):
        part = centres[at:at + some]
        flat = part.reshape(-1, width)
        yield part, np.maximum(own[None, :] + (flat * flat).sum(1)[:, None] - 2 * (flat @ x.T), 0.0).reshape(len(part), k, len(x))


def sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Per restart and centre: sum and number of its rows and their squared distances, restarts x k x (d + 2)."""
    found = []
    for part, far in together(x, centres, squares(x)):
        restarts, k, width = part.shape
        label = far.argmin(1)
        one = np.zeros((restarts, k, len(x)))
        np.put_along_axis(one, label[:, None, :], 1.0, axis=1)
        near = far.min(1)
        cost = np.stack([np.bincount(c, n, k) for c, n in zip(label, near, strict=True)])
        total = (one.reshape(-1, len(x)) @ x).reshape(restarts, k, width)
        found.append(np.concatenate((total, one.sum(2)[:, :, None], cost[:, :, None]), axis=2))
    return np.concatenate(found)


def _each(work: Callable[[np.ndarray, np.ndarray], bytes | None], width: int, join: Callable[[list[bytes]], bytes]):
    """One result a task over its packed matrices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for keys, matrix in zip(batch.column("keys").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
                got.append(work(np.frombuffer(keys, np.int64), np.frombuffer(matrix, float).reshape(-1, width)))
                if len(got) > 16:
                    got = [join(got)]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([join(got)], pa.binary())], ["part"])
    return run


def _pass(packed: DataFrame, work, width: int, join) -> bytes | None:
    """``work`` over all rows, its results joined in tasks and at the end on the driver."""
    parts = packed.mapInArrow(_each(work, width, join), "part binary")
    count = packed.rdd.getNumPartitions()
    if count > DIRECT:
        def joined(batches):
            got = [p for batch in batches for p in batch.column("part").to_pylist()]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([join(got)], pa.binary())], ["part"])
        parts = parts.repartition(max(1, int(count ** 0.5))).mapInArrow(joined, "part binary")
    got = [r["part"] for r in parts.collect()]
    return join(got) if got else None


def _first_centres(packed: DataFrame, k: int, seeds: list[int], width: int) -> np.ndarray:
    """restarts x k x d centres by k-means++; where fewer rows differ the last centre is repeated."""
    centres = np.zeros((len(seeds), 0, width))
    for step in range(k):
        now = centres

        def work(key, x):
            own = squares(x)
            far = np.concatenate([gap.min(1) for _, gap in together(x, now, own)]) if step else [None] * len(seeds)
            rows = [drawn(key, x, now[r], seed, step, own, far[r]) for r, seed in enumerate(seeds)]
            return np.stack([np.concatenate(([d[0]], d[1])) if d else np.concatenate(([-np.inf], np.zeros(width))) for d in rows]).tobytes()

        def join(parts):
            every = np.stack([np.frombuffer(p, float).reshape(len(seeds), width + 1) for p in parts])
            return every[every[:, :, 0].argmax(0), np.arange(len(seeds))].tobytes()

        best = np.frombuffer(_pass(packed, work, width, join), float).reshape(len(seeds), width + 1)
        new = np.where(np.isfinite(best[:, :1]) | (step == 0), best[:, 1:], centres[:, -1] if step else best[:, 1:])
        centres = np.concatenate((centres, new[:, None, :]), axis=1)
    return centres


def moved(centres: np.ndarray, found: np.ndarray) -> np.ndarray:
    """New centres from sums; a centre without rows stays."""
    count = found[:, -2:-1]
    return np.where(count > 0, found[:, :-2] / np.maximum(count, 1), centres)


def best_centres(vectors: DataFrame, k: int, seed: int, restarts: int, rounds: int, tolerance: float, vector_col: str) -> np.ndarray | None:
    """Centres of the restart with the least cost (ties: the first one); None without rows."""
    x = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.xxhash64(F.col("entity_id").cast("string")).alias("key"), x.alias("x"))
    packed = reliable(rows.mapInArrow(_pack, "keys binary, matrix binary"))
    first = rows.select(F.size("x").alias("n")).head()
    if first is None or not first["n"]:
        return None
    width = first["n"]
    add = lambda parts: np.sum([np.frombuffer(p, float) for p in parts], axis=0).tobytes()
    centres = _first_centres(packed, k, [seed + r for r in range(restarts)], width)
    moving = list(range(restarts))
    for _ in range(rounds):
        now = centres[moving]
        found = np.frombuffer(_pass(packed, lambda key, x: sums(x, now).tobytes(), width, add), float).reshape(len(moving), k, width + 2)
        still = []
        for r, f in zip(moving, found, strict=True):
            new = moved(centres[r], f)
            if ((new - centres[r]) ** 2).sum(1).max() > tolerance ** 2:
                still.append(r)
            centres[r] = new
        moving = still
        if not moving:
            break

    def costs(key, x):
        return np.concatenate([gap.min(1).sum(1) for _, gap in together(x, centres, squares(x))]).tobytes()

    cost = np.frombuffer(_pass(packed, costs, width, add), float)
    return centres[int(cost.argmin())]


def nearest_centre(vectors: DataFrame, centres: np.ndarray | None, name: str, vector_col: str) -> DataFrame:
    """Adds the number of the nearest centre (ties: the first one); null for a null vector."""
    if centres is None:
        return vectors.withColumn(name, F.lit(None).cast("int"))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    rows = vectors.withColumn("_x", F.col(vector_col).cast("array<double>"))

    @F.pandas_udf("int")
    def label(x):
        out = np.full(len(x), -1, np.int32)
        held = x.notna().to_numpy()
        if held.any():
            out[held] = gaps(np.stack(x[held].to_numpy()), shared.value).argmin(1)
        import pandas as pd
        return pd.Series(out)

    return rows.withColumn(name, F.nullif(label("_x"), F.lit(-1))).drop("_x")
