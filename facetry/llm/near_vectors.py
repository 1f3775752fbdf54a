"""Near copies among vectors by a pigeonhole join of rotated blocks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import stored
from facetry.llm.components import components

#: Coordinates of a block.
BLOCK_WIDTH = 8
#: Rows of a cell that are looked at together; larger cells are cut into chunks.
CHUNK = 32_768
#: Rows of a tile of distances.
TILE = 128
#: A cell is so many radii wide in each of its coordinates.
CELL_RADII = 4
#: Room for rounding when block distances are compared with the budget in single precision.
SLACK = 1e-5
CELLS = "block int, cell long, home boolean, key long, weight long, vector binary"


def rotation(size: int) -> np.ndarray:
    """The same random rotation for every call: it spreads distances evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def blocks_of(size: int) -> list[slice]:
    """Coordinates of the blocks, near ``BLOCK_WIDTH`` each."""
    n = max(1, round(size / BLOCK_WIDTH))
    edges = [i * size // n for i in range(n + 1)]
    return [slice(a, b) for a, b in itertools.pairwise(edges)]


def budget(cosine: float, width: int, size: int) -> float:
    """Greatest squared distance of a block: unit vectors with this cosine differ by 2 - 2 cos in total."""
    return (2 - 2 * cosine) * width / size


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in the batch; zero vectors are left out."""
    lists = batch.column("embedding")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        rows = np.nonzero(sizes == size)[0]
        matrix = flat[(ends[rows] - size)[:, None] + np.arange(size)]
        good = (matrix != 0).any(axis=1)
        if good.any():
            yield rows[good], matrix[good]


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; first by the largest component, so no square overflows or vanishes."""
    x = matrix.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            for rows, matrix in _vectors(batch):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("vec_id").take(at), pa.array([m.tobytes() for m in matrix], pa.binary())], ["key", "vec_id", "vector"])


def _cell_name(size: int, block: int, place: np.ndarray) -> np.ndarray:
    name = np.full(len(place), size * 1_000_003 + block, np.uint64)
    for column in place.T:
        name = (name ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def _placed(cosine: float, coordinates: int, kind: str, whole: bool):
    """Each vector at home in one cell of each block, and as a guest of the cells after its own that it may have a partner in; only the cells unless ``whole``."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, weight = batch.column("key").to_numpy(), batch.column("weight").to_numpy()
            raw = batch.column("vector")
            sizes = pc.binary_length(raw).to_numpy() // np.dtype(kind).itemsize
            for size in np.unique(sizes).tolist():
                rows = np.nonzero(sizes == size)[0]
                own = raw.take(pa.array(rows))
                x = unit(np.frombuffer(b"".join(own.to_pylist()), kind).reshape(-1, size)) @ rotation(size)
                for b, part in enumerate(blocks_of(size)):
                    width = part.stop - part.start
                    radius = math.sqrt(budget(cosine, width, size)) + SLACK
                    cell = max(radius * CELL_RADII, 1e-9)
                    g = min(coordinates, width)
                    scaled = x[:, part][:, :g] / cell
                    place = np.floor(scaled).astype(np.int64)
                    inside, reach = scaled - place, radius / cell
                    near = {-1: inside <= reach, 0: np.ones_like(inside, bool), 1: inside >= 1 - reach}
                    for step in itertools.product((-1, 0, 1), repeat=g):
                        if step < (0,) * g:
                            continue
                        there = np.logical_and.reduce([near[s][:, i] for i, s in enumerate(step)])
                        if there.any():
                            at = np.nonzero(there)[0]
                            columns = [pa.array(np.full(len(at), b, np.int32)), pa.array(_cell_name(size, b, place[at] + np.array(step)))]
                            if whole:
                                columns += [pa.array(np.full(len(at), not any(step))), pa.array(key[rows[at]]), pa.array(weight[rows[at]]), own.take(pa.array(at))]
                            yield pa.RecordBatch.from_arrays(columns, ["block", "cell", "home", "key", "weight", "vector"][:len(columns)])
    return run


class _Side:
    """Vectors of one chunk in the order of one of the block's coordinates, ``along``, with all of them in single precision."""

    def __init__(self, key, weight, x, rotated, part):
        own = rotated[:, part]
        by = np.argsort(own[:, -1], kind="stable")
        self.key, self.weight, self.x = key[by], weight[by], x[by]
        self.along = own[by, -1]
        part = own[by].astype(np.float32)
        square, one = np.einsum("ij,ij->i", part, part)[:, None], np.ones((len(part), 1), np.float32)
        #: the product of a row of one with a row of the other is their squared distance
        self.left, self.right = np.hstack((part, square, one)), np.hstack((-2 * part, one, square))


def _close(a: _Side, b: _Side, limit: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the block's budget, a tile at a time; a tile meets what lies within the radius along the order."""
    reach = math.sqrt(limit) + SLACK
    for at in range(0, len(a.key), TILE):
        end = min(at + TILE, len(a.key))
        low = at if same else int(np.searchsorted(b.along, a.along[at] - reach))
        high = int(np.searchsorted(b.along, a.along[end - 1] + reach, "right"))
        if low >= high:
            continue
        far = a.left[at:end] @ b.right[low:high].T
        i, j = np.divmod(np.flatnonzero(far <= limit), high - low)
        i, j = i + at, j + low
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 100_000):
            yield i[k:k + 100_000], j[k:k + 100_000]


def _joined(cosine: float, kind: str, block: int, first: list, second: list | None):
    """Links of one pair of chunks: (key, links) sums and star edges of what is connected."""
    def loaded(rows):
        key, weight, home, vector = rows
        x = unit(np.frombuffer(b"".join(vector), kind).reshape(-1, size))
        rotated = x @ turn
        pick = lambda m: _Side(key[m], weight[m], x[m], rotated[m], parts[block])
        return pick(home), pick(~home)

    size = len(first[3][0]) // np.dtype(kind).itemsize
    turn, parts = rotation(size), blocks_of(size)
    limit = budget(cosine, parts[block].stop - parts[block].start, size) + SLACK
    home, guest = loaded(first)
    if second is None:
        meets = [(home, home, True), (home, guest, False)]
    else:
        home2, guest2 = loaded(second)
        meets = [(home, home2, False), (home, guest2, False), (home2, guest, False)]
    for a, b, same in meets:
        if not len(a.key) or not len(b.key):
            continue
        total_a, total_b = np.zeros(len(a.key), np.int64), np.zeros(len(b.key), np.int64)
        label_a, label_b = np.arange(len(a.key)), np.arange(len(b.key)) + (0 if same else len(a.key))
        parent = np.arange(len(a.key) + (0 if same else len(b.key)))
        for i, j in _close(a, b, limit, same):
            left, right = a.x[i], b.x[j]
            good = np.einsum("ij,ij->i", left, right) >= cosine
            i, j, left, right = i[good], j[good], left[good], right[good]
            # a pair counts in the block where it is closest, so in one task only
            swap = a.key[i] > b.key[j]
            gap = np.where(swap[:, None], right - left, left - right)
            turned = np.einsum("ij,jk->ik", gap, turn)
            gaps = np.stack([np.einsum("ij,ij->i", turned[:, p], turned[:, p]) / (p.stop - p.start) for p in parts])
            mine = gaps.argmin(axis=0) == block
            i, j = i[mine], j[mine]
            np.add.at(total_a, i, b.weight[j])
            np.add.at(total_a if same else total_b, j, a.weight[i])
            _hang(parent, label_a[i], label_b[j])
        if same:
            names, total = a.key, total_a
        else:
            names, total = np.concatenate((a.key, b.key)), np.concatenate((total_a, total_b))
        at = np.nonzero(total)[0]
        if len(at):
            yield names[at], total[at], names[_roots(parent)[at]]


def _roots(parent: np.ndarray) -> np.ndarray:
    while (parent != (up := parent[parent])).any():
        parent[:] = up
    return parent


def _hang(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j by hanging greater roots on lesser ones until the pairs agree."""
    while len(i):
        _roots(parent)
        a, b = parent[i], parent[j]
        open_ = a != b
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _cells(cosine: float, kind: str):
    """Rows sorted by block, cell and pair of chunks; one pair is held at a time."""
    def emit(at, held):
        rows = pa.Table.from_batches(held)
        key, weight, home, is_one = (rows.column(c).to_numpy() for c in ("key", "weight", "home", "is_one"))
        alone = at[2] == at[3]
        if not is_one.any() or not (alone or not is_one.all()):
            return
        vector = rows.column("vector")
        side = lambda m: (key[m], weight[m], home[m], vector.filter(pa.array(m)).to_pylist())
        for names, total, root in _joined(cosine, kind, at[0], side(is_one), None if alone else side(~is_one)):
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(root)], ["key", "links", "root"])

    def run(batches):
        at, held, count = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "cell", "one", "two")])
            cuts = [0, *(np.nonzero((names[:, 1:] != names[:, :-1]).any(axis=0))[0] + 1).tolist(), batch.num_rows]
            for low, high in itertools.pairwise(cuts):
                now = tuple(names[:, low].tolist())
                if now != at:
                    if count > 1:
                        yield from emit(at, held)
                    at, held, count = now, [], 0
                held.append(batch.slice(low, high - low))
                count += high - low
        if count > 1:
            yield from emit(at, held)
    return run


def near_vectors(table: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``table`` (vec_id, embedding).

    Vectors of unit length with cosine c or more differ by 2 - 2c in squared distance.
    After a rotation their coordinates are cut into blocks of about 8; by the pigeonhole
    principle some block of a linked pair differs by its proportional share or less.  Each
    block is range-joined on a grid: a vector is at home in one cell and a guest of the
    cells behind its own that lie within the radius.  What is within a block's budget is
    verified on the whole vectors in double precision, and counts in the block where the
    pair is closest, so no pair is counted twice or moved.  A task returns sums of links
    and star edges, never pairs.

    Equal vectors are joined once with their number as weight.  Cells of more than 32,768
    rows are cut into chunks that meet two by two.  In many even dimensions a block prunes
    little and work stays quadratic with a small constant; the grid gets more coordinates
    as rows grow.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different lengths are not compared.  Repeated ids are rows of their
    own; a null id names no component.  Other columns are not read; an empty table gives no rows.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    double = table.schema["embedding"].dataType.simpleString() == "array<double>"
    kind = "float64" if double else "float32"
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>" if double else "array<float>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("key", F.when(F.col("embedding").isNotNull() & ~bad, F.xxhash64("embedding")))
    valid = rows.where("key IS NOT NULL").select("key", "vec_id", "embedding").mapInArrow(_valid, "key long, vec_id long, vector binary")
    distinct = stored(valid.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")), "near-vectors")
    coordinates = min(BLOCK_WIDTH, max(2, math.ceil(math.log2(max(1, distinct.count() / CHUNK)))))
    vectors = distinct.select("key", "weight", "vector")
    placed = vectors.mapInArrow(_placed(cosine, coordinates, kind, True), CELLS)
    sizes = vectors.mapInArrow(_placed(cosine, coordinates, kind, False), "block int, cell long").groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > CHUNK).select("block", "cell", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "near-cells")
    chunked = placed.join(large, ["block", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    # a chunk meets itself and every other one: as the first of the pair or the second
    meets = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "block", "cell", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), (F.col("chunk") <= F.col("other")).alias("is_one"),
        "key", "weight", "home", "vector")
    pairs = ["block", "cell", "one", "two"]
    found = stored(meets.repartition(*pairs).sortWithinPartitions(*pairs).mapInArrow(_cells(cosine, kind), "key long, links long, root long"), "near-links")
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("v"), F.col("root").alias("u")), "near-roots")
    named = distinct.select("key", "weight", "least").join(linked, "key", "left").join(roots.select(F.col("v").alias("key"), "root"), "key", "left").where("weight > 1 OR links IS NOT NULL")
    named = stored(named.select("key", "least", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")), "near-named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = named.join(ids, "root").select("key", "n_links", "component_id")
    out = rows.select("vec_id", "key").join(grouped, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
