"""Spanning tree of the mutual reachability graph; density clusters for any radius are cuts of it.

Each block pair within the radius reports the least spanning forest of its own pairs: by the
cycle property an edge that is the longest of a cycle there is in no least spanning forest of
the whole graph.  What is left is linear in the rows, and Boruvka rounds over it keep the
edges of the whole forest: every part takes its shortest edge to another part, and parts so
joined become one.  Edges are ordered by weight and ends, so there are no ties.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators import cluster
from facetry.operators import neighbours as nb
from facetry.operators.cluster import connected_components, core_distance
from facetry.runtime import reliable


def least_forest(i: np.ndarray, j: np.ndarray, rank: np.ndarray, nodes: int) -> np.ndarray:
    """Places of the edges of the least spanning forest; ``rank`` orders the edges without ties."""
    label = np.arange(nodes)
    alive = np.arange(len(i))
    chosen = []
    while len(alive):
        a, b = label[i[alive]], label[j[alive]]
        outer = a != b
        alive, a, b = alive[outer], a[outer], b[outer]
        if not len(alive):
            break
        best = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(best, a, rank[alive])
        np.minimum.at(best, b, rank[alive])
        mine = (best[a] == rank[alive]) | (best[b] == rank[alive])
        chosen.append(alive[mine])
        parent = np.arange(nodes)
        left, right = a[mine], b[mine]
        # each part hangs on the part its shortest edge leads to; of two that chose each other the lesser is the root
        own = best[left] == rank[alive[mine]]
        parent[left[own]] = right[own]
        own = best[right] == rank[alive[mine]]
        parent[right[own]] = left[own]
        both = parent[parent] == np.arange(nodes)
        root = both & (np.arange(nodes) < parent)
        parent[root] = np.nonzero(root)[0]
        while (parent != parent[parent]).any():
            parent = parent[parent]
        label = parent[label]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _block_forest(a, b, i, j, value):
    """(id, neighbour_id, reach) of the least forest of one block pair; the tag of a row is its core distance."""
    core = [np.array([float(t[0]) for t in s.tags]) for s in (a, b)]
    reach = np.maximum(value, np.maximum(core[0][i], core[1][j]))
    names, number = np.unique(np.concatenate((a.ids, b.ids)), return_inverse=True)
    x, y = number[:len(a.ids)][i], number[len(a.ids):][j]
    low, high = np.minimum(x, y), np.maximum(x, y)
    rank = np.empty(len(low), np.int64)
    rank[np.lexsort((high, low, reach))] = np.arange(len(low))
    kept = least_forest(low, high, rank, len(names))
    return names[low[kept]], names[high[kept]], reach[kept]


def close_edges(rows: DataFrame, core: DataFrame, eps: float) -> DataFrame:
    """Edges up to ``eps`` that hold every part of the reachability graph together at every lesser radius as well."""
    dense = rows.drop("tags").join(core.where(F.col("core") <= eps).select("id", F.array(F.col("core").cast("string")).alias("tags")), "id")
    kind = rows.schema["id"].dataType.simpleString()
    return nb.radius_reduce(dense, eps, f"id {kind},neighbour_id {kind},reach double", _block_forest, metric="euclidean").distinct()


def least_tree(edges: DataFrame) -> DataFrame:
    """Least spanning forest of an edge table (id, neighbour_id, reach), id < neighbour_id, by rounds over the whole table."""
    weight = F.struct("reach", "id", "neighbour_id")
    left = reliable(edges.select(weight.alias("e"), F.col("id").alias("a"), F.col("neighbour_id").alias("b")))
    taken = None
    while rest := left.count():
        if rest <= cluster.FEW_EDGES:
            last = _few_forest(left)
            return reliable((last if taken is None else taken.select("e.id", "e.neighbour_id", "e.reach").unionByName(last)))
        both = left.select("e", "a", "b").unionByName(left.select("e", F.col("b").alias("a"), F.col("a").alias("b")))
        best = reliable(both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.e").alias("e"), F.col("m.b").alias("b")))
        new = best.select("e").distinct()
        taken = new if taken is None else taken.unionByName(new)
        back = best.select(F.col("a").alias("b"), F.col("b").alias("_back"))
        # of two parts that chose each other the lesser is the root
        parent = reliable(best.join(back, "b", "left").select(
            "a", F.when((F.col("_back") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("p")))
        parent = _jumped(parent)
        up = lambda c: parent.select(F.col("a").alias(c), F.col("p").alias(f"_{c}"))
        moved = left.join(up("a"), "a").join(up("b"), "b").select("e", F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b")
        # of the edges between two parts the shortest is enough
        left = reliable(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e")).select("e", "a", "b"))
    if taken is None:
        return edges.limit(0)
    return reliable(taken.select("e.id", "e.neighbour_id", "e.reach"))


def _few_forest(left: DataFrame) -> DataFrame:
    """Least forest of the at most FEW_EDGES edges (e, a, b) that are left between parts, in one task."""
    kind = left.schema["e"].dataType["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        pdf = pd.concat(held, ignore_index=True) if held else None
        if pdf is None or not len(pdf):
            return
        n = len(pdf)
        _, ends = np.unique(np.concatenate((pdf["id"].to_numpy(), pdf["neighbour_id"].to_numpy())), return_inverse=True)
        names, parts = np.unique(np.concatenate((pdf["a"].to_numpy(), pdf["b"].to_numpy())), return_inverse=True)
        rank = np.empty(n, np.int64)
        rank[np.lexsort((ends[n:], ends[:n], pdf["reach"].to_numpy()))] = np.arange(n)
        kept = least_forest(parts[:n], parts[n:], rank, len(names))
        yield pdf.iloc[kept][["id", "neighbour_id", "reach"]]

    return left.select("e.id", "e.neighbour_id", "e.reach", "a", "b").coalesce(1).mapInPandas(run, f"id {kind}, neighbour_id {kind}, reach double")


def _jumped(parent: DataFrame) -> DataFrame:
    """Every part's root, by looking up the parent's parent until nothing changes."""
    while True:
        grand = parent.select(F.col("a").alias("p"), F.col("p").alias("_g"))
        new = reliable(parent.join(grand, "p").select("a", "p", "_g"))
        if not new.where("p <> _g").head(1):
            return parent
        parent = new.select("a", F.col("_g").alias("p"))


def reach_tree(rows: DataFrame, eps: float, min_samples: int = 5, core: DataFrame | None = None) -> DataFrame:
    """Least spanning forest of the mutual reachability graph up to ``eps``: (id, neighbour_id, reach)."""
    rows = reliable(rows)
    core = reliable(core_distance(rows, max(1, min_samples)) if core is None else core)
    return least_tree(close_edges(rows, core, eps))


def tree_cuts(tree: DataFrame, core: DataFrame, settings: Sequence[tuple[float, int]]) -> DataFrame:
    """(setting, id, component) of the dense rows at every setting (eps, least cluster size), all in the same rounds.

    Small components are left out.  A setting's rows never meet another's: its number is part of the node.
    """
    spark = tree.sparkSession
    cut = F.broadcast(spark.createDataFrame([(n, float(eps), int(size)) for n, (eps, size) in enumerate(settings)], "setting int, eps double, size int"))  # one row a setting
    node = lambda c: F.struct(F.col("setting"), F.col(c).alias("id"))
    nodes = core.join(cut, F.col("core") <= F.col("eps")).select(node("id").alias("id"), "size")
    edges = tree.join(cut, F.col("reach") <= F.col("eps")).select(node("id").alias("id"), node("neighbour_id").alias("neighbour_id"))
    parts = reliable(connected_components(nodes, edges))
    big = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(cut.select(F.col("setting").alias("_s"), "size"), F.col("component.setting") == F.col("_s")).where("n >= size")
    return parts.join(big.select("component"), "component", "left_semi").select("id.setting", "id.id", F.col("component.id").alias("component"))
