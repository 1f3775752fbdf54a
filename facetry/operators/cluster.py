"""Clusters: k-means, density clusters as connected components, summaries and quality."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetry.operators import lloyd
from facetry.operators import neighbours as nb
from facetry.operators.ordering import with_position
from facetry.runtime import reliable

#: Edges that one task joins to components at once (some 50 MB); more go through rounds over the whole table.
FEW_EDGES = 1 << 18


def kmeans(vectors: DataFrame, k: int = 8, seed: int = 42, restarts: int = 10, vector_col: str = "vector", rounds: int = 20,
           tolerance: float = 1e-4) -> DataFrame:
    """Best of several seeded runs by their cost: adds ``label`` (larger clusters first; -1 for a null vector).

    All runs share each pass over the rows (see ``lloyd``): k passes for the first centres,
    at most ``rounds`` for the moves and one for the costs, however many restarts there are.
    """
    centres = lloyd.best_centres(vectors, k, seed, restarts, rounds, tolerance, vector_col)
    return _ordered_labels(reliable(lloyd.nearest_centre(vectors, centres, "_p", vector_col)), "_p")


def _ordered_labels(rows: DataFrame, raw: str) -> DataFrame:
    """Replace raw labels by 0.. in order of size, then smallest entity; null stays -1.

    Clusters are numbered by a range sort, as their number may grow with the rows; noise takes no part in the join.
    """
    marked = rows.where(F.col(raw).isNotNull())
    sizes = marked.groupBy(raw).agg(F.count(F.lit(1)).alias("_n"), F.min("entity_id").alias("_first"))
    ranked = with_position(sizes, F.desc("_n"), F.col("_first"), name="label").select(raw, F.col("label").cast("int").alias("label"))
    noise = rows.where(F.col(raw).isNull()).withColumn("label", F.lit(-1)).drop(raw)
    return marked.join(ranked, raw).drop(raw).unionByName(noise)


def core_distance(rows: DataFrame, min_samples: int = 5) -> DataFrame:
    """Distance to the min_samples-th neighbour (to the last one when there are fewer): (id, core)."""
    near = nb.knn_join(rows, max(1, min_samples), "euclidean")
    return near.groupBy("id").agg(F.max("value").alias("core"))


def mutual_reachability(rows: DataFrame, min_samples: int = 5) -> DataFrame:
    """Neighbour edges with weight max(core_i, core_j, d_ij): (i, j, d, reach)."""
    near = reliable(nb.knn_join(rows, max(1, min_samples), "euclidean"))
    core = near.groupBy("id").agg(F.max("value").alias("core"))
    return (near.join(core, "id").join(core.select(F.col("id").alias("neighbour_id"), F.col("core").alias("_cj")), "neighbour_id")
            .select(F.col("id").alias("i"), F.col("neighbour_id").alias("j"), F.col("value").alias("d"),
                    F.greatest("core", "_cj", "value").alias("reach")))


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Smallest reachable id per node: (id, component).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): the
    edges shrink towards stars in a logarithmic number of rounds, each a partial
    ``min`` aggregation and a join; every round is checkpointed.
    """
    edges = reliable(edges.select("id", "neighbour_id").where(F.col("id") != F.col("neighbour_id")).distinct())
    if edges.count() <= FEW_EDGES:
        return _rooted(nodes, reliable(_few_components(edges)))
    signature = None
    for _ in range(max_rounds):
        edges = reliable(_small_star(_large_star(edges)))
        stats = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "neighbour_id").cast("decimal(38,0)"))).head()
        if tuple(stats) == signature:
            break
        signature = tuple(stats)
    else:
        raise RuntimeError("connected components did not settle")
    return _rooted(nodes, edges)


def _rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    root = edges.groupBy("id").agg(F.min("neighbour_id").alias("_root"))
    return nodes.select("id").distinct().join(root, "id", "left").select("id", F.least("id", F.coalesce("_root", "id")).alias("component"))


def _few_components(edges: DataFrame) -> DataFrame:
    """Every node of at most FEW_EDGES edges with the smallest node it reaches, in one task."""
    columns = edges.schema["id"].dataType
    struct = columns.names if isinstance(columns, T.StructType) else None
    flat = [F.col(f"{side}.{name}") for side in ("id", "neighbour_id") for name in struct] if struct else [F.col("id"), F.col("neighbour_id")]
    fields = columns.fields if struct else [T.StructField("id", columns)]
    width = len(fields)
    schema = T.StructType([T.StructField(f"{side}{n}", f.dataType) for side in ("u", "v") for n, f in enumerate(fields)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def find(v):
            parent.setdefault(v, v)
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                u, v = find(tuple(row[:width])), find(tuple(row[width:]))
                if u != v:
                    parent[max(u, v)] = min(u, v)  # the root stays the smallest
        if parent:
            yield pd.DataFrame([v + find(v) for v in list(parent)], columns=schema.names)

    numbered = [c.alias(n) for c, n in zip(flat, schema.names, strict=True)]
    found = edges.select(*numbered).coalesce(1).mapInPandas(run, schema)
    back = lambda side: F.struct(*[F.col(f"{side}{n}").alias(f.name) for n, f in enumerate(fields)]) if struct else F.col(f"{side}0")
    return found.select(back("u").alias("id"), back("v").alias("neighbour_id"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("neighbour_id").alias("id"), F.col("id").alias("neighbour_id")))
    low = both.groupBy("id").agg(F.min("neighbour_id").alias("_m")).select("id", F.least("id", "_m").alias("_m"))
    return both.where(F.col("neighbour_id") > F.col("id")).join(low, "id").select(
        F.col("neighbour_id").alias("id"), F.col("_m").alias("neighbour_id")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("id", "neighbour_id").alias("id"), F.least("id", "neighbour_id").alias("neighbour_id"))
    low = down.groupBy("id").agg(F.min("neighbour_id").alias("_m"))
    moved = down.join(low, "id").where(F.col("neighbour_id") != F.col("_m")).select(
        F.col("neighbour_id").alias("id"), F.col("_m").alias("neighbour_id"))
    return moved.unionByName(low.select("id", F.col("_m").alias("neighbour_id"))).distinct()


def density_clusters(rows: DataFrame, eps: float, min_cluster_size: int = 5, min_samples: int = 5,
                     core: DataFrame | None = None) -> DataFrame:
    """Components of points whose core distances and gap are within eps: (entity_id, label).

    Small components and sparse points are noise (-1).  Each block pair reports
    only a spanning forest of its close pairs, so dense regions stay linear.
    Sizes are held to 2 <= size <= n, samples to at least 1.
    """
    rows = reliable(rows)
    total = rows.count()
    min_cluster_size = min(max(2, min_cluster_size), max(total, 1))
    min_samples = max(1, min_samples)
    core = core_distance(rows, min_samples) if core is None else core
    dense = reliable(rows.join(core.where(F.col("core") <= eps).select("id"), "id", "left_semi"))
    if not dense.head(1):
        return rows.select(F.col("id").alias("entity_id"), F.lit(-1).alias("label"))

    def forest(a, b, i, j, value):
        kept = nb.spanning_forest(a.ids[i], b.ids[j])
        return a.ids[i][kept], b.ids[j][kept]

    id_type = rows.schema["id"].dataType.simpleString()
    edges = nb.radius_reduce(dense, eps, f"id {id_type},neighbour_id {id_type}", forest, metric="euclidean")
    parts = reliable(connected_components(dense, edges))
    big = parts.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cluster_size)
    kept = parts.join(big.select("component"), "component", "left_semi")
    labelled = rows.select("id").join(kept, "id", "left").withColumnRenamed("id", "entity_id")
    return _ordered_labels(labelled, "component").select("entity_id", "label")


def density_sweep(rows: DataFrame, grid: Sequence[tuple[float, int, int]]) -> DataFrame:
    """Clusters and noise of ``density_clusters`` for each (eps, min_cluster_size, min_samples).

    Settings with the same ``min_samples`` are cuts of one spanning tree (see ``tree``) and
    share all rounds, so further radii cost no further passes over the rows.  One summary
    row per setting; a setting that fails gives a row with its error.
    """
    from facetry.operators import tree

    rows = reliable(rows)
    spark = rows.sparkSession
    total = rows.count()
    schema = "eps double, min_cluster_size int, min_samples int, clusters bigint, noise_ratio double, error string"
    out = [spark.createDataFrame([(float(e), s, m, None, None, "eps must not be negative") for e, s, m in grid if e < 0], schema)]
    for samples in sorted({m for e, _, m in grid if e >= 0}):
        mine = [(float(e), s) for e, s, m in grid if m == samples and e >= 0]
        try:
            core = reliable(core_distance(rows, max(1, samples)))
            edges = tree.reach_tree(rows, max(e for e, _ in mine), samples, core)
            held = [(e, min(max(2, s), max(total, 1))) for e, s in mine]
            found = reliable(tree.tree_cuts(edges, core, held).groupBy("setting").agg(F.countDistinct("component").alias("clusters"), F.count(F.lit(1)).alias("n")))
            names = spark.createDataFrame([(n, e, s, samples) for n, (e, s) in enumerate(mine)], "setting int, eps double, min_cluster_size int, min_samples int")
            out.append(names.join(found, "setting", "left").select(
                "eps", "min_cluster_size", "min_samples", F.coalesce("clusters", F.lit(0)).cast("bigint").alias("clusters"),
                F.try_divide(F.lit(total) - F.coalesce("n", F.lit(0)), F.lit(total)).alias("noise_ratio"), F.lit(None).cast("string").alias("error")))
        except Exception as problem:  # noqa: BLE001 - the sweep reports failures as rows
            out.append(spark.createDataFrame([(e, s, samples, None, None, str(problem)) for e, s in mine], schema))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def label_stats(labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    noise = F.sum(F.when(F.col("label") == -1, F.col("_n")).otherwise(0))
    return sizes.agg(F.count_if(F.col("label") != -1).alias("clusters"), F.sum("_n").alias("entities"),
                     F.try_divide(noise, F.sum("_n")).alias("noise_ratio"))


def silhouette(labelled: DataFrame, vector_col: str = "vector", label_col: str = "label", metric: str = "squaredEuclidean") -> DataFrame:
    """Mean silhouette over clustered rows (noise left out) as a one-row table."""
    rows = labelled.where(F.col(label_col) >= 0).select(
        array_to_vector(F.col(vector_col).cast("array<double>")).alias("x"), F.col(label_col).cast("double").alias("p"))
    score = ClusteringEvaluator(featuresCol="x", predictionCol="p", distanceMeasure=metric).evaluate(rows)
    return labelled.sparkSession.createDataFrame([(float(score),)], "silhouette double")


def cluster_summary(members: DataFrame, label_col: str = "label", supergroup_col: str = "supergroup",
                    xyz_col: str = "color_xyz", w_abs_col: str = "w_abs") -> DataFrame:
    """Per cluster: size, distinct super-groups, mean colour coordinates and mean \\|w\\|, largest first."""
    xyz = F.col(xyz_col)
    stats = members.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("members"),
        F.array_sort(F.collect_set(F.nullif(F.col(supergroup_col).cast("string"), F.lit("")))).alias("supergroups"),
        F.array(F.avg(xyz[0]), F.avg(xyz[1]), F.avg(F.coalesce(F.get(xyz, 2), F.lit(0.0)))).alias("color_xyz"),
        F.avg(w_abs_col).alias("w_abs"))
    return stats.orderBy(F.desc("members"), label_col)
