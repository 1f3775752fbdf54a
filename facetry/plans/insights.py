"""Compositions that answer the product questions: five insights and the entity panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.keys import family_label
from facetry.functions.scores import distance_score
from facetry.operators import calibrate, cluster, grid, neighbours, profiles, similarity
from facetry.operators.ordering import top_k_per_group


def farthest_twins(rows: DataFrame, entities: DataFrame, profile: DataFrame | None = None, n: int = 5) -> tuple[DataFrame, DataFrame | None]:
    """Similar pairs far apart, with names, and the features they share or differ on."""
    twins = similarity.farthest_twins(rows, entities, n)
    side = lambda s: entities.select(F.col("entity_id").alias(f"_{s}"), F.col("name").alias(f"name_{s}"))
    named = (twins.join(side("a"), F.col("id") == F.col("_a")).join(side("b"), F.col("neighbour_id") == F.col("_b"))
             .select("round", F.col("id").alias("a_id"), F.col("neighbour_id").alias("b_id"), "name_a", "name_b",
                     F.bround("km", 0).cast("bigint").alias("km"), F.round("value", 3).alias("cosine")))
    detail = None if profile is None else similarity.feature_overlap(profile, named)
    return named.orderBy("round"), detail


def lonely_profiles(rows: DataFrame, entities: DataFrame, k: int = 10, n: int = 5) -> DataFrame:
    return similarity.lonely(neighbours.knn_join(rows, k, "cosine"), entities, n)


def crossroads(rows: DataFrame, entities: DataFrame, k: int = 10, n: int = 5) -> DataFrame:
    return similarity.crossroads(neighbours.knn_join(rows, k, "cosine"), entities, n)


def diverse_groups(entities: DataFrame, n: int = 5, xyz_col: str = "color_xyz") -> DataFrame:
    """Groups with the widest spread of (spherical) hue."""
    hues = entities.withColumn("angle", calibrate.hue_angle(F.col(xyz_col), "spherical"))
    return grid.circular_std(hues).orderBy(F.desc("hue_std_deg"), "group").limit(n)


def families(entities: DataFrame, profile: DataFrame, calibration: DataFrame, k: int = 8, restarts: int = 10,
             vector_col: str = "embedding") -> DataFrame:
    """Clusters of embeddings with a label from their strongest features and a colour."""
    members = cluster.kmeans(entities, k, restarts=restarts, vector_col=vector_col)
    lift = profiles.cluster_lift(profile, members, "label")
    tops = lift.groupBy("label").agg(*[F.max(F.when(F.col("rank") == r, F.col("feature"))).alias(f"top{r}") for r in (1, 2, 3)])
    summary = cluster.cluster_summary(members).join(tops, "label", "left")
    named = summary.withColumn("family", family_label(F.col("top1"), F.col("top2"), F.col("label")))
    return calibrate.color_entities(named, calibration, "color_xyz", "w_abs").select(
        "label", "family", F.concat_ws(", ", "top1", "top2", "top3").alias("top_features"), "members",
        F.concat_ws(", ", "supergroups").alias("supergroups"), "color").orderBy(F.desc("members"), "label")


def family_listing(fams: DataFrame, tags: int = 4) -> DataFrame:
    """Families, largest first, with their super-groups as text and the labels of the ``tags`` largest of all as one text."""
    top = fams.orderBy(F.desc("members"), "label").limit(tags)
    text = top.agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct((-F.col("members")).alias("n"), "label", "family"))), lambda s: s["family"])).alias("_t")).scalar()
    return fams.withColumn("largest", text).orderBy(F.desc("members"), "label").select("label", "family", "members", "supergroups", "largest")


def foreign_neighbours(rows: DataFrame, k: int = 7) -> DataFrame:
    """k nearest entities of another name and group (rows carry name and group as tags), with a percent score."""
    near = neighbours.knn_join(rows, k, "euclidean")
    return near.select(F.col("id").alias("entity_id"), "neighbour_id", F.col("value").alias("distance"), "rank",
                       distance_score(F.col("value")).alias("score"))


def entity_panel(profile: DataFrame, near: DataFrame, n_ing: int = 8, n_met: int = 6) -> dict[str, DataFrame]:
    """Top features per kind, foreign neighbours and what sets an entity apart from them."""
    limit = F.when(F.col("kind") == "ing", n_ing).otherwise(n_met)
    tops = top_k_per_group(profile, ["entity_id", "kind"], max(n_ing, n_met), F.desc("score"), F.col("feature"))
    return {"top_features": tops.where(F.col("rank") <= limit), "neighbours": near,
            "distinctive": profiles.neighbour_contrast(profile, near)}


def panel_rows(panel: dict[str, DataFrame]) -> DataFrame:
    """The three parts of ``entity_panel`` in one table: (part, entity_id, kind, item, value, rank)."""
    none = F.lit(None).cast("string")
    tops = panel["top_features"].select(F.lit("top_features").alias("part"), "entity_id", "kind", F.col("feature").alias("item"), F.col("score").alias("value"), "rank")
    near = panel["neighbours"].select(F.lit("neighbours").alias("part"), "entity_id", none.alias("kind"), F.col("neighbour_id").cast("string").alias("item"), F.col("distance").alias("value"), "rank")
    own = panel["distinctive"].select(F.lit("distinctive").alias("part"), "entity_id", none.alias("kind"), F.col("feature").alias("item"), F.col("excess").alias("value"), "rank")
    return tops.unionByName(near).unionByName(own)
