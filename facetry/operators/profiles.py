"""Long profiles (entity, kind, feature, score): merging, weighting, feature statistics.

Windows partition by entity only: after the merge an entity holds each feature
once, so such a group is limited by the feature catalogue.  Everything grouped
by feature, kind or dataset is a partial aggregate that is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.scores import TIE, is_filler_tol, raw_variant, variant_number
from facetry.operators.ordering import top_k_per_group, with_position
from facetry.runtime import reliable, scalar

KEY = ["entity_id", "kind", "feature"]


def merge_max(rows: DataFrame) -> DataFrame:
    """One row per entity and feature: colliding keys keep the largest score."""
    return rows.groupBy(*KEY).agg(F.max("score").alias("score"))


def merge_sum_capped(rows: DataFrame, cap: float = 1.0) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.least(F.lit(cap), F.sum("score")).alias("score"))


def merge_max_methods(rows: DataFrame, cap: float = 1.0) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.least(F.lit(cap), F.max("score")).alias("score"))


def feature_df(profile: DataFrame) -> DataFrame:
    """Entities per feature, each counted once: merged first, so no distinct set is kept."""
    once = profile.where(F.col("score") > 0).select(*KEY).distinct()
    return once.groupBy("kind", "feature").agg(F.count(F.lit(1)).alias("df"))


def min_support(profile: DataFrame, support: int = 5) -> DataFrame:
    """Feature catalogue: features with enough entities, indexed by kind then name."""
    kept = feature_df(profile).where(F.col("df") >= support)
    return with_position(kept, F.col("kind"), F.col("feature"), name="feature_index")


def keep_supported(profile: DataFrame, support: int = 5) -> DataFrame:
    kept = feature_df(profile).where(F.col("df") >= support)
    return profile.join(kept.select("kind", "feature"), ["kind", "feature"], "left_semi")


def l1_normalize(profile: DataFrame) -> DataFrame:
    """Scores divided by the entity's sum (a zero sum divides by 1)."""
    mass = F.sum("score").over(Window.partitionBy("entity_id"))
    return profile.withColumn("score", F.col("score") / F.when(mass == 0, 1.0).otherwise(mass))


def entity_count(profile: DataFrame):
    """Number of entities as a scalar (distinct over the shuffled keys, not one task)."""
    return scalar(profile.select("entity_id").distinct(), F.count(F.lit(1)))


def idf(normalized: DataFrame, threshold: float = 0.01) -> DataFrame:
    """ln((n+1)/(df+1)) + 1 per feature, where df counts values above ``threshold``.

    A share that equals the threshold but for the order in which its sum was rounded is not above it.
    """
    strong = normalized.groupBy("kind", "feature").agg(
        F.count_if(F.col("score") > threshold * (1 + TIE)).alias("df"))
    n = entity_count(normalized)
    return strong.select("kind", "feature", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def idf_weight(normalized: DataFrame, threshold: float = 0.01) -> DataFrame:
    weights = idf(normalized, threshold).select("kind", "feature", "idf")
    return normalized.join(weights, ["kind", "feature"]).withColumn(
        "score", F.col("score") * F.col("idf")).drop("idf")


def feature_variance(profile: DataFrame) -> DataFrame:
    """Population variance per feature; absent features count as zero."""
    n = entity_count(profile)
    sums = profile.groupBy("kind", "feature").agg(
        F.sum("score").alias("_s"), F.sum(F.col("score") * F.col("score")).alias("_ss"))
    mean = F.col("_s") / n
    return sums.select("kind", "feature", (F.col("_ss") / n - mean * mean).alias("variance"))


def top_variance(profile: DataFrame, n: int = 15) -> DataFrame:
    return feature_variance(profile).orderBy(F.desc("variance"), "kind", "feature").limit(n)


def column_moments(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Mean and population deviation (floored at 1e-8) per vector position."""
    cells = vectors.select(F.posexplode(vector_col).alias("dim", "x"))
    return cells.groupBy("dim").agg(
        F.avg("x").alias("mu"), F.greatest(F.stddev_pop("x"), F.lit(1e-8)).alias("sigma"))


def split_scores(rows: DataFrame, whitelist: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """Every raw score with the reason it is removed for, null when it is kept.

    ``raw_score`` is a variant or JSON text, so text such as "0.5" is no number while true
    counts as 1.  ``raw_key`` keeps the key as it was written.  The reasons are tested in the
    order non_positive, filler, not_in_master.
    """
    from facetry.functions.keys import with_alias

    rows = rows.withColumn("raw_key", F.col("feature"))
    named = with_alias(rows, alias) if alias is not None else rows
    master = whitelist.select("kind", "feature").distinct().withColumn("_known", F.lit(True))
    number = variant_number(raw_variant(rows, "raw_score"))
    reason = (
        F.when(number.isNull() | F.isnan(number) | (number <= 0), "non_positive")
        .when(is_filler_tol(number), "filler")
        .when(F.col("_known").isNull(), "not_in_master")
    )
    return named.join(master, ["kind", "feature"], "left").select(
        *named.columns, number.alias("score"), reason.alias("reason"))


def clean_profile(rows: DataFrame, whitelist: DataFrame, alias: DataFrame | None = None) -> DataFrame:
    """The profile that is left: one row per entity and canonical key, with the greatest of its kept scores."""
    return merge_max(split_scores(rows, whitelist, alias).where(F.col("reason").isNull()))


def clean_report(split: DataFrame, file_col: str = "file", kind: str = "ing") -> DataFrame:
    """Per file: entities, removed scores, entities left without any feature of ``kind``."""
    per_entity = split.groupBy(file_col, "entity_id").agg(
        F.count("reason").alias("_removed"), F.count_if(F.col("reason").isNull() & (F.col("kind") == kind)).alias("_kept"))
    return per_entity.groupBy(file_col).agg(
        F.count(F.lit(1)).alias("entities"), F.sum("_removed").alias("removed"),
        F.count_if(F.col("_kept") == 0).alias("empty_entities"))


def clean_details(split: DataFrame, entities: DataFrame, file_col: str = "file") -> DataFrame:
    """Per entity: file, name, kept features of either kind, whether none of its ingredients is left, and its removed keys with reasons.

    A kept key counts once however many raw keys meet in it.  The list is bounded by the raw keys of one entity.
    """
    gone = F.when(F.col("reason").isNotNull(), F.struct("kind", "raw_key", "reason"))
    kept = lambda kind: F.count_distinct(F.when(F.col("reason").isNull() & (F.col("kind") == kind), F.col("feature")))
    per_entity = split.groupBy("entity_id").agg(
        kept("ing").alias("kept_ingredients"), kept("met").alias("kept_methods"), F.array_sort(F.collect_list(gone)).alias("removed"))
    zero = F.lit(0).cast("bigint")
    rows = entities.select("entity_id", "name", file_col).join(per_entity, "entity_id", "left")
    return rows.select(file_col, "entity_id", "name", F.coalesce("kept_ingredients", zero).alias("kept_ingredients"), F.coalesce("kept_methods", zero).alias("kept_methods"),
                       (F.coalesce("kept_ingredients", zero) == 0).alias("emptied"),
                       F.coalesce("removed", F.array().cast("array<struct<kind:string,raw_key:string,reason:string>>")).alias("removed"))


def clean_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("files"), F.sum("entities").alias("entities"),
                      F.sum("removed").alias("removed"), F.sum("empty_entities").alias("empty_entities"))


def profile_map(profile: DataFrame, kind: str | None = None) -> DataFrame:
    """Fold the long form back to one ``map<feature, score>`` per entity."""
    rows = profile if kind is None else profile.where(F.col("kind") == kind)
    return rows.groupBy("entity_id").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "score"))).alias("scores"))


def top_features(profile: DataFrame, k: int = 8) -> DataFrame:
    return top_k_per_group(profile, ["entity_id", "kind"], k, F.desc("score"), F.col("feature"))


def drop_small_cap(profile: DataFrame, caps: dict[str, int], minimum: float = 0.05) -> DataFrame:
    """Drop scores below ``minimum`` and keep each kind's best (the cap is the rule itself)."""
    ranked = top_k_per_group(profile.where(F.col("score") >= minimum), ["entity_id", "kind"],
                             max(caps.values()), F.desc("score"), F.col("feature"))
    cap = F.coalesce(*[F.when(F.col("kind") == kind, F.lit(n)) for kind, n in caps.items()], F.lit(0))
    return ranked.where(F.col("rank") <= cap)


def relative_percent(profile: DataFrame) -> DataFrame:
    """Score as rounded percent of the entity's best score of that kind (half rounds up)."""
    best = F.max("score").over(Window.partitionBy("entity_id", "kind"))
    return profile.withColumn("percent", F.floor(F.try_divide(F.col("score"), best) * 100 + 0.5))


def group_profile_topk(profile: DataFrame, members: DataFrame, group_col: str, k: int = 10) -> DataFrame:
    """Mean score per group and feature (absent = 0), best k per kind."""
    sizes = members.groupBy(group_col).agg(F.count(F.lit(1)).alias("members"))
    sums = profile.join(members.select("entity_id", group_col), "entity_id").groupBy(
        group_col, "kind", "feature").agg(F.sum("score").alias("_sum"))
    means = sums.join(sizes, group_col).withColumn("avg_score", F.col("_sum") / F.col("members"))
    return top_k_per_group(means, [group_col, "kind"], k, F.desc("avg_score"), F.col("feature")).drop("_sum")


def group_context(profile: DataFrame, members: DataFrame, group_col: str, k: int = 10, shown: int = 50) -> DataFrame:
    """``group_profile_topk`` of each group beside its members' names: the first ``shown`` by name, and how many there are."""
    tops = group_profile_topk(profile, members, group_col, k).groupBy(group_col).agg(
        F.array_sort(F.collect_list(F.struct("kind", "rank", "feature", "avg_score"))).alias("features"))  # 2 k entries a group at most
    names = top_k_per_group(members.select(group_col, "name", "entity_id"), [group_col], shown, F.col("name"), F.col("entity_id"))
    listed = names.groupBy(group_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("names"))
    sizes = members.groupBy(group_col).agg(F.count(F.lit(1)).alias("members"))
    return sizes.join(listed, group_col).join(tops, group_col, "left")


def cluster_lift(profile: DataFrame, members: DataFrame, label_col: str, kind: str = "ing", k: int = 3) -> DataFrame:
    """Features whose mean in a cluster exceeds the global mean most (absent = 0 in both)."""
    sizes = members.groupBy(label_col).agg(F.count(F.lit(1)).alias("_members"))
    n = scalar(members, F.count(F.lit(1)))
    rows = profile.where(F.col("kind") == kind).join(members.select("entity_id", label_col), "entity_id")
    inside = rows.groupBy(label_col, "feature").agg(F.sum("score").alias("_sum"))
    overall = inside.groupBy("feature").agg((F.sum("_sum")).alias("_all"))
    lift = inside.join(sizes, label_col).join(overall, "feature").withColumn(
        "lift", F.col("_sum") / F.col("_members") - F.col("_all") / n)
    return top_k_per_group(lift.where(F.col("lift") > 0), [label_col], k, F.desc("lift"), F.col("feature")).select(
        label_col, "feature", "lift", "rank")


def neighbour_contrast(profile: DataFrame, neighbours: DataFrame, top: int = 8, excess: float = 0.15,
                       keep: int = 5, kind: str = "ing") -> DataFrame:
    """An entity's best features that stand out against the mean of its neighbours (absent = 0)."""
    rows = profile.where(F.col("kind") == kind)
    own = reliable(top_k_per_group(rows, ["entity_id"], top, F.desc("score"), F.col("feature"), name="_own"))
    sizes = neighbours.groupBy("entity_id").agg(F.count(F.lit(1)).alias("_k"))
    # only what is compared: ``top`` features of each neighbour, however many it has
    around = (
        neighbours.select("entity_id", "neighbour_id").join(own.select("entity_id", "feature"), "entity_id")
        .join(rows.select(F.col("entity_id").alias("neighbour_id"), "feature", F.col("score").alias("_s")), ["neighbour_id", "feature"])
        .groupBy("entity_id", "feature").agg(F.sum("_s").alias("_sum"))
    )
    diff = F.col("score") - F.coalesce(F.col("_sum"), F.lit(0.0)) / F.coalesce(F.col("_k"), F.lit(1))
    rows = (own.join(around, ["entity_id", "feature"], "left").join(sizes, "entity_id", "left")
            .withColumn("excess", diff).where(F.col("excess") > excess))
    return top_k_per_group(rows, ["entity_id"], keep, F.desc("excess"), F.col("feature")).select(
        "entity_id", "feature", "score", "excess", "rank")
