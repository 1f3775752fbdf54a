"""Data quality rules.  Every rule returns (entity_id, group, rule, severity, detail)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.color import hue_diff
from facetry.functions.scores import FILLER_SET, TIE, is_filler_set, raw_variant, variant_number
from facetry.runtime import reliable, scalar

COLUMNS = ["entity_id", "group", "rule", "severity", "detail"]

# Names that are too general to be features, and banned methods.
GENERIC_KEYS = {
    "ing": ("herb", "herbs", "seafood", "vegetables", "spices", "chili_peppers", "meat", "dairy", "grain", "protein"),
    "met": (),
}
BANNED_KEYS = {"ing": (), "met": ("stuffing",)}
REQUIRED_FIELDS = ("id", "name", "countryCode", "continent", "latitude", "longitude")


def _violations(df: DataFrame, rules: Sequence[tuple[Column, str, str, Column]]) -> DataFrame:
    """One pass over ``df``: each (condition, rule, severity, detail) that holds becomes a row."""
    found = F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
                                                        detail.cast("string").alias("detail")))
        for cond, rule, severity, detail in rules])
    hits = df.select("entity_id", F.col("group").cast("string").alias("group"),
                     F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v"))
    return hits.select("entity_id", "group", "v.rule", "v.severity", "v.detail")


def required_fields(entities: DataFrame, fields: Iterable[str]) -> DataFrame:
    return _violations(entities, [(F.col(f).isNull(), "missing_field", "error", F.lit(f)) for f in fields])


def coordinate_range(entities: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return _violations(entities, [
        (~F.col(lat).between(-90, 90), "latitude_range", "error", F.col(lat)),
        (~F.col(lon).between(-180, 180), "longitude_range", "error", F.col(lon))])


def key_rules(profile: DataFrame, whitelist: DataFrame, generic: Mapping[str, Sequence[str]] = GENERIC_KEYS,
              banned: Mapping[str, Sequence[str]] = BANNED_KEYS) -> DataFrame:
    """Generic, banned and unknown keys of merged profiles (entity_id, group, kind, feature)."""
    master = whitelist.select("kind", "feature").distinct().withColumn("_known", F.lit(True))
    named = lambda table: reduce(lambda a, b: a | b, [
        (F.col("kind") == kind) & F.col("feature").isin(list(names)) for kind, names in table.items() if names], F.lit(False))
    rows = profile.join(master, ["kind", "feature"], "left")
    rule = F.when(named(generic), "generic_key").when(named(banned), "banned_key").when(F.col("_known").isNull(), "unknown_key")
    return rows.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(
        "entity_id", F.col("group").cast("string").alias("group"), "rule", F.lit("error").alias("severity"),
        F.col("feature").alias("detail"))


def score_rules(scores: DataFrame, fillers: Iterable[float] = FILLER_SET) -> DataFrame:
    """Score is not a number, a filler value or outside [0, 1]; ``raw_score`` is a variant or JSON text, so text such as "0.5" is no number."""
    number = variant_number(raw_variant(scores, "raw_score"))
    rule = (F.when(number.isNull() | F.isnan(number), "not_a_number").when(is_filler_set(number, fillers), "filler_value")
            .when(~number.between(0, 1), "score_range"))
    return scores.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(
        "entity_id", F.col("group").cast("string").alias("group"), "rule", F.lit("error").alias("severity"),
        F.concat_ws("=", "feature", F.col("raw_score").cast("string")).alias("detail"))


def coverage_rules(profile: DataFrame, entities: DataFrame, kind: str = "ing", min_total: int = 8,
                   min_meaningful: int = 4, meaningful: float = 0.5, min_std: float = 0.05) -> DataFrame:
    """Too few features (error), too few strong ones (warning), flat profile (warning).

    A deviation that equals ``min_std`` but for the order in which it was rounded is not flat.
    """
    stats = profile.where(F.col("kind") == kind).groupBy("entity_id").agg(
        F.count_if(F.col("score") > 0).alias("_n"), F.count_if(F.col("score") >= meaningful).alias("_m"),
        F.coalesce(F.stddev_pop(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0)).alias("_std"))
    rows = entities.select("entity_id", "group").join(stats, "entity_id", "left")
    n, m = F.coalesce("_n", F.lit(0)), F.coalesce("_m", F.lit(0))
    return _violations(rows, [
        (n < min_total, "few_features", "error", n), (m < min_meaningful, "few_strong_features", "warning", m),
        ((n > 0) & (F.col("_std") < min_std * (1 - TIE)), "flat_profile", "warning", F.round("_std", 3))])


def homogeneity_rules(stats: DataFrame, min_members: int = 3, error_share: float = 0.80, warn_share: float = 0.50) -> DataFrame:
    """Copy-paste groups, from the pair statistics of ``similarity.group_similarity``."""
    share = F.try_divide(F.col("high_pairs"), F.col("pairs"))
    rows = stats.where(F.col("members") >= min_members).withColumn("entity_id", F.lit(None).cast("string"))
    return _violations(rows, [
        (F.col("identical_pairs") > 0, "identical_profiles", "error", F.col("identical_pairs")),
        (share >= error_share, "homogeneous_group", "error", F.round(share, 4)),
        ((share >= warn_share) & (share < error_share), "similar_group", "warning", F.round(share, 4)),
        (F.col("near_pairs") > 0, "near_duplicates", "warning", F.col("near_pairs"))])


def dimension_coverage(profile: DataFrame, entities: DataFrame, dimensions: DataFrame, fail_at: int = 2) -> DataFrame:
    """Missing dimensions per entity: ``dimensions`` is (dimension, feature).

    fail_at or more missing is an error, fewer a warning.  The dimension names
    form a short fixed list that is folded into one row.
    """
    names = scalar(dimensions, F.array_sort(F.collect_set("dimension")))
    has = profile.where(F.col("score") > 0).join(dimensions.distinct(), "feature").groupBy("entity_id").agg(
        F.collect_set("dimension").alias("_has"))
    rows = entities.select("entity_id", "group").join(has, "entity_id", "left").withColumn("_names", names).withColumn(
        "_missing", F.array_except("_names", F.coalesce("_has", F.array().cast("array<string>"))))
    n, listing = F.size("_missing"), F.concat_ws(",", "_missing")
    return _violations(rows, [
        (n >= fail_at, "dimension_gap", "error", listing), ((n > 0) & (n < fail_at), "dimension_gap", "warning", listing)])


def regional_rules(profile: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Entities of a rule's groups must have one of its features: ``rules`` is (rule, group, feature)."""
    asked = entities.select("entity_id", F.col("group").cast("string").alias("group")).join(
        rules.select("rule", F.col("group").cast("string").alias("group")).distinct(), "group")
    met = profile.where(F.col("score") > 0).join(rules.select("rule", "feature").distinct(), "feature").select(
        "entity_id", "rule").distinct()
    return asked.join(met, ["entity_id", "rule"], "left_anti").select(
        "entity_id", "group", "rule", F.lit("warning").alias("severity"), F.lit("required feature missing").alias("detail"))


def dataset_rules(entities: DataFrame, vector_col: str, color_col: str, size: int = 12) -> DataFrame:
    """Duplicate (name, group), vectors of a wrong size, missing colour coordinates."""
    twice = entities.groupBy("name", "group").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(
        F.lit(None).cast("string").alias("entity_id"), F.col("group").cast("string").alias("group"),
        F.lit("duplicate_name").alias("rule"), F.lit("error").alias("severity"),
        F.concat(F.col("name").cast("string"), F.lit(" x"), F.col("_n").cast("string")).alias("detail"))
    rows = _violations(entities, [
        (F.coalesce(F.size(vector_col), F.lit(-1)) != size, "vector_size", "error", F.size(vector_col)),
        (F.coalesce(F.size(color_col), F.lit(-1)) < 2, "no_color_coordinates", "error", F.lit(""))])
    return twice.unionByName(rows.withColumn("entity_id", F.col("entity_id").cast("string")))


def hue_pair_rules(spec: DataFrame, hues: DataFrame) -> DataFrame:
    """Named pairs whose hue gap must be at most or at least a bound: (a, b, op, bound) -> status."""
    side = hues.select("name", "hue")
    rows = spec.join(side.select(F.col("name").alias("a"), F.col("hue").alias("_ha")), "a", "left").join(
        side.select(F.col("name").alias("b"), F.col("hue").alias("_hb")), "b", "left")
    gap = hue_diff(F.col("_ha"), F.col("_hb"))
    ok = F.when(F.col("op") == "<=", gap <= F.col("bound")).otherwise(gap >= F.col("bound"))
    return rows.select("a", "b", "op", "bound", gap.alias("gap"), F.when(gap.isNull(), "skip").when(ok, "pass").otherwise("fail").alias("status"))


def separation_share(pairs: DataFrame, min_gap: float = 10.0, min_share: float = 0.80) -> DataFrame:
    """Share of cross-group pairs (a_hue, b_hue) at least ``min_gap`` degrees apart, with its gate."""
    wide = F.count_if(hue_diff(F.col("a_hue"), F.col("b_hue")) >= min_gap)
    out = pairs.agg(F.count(F.lit(1)).alias("pairs"), wide.alias("separated"))
    share = F.try_divide(F.col("separated"), F.col("pairs"))
    return out.select("pairs", "separated", share.alias("share"), F.coalesce(share >= min_share, F.lit(True)).alias("ok"))


def payload_rules(cities: DataFrame, required: DataFrame | None = None, max_keys: int = 60,
                  flat_low: float = 0.45, flat_high: float = 0.55, flat_share: float = 0.5, least: float = 0.05,
                  caps: tuple[int, int] = (35, 12)) -> DataFrame:
    """Structure and content rules of parsed extension rows.

    Number of keys and flatness are judged on what is stored in the end: scores of
    ``least`` or more, at most ``caps`` of each kind, the highest first.

    ``cities`` holds entity_id, group, id, name, ingredients and methods (maps
    of variants), dishes (variant), extended_at.
    """
    from facetry.functions.scores import variant_number

    def bad_scores(maps: str) -> Column:
        def wrong(_, v):
            n = variant_number(v, allow_bool=False)
            return n.isNull() | ~n.between(0, 1)
        return F.concat_ws(",", F.array_sort(F.map_keys(F.map_filter(maps, wrong))))

    def stored(maps: str, most: int) -> Column:
        numbers = F.filter(F.transform(F.map_values(maps), lambda v: variant_number(v, False)), lambda v: v >= least)
        return F.slice(F.sort_array(numbers, asc=False), 1, most)

    kept = F.concat(stored("ingredients", caps[0]), stored("methods", caps[1]))
    flat = F.size(F.filter(kept, lambda v: v.between(flat_low, flat_high)))
    n_keys = F.size(kept)
    dishes = F.schema_of_variant("dishes")
    rows = _violations(cities, [
        (F.coalesce(F.col("id"), F.lit("")) == "", "missing_id", "error", F.lit("")),
        (F.coalesce(F.col("name"), F.lit("")) == "", "missing_name", "error", F.lit("")),
        (F.col("ingredients").isNull(), "missing_ingredients", "error", F.lit("")),
        (F.col("methods").isNull(), "missing_methods", "error", F.lit("")),
        (F.coalesce(F.col("extended_at"), F.lit("")) == "", "missing_timestamp", "error", F.lit("")),
        (F.col("dishes").isNotNull() & ~dishes.rlike(r"^ARRAY<(STRING|VOID)>$"), "dishes_not_texts", "error", dishes),
        (bad_scores("ingredients") != "", "bad_ingredient_score", "error", bad_scores("ingredients")),
        (bad_scores("methods") != "", "bad_method_score", "error", bad_scores("methods")),
        (n_keys > max_keys, "too_many_keys", "error", n_keys),
        ((F.size(kept) > 0) & (flat >= flat_share * F.size(kept)), "too_flat", "error", flat)])
    if required is None:
        return rows

    def named(maps: str, kind: str) -> Column:
        return F.transform(F.map_keys(maps), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("feature")))

    have = cities.select("entity_id", F.explode(F.concat(named("ingredients", "ing"), named("methods", "met"))).alias(
        "k")).select("entity_id", "k.kind", "k.feature")
    asked = scalar(required, F.collect_set(F.struct("kind", "feature")))  # a short fixed rule list
    missing = cities.select("entity_id", "group", F.explode(asked).alias("k")).select(
        "entity_id", "group", "k.kind", "k.feature").join(have, ["entity_id", "kind", "feature"], "left_anti")
    return rows.unionByName(missing.select(
        "entity_id", F.col("group").cast("string").alias("group"), F.lit("missing_required_key").alias("rule"),
        F.lit("error").alias("severity"), F.col("feature").alias("detail")))


def proposal_rules(proposals: DataFrame) -> DataFrame:
    """Proposed keys: text key, array mapTo, text reason, confidence in [0, 1] (all variants)."""
    kind = lambda c: F.coalesce(F.schema_of_variant(c), F.lit("VOID"))
    confidence = F.try_variant_get("confidence", "$", "double")
    number = kind("confidence").rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return _violations(proposals, [
        (kind("key") != "STRING", "proposal_key", "error", kind("key")),
        (F.col("map_to").isNotNull() & ~kind("map_to").startswith("ARRAY"), "proposal_map_to", "error", kind("map_to")),
        (kind("reason") != "STRING", "proposal_reason", "error", kind("reason")),
        (~number | ~confidence.between(0, 1), "proposal_confidence", "error", confidence)])


def key_audit(keys: DataFrame, alias: DataFrame, prefixes: Sequence[str] = ("spice", "herb", "green")) -> DataFrame:
    """Per kind: keys, keys already canonical, canonical names with several raw keys, broad-prefix keys."""
    from facetry.functions.keys import with_alias

    named = with_alias(keys.select("kind", "feature").distinct(), alias, out_col="canonical")
    per_name = named.groupBy("kind", "canonical").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("feature") == F.col("canonical")).alias("_same"),
        F.count_if(reduce(lambda a, b: a | b, [F.col("feature").startswith(p) for p in prefixes])).alias("_broad"))
    return per_name.groupBy("kind").agg(
        F.sum("_n").alias("keys"), F.sum("_same").alias("already_canonical"),
        F.count_if(F.col("_n") > 1).alias("collisions"), F.sum("_broad").alias("broad_prefix_keys"))


def alias_audit(alias: DataFrame) -> DataFrame:
    """Chains (a -> b -> c), cycles and raw keys with several targets: (kind, raw_key, finding, detail)."""
    rows = alias.select("kind", "raw_key", "canonical").distinct()
    conflict = rows.groupBy("kind", "raw_key").agg(
        F.array_sort(F.collect_set("canonical")).alias("_t")).where(F.size("_t") > 1).select(
        "kind", "raw_key", F.lit("conflict").alias("finding"), F.concat_ws("|", "_t").alias("detail"))
    step = rows.where(F.col("raw_key") != F.col("canonical"))
    onward = step.select("kind", F.col("raw_key").alias("canonical"), F.col("canonical").alias("_next"))
    chained = step.join(onward, ["kind", "canonical"])
    chain = chained.select("kind", "raw_key", F.when(F.col("_next") == F.col("raw_key"), "cycle").otherwise("chain").alias("finding"),
                           F.concat_ws(">", "raw_key", "canonical", "_next").alias("detail"))
    return conflict.unionByName(chain)


def quality_gates(metrics: DataFrame, min_silhouette: float = 0.42, max_noise: float = 0.32) -> DataFrame:
    """ok or degraded with the failed gates, from rows of (silhouette, noise_ratio)."""
    failed = F.filter(F.array(F.when(F.col("silhouette") < min_silhouette, "silhouette"),
                              F.when(F.col("noise_ratio") > max_noise, "noise_ratio")), lambda v: v.isNotNull())
    return metrics.withColumn("failed_gates", F.concat_ws(",", failed)).withColumn(
        "status", F.when(F.col("failed_gates") == "", "ok").otherwise("degraded"))


def identical_dishes(entities: DataFrame, dishes_col: str = "dishes") -> DataFrame:
    """Groups whose members (two or more) all list the same dishes."""
    per_list = entities.groupBy("group", F.array_sort(dishes_col).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    return per_list.groupBy("group").agg(F.count(F.lit(1)).alias("lists"), F.sum("_n").alias("members")).where(
        (F.col("lists") == 1) & (F.col("members") > 1))


def mapping_impact(before: DataFrame, after: DataFrame, support: int = 5) -> DataFrame:
    """Features kept before and after an alias change, side by side."""
    from facetry.operators.profiles import feature_df

    def stats(profile, name):
        kept = feature_df(profile)
        return kept.agg(F.count(F.lit(1)).alias("features"), F.count_if(F.col("df") >= support).alias("supported"),
                        F.sum("df").alias("entries")).withColumn("variant", F.lit(name))
    return stats(before, "before").unionByName(stats(after, "after"))


def mapping_quality(before: DataFrame, after: DataFrame, k: int = 8, restarts: int = 10, support: int = 1) -> DataFrame:
    """Clusters of the profiles before and after an alias change: features, entities, clusters and their silhouette per variant."""
    from facetry.operators import cluster, embed, profiles

    def of(profile: DataFrame, name: str) -> DataFrame:
        weighed = reliable(profiles.idf_weight(profiles.l1_normalize(profiles.merge_max(profile))))
        labelled = reliable(cluster.kmeans(reliable(embed.dense_profile(weighed, support)), k, restarts=restarts))
        counts = labelled.agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("label").alias("clusters"))
        features = scalar(weighed.select("kind", "feature").distinct(), F.count(F.lit(1)))
        return counts.select(F.lit(name).alias("variant"), features.alias("features"), "entities", "clusters").crossJoin(cluster.silhouette(labelled))  # one row each
    return of(before, "before").unionByName(of(after, "after"))


def rule_scoreboard(results: DataFrame) -> DataFrame:
    """Totals of (family, status) rows."""
    return results.groupBy("family").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "skip")])


def group_status(violations: DataFrame, groups: DataFrame) -> DataFrame:
    """FAIL with any error, WARN with only warnings, else PASS."""
    counts = violations.groupBy("group").agg(F.count_if(F.col("severity") == "error").alias("errors"),
                                             F.count_if(F.col("severity") == "warning").alias("warnings"))
    sizes = groups.groupBy(F.col("group").cast("string").alias("group")).agg(F.count(F.lit(1)).alias("members"))
    zero = F.lit(0).cast("bigint")
    errors, warnings = F.coalesce("errors", zero), F.coalesce("warnings", zero)
    return sizes.join(counts, "group", "left").select(
        "group", "members", errors.alias("errors"), warnings.alias("warnings"),
        F.when(errors > 0, "FAIL").when(warnings > 0, "WARN").otherwise("PASS").alias("status"))


def rule_sweep(hues: DataFrame, rules: DataFrame) -> DataFrame:
    """Per variant: whether every rule on pairs of names holds; the first passing variant is marked.

    ``hues`` is (variant, name, hue), ``rules`` (a, b, op, bound).
    """
    side = hues.select("variant", "name", "hue")
    rows = rules.join(side.select("variant", F.col("name").alias("a"), F.col("hue").alias("_ha")), "a").join(
        side.select("variant", F.col("name").alias("b"), F.col("hue").alias("_hb")), ["variant", "b"])
    gap = hue_diff(F.col("_ha"), F.col("_hb"))
    ok = F.when(F.col("op") == "<=", gap <= F.col("bound")).otherwise(gap >= F.col("bound"))
    per = rows.groupBy("variant").agg(F.count_if(ok).alias("held"), F.count(F.lit(1)).alias("rules"), F.bool_and(ok).alias("ok"))
    first = scalar(per.where("ok"), F.min("variant"))
    return per.withColumn("chosen", F.coalesce(F.col("variant") == first, F.lit(False)))
