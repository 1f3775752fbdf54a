"""Queries on profiles and records: keys, merges, weights, cleaning, dedupe, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.functions import keys as K
from facetry.functions import scores as S
from facetry.operators import ordering, profiles, records
from facetry.plans import bindings as B
from facetry.plans.registry import query, tidy

# A small alias list for event types.
ALIAS_ROWS = [("ing", "click", "touch"), ("ing", "view", "touch"), ("ing", "purchase", "buy")]
ALIAS_SQL = "alias(kind, raw_key, canonical) AS (VALUES ('ing', 'click', 'touch'), ('ing', 'view', 'touch'), ('ing', 'purchase', 'buy'))"


def alias_table(spark):
    return spark.createDataFrame(ALIAS_ROWS, "kind string, raw_key string, canonical string")


def event_scores(spark, sf):
    """Raw event scores by user and event type, with untidy keys to be canonicalised."""
    e = B.table(spark, sf, "events")
    return e.select(F.col("user_id").alias("entity_id"), F.lit("ing").alias("kind"),
                    F.concat(F.lit("  "), F.upper("event_type"), F.lit("\t")).alias("feature"), (F.col("value") / 100).alias("score"))


EV_SQL = f"""WITH {ALIAS_SQL},
ev AS (SELECT user_id AS entity_id, 'ing' AS kind, coalesce(canonical, event_type) AS feature, value / 100 AS score
  FROM events LEFT JOIN alias ON raw_key = event_type)
"""


@query("feature_df", f"WITH {B.PF} SELECT kind, feature, count(DISTINCT entity_id) AS df FROM pf WHERE score > 0 GROUP BY 1, 2")
def feature_df(spark, sf):
    return tidy(profiles.feature_df(B.customer_profile(spark, sf)))


@query("min_support", f"""WITH {B.PF}, d AS (SELECT kind, feature, count(DISTINCT entity_id) AS df FROM pf WHERE score > 0 GROUP BY 1, 2)
SELECT kind, feature, df, row_number() OVER (ORDER BY kind, feature) - 1 AS feature_index FROM d WHERE df >= 300""")
def min_support(spark, sf):
    return tidy(profiles.min_support(B.customer_profile(spark, sf), 300))


@query("merge_max", EV_SQL + "SELECT entity_id, kind, feature, round(max(score), 6) AS score FROM ev GROUP BY 1, 2, 3")
def merge_max(spark, sf):
    return tidy(profiles.merge_max(K.with_alias(event_scores(spark, sf), alias_table(spark))))


@query("merge_sum_capped", EV_SQL + "SELECT entity_id, kind, feature, round(least(1.0, sum(score)), 6) AS score FROM ev GROUP BY 1, 2, 3")
def merge_sum_capped(spark, sf):
    return tidy(profiles.merge_sum_capped(K.with_alias(event_scores(spark, sf), alias_table(spark))))


@query("merge_max_methods", EV_SQL + "SELECT entity_id, kind, feature, round(least(1.0, max(score)), 6) AS score FROM ev GROUP BY 1, 2, 3")
def merge_max_methods(spark, sf):
    return tidy(profiles.merge_max_methods(K.with_alias(event_scores(spark, sf), alias_table(spark))))


@query("alias_lookup", EV_SQL + "SELECT feature, count(*) AS n FROM ev GROUP BY 1")
def alias_lookup(spark, sf):
    return K.with_alias(event_scores(spark, sf), alias_table(spark)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("resolve_schema_key", f"""WITH {ALIAS_SQL},
back AS (SELECT kind, canonical AS k, max(raw_key) AS b FROM alias GROUP BY 1, 2), forth AS (SELECT kind, raw_key AS k, min(canonical) AS f FROM alias GROUP BY 1, 2),
ev AS (SELECT user_id AS entity_id, 'ing' AS kind, CASE WHEN event_type = 'click' THEN 'touch' ELSE event_type END AS feature, value / 100 AS score FROM events)
SELECT entity_id, ev.kind, coalesce(b, f, feature) AS feature, round(CASE WHEN count(*) > 1 THEN least(1.0, max(score)) ELSE max(score) END, 6) AS score
FROM ev LEFT JOIN back ON back.k = feature LEFT JOIN forth ON forth.k = feature GROUP BY 1, 2, 3""")
def resolve_schema_key(spark, sf):
    e = B.table(spark, sf, "events").select(
        F.col("user_id").alias("entity_id"), F.lit("ing").alias("kind"),
        F.when(F.col("event_type") == "click", "touch").otherwise(F.col("event_type")).alias("feature"), (F.col("value") / 100).alias("score"))
    return tidy(K.resolve_to_schema_key(e, alias_table(spark)))


@query("l1_profile", f"WITH {B.PF} SELECT entity_id, kind, feature, round(score / sum(score) OVER (PARTITION BY entity_id), 12) AS score FROM pf")
def l1_profile(spark, sf):
    return tidy(profiles.l1_normalize(B.customer_profile(spark, sf)).select("entity_id", "kind", "feature", "score"), 12)


_L1 = f"WITH {B.PF}, l1 AS (SELECT entity_id, kind, feature, score / sum(score) OVER (PARTITION BY entity_id) AS score FROM pf)"
_IDF = _L1 + """, w AS (SELECT kind, feature, count(*) FILTER (WHERE score > 0.01) AS df,
  ln(((SELECT count(DISTINCT entity_id) FROM l1) + 1) / (count(*) FILTER (WHERE score > 0.01) + 1)) + 1 AS idf FROM l1 GROUP BY 1, 2)
"""


@query("idf", _IDF + "SELECT kind, feature, df, round(idf, 6) AS idf FROM w")
def idf(spark, sf):
    return tidy(profiles.idf(profiles.l1_normalize(B.customer_profile(spark, sf))))


@query("idf_profile", _IDF + "SELECT entity_id, l1.kind, l1.feature, round(score * idf, 6) AS score FROM l1 JOIN w ON l1.kind = w.kind AND l1.feature = w.feature")
def idf_profile(spark, sf):
    rows = profiles.l1_normalize(B.customer_profile(spark, sf))
    return tidy(profiles.idf_weight(rows).select("entity_id", "kind", "feature", "score"))


@query("top_variance", _IDF + """, x AS (SELECT l1.kind, l1.feature, score * idf AS s FROM l1 JOIN w ON l1.kind = w.kind AND l1.feature = w.feature),
n AS (SELECT count(DISTINCT entity_id) AS n FROM l1)
SELECT kind, feature, round(variance * 1e6, 6) AS variance_ppm FROM (SELECT kind, feature, sum(s * s) / any_value(n) - (sum(s) / any_value(n)) ** 2 AS variance FROM x, n GROUP BY 1, 2)
ORDER BY variance DESC, kind, feature LIMIT 15""")
def top_variance(spark, sf):
    """Most discriminating features: support, L1, IDF, variance with implicit zeros."""
    rows = profiles.idf_weight(profiles.l1_normalize(B.customer_profile(spark, sf)))
    top = profiles.top_variance(rows, 15)
    return tidy(top.select("kind", "feature", (F.col("variance") * 1e6).alias("variance_ppm")))


@query("column_moments", f"""WITH {B.EM}, c AS (SELECT generate_subscripts(vector, 1) - 1 AS dim, unnest(vector) AS x FROM em)
SELECT dim::BIGINT AS dim, round(avg(x), 6) AS mu, round(greatest(stddev_pop(x), 1e-8), 6) AS sigma FROM c GROUP BY 1""")
def column_moments(spark, sf):
    return tidy(profiles.column_moments(B.embeddings(spark, sf)))


@query("canonical_key", "SELECT p_partkey, lower(trim(p_name)) AS key FROM part")
def canonical_key(spark, sf):
    p = B.table(spark, sf, "part")
    return p.select("p_partkey", K.canonical_key(F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("\n "))).alias("key"))


@query("slug_key", r"""SELECT conv_id, turn, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM conversations""")
def slug_key(spark, sf):
    c = B.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", K.slug_key(F.col("text")).alias("slug"))


@query("slug_key_exact", r"""SELECT doc_id, trim(regexp_replace(strip_accents(lower(source || ' ' || lang)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM documents""")
def slug_key_exact(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", K.slug_key(F.concat_ws(" ", "source", "lang"), exact=True).alias("slug"))


@query("entity_key", f"""WITH {B.CM} SELECT entity_id, lower(regexp_replace(concat_ws('__', name, nullif(CASE WHEN weight < 0 THEN '' ELSE supergroup END, ''), "group"), '\\s+', '_', 'g')) AS key FROM cm""")
def entity_key(spark, sf):
    c = B.customers(spark, sf)
    return c.select("entity_id", K.entity_key(F.col("name"), F.when(F.col("weight") < 0, "  ").otherwise(F.col("supergroup")), F.col("group")).alias("key"))


@query("city_id", f"""WITH {B.CM} SELECT entity_id, name || '-' || supergroup || '-' || "group" AS key FROM cm""")
def city_id(spark, sf):
    c = B.customers(spark, sf)
    return c.select("entity_id", K.city_id(F.col("name"), F.col("supergroup"), F.col("group")).alias("key"))


@query("pretty_label", """SELECT p_partkey, upper(split_part(p_name, ' ', 1)[1:1]) || split_part(p_name, ' ', 1)[2:] || ' '
 || upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] AS label FROM part""")
def pretty_label(spark, sf):
    p = B.table(spark, sf, "part")
    return p.select("p_partkey", K.pretty_label(F.translate("p_name", " ", "_")).alias("label"))


@query("positive_numeric", "SELECT event_id, (props->>'k')::DOUBLE > 0 AS positive FROM events")
def positive_numeric(spark, sf):
    e = B.table(spark, sf, "events")
    return e.select("event_id", S.positive_numeric(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")).alias("positive"))


@query("coerce_scores", "SELECT event_id, round((props->>'k')::DOUBLE, 6) AS k, 1::BIGINT AS entries FROM events")
def coerce_scores(spark, sf):
    e = B.table(spark, sf, "events").withColumn("m", S.coerce_scores(F.map_concat(
        F.from_json("props", "map<string,string>"), F.create_map(F.lit("bad"), F.lit("text")))))
    return tidy(e.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").alias("entries")))


@query("coerce_vector", "SELECT vec_id, len(embedding) AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def coerce_vector(spark, sf):
    e = B.embeddings(spark, sf).withColumn("v", S.coerce_vector(F.to_json("vector")))
    return tidy(e.select(F.col("entity_id").alias("vec_id"), F.size("v").alias("n"),
                         F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")))


_WHITE = "white AS (SELECT DISTINCT 'ing' AS kind, p_brand || '/' || p_type AS feature FROM part WHERE p_brand <> 'Brand#13')"


def whitelist(spark, sf):
    p = B.table(spark, sf, "part").where(F.col("p_brand") != "Brand#13")
    return p.select(F.lit("ing").alias("kind"), F.concat_ws("/", "p_brand", "p_type").alias("feature")).distinct()


_SPLIT = f"""WITH {B.PF}, {_WHITE}, split AS (SELECT entity_id, pf.kind, pf.feature, score, CASE WHEN score <= 0 THEN 'non_positive'
  WHEN abs(score - 0.44) <= 0.0005 THEN 'filler' WHEN white.feature IS NULL THEN 'not_in_master' END AS reason
  FROM pf LEFT JOIN white ON white.kind = pf.kind AND white.feature = pf.feature)
"""


def _split(spark, sf):
    rows = B.customer_profile(spark, sf).withColumn("raw_score", F.col("score").cast("string")).drop("score")
    return profiles.split_scores(rows, whitelist(spark, sf))


@query("filler_split", _SPLIT + "SELECT entity_id, kind, feature, round(score, 6) AS score, coalesce(reason, 'kept') AS reason FROM split")
def filler_split(spark, sf):
    return tidy(_split(spark, sf).select("entity_id", "kind", "feature", "score", F.coalesce("reason", F.lit("kept")).alias("reason")))


_REPORT = _SPLIT + """, f AS (SELECT n_name AS file, entity_id, count(reason) AS removed, count(*) FILTER (WHERE reason IS NULL) AS kept
  FROM split JOIN customer ON c_custkey = entity_id JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2),
r AS (SELECT file, count(*) AS entities, sum(removed)::BIGINT AS removed, count(*) FILTER (WHERE kept = 0) AS empty_entities FROM f GROUP BY 1)
"""


def _report(spark, sf):
    files = B.customers(spark, sf).select("entity_id", F.col("group").alias("file"))
    return profiles.clean_report(_split(spark, sf).join(files, "entity_id"))


@query("clean_report", _REPORT + "SELECT * FROM r")
def clean_report(spark, sf):
    return tidy(_report(spark, sf))


@query("clean_typed", """WITH r AS (SELECT user_id AS entity_id, event_type, event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 1.0::DOUBLE ELSE value / 20 END AS score FROM events)
SELECT entity_id, 'ing' AS kind, event_type AS feature, round(max(score), 6) AS score FROM r
WHERE score > 0 AND abs(score - 0.44) > 0.0005 AND event_id % 3 < 2 AND event_type <> 'view' GROUP BY 1, 2, 3""")
def clean_typed(spark, sf):
    """Typed raw scores: text is no number, true counts as 1, keys that meet in one keep the greatest."""
    e = B.table(spark, sf, "events")
    plain = (F.col("value") / 20).cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('"'), plain, F.lit('"'))).when(F.col("event_id") % 4 == 1, "true").otherwise(plain)
    rows = e.select(F.col("user_id").alias("entity_id"), F.lit("ing").alias("kind"), F.concat_ws("_", "event_type", (F.col("event_id") % 3).cast("string")).alias("feature"), raw.alias("raw_score"))
    types = e.select("event_type").distinct()
    alias = types.select(F.lit("ing").alias("kind"), F.explode(F.array(F.concat("event_type", F.lit("_0")), F.concat("event_type", F.lit("_1")))).alias("raw_key"), F.col("event_type").alias("canonical"))
    white = types.where("event_type <> 'view'").select(F.lit("ing").alias("kind"), F.col("event_type").alias("feature"))
    return tidy(profiles.clean_profile(rows, white, alias))


@query("clean_details", _SPLIT + """, d AS (SELECT entity_id, count(DISTINCT feature) FILTER (WHERE reason IS NULL AND kind = 'ing') AS kept_ingredients, count(DISTINCT feature) FILTER (WHERE reason IS NULL AND kind = 'met') AS kept_methods,
  string_agg(kind || ':' || feature || ':' || reason, ';' ORDER BY kind, feature, reason) FILTER (WHERE reason IS NOT NULL) AS removed FROM split GROUP BY 1)
SELECT n_name AS file, c_custkey AS entity_id, c_name AS name, coalesce(kept_ingredients, 0) AS kept_ingredients, coalesce(kept_methods, 0) AS kept_methods, coalesce(kept_ingredients, 0) = 0 AS emptied, coalesce(removed, '') AS removed
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN d ON entity_id = c_custkey""")
def clean_details(spark, sf):
    """What cleaning removed from each customer, with reasons, and who is left empty."""
    entities = B.customers(spark, sf).select("entity_id", "name", F.col("group").alias("file"))
    rows = profiles.clean_details(_split(spark, sf), entities)
    return rows.withColumn("removed", F.concat_ws(";", F.transform("removed", lambda r: F.concat_ws(":", r["kind"], r["raw_key"], r["reason"]))))


@query("clean_totals", _REPORT + "SELECT count(*) AS files, sum(entities)::BIGINT AS entities, sum(removed)::BIGINT AS removed, sum(empty_entities)::BIGINT AS empty_entities FROM r")
def clean_totals(spark, sf):
    return tidy(profiles.clean_totals(_report(spark, sf)))


@query("whitelist_keep", f"WITH {B.PF}, {_WHITE} SELECT entity_id, kind, feature, round(score, 6) AS score FROM pf SEMI JOIN white USING (kind, feature)")
def whitelist_keep(spark, sf):
    rows = B.customer_profile(spark, sf).join(whitelist(spark, sf), ["kind", "feature"], "left_semi")
    return tidy(rows.select("entity_id", "kind", "feature", "score"))


@query("whitelist_reject", f"WITH {B.PF}, {_WHITE} SELECT entity_id, kind, feature, round(score, 6) AS score FROM pf ANTI JOIN white USING (kind, feature)")
def whitelist_reject(spark, sf):
    rows = B.customer_profile(spark, sf).join(whitelist(spark, sf), ["kind", "feature"], "left_anti")
    return tidy(rows.select("entity_id", "kind", "feature", "score"))


@query("unknown_keys", f"WITH {B.PF}, {_WHITE} SELECT DISTINCT kind, feature FROM pf ANTI JOIN white USING (kind, feature)")
def unknown_keys(spark, sf):
    return records.new_keys(B.customer_profile(spark, sf), whitelist(spark, sf))


@query("grow_catalog", f"WITH {B.PF}, {_WHITE} SELECT kind, feature FROM white UNION SELECT kind, feature FROM pf")
def grow_catalog(spark, sf):
    return records.grow_catalog(B.customer_profile(spark, sf), whitelist(spark, sf))


@query("drop_small_cap", f"""WITH {B.PF}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, kind ORDER BY score DESC, feature) AS rank FROM pf WHERE score >= 0.05)
SELECT entity_id, kind, feature, round(score, 6) AS score, rank FROM r WHERE rank <= CASE kind WHEN 'ing' THEN 35 ELSE 12 END""")
def drop_small_cap(spark, sf):
    rows = profiles.drop_small_cap(B.customer_profile(spark, sf), {"ing": 35, "met": 12})
    return tidy(rows.select("entity_id", "kind", "feature", "score", "rank"))


@query("top_features", f"""WITH {B.PF} SELECT entity_id, kind, feature, round(score, 6) AS score, row_number() OVER (PARTITION BY entity_id, kind ORDER BY score DESC, feature) AS rank
FROM pf QUALIFY rank <= 8""")
def top_features(spark, sf):
    return tidy(profiles.top_features(B.customer_profile(spark, sf), 8).select("entity_id", "kind", "feature", "score", "rank"))


@query("sorted_maps", f"""WITH {B.PF} SELECT entity_id, string_agg(feature, ',' ORDER BY score DESC, feature) AS listing FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, feature) AS r FROM pf WHERE kind = 'ing' AND score >= 0.05) WHERE r <= 6 GROUP BY 1""")
def sorted_maps(spark, sf):
    maps = profiles.profile_map(B.customer_profile(spark, sf), "ing")
    return maps.select("entity_id", F.array_join(F.transform(S.drop_small_and_cap(F.col("scores"), 6), lambda e: e["key"]), ",").alias("listing"))


@query("relative_percent", f"WITH {B.PF} SELECT entity_id, kind, feature, floor(score / max(score) OVER (PARTITION BY entity_id, kind) * 100 + 0.5)::BIGINT AS percent FROM pf")
def relative_percent(spark, sf):
    return tidy(profiles.relative_percent(B.customer_profile(spark, sf)).select("entity_id", "kind", "feature", "percent"))


@query("filler_set", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount * 11, 4) IN (0.44, 0.4656, 0.4386, 0.4325, 0.4086, 0.3694, 0.3256, 0.2944, 0.45, 0.35) AS filler FROM lineitem")
def filler_set(spark, sf):
    li = B.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.is_filler_set(F.col("l_discount") * 11).alias("filler"))


_CMN = f"WITH {B.PF}, {B.CM}, rich AS (SELECT entity_id, count(*) FILTER (WHERE score > 0) AS n_positive FROM pf WHERE kind = 'ing' GROUP BY 1)"


def richness(spark, sf):
    return B.customer_profile(spark, sf).where(F.col("kind") == "ing").groupBy("entity_id").agg(
        F.count_if(F.col("score") > 0).alias("n_positive"))


@query("dedupe_richest", _CMN + """ SELECT segment AS name, "group", entity_id, n_positive FROM (SELECT segment, "group", cm.entity_id, coalesce(n_positive, 0) AS n_positive,
  row_number() OVER (PARTITION BY segment, "group" ORDER BY coalesce(n_positive, 0) DESC, cm.entity_id) AS r FROM cm LEFT JOIN rich ON rich.entity_id = cm.entity_id) WHERE r = 1""")
def dedupe_richest(spark, sf):
    named = B.customers(spark, sf).select("entity_id", F.col("segment").alias("name"), "group")
    return tidy(records.dedupe_richest(named, richness(spark, sf), ["entity_id"]).select("name", "group", "entity_id", "n_positive"))


@query("dedupe_heaviest", f"""WITH {B.CM} SELECT segment AS name, entity_id, round(weight, 6) AS weight FROM cm
QUALIFY row_number() OVER (PARTITION BY segment ORDER BY coalesce(weight, 0) DESC, entity_id) = 1""")
def dedupe_heaviest(spark, sf):
    named = B.customers(spark, sf).select("entity_id", F.col("segment").alias("name"), "weight")
    return tidy(records.dedupe_heaviest(named, "entity_id").select("name", "entity_id", "weight"))


@query("sparsest_per_group", _CMN + """ SELECT supergroup, cm.entity_id, n_positive AS n_features, row_number() OVER (PARTITION BY supergroup ORDER BY n_positive, name, cm.entity_id) AS rank
FROM cm JOIN rich ON rich.entity_id = cm.entity_id WHERE n_positive < 40 QUALIFY rank <= 5""")
def sparsest_per_group(spark, sf):
    counts = B.customers(spark, sf).join(richness(spark, sf), "entity_id").withColumnRenamed("n_positive", "n_features")
    return tidy(records.sparsest_per_group(counts, "supergroup", 5, 40).select("supergroup", "entity_id", "n_features", "rank"))


@query("merge_extended", """WITH ext AS (SELECT l_orderkey AS id, sum(l_quantity) AS total, 'R' AS status FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS id, o_custkey, CASE WHEN ext.id IS NOT NULL THEN ext.status ELSE o_orderstatus END AS status, round(CASE WHEN ext.id IS NOT NULL THEN ext.total ELSE o_totalprice END, 6) AS total
FROM orders LEFT JOIN ext ON ext.id = o_orderkey""")
def merge_extended(spark, sf):
    base = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    ext = B.table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").alias("total")).withColumn("status", F.lit("R"))
    return tidy(records.merge_extended(base, ext, ["status", "total"]))


@query("pending_entities", "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')")
def pending_entities(spark, sf):
    base = B.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    done = B.table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id"))
    return records.pending(base, done)


@query("resume_guard", "SELECT (SELECT count(*) FROM orders) AS base_rows, (SELECT count(*) FROM lineitem) AS merged_rows, (SELECT count(*) FROM orders) = (SELECT count(*) FROM lineitem) AS resumable")
def resume_guard(spark, sf):
    return records.resume_guard(B.table(spark, sf, "orders"), B.table(spark, sf, "lineitem"))


@query("upsert_latest", """SELECT coalesce(user_id::VARCHAR, event_type) AS upsert_key, event_id, event_type, round(value, 6) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def upsert_latest(spark, sf):
    e = B.table(spark, sf, "events")
    rows = records.upsert_by_key(e, "event_id", F.col("user_id").cast("string"), F.col("event_type"))
    return tidy(rows.select("upsert_key", "event_id", "event_type", "value"))


def _broken_ids(spark, sf):
    """Customers by nation; every 13th has no id and every 11th a blank name, as broken raw files have."""
    c = B.customers(spark, sf).withColumn("file", F.col("group"))
    c = c.withColumn("id", F.when(F.col("entity_id") % 13 != 0, F.col("entity_id").cast("string"))).withColumn("name", F.when(F.col("entity_id") % 11 != 0, F.col("name")).otherwise(" "))
    return records.correct_ids(c, ["name", "supergroup", "group"])


@query("correct_ids", f"""WITH {B.CM}, f AS (SELECT *, entity_id % 13 = 0 OR entity_id % 11 = 0 AS bad FROM cm)
SELECT "group" AS file, count(*) AS total, count(*) FILTER (WHERE NOT bad) AS updated, count(*) FILTER (WHERE bad) AS failed FROM f GROUP BY 1""")
def correct_ids(spark, sf):
    return records.correction_report(_broken_ids(spark, sf))


@query("failed_ids", f"""WITH {B.CM} SELECT "group" AS file, CASE WHEN entity_id % 13 <> 0 THEN entity_id::VARCHAR END AS id, CASE WHEN entity_id % 11 <> 0 THEN name ELSE ' ' END AS name
FROM cm WHERE entity_id % 13 = 0 OR entity_id % 11 = 0""")
def failed_ids(spark, sf):
    return records.failed_ids(_broken_ids(spark, sf))


@query("group_by_country", """SELECT coalesce(n_name, 'UNKNOWN') AS "group", count(*) AS entities FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 0 GROUP BY 1""")
def group_by_country(spark, sf):
    n = B.table(spark, sf, "nation").where("n_regionkey <> 0")
    c = B.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return records.group_by_country(c, "n_name")


@query("nested_groups", f"""WITH {B.CM}, r AS (SELECT supergroup, "group", name, row_number() OVER (PARTITION BY supergroup, "group" ORDER BY name) - 1 AS r, count(*) OVER (PARTITION BY supergroup, "group") AS n_places FROM cm)
SELECT supergroup, "group", (r // 40)::BIGINT AS part, string_agg(name, ',' ORDER BY name) AS places, n_places FROM r GROUP BY 1, 2, 3, 5""")
def nested_groups(spark, sf):
    """Customers nested by region and nation, in parts of 40 names."""
    rows = records.nested_groups(B.customers(spark, sf), "supergroup", "group", "name", 40)
    return tidy(rows.withColumn("places", F.concat_ws(",", "places")))


@query("members_of_group", f"""WITH {B.CM} SELECT entity_id, name FROM cm WHERE "group" = 'NATION_3'""")
def members_of_group(spark, sf):
    return records.members_of_group(B.customers(spark, sf), "group", "NATION_3").select("entity_id", "name")


@query("name_lookup", "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS nation_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 1")
def name_lookup(spark, sf):
    names = B.table(spark, sf, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    rows = records.name_lookup(B.table(spark, sf, "customer"), names, "c_nationkey")
    return rows.select("c_custkey", F.col("c_nationkey_name").alias("nation_name"))


@query("group_context", f"""WITH {B.PF}, {B.CM}, sizes AS (SELECT "group", count(*) AS members FROM cm GROUP BY 1),
m AS (SELECT cm."group", kind, feature, sum(score) / any_value(members) AS avg_score FROM pf JOIN cm ON cm.entity_id = pf.entity_id JOIN sizes ON sizes."group" = cm."group" GROUP BY 1, 2, 3),
t AS (SELECT "group", kind, feature, row_number() OVER (PARTITION BY "group", kind ORDER BY avg_score DESC, feature) AS rank FROM m QUALIFY rank <= 10),
f AS (SELECT "group", string_agg(kind || ':' || feature, ',' ORDER BY kind, rank) AS features FROM t GROUP BY 1),
n AS (SELECT "group", string_agg(name, ',' ORDER BY name) AS names FROM (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY "group" ORDER BY name, entity_id) <= 20) GROUP BY 1)
SELECT sizes."group", members, names, features FROM sizes JOIN n ON n."group" = sizes."group" LEFT JOIN f ON f."group" = sizes."group\"""")
def group_context(spark, sf):
    """Each nation's strongest features beside the names of its members."""
    rows = profiles.group_context(B.customer_profile(spark, sf), B.customers(spark, sf), "group", 10, 20)
    features = F.concat_ws(",", F.transform("features", lambda f: F.concat_ws(":", f["kind"], f["feature"])))
    return tidy(rows.select("group", "members", F.concat_ws(",", "names").alias("names"), features.alias("features")))


@query("group_profile_topk", f"""WITH {B.PF}, {B.CM}, sizes AS (SELECT "group", count(*) AS members FROM cm GROUP BY 1),
m AS (SELECT cm."group", kind, feature, sum(score) / any_value(members) AS avg_score, any_value(members) AS members FROM pf JOIN cm ON cm.entity_id = pf.entity_id JOIN sizes ON sizes."group" = cm."group" GROUP BY 1, 2, 3)
SELECT "group", kind, feature, round(avg_score, 6) AS avg_score, members, row_number() OVER (PARTITION BY "group", kind ORDER BY avg_score DESC, feature) AS rank FROM m QUALIFY rank <= 10""")
def group_profile_topk(spark, sf):
    rows = profiles.group_profile_topk(B.customer_profile(spark, sf), B.customers(spark, sf), "group")
    return tidy(rows.select("group", "kind", "feature", "avg_score", "members", "rank"))


@query("cluster_lift", f"""WITH {B.PF}, {B.CM}, n AS (SELECT count(*) AS n FROM cm), sizes AS (SELECT supergroup, count(*) AS members FROM cm GROUP BY 1),
s AS (SELECT supergroup, feature, sum(score) AS s FROM pf JOIN cm ON cm.entity_id = pf.entity_id WHERE kind = 'ing' GROUP BY 1, 2), g AS (SELECT feature, sum(s) AS g FROM s GROUP BY 1),
l AS (SELECT s.supergroup, s.feature, s / members - g / n AS lift FROM s JOIN sizes ON sizes.supergroup = s.supergroup JOIN g ON g.feature = s.feature, n)
SELECT supergroup, feature, round(lift, 6) AS lift, row_number() OVER (PARTITION BY supergroup ORDER BY lift DESC, feature) AS rank FROM l WHERE lift > 0 QUALIFY rank <= 3""")
def cluster_lift(spark, sf):
    return tidy(profiles.cluster_lift(B.customer_profile(spark, sf), B.customers(spark, sf), "supergroup"))


@query("position", f"WITH {B.CM} SELECT entity_id, row_number() OVER (ORDER BY weight, entity_id) - 1 AS position FROM cm")
def position(spark, sf):
    return ordering.with_position(B.customers(spark, sf).select("entity_id", "weight"), F.col("weight"), F.col("entity_id")).select("entity_id", "position")


@query("chunks", f"WITH {B.CM}, p AS (SELECT entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS i, count(*) OVER () AS n FROM cm) SELECT entity_id, floor(i / ceil(n / 7))::BIGINT AS chunk FROM p")
def chunks(spark, sf):
    return ordering.chunk_ids(B.customers(spark, sf).select("entity_id"), 7, F.col("entity_id")).select("entity_id", "chunk")


@query("split_batches", f"WITH {B.CM} SELECT entity_id, ((row_number() OVER (ORDER BY entity_id) - 1) // 100)::BIGINT AS batch_id FROM cm")
def split_batches(spark, sf):
    return ordering.split_batches(B.customers(spark, sf).select("entity_id"), 100, F.col("entity_id")).select("entity_id", "batch_id")


@query("top_by_weight", f"WITH {B.CM} SELECT entity_id, round(weight, 6) AS weight FROM cm ORDER BY weight DESC, entity_id LIMIT 50")
def top_by_weight(spark, sf):
    return tidy(ordering.top_n(B.customers(spark, sf).select("entity_id", "weight"), 50, F.desc("weight"), F.col("entity_id")))


@query("capped_list", f"""WITH {B.CM}, r AS (SELECT "group", name, row_number() OVER (PARTITION BY "group" ORDER BY entity_id) AS r, count(*) OVER (PARTITION BY "group") AS n FROM cm)
SELECT "group", any_value(n) AS total, string_agg(name, ', ' ORDER BY r) FILTER (WHERE r <= 3) || CASE WHEN any_value(n) > 3 THEN ' +' || (any_value(n) - 3)::VARCHAR || ' more' ELSE '' END AS listing FROM r GROUP BY 1""")
def capped_list(spark, sf):
    return ordering.capped_list(B.customers(spark, sf), ["group"], "name", 3, F.col("entity_id"))


@query("union_of_tables", "SELECT c_name AS name, c_acctbal::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def union_of_tables(spark, sf):
    from facetry.sources.readers import union_files
    c = B.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = B.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return union_files([c, s])
