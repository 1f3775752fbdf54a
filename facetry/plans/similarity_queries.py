"""Queries on similarity, neighbours, expectations and quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetry.operators import inverted
from facetry.operators import neighbours as nb
from facetry.operators import ordering, quality, similarity
from facetry.operators.grid import hue_histogram
from facetry.plans import bindings as B
from facetry.plans import insights
from facetry.plans.profile_queries import alias_table, event_scores, whitelist
from facetry.plans.registry import query, tidy
from facetry.runtime import reliable

PAIRS = ["id", "neighbour_id", "value"]


def _next_pairs(spark, sf):
    """Every supplier with the next one by key; the last has no partner."""
    s = B.suppliers(spark, sf).select("entity_id", "name")
    after = s.select((F.col("entity_id") - 1).alias("entity_id"), F.col("entity_id").alias("b_id"), F.col("name").alias("b"))
    return s.join(after, "entity_id").select(F.col("entity_id").alias("a_id"), "b_id", F.col("name").alias("a"), "b")


@query("cosine_pairs", f"WITH {B.SP_COS} SELECT a_id, b_id, round(cosine, 6) AS cosine FROM sp_cos WHERE b_id = a_id + 1")
def cosine_pairs(spark, sf):
    rows = similarity.cosine_of_pairs(B.supplier_profile(spark, sf), _next_pairs(spark, sf).select("a_id", "b_id"))
    return tidy(rows.select("a_id", "b_id", "cosine"))


@query("cosine_dense", f"""WITH {B.EM} SELECT a.entity_id AS a_id, b.entity_id AS b_id, round(list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 6) AS cosine
FROM em a JOIN em b ON b.entity_id = a.entity_id + 1""")
def cosine_dense(spark, sf):
    e = B.embeddings(spark, sf)
    pairs = e.select(F.col("entity_id").alias("a_id"), (F.col("entity_id") + 1).alias("b_id"))
    return tidy(similarity.cosine_of_vector_pairs(e, pairs).select("a_id", "b_id", "cosine"))


@query("similar_pairs", f"WITH {B.SP_COS} SELECT a_id AS id, b_id AS neighbour_id, round(cosine, 6) AS value FROM sp_cos WHERE cosine > 0.80")
def similar_pairs(spark, sf):
    """Every pair of suppliers above 0.80, copies of a profile included."""
    return tidy(similarity.listed_pairs(nb.sparse_rows(B.supplier_profile(spark, sf)), 0.80).select(*PAIRS))


_CUSTOMER_PAIRS = f"""WITH {B.PF}, n AS (SELECT entity_id, sqrt(sum(score * score)) AS norm FROM pf GROUP BY 1),
c AS (SELECT a.entity_id AS id, b.entity_id AS neighbour_id, sum(a.score * b.score) / (any_value(na.norm) * any_value(nb.norm)) AS value
  FROM pf a JOIN pf b ON a.kind = b.kind AND a.feature = b.feature AND a.entity_id < b.entity_id
  JOIN n na ON na.entity_id = a.entity_id JOIN n nb ON nb.entity_id = b.entity_id GROUP BY 1, 2)
"""


@query("similar_customers", _CUSTOMER_PAIRS + "SELECT id, neighbour_id, round(value, 6) AS value FROM c WHERE value >= 0.70")
def similar_customers(spark, sf):
    """Customers whose profiles reach a cosine of 0.70, by the inverted index over distinct profiles."""
    return tidy(similarity.listed_pairs(nb.sparse_rows(B.customer_profile(spark, sf)), 0.70, strict=False).select(*PAIRS))


@query("similarity_index")
def similarity_index(spark, sf):
    """What the index over customer profiles spares at three thresholds."""
    rows = reliable(nb.sparse_rows(B.customer_profile(spark, sf)))
    out = None
    for threshold in (0.70, 0.80, 0.95):
        one = inverted.index_report(rows, threshold).withColumn("threshold", F.lit(threshold))
        out = one if out is None else out.unionByName(one)
    return out


@query("group_pairs", f"""WITH {B.SP_COS}, {B.SM} SELECT a."group", a_id AS id, b_id AS neighbour_id, round(cosine, 6) AS value FROM sp_cos
JOIN sm a ON a.entity_id = a_id JOIN sm b ON b.entity_id = b_id AND a."group" = b."group" WHERE cosine >= 0.75""")
def group_pairs(spark, sf):
    rows = similarity.group_similar_pairs(nb.sparse_rows(B.supplier_profile(spark, sf)), B.suppliers(spark, sf), 0.75)
    return tidy(rows.select("group", *PAIRS))


_GROUP_STATS = f"""WITH {B.SP_COS}, {B.SM}, m AS (SELECT "group", count(*) AS members, count(*) * (count(*) - 1) // 2 AS pairs FROM sm WHERE entity_id IN (SELECT entity_id FROM sp) GROUP BY 1),
c AS (SELECT a."group", count(*) FILTER (WHERE cosine >= 0.75) AS high_pairs, count(*) FILTER (WHERE cosine >= 0.78) AS near_pairs FROM sp_cos
  JOIN sm a ON a.entity_id = a_id JOIN sm b ON b.entity_id = b_id AND a."group" = b."group" GROUP BY 1),
g AS (SELECT m."group", members, pairs, 0::BIGINT AS identical_pairs, coalesce(high_pairs, 0) AS high_pairs, coalesce(near_pairs, 0) AS near_pairs FROM m LEFT JOIN c ON c."group" = m."group")
"""


@query("group_similarity", _GROUP_STATS + "SELECT * FROM g")
def group_similarity(spark, sf):
    rows = similarity.group_similarity(nb.sparse_rows(B.supplier_profile(spark, sf)), B.suppliers(spark, sf), 0.75, 0.78)
    return tidy(rows.drop("near_listing"))


@query("group_homogeneity", _GROUP_STATS + """, v AS (
 SELECT "group", 'homogeneous_group' AS rule, 'error' AS severity FROM g WHERE members >= 3 AND high_pairs / pairs >= 0.8
 UNION ALL SELECT "group", 'similar_group', 'warning' FROM g WHERE members >= 3 AND high_pairs / pairs >= 0.5 AND high_pairs / pairs < 0.8
 UNION ALL SELECT "group", 'near_duplicates', 'warning' FROM g WHERE members >= 3 AND near_pairs > 0) SELECT * FROM v""")
def group_homogeneity(spark, sf):
    stats = similarity.group_similarity(nb.sparse_rows(B.supplier_profile(spark, sf)), B.suppliers(spark, sf), 0.75, 0.78)
    return quality.homogeneity_rules(stats).select("group", "rule", "severity")


@query("mean_group_cosine", f"""WITH {B.SP_COS}, {B.SM} SELECT a."group", (1 + sqrt(1 + 8 * count(*))) // 2 AS members, round(avg(cosine), 6) AS mean_cosine FROM sp_cos
JOIN sm a ON a.entity_id = a_id JOIN sm b ON b.entity_id = b_id AND a."group" = b."group" GROUP BY 1""".replace("(1 + sqrt(1 + 8 * count(*))) // 2 AS", "((1 + sqrt(1 + 8 * count(*))) / 2)::BIGINT AS"))
def mean_group_cosine(spark, sf):
    return tidy(similarity.mean_group_cosine(B.supplier_profile(spark, sf), B.suppliers(spark, sf)))


_KNN_SP = f"""WITH {B.SP_COS}, both_ways AS (SELECT a_id AS id, b_id AS neighbour_id, cosine FROM sp_cos UNION ALL SELECT b_id, a_id, cosine FROM sp_cos)
SELECT id, neighbour_id, round(cosine, 6) AS value, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour_id) AS rank FROM both_ways QUALIFY rank <= 10"""


@query("supplier_neighbours", _KNN_SP)
def supplier_neighbours(spark, sf):
    """Ten most similar suppliers of every supplier (fewer where there are fewer)."""
    return tidy(nb.knn_join(nb.sparse_rows(B.supplier_profile(spark, sf)), 10, "cosine"))


_PF_COS = f"""WITH {B.PF}, n AS (SELECT entity_id, sqrt(sum(score * score)) AS norm FROM pf GROUP BY 1),
c AS (SELECT a.entity_id AS id, b.entity_id AS neighbour_id, sum(a.score * b.score) / (any_value(na.norm) * any_value(nb.norm)) AS cosine
  FROM pf a JOIN pf b ON a.kind = b.kind AND a.feature = b.feature AND a.entity_id <> b.entity_id
  JOIN n na ON na.entity_id = a.entity_id JOIN n nb ON nb.entity_id = b.entity_id GROUP BY 1, 2)
SELECT id, neighbour_id, round(cosine, 6) AS value, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour_id) AS rank FROM c QUALIFY rank <= 10"""


@query("customer_neighbours", _PF_COS)
def customer_neighbours(spark, sf):
    """Ten most similar customers of every customer."""
    return tidy(nb.knn_join(nb.sparse_rows(B.customer_profile(spark, sf)), 10, "cosine"))


@query("knn_cosine", f"WITH {B.EM_KNN} SELECT id, neighbour_id, round(value, 6) AS value, rank FROM em_knn")
def knn_cosine(spark, sf):
    return tidy(_em_knn(spark, sf))


def _em_knn(spark, sf, k=10):
    return nb.knn_join(nb.dense_rows(B.embeddings(spark, sf), "entity_id", "vector"), k, "cosine")


_EUCLID = f"""WITH {B.EM}, d AS (SELECT a.entity_id, b.entity_id AS neighbour_id, list_distance(a.vector, b.vector) AS distance FROM em a JOIN em b
  ON a.name <> b.name AND a."group" <> b."group"), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY distance, neighbour_id) AS rank FROM d QUALIFY rank <= 7)
"""


@query("knn_euclid", _EUCLID + "SELECT entity_id, neighbour_id, round(distance, 6) AS distance, rank, least(greatest(floor((1 - distance / 35.0) * 100 + 0.5), 3), 99)::BIGINT AS score FROM r")
def knn_euclid(spark, sf):
    """Nearest vectors of another name and group, with the percent score."""
    return tidy(insights.foreign_neighbours(nb.dense_rows(B.embeddings(spark, sf), "entity_id", "vector", "name", "group")))


_LONELY = f"""WITH {B.EM_KNN}, a AS (SELECT id, 'v' || id::VARCHAR AS name, any_value(sa) AS supergroup, avg(value) AS avg_similarity FROM em_knn GROUP BY 1),
p0 AS (SELECT *, 0 AS phase FROM a QUALIFY row_number() OVER (PARTITION BY supergroup ORDER BY avg_similarity, id) = 1 ORDER BY avg_similarity, id LIMIT 5),
p1 AS (SELECT *, 1 AS phase FROM a WHERE name NOT IN (SELECT name FROM p0) ORDER BY avg_similarity, id LIMIT 5)
SELECT id, name, supergroup, round(avg_similarity, 6) AS avg_similarity FROM (FROM p0 UNION ALL FROM p1 ORDER BY phase, avg_similarity, id LIMIT 5)"""


@query("lonely", _LONELY)
def lonely(spark, sf):
    e = B.embeddings(spark, sf)
    rows = insights.lonely_profiles(nb.dense_rows(e, "entity_id", "vector"), e)
    return tidy(rows.select("id", "name", "supergroup", "avg_similarity"))


@query("crossroads", f"""WITH {B.EM_KNN}, s AS (SELECT id, 'v' || id::VARCHAR AS name, count(DISTINCT sb) AS groups_covered,
  string_agg('v' || neighbour_id::VARCHAR, ', ' ORDER BY rank) FILTER (WHERE rank <= 5) AS top_neighbours FROM em_knn GROUP BY 1)
SELECT id, name, groups_covered, top_neighbours FROM s ORDER BY groups_covered DESC, id LIMIT 5""")
def crossroads(spark, sf):
    e = B.embeddings(spark, sf)
    rows = insights.crossroads(nb.dense_rows(e, "entity_id", "vector"), e)
    return tidy(rows.select("id", "name", "groups_covered", "top_neighbours"))


_FAR = f"""WITH {B.SP_COS}, {B.SM}, p AS (SELECT a_id, b_id, cosine, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2)
   + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM sp_cos JOIN sm a ON a.entity_id = a_id JOIN sm b ON b.entity_id = b_id),
t AS (SELECT CASE WHEN max(cosine) > 0.7 THEN 0.7 WHEN max(cosine) > 0.6 THEN 0.6 ELSE 0.5 END AS t FROM p),
f AS (SELECT CASE WHEN count(*) FILTER (WHERE km > 10000) >= 3 THEN 10000 ELSE 8000 END AS f FROM p, t WHERE cosine > t),
q AS (SELECT a_id, b_id, cosine, km FROM p, t, f WHERE cosine > t AND km > f)"""
for _i in range(1, 6):
    _used = " ".join(f"AND a_id NOT IN (SELECT a_id FROM r{j} UNION ALL SELECT b_id FROM r{j}) AND b_id NOT IN (SELECT a_id FROM r{j} UNION ALL SELECT b_id FROM r{j})" for j in range(1, _i))
    _FAR += f",\nr{_i} AS (SELECT {_i} AS round, * FROM q WHERE true {_used} ORDER BY cosine DESC, a_id, b_id LIMIT 1)"
_TWINS = _FAR + ",\ntwins AS (" + " UNION ALL ".join(f"FROM r{i}" for i in range(1, 6)) + ")\n"


@query("farthest_twins", _TWINS + "SELECT round, a_id, b_id, round_even(km, 0)::BIGINT AS km, round(cosine, 3) AS cosine FROM twins")
def farthest_twins(spark, sf):
    rows, _ = insights.farthest_twins(nb.sparse_rows(B.supplier_profile(spark, sf)), B.suppliers(spark, sf))
    return tidy(rows.select("round", "a_id", "b_id", "km", "cosine"))


@query("twin_overlap", _TWINS + """, pairs AS (SELECT a_id, b_id FROM twins),
sides AS (SELECT a_id, b_id, feature, score AS sa, NULL::DOUBLE AS sb FROM pairs JOIN sp ON entity_id = a_id AND kind = 'ing' UNION ALL SELECT a_id, b_id, feature, NULL, score FROM pairs JOIN sp ON entity_id = b_id AND kind = 'ing'),
o AS (SELECT a_id, b_id, feature, coalesce(max(sa), 0) AS score_a, coalesce(max(sb), 0) AS score_b FROM sides GROUP BY 1, 2, 3),
sh AS (SELECT a_id, b_id, 'shared' AS relation, feature, score_a, score_b, row_number() OVER (PARTITION BY a_id, b_id ORDER BY round(least(score_a, score_b), 2) DESC, feature) AS rank FROM o WHERE least(score_a, score_b) >= 0.45 QUALIFY rank <= 8),
df AS (SELECT a_id, b_id, 'differs' AS relation, feature, score_a, score_b, row_number() OVER (PARTITION BY a_id, b_id ORDER BY abs(score_a - score_b) DESC, feature) AS rank FROM o WHERE abs(score_a - score_b) >= 0.35 QUALIFY rank <= 6)
SELECT a_id, b_id, relation, feature, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, rank FROM (FROM sh UNION ALL FROM df)""")
def twin_overlap(spark, sf):
    """Shared and differing features of the far-apart twins."""
    profile = reliable(B.supplier_profile(spark, sf))
    _, detail = insights.farthest_twins(nb.sparse_rows(profile), B.suppliers(spark, sf), profile)
    return tidy(detail)


@query("feature_overlap", f"""WITH {B.SP}, pairs AS (SELECT a.s_suppkey AS a_id, b.s_suppkey AS b_id FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
sides AS (SELECT a_id, b_id, feature, score AS sa, NULL::DOUBLE AS sb FROM pairs JOIN sp ON entity_id = a_id AND kind = 'ing' UNION ALL SELECT a_id, b_id, feature, NULL, score FROM pairs JOIN sp ON entity_id = b_id AND kind = 'ing'),
o AS (SELECT a_id, b_id, feature, coalesce(max(sa), 0) AS score_a, coalesce(max(sb), 0) AS score_b FROM sides GROUP BY 1, 2, 3),
sh AS (SELECT a_id, b_id, 'shared' AS relation, feature, score_a, score_b, row_number() OVER (PARTITION BY a_id, b_id ORDER BY round(least(score_a, score_b), 2) DESC, feature) AS rank FROM o WHERE least(score_a, score_b) >= 0.45 QUALIFY rank <= 8),
df AS (SELECT a_id, b_id, 'differs' AS relation, feature, score_a, score_b, row_number() OVER (PARTITION BY a_id, b_id ORDER BY abs(score_a - score_b) DESC, feature) AS rank FROM o WHERE abs(score_a - score_b) >= 0.35 QUALIFY rank <= 6)
SELECT a_id, b_id, relation, feature, round(score_a, 6) AS score_a, round(score_b, 6) AS score_b, rank FROM (FROM sh UNION ALL FROM df)""")
def feature_overlap(spark, sf):
    return tidy(similarity.feature_overlap(B.supplier_profile(spark, sf), _next_pairs(spark, sf)))


@query("neighbour_contrast", f"""WITH {B.SP_COS}, both_ways AS (SELECT a_id AS id, b_id AS neighbour_id, cosine FROM sp_cos UNION ALL SELECT b_id, a_id, cosine FROM sp_cos),
k AS (SELECT id, neighbour_id FROM both_ways QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour_id) <= 7), n AS (SELECT id, count(*) AS n FROM k GROUP BY 1),
m AS (SELECT id, feature, sum(score) AS s FROM k JOIN sp ON entity_id = neighbour_id AND kind = 'ing' GROUP BY 1, 2),
own AS (SELECT entity_id, feature, score FROM sp WHERE kind = 'ing' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, feature) <= 8),
x AS (SELECT entity_id, own.feature, score, score - coalesce(s, 0) / coalesce(n, 1) AS excess FROM own LEFT JOIN n ON n.id = entity_id LEFT JOIN m ON m.id = entity_id AND m.feature = own.feature)
SELECT entity_id, feature, round(score, 6) AS score, round(excess, 6) AS excess, row_number() OVER (PARTITION BY entity_id ORDER BY excess DESC, feature) AS rank FROM x WHERE excess > 0.15 QUALIFY rank <= 5""")
def neighbour_contrast(spark, sf):
    from facetry.operators.profiles import neighbour_contrast as contrast
    profile = reliable(B.supplier_profile(spark, sf))
    near = nb.knn_join(nb.sparse_rows(profile), 7, "cosine").withColumnRenamed("id", "entity_id")
    return tidy(contrast(profile, near))


_PANEL = f"""WITH {B.SP}, {B.SM}, q AS (SELECT entity_id, sum(score * score) AS q FROM sp GROUP BY 1),
dot AS (SELECT a.entity_id AS a, b.entity_id AS b, sum(a.score * b.score) AS s FROM sp a JOIN sp b ON a.kind = b.kind AND a.feature = b.feature AND a.entity_id <> b.entity_id GROUP BY 1, 2),
d AS (SELECT x.entity_id, y.entity_id AS neighbour_id, sqrt(greatest(qx.q + qy.q - 2 * coalesce(s, 0), 0)) AS distance FROM sm x JOIN sm y ON x.name <> y.name AND x."group" <> y."group"
  JOIN q qx ON qx.entity_id = x.entity_id JOIN q qy ON qy.entity_id = y.entity_id LEFT JOIN dot ON dot.a = x.entity_id AND dot.b = y.entity_id),
k AS (SELECT entity_id, neighbour_id, distance, row_number() OVER (PARTITION BY entity_id ORDER BY distance, neighbour_id) AS rank FROM d QUALIFY rank <= 7),
t AS (SELECT entity_id, kind, feature, score, row_number() OVER (PARTITION BY entity_id, kind ORDER BY score DESC, feature) AS rank FROM sp QUALIFY rank <= CASE kind WHEN 'ing' THEN 8 ELSE 6 END),
n AS (SELECT entity_id, count(*) AS n FROM k GROUP BY 1), m AS (SELECT k.entity_id, feature, sum(score) AS s FROM k JOIN sp ON sp.entity_id = k.neighbour_id AND kind = 'ing' GROUP BY 1, 2),
x AS (SELECT t.entity_id, t.feature, score - coalesce(s, 0) / coalesce(n, 1) AS excess FROM t LEFT JOIN n ON n.entity_id = t.entity_id LEFT JOIN m ON m.entity_id = t.entity_id AND m.feature = t.feature WHERE kind = 'ing'),
own AS (SELECT entity_id, feature, excess, row_number() OVER (PARTITION BY entity_id ORDER BY excess DESC, feature) AS rank FROM x WHERE excess > 0.15 QUALIFY rank <= 5)
SELECT 'top_features' AS part, entity_id, kind, feature AS item, round(score, 6) AS value, rank FROM t
UNION ALL SELECT 'neighbours', entity_id, NULL, neighbour_id::VARCHAR, round(distance, 6), rank FROM k
UNION ALL SELECT 'distinctive', entity_id, NULL, feature, round(excess, 6), rank FROM own"""


@query("entity_panel", _PANEL)
def entity_panel(spark, sf):
    """Top features, foreign neighbours (another name and nation) and what sets each supplier apart from them."""
    profile = reliable(B.supplier_profile(spark, sf))
    near = insights.foreign_neighbours(nb.sparse_rows(profile, B.suppliers(spark, sf), ["name", "group"]))
    return tidy(insights.panel_rows(insights.entity_panel(profile, reliable(near))))


def _pair_spec(spark, sf):
    """Every supplier is expected close to the next one; the last expects an entity that is missing."""
    s = B.suppliers(spark, sf).select("entity_id", F.col("name").alias("a"))
    after = B.suppliers(spark, sf).select((F.col("entity_id") - 1).alias("entity_id"), F.col("name").alias("b"))
    return s.join(after, "entity_id", "left").select("a", F.coalesce("b", F.lit("nobody")).alias("b"),
                                                     F.lit(0.72).alias("lo"), F.lit(0.80).alias("hi"))


_EXPECTED = f"""WITH {B.SP_COS}, {B.SM}, e AS (SELECT a.name AS a, coalesce(b.name, 'nobody') AS b, CASE WHEN b.name IS NULL THEN 'skip' WHEN coalesce(cosine, 0) BETWEEN 0.72 AND 0.80 THEN 'pass' ELSE 'fail' END AS status
FROM sm a LEFT JOIN sm b ON b.entity_id = a.entity_id + 1 LEFT JOIN sp_cos ON a_id = a.entity_id AND b_id = b.entity_id)
"""


@query("expected_pairs", _EXPECTED + "SELECT a, b, status FROM e")
def expected_pairs(spark, sf):
    rows = similarity.expected_pairs(B.supplier_profile(spark, sf), B.suppliers(spark, sf), _pair_spec(spark, sf))
    return rows.select("a", "b", "status")


_PRESENCE = f"""WITH {B.SP}, {B.SM}, spec AS (SELECT name AS entity, 'Brand#7/SMALL' AS feature FROM sm UNION ALL SELECT n_name, 'Brand#7/SMALL' FROM nation),
f AS (SELECT entity, spec.feature, CASE WHEN sm.entity_id IS NULL THEN 'skip' WHEN sp.entity_id IS NULL THEN 'fail' ELSE 'pass' END AS status
FROM spec LEFT JOIN sm ON sm.name = entity LEFT JOIN sp ON sp.entity_id = sm.entity_id AND sp.feature = spec.feature AND sp.score > 0)
"""


def _presence(spark, sf):
    spec = B.suppliers(spark, sf).select(F.col("name").alias("entity")).unionByName(
        B.table(spark, sf, "nation").select(F.col("n_name").alias("entity"))).withColumn("feature", F.lit("Brand#7/SMALL"))
    return similarity.expected_presence(B.supplier_profile(spark, sf), B.suppliers(spark, sf), spec)


@query("expected_presence", _PRESENCE + "SELECT entity, feature, status FROM f")
def expected_presence(spark, sf):
    return _presence(spark, sf)


@query("rule_scoreboard", _PRESENCE + """SELECT 'presence' AS family, count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail, count(*) FILTER (WHERE status = 'skip') AS skip FROM f
UNION ALL SELECT 'similarity', count(*) FILTER (WHERE status = 'pass'), count(*) FILTER (WHERE status = 'fail'), count(*) FILTER (WHERE status = 'skip') FROM (""" + _EXPECTED + "FROM e)")
def rule_scoreboard(spark, sf):
    pairs = expected_pairs(spark, sf).select(F.lit("similarity").alias("family"), "status")
    return quality.rule_scoreboard(pairs.unionByName(_presence(spark, sf).select(F.lit("presence").alias("family"), "status")))


@query("cross_group_pairs", f"""WITH {B.CM}, t AS (SELECT * FROM cm ORDER BY weight DESC, entity_id LIMIT 200), r AS (SELECT *, row_number() OVER (ORDER BY weight DESC, entity_id) AS rn FROM t)
SELECT a.entity_id AS a_entity_id, b.entity_id AS b_entity_id, a.supergroup AS a_supergroup, b.supergroup AS b_supergroup FROM r a JOIN r b ON a.rn < b.rn AND a.supergroup <> b.supergroup""")
def cross_group_pairs(spark, sf):
    rows = similarity.cross_group_pairs(B.customers(spark, sf).select("entity_id", "supergroup", "weight"))
    return rows.select("a_entity_id", "b_entity_id", "a_supergroup", "b_supergroup")


@query("mean_pair_distance", f"""WITH {B.EM}, r AS (SELECT *, row_number() OVER (ORDER BY vector[1] DESC, entity_id) AS rn FROM em QUALIFY rn <= 50)
SELECT count(*) AS pairs, round(avg(list_distance(a.vector, b.vector)), 6) AS mean_distance FROM r a JOIN r b ON b.rn BETWEEN a.rn + 1 AND a.rn + 9""")
def mean_pair_distance(spark, sf):
    e = B.embeddings(spark, sf).withColumn("weight", F.col("vector")[0])
    return tidy(similarity.mean_pair_distance(e))


@query("spearman", f"""WITH {B.EM}, p AS (SELECT a.entity_id AS id, list_dot_product(a.vector, b.vector) AS x, -abs(a.vector[1] - b.vector[1]) AS y FROM em a JOIN em b ON b.entity_id = a.entity_id + 1),
r AS (SELECT row_number() OVER (ORDER BY x, id) AS rx, row_number() OVER (ORDER BY y, id) AS ry FROM p)
SELECT count(*) AS pairs, round(corr(rx, ry), 6) AS rho, CASE WHEN count(*) < 30 THEN 'skip' WHEN corr(rx, ry) >= 0.25 THEN 'pass' WHEN corr(rx, ry) >= 0.15 THEN 'warn' ELSE 'fail' END AS status FROM r""")
def spearman(spark, sf):
    """Rank correlation of full similarity with closeness on the first axis, over consecutive vectors."""
    from facetry.functions.vectors import dot
    e = B.embeddings(spark, sf)
    pairs = e.select(F.col("entity_id").alias("id"), F.col("vector").alias("a")).join(
        e.select((F.col("entity_id") - 1).alias("id"), F.col("vector").alias("b")), "id")
    scored = pairs.select("id", dot(F.col("a"), F.col("b")).alias("x"), (-F.abs(F.col("a")[0] - F.col("b")[0])).alias("y"))
    return tidy(ordering.spearman(scored, "x", "y", "id"))


@query("rank_no_ties", f"WITH {B.CM} SELECT entity_id, row_number() OVER (ORDER BY lat, entity_id) AS rank FROM cm")
def rank_no_ties(spark, sf):
    return ordering.rank_no_ties(B.customers(spark, sf).select("entity_id", "lat"), "lat", "entity_id").select("entity_id", "rank")


@query("similarity_preserved", f"""WITH {B.SP_COS}, first3 AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT a.*, list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) AS kept
 FROM sp_cos a LEFT JOIN first3 x ON x.vec_id = a_id LEFT JOIN first3 y ON y.vec_id = b_id WHERE cosine > 0.80)
SELECT count(*) AS pairs, count(*) FILTER (WHERE kept IS NULL OR kept <= 0.5) AS lost, count(*) FILTER (WHERE kept IS NULL) AS without_vector, round(coalesce(min(kept), 1.0), 6) AS lowest,
 coalesce(bool_and(coalesce(kept > 0.5, false)), true) AS preserved FROM k""")
def similarity_preserved(spark, sf):
    """Supplier pairs above 0.80 against all vectors of the same number."""
    rows = similarity.similarity_preserved(nb.sparse_rows(B.supplier_profile(spark, sf)), B.embeddings(spark, sf))
    return tidy(rows)


@query("knn_fidelity", f"""WITH {B.EM}, cut AS (SELECT entity_id, vector, vector[1:32] AS part FROM em),
d1 AS (SELECT a.entity_id AS id, b.entity_id AS n FROM cut a JOIN cut b ON a.entity_id <> b.entity_id QUALIFY row_number() OVER (PARTITION BY a.entity_id ORDER BY list_distance(a.vector, b.vector), b.entity_id) <= 15),
d2 AS (SELECT a.entity_id AS id, b.entity_id AS n FROM cut a JOIN cut b ON a.entity_id <> b.entity_id QUALIFY row_number() OVER (PARTITION BY a.entity_id ORDER BY list_distance(a.part, b.part), b.entity_id) <= 15),
j AS (SELECT c.entity_id, (SELECT count(*) FROM d1 JOIN d2 ON d1.id = d2.id AND d1.n = d2.n WHERE d1.id = c.entity_id) AS both_, (SELECT count(*) FROM d1 WHERE d1.id = c.entity_id) AS n1 FROM cut c),
f AS (SELECT both_ / (2 * n1 - both_) AS jac FROM j)
SELECT round(avg(jac), 6) AS mean, round(quantile_cont(jac, 0.5), 6) AS median, round(quantile_cont(jac, 0.1), 6) AS p10, round(quantile_cont(jac, 0.9), 6) AS p90 FROM f""")
def knn_fidelity(spark, sf):
    """How well half of the coordinates keep the 15 nearest neighbours, over all vectors."""
    e = B.embeddings(spark, sf).withColumn("part", F.slice("vector", 1, 32))
    full = nb.knn_join(nb.dense_rows(e, "entity_id", "vector"), 15)
    half = nb.knn_join(nb.dense_rows(e, "entity_id", "part"), 15)
    return tidy(similarity.fidelity_summary(similarity.knn_fidelity(full, half)).select("mean", "median", "p10", "p90"))


# ---------------------------------------------------------------- quality rules

@query("required_fields", """SELECT c_custkey AS entity_id, CASE WHEN n_name IS NULL THEN NULL ELSE n_name END AS "group", 'missing_field' AS rule, 'error' AS severity, 'group' AS detail
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 2 WHERE n_name IS NULL""")
def required_fields(spark, sf):
    n = B.table(spark, sf, "nation").where("n_regionkey <> 2")
    c = B.table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("n_name").alias("group"))
    return quality.required_fields(c, ["entity_id", "name", "group"])


@query("coordinate_range", f"""WITH {B.CM} SELECT entity_id, "group", 'latitude_range' AS rule, 'error' AS severity FROM cm WHERE lat * 1.2 NOT BETWEEN -90 AND 90
UNION ALL SELECT entity_id, "group", 'longitude_range', 'error' FROM cm WHERE lon * 1.1 NOT BETWEEN -180 AND 180""")
def coordinate_range(spark, sf):
    c = B.customers(spark, sf).withColumn("lat", F.col("lat") * 1.2).withColumn("lon", F.col("lon") * 1.1)
    return quality.coordinate_range(c).drop("detail")


def _named_profile(spark, sf):
    return B.customer_profile(spark, sf).join(B.customers(spark, sf).select("entity_id", "group"), "entity_id")


@query("key_rules", f"""WITH {B.PF}, {B.CM}, white AS (SELECT DISTINCT p_brand || '/' || p_type AS feature FROM part WHERE p_brand <> 'Brand#13'),
k AS (SELECT pf.entity_id, "group", feature AS detail, CASE WHEN kind = 'ing' AND feature IN ('Brand#1/SMALL', 'Brand#2/SMALL') THEN 'generic_key' WHEN kind = 'met' AND feature = 'size_0' THEN 'banned_key'
  WHEN kind = 'met' OR feature NOT IN (SELECT feature FROM white) THEN 'unknown_key' END AS rule FROM pf JOIN cm ON cm.entity_id = pf.entity_id)
SELECT entity_id, "group", rule, 'error' AS severity, detail FROM k WHERE rule IS NOT NULL""")
def key_rules(spark, sf):
    return quality.key_rules(_named_profile(spark, sf), whitelist(spark, sf),
                             {"ing": ("Brand#1/SMALL", "Brand#2/SMALL"), "met": ()}, {"ing": (), "met": ("size_0",)})


@query("score_rules", """SELECT user_id AS entity_id, event_type AS "group", event_id, CASE WHEN round(value / 20, 4) IN (0.44, 0.4656, 0.4386, 0.4325, 0.4086, 0.3694, 0.3256, 0.2944, 0.45, 0.35) THEN 'filler_value' ELSE 'score_range' END AS rule
FROM events WHERE round(value / 20, 4) IN (0.44, 0.4656, 0.4386, 0.4325, 0.4086, 0.3694, 0.3256, 0.2944, 0.45, 0.35) OR NOT value / 20 BETWEEN 0 AND 1""")
def score_rules(spark, sf):
    e = B.table(spark, sf, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("group"),
        F.col("event_id").cast("string").alias("feature"), (F.col("value") / 20).cast("string").alias("raw_score"))
    rows = quality.score_rules(e)
    return rows.select("entity_id", "group", F.split("detail", "=")[0].cast("bigint").alias("event_id"), "rule")


_COVER = f"""WITH {B.PF}, {B.CM}, s AS (SELECT entity_id, count(*) FILTER (WHERE score > 0) AS n, count(*) FILTER (WHERE score >= 0.5) AS m, stddev_pop(score) AS sd FROM pf WHERE kind = 'ing' GROUP BY 1),
x AS (SELECT cm.entity_id, "group", coalesce(n, 0) AS n, coalesce(m, 0) AS m, sd FROM cm LEFT JOIN s ON s.entity_id = cm.entity_id),
v AS (SELECT entity_id, "group", 'few_features' AS rule, 'error' AS severity FROM x WHERE n < 20 UNION ALL SELECT entity_id, "group", 'few_strong_features', 'warning' FROM x WHERE m < 10
 UNION ALL SELECT entity_id, "group", 'flat_profile', 'warning' FROM x WHERE n > 0 AND sd < 0.2)
"""


def _coverage(spark, sf):
    return quality.coverage_rules(B.customer_profile(spark, sf), B.customers(spark, sf), min_total=20, min_meaningful=10, min_std=0.2)


@query("coverage_rules", _COVER + "SELECT * FROM v")
def coverage_rules(spark, sf):
    return _coverage(spark, sf).drop("detail")


@query("group_status", _COVER + """, c AS (SELECT "group", count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM v GROUP BY 1), g AS (SELECT "group", count(*) AS members FROM cm GROUP BY 1)
SELECT g."group", members, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, CASE WHEN coalesce(errors, 0) > 0 THEN 'FAIL' WHEN coalesce(warnings, 0) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM g LEFT JOIN c ON c."group" = g."group\"""")
def group_status(spark, sf):
    return quality.group_status(_coverage(spark, sf), B.customers(spark, sf))


_DIM = """dims AS (SELECT DISTINCT p_type AS dimension, p_brand || '/' || p_type AS feature FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3'))"""


def _dimensions(spark, sf):
    p = B.table(spark, sf, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
    return p.select(F.col("p_type").alias("dimension"), F.concat_ws("/", "p_brand", "p_type").alias("feature")).distinct()


@query("dimension_coverage", f"""WITH {B.PF}, {B.CM}, {_DIM}, need AS (SELECT cm.entity_id, "group", dimension FROM cm, (SELECT DISTINCT dimension FROM dims)),
has AS (SELECT DISTINCT entity_id, dimension FROM pf JOIN dims ON dims.feature = pf.feature WHERE score > 0),
miss AS (SELECT entity_id, "group", count(*) AS n, string_agg(dimension, ',' ORDER BY dimension) AS detail FROM need ANTI JOIN has USING (entity_id, dimension) GROUP BY 1, 2)
SELECT entity_id, "group", 'dimension_gap' AS rule, CASE WHEN n >= 2 THEN 'error' ELSE 'warning' END AS severity, detail FROM miss""")
def dimension_coverage(spark, sf):
    return quality.dimension_coverage(B.customer_profile(spark, sf), B.customers(spark, sf), _dimensions(spark, sf))


@query("sparsest_covered", f"""WITH {B.PF}, {B.CM}, {_DIM}, need AS (SELECT cm.entity_id, dimension FROM cm, (SELECT DISTINCT dimension FROM dims)),
has AS (SELECT DISTINCT entity_id, dimension FROM pf JOIN dims ON dims.feature = pf.feature WHERE score > 0),
gaps AS (SELECT entity_id FROM need ANTI JOIN has USING (entity_id, dimension) GROUP BY 1 HAVING count(*) >= 2),
n AS (SELECT entity_id, count(*) FILTER (WHERE score > 0) AS n_features FROM pf GROUP BY 1)
SELECT supergroup, entity_id, n_features, row_number() OVER (PARTITION BY supergroup ORDER BY n_features, name, entity_id) AS rank FROM cm JOIN n USING (entity_id) ANTI JOIN gaps USING (entity_id)
WHERE n_features < 45 QUALIFY rank <= 5""")
def sparsest_covered(spark, sf):
    """The sparsest customers of each region among those that pass the dimension test."""
    from facetry.operators import records

    profile, entities = B.customer_profile(spark, sf), B.customers(spark, sf)
    counts = entities.join(profile.groupBy("entity_id").agg(F.count_if(F.col("score") > 0).alias("n_features")), "entity_id")
    gaps = quality.dimension_coverage(profile, entities, _dimensions(spark, sf)).where("severity = 'error'")
    return tidy(records.sparsest_per_group(counts, "supergroup", 5, 45, gaps).select("supergroup", "entity_id", "n_features", "rank"))


@query("regional_rules", f"""WITH {B.PF}, {B.CM}, rules AS (SELECT 'r' || n_regionkey::VARCHAR AS rule, n_name AS "group", p_brand || '/' || p_type AS feature FROM nation JOIN (SELECT DISTINCT p_brand, p_type FROM part) ON p_brand = 'Brand#' || (n_regionkey + 1)::VARCHAR WHERE p_type IN ('SMALL', 'LARGE'))
SELECT entity_id, "group", rule, 'warning' AS severity FROM (SELECT DISTINCT entity_id, cm."group", rule FROM cm JOIN rules ON rules."group" = cm."group")
ANTI JOIN (SELECT DISTINCT entity_id, rule FROM pf JOIN rules ON rules.feature = pf.feature WHERE score > 0) USING (entity_id, rule)""")
def regional_rules(spark, sf):
    n = B.table(spark, sf, "nation")
    p = B.table(spark, sf, "part").where(F.col("p_type").isin("SMALL", "LARGE")).select("p_brand", "p_type").distinct()
    rules = n.join(p, F.col("p_brand") == F.concat(F.lit("Brand#"), (F.col("n_regionkey") + 1).cast("string"))).select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("rule"), F.col("n_name").alias("group"),
        F.concat_ws("/", "p_brand", "p_type").alias("feature"))
    return quality.regional_rules(B.customer_profile(spark, sf), B.customers(spark, sf), rules).drop("detail")


@query("dataset_rules", """SELECT rule, count(*) AS n FROM (
 SELECT 'duplicate_name' AS rule FROM (SELECT 1 FROM customer GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1)
 UNION ALL SELECT 'vector_size' FROM embeddings WHERE len(embedding) <> 12) GROUP BY 1""")
def dataset_rules(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("group"),
                                              F.array_repeat(F.lit(0.0), 12).alias("vector"), F.array_repeat(F.lit(0.0), 3).alias("xyz"))
    e = B.embeddings(spark, sf).select("entity_id", "name", "group", "vector", F.slice("vector", 1, 3).alias("xyz"))
    rows = quality.dataset_rules(c, "vector", "xyz").unionByName(quality.dataset_rules(e, "vector", "xyz"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("alias_audit", """WITH alias AS (SELECT DISTINCT 'ing' AS kind, p_type AS raw_key, CASE p_type WHEN 'SMALL' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'LARGE' WHEN 'PROMO' THEN 'ECONOMY' WHEN 'ECONOMY' THEN 'PROMO' ELSE p_type END AS canonical FROM part
  UNION SELECT 'ing', p_type, 'bulk' FROM part WHERE p_type = 'SMALL'),
s AS (SELECT * FROM alias WHERE raw_key <> canonical)
SELECT kind, raw_key, 'conflict' AS finding, string_agg(canonical, '|' ORDER BY canonical) AS detail FROM alias GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT a.kind, a.raw_key, CASE WHEN b.canonical = a.raw_key THEN 'cycle' ELSE 'chain' END, a.raw_key || '>' || a.canonical || '>' || b.canonical FROM s a JOIN s b ON b.kind = a.kind AND b.raw_key = a.canonical""")
def alias_audit(spark, sf):
    """Alias rows over part types with a chain, a cycle and a conflict."""
    p = B.table(spark, sf, "part").select("p_type").distinct()
    to = (F.when(F.col("p_type") == "SMALL", "MEDIUM").when(F.col("p_type") == "MEDIUM", "LARGE").when(F.col("p_type") == "PROMO", "ECONOMY")
          .when(F.col("p_type") == "ECONOMY", "PROMO").otherwise(F.col("p_type")))
    alias = p.select(F.lit("ing").alias("kind"), F.col("p_type").alias("raw_key"), to.alias("canonical")).unionByName(
        p.where("p_type = 'SMALL'").select(F.lit("ing").alias("kind"), F.col("p_type").alias("raw_key"), F.lit("bulk").alias("canonical")))
    return quality.alias_audit(alias)


@query("key_audit", """WITH k AS (SELECT DISTINCT event_type AS feature, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'touch' WHEN 'purchase' THEN 'buy' ELSE event_type END AS c FROM events),
p AS (SELECT c, count(*) AS n, count(*) FILTER (WHERE feature = c) AS same, count(*) FILTER (WHERE feature LIKE 'c%' OR feature LIKE 's%') AS broad FROM k GROUP BY 1)
SELECT 'ing' AS kind, sum(n)::BIGINT AS keys, sum(same)::BIGINT AS already_canonical, count(*) FILTER (WHERE n > 1) AS collisions, sum(broad)::BIGINT AS broad_prefix_keys FROM p""")
def key_audit(spark, sf):
    keys = B.table(spark, sf, "events").select(F.lit("ing").alias("kind"), F.col("event_type").alias("feature"))
    return quality.key_audit(keys, alias_table(spark), ("c", "s"))


@query("mapping_quality")
def mapping_quality(spark, sf):
    """Clusters of customer profiles before and after brands are merged into their first digit."""
    profile = reliable(B.customer_profile(spark, sf))
    merged = profile.withColumn("feature", F.regexp_replace("feature", r"^(Brand#[0-9])[0-9]*/", "$1/"))
    return tidy(quality.mapping_quality(profile, merged))


@query("mapping_impact", """WITH b AS (SELECT event_type AS f, count(DISTINCT user_id) AS df FROM events WHERE value > 0 GROUP BY 1),
a AS (SELECT CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'touch' WHEN 'purchase' THEN 'buy' ELSE event_type END AS f, count(DISTINCT user_id) AS df FROM events WHERE value > 0 GROUP BY 1)
SELECT 'before' AS variant, count(*) AS features, count(*) FILTER (WHERE df >= 5) AS supported, sum(df)::BIGINT AS entries FROM b
UNION ALL SELECT 'after', count(*), count(*) FILTER (WHERE df >= 5), sum(df)::BIGINT FROM a""")
def mapping_impact(spark, sf):
    from facetry.functions.keys import with_alias
    e = event_scores(spark, sf)
    plain = e.withColumn("feature", F.lower(F.trim(F.regexp_replace("feature", r"\s", ""))))
    return quality.mapping_impact(plain, with_alias(e, alias_table(spark)))


@query("identical_dishes", """WITH d AS (SELECT c_nationkey AS "group", list_sort([c_mktsegment]) AS d FROM customer), l AS (SELECT "group", d, count(*) AS n FROM d GROUP BY 1, 2)
SELECT "group", count(*) AS lists, sum(n)::BIGINT AS members FROM l GROUP BY 1 HAVING count(*) = 1 AND sum(n) > 1""")
def identical_dishes(spark, sf):
    c = B.table(spark, sf, "customer").select(F.col("c_nationkey").alias("group"), F.array("c_mktsegment").alias("dishes"))
    return quality.identical_dishes(c)


@query("hue_rules", f"""WITH {B.EM}, h AS (SELECT entity_id, name, degrees(atan2(vector[2], vector[1])) + 180 AS hue FROM em),
p AS (SELECT a.name AS a, coalesce(b.name, 'nobody') AS b, least(abs(a.hue - b.hue), 360 - abs(a.hue - b.hue)) AS gap FROM h a LEFT JOIN h b ON b.entity_id = a.entity_id + 1)
SELECT a, b, '<=' AS op, round(gap, 6) AS gap, CASE WHEN gap IS NULL THEN 'skip' WHEN gap <= 90 THEN 'pass' ELSE 'fail' END AS status FROM p""")
def hue_rules(spark, sf):
    """Every vector is expected within 90 degrees of the next one's hue."""
    h = _hues(spark, sf)
    after = h.select((F.col("entity_id") - 1).alias("entity_id"), F.col("name").alias("b"))
    spec = h.join(after, "entity_id", "left").select(F.col("name").alias("a"), F.coalesce("b", F.lit("nobody")).alias("b"),
                                                     F.lit("<=").alias("op"), F.lit(90.0).alias("bound"))
    return tidy(quality.hue_pair_rules(spec, h).drop("bound"))


def _hues(spark, sf):
    e = B.embeddings(spark, sf)
    return e.select("entity_id", "name", "supergroup", "group", (F.degrees(F.atan2(F.col("vector")[1], F.col("vector")[0])) + 180).alias("hue"))


@query("hue_separation", f"""WITH {B.EM}, h AS (SELECT entity_id, supergroup, degrees(atan2(vector[2], vector[1])) + 180 AS hue FROM em), t AS (SELECT *, row_number() OVER (ORDER BY entity_id DESC) AS rn FROM h QUALIFY rn <= 200),
p AS (SELECT least(abs(a.hue - b.hue), 360 - abs(a.hue - b.hue)) AS gap FROM t a JOIN t b ON a.rn < b.rn AND a.supergroup <> b.supergroup)
SELECT count(*) AS pairs, count(*) FILTER (WHERE gap >= 10) AS separated, round(count(*) FILTER (WHERE gap >= 10) / count(*), 6) AS share, count(*) FILTER (WHERE gap >= 10) / count(*) >= 0.8 AS ok FROM p""")
def hue_separation(spark, sf):
    h = _hues(spark, sf).withColumn("weight", F.col("entity_id")).withColumn("supergroup", F.col("supergroup").cast("string"))
    return tidy(quality.separation_share(similarity.cross_group_pairs(h)))


@query("hue_histogram", f"""WITH {B.EM}, h AS (SELECT floor((degrees(atan2(vector[2], vector[1])) + 180) / 20)::BIGINT % 18 AS bucket FROM em), b AS (SELECT unnest(range(18)) AS bucket),
c AS (SELECT b.bucket, count(h.bucket) AS entities FROM b LEFT JOIN h ON h.bucket = b.bucket GROUP BY 1)
SELECT bucket, entities, max(entities) OVER () <= 3 * avg(entities) OVER () AS uniform FROM c""")
def hue_uniformity(spark, sf):
    return hue_histogram(_hues(spark, sf))


@query("rule_sweep", f"""WITH {B.EM}, v AS (SELECT unnest(range(1, 33)) AS variant), h AS (SELECT variant, entity_id, name, degrees(atan2(vector[2 * variant], vector[2 * variant - 1])) + 180 AS hue FROM em, v),
r AS (SELECT a.variant, least(abs(a.hue - b.hue), 360 - abs(a.hue - b.hue)) >= 0.001 AS ok FROM h a JOIN h b ON a.variant = b.variant AND b.entity_id = a.entity_id + 1),
p AS (SELECT variant, count(*) FILTER (WHERE ok) AS held, count(*) AS rules, bool_and(ok) AS ok FROM r GROUP BY 1)
SELECT variant, held, rules, ok, coalesce(variant = (SELECT min(variant) FROM p WHERE ok), false) AS chosen FROM p""")
def rule_sweep(spark, sf):
    """32 colour variants (coordinate pairs) against one rule per consecutive pair of vectors."""
    e = B.embeddings(spark, sf)
    at = lambda i: F.element_at("vector", i)
    hues = e.select("entity_id", "name", "vector", F.explode(F.sequence(F.lit(1), F.lit(32))).alias("variant")).select(
        F.col("variant").cast("bigint").alias("variant"), "name",
        (F.degrees(F.atan2(at(F.col("variant") * 2), at(F.col("variant") * 2 - 1))) + 180).alias("hue"))
    names = e.select("entity_id", F.col("name").alias("a")).join(e.select((F.col("entity_id") - 1).alias("entity_id"), F.col("name").alias("b")), "entity_id")
    rules = names.select("a", "b", F.lit(">=").alias("op"), F.lit(0.001).alias("bound"))
    return quality.rule_sweep(hues, rules)
