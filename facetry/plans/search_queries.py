"""Queries on search, payload validation and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from facetry.operators import ordering, quality, terms
from facetry.plans import bindings as B
from facetry.plans import search
from facetry.plans.registry import query, tidy
from facetry.runtime import checkpoint_dir
from facetry.streaming import incremental as inc


@query("name_search", """SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'reti') OR contains(strip_accents(lower(source)), 'reti') ORDER BY doc_id LIMIT 8""")
def name_search(spark, sf):
    """First eight documents that contain a word part, whatever its case and accents."""
    return search.name_search(B.table(spark, sf, "documents"), "Rétì", ["text", "source"], "doc_id").select("doc_id")


@query("name_search_all", """SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'reti')""")
def name_search_all(spark, sf):
    return search.name_search(B.table(spark, sf, "documents"), "reti", ["text"], "doc_id", None).select("doc_id")


def _score_sql(field: str, words: list[str]) -> str:
    parts = []
    for w in words:
        d = terms.allowed_edits(w)
        parts.append(f"coalesce(list_max([CASE WHEN damerau_levenshtein(t, '{w}') <= {d} THEN 1 - damerau_levenshtein(t, '{w}') / {float(len(w))} ELSE 0.0 END FOR t IN "
                     f"list_filter(string_split_regex(lower({field}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')]), 0.0)")
    return " + ".join(parts)


_RANKED = f"""WITH s AS (SELECT p_partkey, greatest({_score_sql('p_name', ['samll', 'gizmoo'])}, {_score_sql('p_brand', ['samll', 'gizmoo'])}, {_score_sql('p_type', ['samll', 'gizmoo'])}) AS score FROM part)
"""
FIELDS = ["p_name", "p_brand", "p_type"]


@query("ranked_search", _RANKED + "SELECT p_partkey, round(score, 6) AS score FROM s WHERE score > 0")
def ranked_search(spark, sf):
    """Parts that match two misspelt words, with their score."""
    return tidy(search.ranked_search(B.table(spark, sf, "part"), "samll gizmoo", FIELDS, "p_partkey").select("p_partkey", "score"))


def _keys_score_sql(words: list[str]) -> str:
    return " + ".join(f"max(CASE WHEN damerau_levenshtein(t, '{w}') <= {terms.allowed_edits(w)} THEN 1 - damerau_levenshtein(t, '{w}') / {float(len(w))} ELSE 0.0 END)" for w in words)


_FEATURE_SEARCH = f"""WITH {B.PF}, f AS (SELECT entity_id, unnest(string_split_regex(lower(feature), '[^a-z0-9]+')) AS t FROM pf WHERE kind = 'ing'),
s AS (SELECT entity_id, {_keys_score_sql(['ecnomy', 'brnad', '31'])} AS score FROM f WHERE t <> '' GROUP BY 1)
SELECT entity_id, round(score, 6) AS score FROM s WHERE score > 0"""


@query("feature_search", _FEATURE_SEARCH)
def feature_search(spark, sf):
    """Customers whose score maps hold features near three words."""
    from facetry.operators.profiles import profile_map

    rows = profile_map(B.customer_profile(spark, sf), "ing")
    return tidy(search.ranked_search(rows, "ecnomy brnad 31", ["scores"], "entity_id").select("entity_id", "score"))


@query("indexed_search", _RANKED + "SELECT p_partkey, round(score, 6) AS score FROM s WHERE score > 0")
def indexed_search(spark, sf):
    """The ranked search over a dictionary that was written beforehand."""
    index = terms.SearchIndex.build(B.table(spark, sf, "part"), FIELDS, "p_partkey", f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    return tidy(index.scores(["samll", "gizmoo"]))


@query("search_page", _RANKED + "SELECT part.p_partkey, p_name FROM part JOIN s USING (p_partkey) WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 20 OFFSET 20")
def search_page(spark, sf):
    rows, _ = search.search_page(B.table(spark, sf, "part"), "samll gizmoo", FIELDS, 20, 20, ["p_name"], id_col="p_partkey")
    return rows


@query("sorted_page", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40")
def sorted_page(spark, sf):
    rows, _ = search.search_page(B.table(spark, sf, "part"), None, FIELDS, 20, 40, ["p_name"], ["-p_retailprice"], "p_partkey")
    return rows


@query("page_stats", _RANKED + "SELECT count(*) AS total, 2::BIGINT AS page, ceil(count(*) / 20)::BIGINT AS total_pages FROM s WHERE score > 0")
def page_stats(spark, sf):
    found = search.ranked_search(B.table(spark, sf, "part"), "samll gizmoo", FIELDS, "p_partkey")
    return ordering.page_stats(found, 20, 20)


@query("prefix_search", r"""SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '' AND starts_with(t, 'ther'))) > 0""")
def prefix_search(spark, sf):
    return search.prefix_search(B.table(spark, sf, "documents"), "Ther", ["text"]).select("doc_id")


@query("get_by_id", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 17")
def get_by_id(spark, sf):
    return search.get_by_id(B.table(spark, sf, "part"), 17, "p_partkey").select("p_partkey", "p_name")


def payloads(spark, sf):
    """One answer document per customer made of its profile; richer customers lack a timestamp."""
    from facetry.operators.profiles import profile_map

    profile = B.customer_profile(spark, sf)
    ing = profile_map(profile, "ing").withColumnRenamed("scores", "ingredients")
    met = profile_map(profile, "met").withColumnRenamed("scores", "cookingMethods")
    rows = B.customers(spark, sf).join(ing, "entity_id").join(met, "entity_id")
    stamp = F.when(F.col("weight") < 8000, F.lit("2024-01-01T00:00:00Z"))
    city = F.struct(F.col("entity_id").cast("string").alias("id"), "name", "ingredients", "cookingMethods",
                    F.array("segment").alias("famousDishes"), stamp.alias("extendedAt"))
    return rows.select(F.col("entity_id").alias("payload_id"), F.to_json(F.struct(F.array(city).alias("cities"))).alias("payload"))


@query("payload_rules", f"""WITH {B.PF}, {B.CM}, top AS (SELECT * FROM pf WHERE score >= 0.05 QUALIFY row_number() OVER (PARTITION BY entity_id, kind ORDER BY score DESC) <= CASE kind WHEN 'ing' THEN 35 ELSE 12 END),
c AS (SELECT entity_id, count(*) AS n, count(*) AS kept, count(*) FILTER (WHERE score BETWEEN 0.45 AND 0.55) AS flat FROM top GROUP BY 1)
SELECT cm.entity_id AS payload_id, 'missing_timestamp' AS rule FROM cm JOIN c USING (entity_id) WHERE weight >= 8000
UNION ALL SELECT entity_id, 'too_many_keys' FROM c WHERE n > 60 UNION ALL SELECT entity_id, 'too_flat' FROM c WHERE flat >= 0.5 * kept""")
def payload_rules(spark, sf):
    cities, _, _ = inc.parse_payloads(payloads(spark, sf))
    rows = quality.payload_rules(cities)
    return rows.select(F.split("entity_id", "#")[0].cast("bigint").alias("payload_id"), "rule")


@query("latest_event_per_user", """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_event_per_user(spark, sf):
    """Events read as a file stream; newest record per user from the written state."""
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    schema = B.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    inc.latest_stream(stream, "user_id", "ts", f"{root}/state", f"{root}/checkpoint", id_col="event_id").awaitTermination()
    rows = inc.latest_table(spark, f"{root}/state", "user_id", "ts", "event_id")
    return tidy(rows.select("user_id", "event_id", "event_type", "value"))


@query("latest_compacted", """SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_compacted(spark, sf):
    """Newest event per user from a store that was compacted between two runs of the stream."""
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    events = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    schema = events.schema
    late = F.xxhash64("event_id") % 2 == 0
    for part, rows in enumerate((events.where(late), events.where(~late))):
        rows.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
        inc.latest_stream(stream, "user_id", "ts", f"{root}/state", f"{root}/checkpoint", id_col="event_id").awaitTermination()
        inc.compact_latest(spark, f"{root}/state", "user_id", "ts", "event_id")
    return tidy(inc.latest_table(spark, f"{root}/state", "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value"))


@query("extend_records")
def extend_records(spark, sf):
    """Payload stream validated, canonicalised and stored; rows per store."""
    root = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    payloads(spark, sf).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("payload_id bigint, payload string").parquet(f"{root}/in")
    alias = spark.createDataFrame([("met", "size_0", "size_small")], "kind string, raw_key string, canonical string")
    catalog = spark.createDataFrame([], "kind string, feature string")
    stores = inc.Stores(f"{root}/out")
    inc.extend_stream(stream, stores, alias, catalog, f"{root}/checkpoint").awaitTermination()
    out = None
    for name, schema in (("entities", inc.CITY_FIELDS), ("scores", "entity_id string, kind string, feature string, score double"),
                         ("catalog", "kind string, feature string"), ("rejected", "payload_id bigint, payload string, reason string")):
        rows = inc.read_store(spark, stores, name, schema).agg(F.count(F.lit(1)).alias("n")).withColumn("store", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
