"""Profiles and entity tables over the star schema, each with the SQL that defines it.

PF  customer profile     entity o_custkey, features brand/type (ing) and size class (met)
SP  supplier profile     the same by l_suppkey
CM  customers            name, group = nation, super-group = region, weight, position
SM  suppliers            the same
EM  embeddings           vector, super-group = label
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(rows: DataFrame) -> DataFrame:
    """Quantity per (entity, kind, feature), scaled by the entity's largest of that kind."""
    pairs = F.array(
        F.struct(F.lit("ing").alias("kind"), F.concat_ws("/", "p_brand", "p_type").alias("feature")),
        F.struct(F.lit("met").alias("kind"), F.concat(F.lit("size_"), F.expr("p_size div 10").cast("string")).alias("feature")))
    sums = rows.select("entity_id", "l_quantity", F.explode(pairs).alias("f")).groupBy(
        "entity_id", F.col("f.kind").alias("kind"), F.col("f.feature").alias("feature")).agg(F.sum("l_quantity").alias("q"))
    best = F.max("q").over(Window.partitionBy("entity_id", "kind"))
    return sums.withColumn("score", F.col("q") / best).drop("q")


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return _scored(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(
        p, F.col("l_partkey") == F.col("p_partkey")).withColumn("entity_id", F.col("o_custkey")))


def supplier_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = (table(spark, sf_dir, t) for t in ("lineitem", "part"))
    return _scored(li.join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("entity_id", F.col("l_suppkey")))


def _position(key: str, weight: str) -> tuple[Column, Column]:
    """Invented positions: spread over the globe, without ties between distances."""
    lat = (F.pmod(F.col(key) * 37, F.lit(181)) - 90) * 0.98 + F.col(weight) / 1e6
    lon = (F.pmod(F.col(key) * 73, F.lit(361)) - 180) * 0.98 + F.col(weight) / 2e6
    return lat, lon


def _entities(rows: DataFrame, spark: SparkSession, sf_dir: str, prefix: str, key: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    weight = f"{prefix}_acctbal"
    lat, lon = _position(key, weight)
    return rows.join(n, F.col(f"{prefix}_nationkey") == F.col("n_nationkey")).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col(key).alias("entity_id"), F.col(f"{prefix}_name").alias("name"), F.col("n_name").alias("group"),
        F.col("r_name").alias("supergroup"), F.col(weight).alias("weight"), lat.alias("lat"), lon.alias("lon"),
        *([F.col("c_mktsegment").alias("segment")] if prefix == "c" else []))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(table(spark, sf_dir, "customer"), spark, sf_dir, "c", "c_custkey")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(table(spark, sf_dir, "supplier"), spark, sf_dir, "s", "s_suppkey")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("entity_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"),
                    F.pmod("vec_id", F.lit(25)).alias("group"), F.col("label").cast("bigint").alias("supergroup"),
                    F.col("embedding").cast("array<double>").alias("vector"))


def _profile_sql(name: str, entity: str, source: str) -> str:
    return f"""
{name}_q AS (
  SELECT {entity} AS entity_id, 'ing' AS kind, p_brand || '/' || p_type AS feature, sum(l_quantity) AS q FROM {source} GROUP BY 1, 2, 3
  UNION ALL
  SELECT {entity}, 'met', 'size_' || (p_size // 10)::VARCHAR, sum(l_quantity) FROM {source} GROUP BY 1, 2, 3),
{name} AS (SELECT entity_id, kind, feature, q / max(q) OVER (PARTITION BY entity_id, kind) AS score FROM {name}_q)"""


PF = _profile_sql("pf", "o_custkey", "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
SP = _profile_sql("sp", "l_suppkey", "lineitem JOIN part ON l_partkey = p_partkey")


def _entity_sql(name: str, source: str, prefix: str, key: str, extra: str = "") -> str:
    return f"""
{name} AS (
  SELECT {key} AS entity_id, {prefix}_name AS name, n_name AS "group", r_name AS supergroup, {prefix}_acctbal AS weight,
         (({key} * 37) % 181 - 90) * 0.98::DOUBLE + {prefix}_acctbal / 1e6 AS lat,
         (({key} * 73) % 361 - 180) * 0.98::DOUBLE + {prefix}_acctbal / 2e6 AS lon{extra}
  FROM {source} JOIN nation ON {prefix}_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


CM = _entity_sql("cm", "customer", "c", "c_custkey", ", c_mktsegment AS segment")
SM = _entity_sql("sm", "supplier", "s", "s_suppkey")
EM = """
em AS (SELECT vec_id AS entity_id, 'v' || vec_id::VARCHAR AS name, vec_id % 25 AS "group", label::BIGINT AS supergroup,
              embedding::DOUBLE[] AS vector FROM embeddings)"""
# All pairs, for the reference result only.
SP_COS = SP + """,
sp_n AS (SELECT entity_id, sqrt(sum(score * score)) AS norm FROM sp GROUP BY 1),
sp_cos AS (SELECT a.entity_id AS a_id, b.entity_id AS b_id, sum(a.score * b.score) / (any_value(na.norm) * any_value(nb.norm)) AS cosine
  FROM sp a JOIN sp b ON a.kind = b.kind AND a.feature = b.feature AND a.entity_id < b.entity_id
  JOIN sp_n na ON na.entity_id = a.entity_id JOIN sp_n nb ON nb.entity_id = b.entity_id GROUP BY 1, 2)"""
EM_KNN = EM + """,
em_cos AS (SELECT a.entity_id AS id, b.entity_id AS neighbour_id, list_dot_product(a.vector, b.vector)
    / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector))) AS value,
    a.supergroup AS sa, b.supergroup AS sb
  FROM em a JOIN em b ON a.entity_id <> b.entity_id),
em_knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, neighbour_id) AS rank FROM em_cos
  QUALIFY rank <= 10)"""
