"""Queries of the operators whose results SQL can state, or that tests hold against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import decontaminate, licenses, mixing, sharding, topk, urls
from facetry.llm.common import table
from facetry.llm.registry import query


def _round_sql(x: str, r: int) -> str:
    """The round function of the Feistel steps over a 32-bit number."""
    h = f"((({x}) + {sharding.ROUND_ADD[r] & 0x7FFFFFFF}) * {sharding.MULTIPLY[0]} & 4294967295)"
    g = f"(xor({h}, {h} >> 15) * {sharding.MULTIPLY[1]} & 4294967295)"
    return f"xor({g}, {g} >> 13)"


def _feistel_sql(source: str, where: str) -> str:
    """One step: (id, p) of ``source`` to (id, p), the four rounds as nested selects."""
    s = f"SELECT id, a, b, n, p // b AS l, p % b AS r FROM {source} WHERE {where}"
    for i in range(4):
        s = (f"SELECT id, a, b, n, (l + {_round_sql('r', i)}) % a AS l, r FROM ({s})" if i % 2 == 0 else
             f"SELECT id, a, b, n, l, (r + {_round_sql('l', i)}) % b AS r FROM ({s})")
    return f"SELECT id, a, b, n, l * b + r AS p FROM ({s})"


CRC_TABLE = """
crc_steps AS (SELECT i::BIGINT AS i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v FROM range(256) t(i)),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps)"""

SHARD_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
bytes AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM documents),
keyed AS (SELECT doc_id, text, len(b)::BIGINT + 1 AS size, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM bytes, crc_table),
counted AS (SELECT *, count(*) OVER ()::BIGINT AS n, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id FROM keyed),
sides AS (SELECT *, ceil(sqrt(n))::BIGINT AS a, ceil(n / ceil(sqrt(n)))::BIGINT AS b FROM counted),
walk AS (
  {_feistel_sql("(SELECT id, a, b, n, id AS p FROM sides)", "true")}
  UNION ALL
  {_feistel_sql("walk", "p >= n")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 8)::INT AS shard, p // 8 AS slot, NULL::INT AS grown_shard
FROM counted JOIN walk USING (id) WHERE p < counted.n
"""


@query("op2_feistel_sharding", SHARD_SQL)
def feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""


@query("op5_uniform_threshold_topk", TOPK_SQL)
def uniform_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, 10)


def captures(pages: DataFrame) -> DataFrame:
    """Captures of the pages; the table has no fetch time, so the id sets a day of 2024."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.expr("date_add(DATE '2024-01-01', cast(pmod(page_id * 37, 365) AS INT))").alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages; digits of the host's digest set days and actions."""
    hosts = pages.select(urls.host_of(F.coalesce("url", F.lit(""))).alias("host")).where("host <> ''").distinct()
    digit = lambda i: f"cast(conv(substr(md5(host), {4 * i + 1}, 4), 16, 10) AS INT)"
    rows = [("host", "'block'", f"{digit(0)} % 180", f"{digit(0)} % 3 = 0"), ("host", "'remove'", f"180 + {digit(1)} % 90", f"{digit(0)} % 3 = 0"),
            ("host", "'block'", f"280 + {digit(1)} % 60", f"{digit(0)} % 3 = 0"),
            ("regexp_replace(host, '^[^.]+[.]', '')", "'block'", f"{digit(2)} % 365", f"{digit(2)} % 5 = 0"),
            ("concat(host, '/en')", "'allow'", f"{digit(1)} % 200", f"{digit(1)} % 2 = 0"),
            ("concat(host, '/fr')", "'block'", f"{digit(2)} % 300", "true")]
    every = None
    for pattern, action, day, when in rows:
        part = hosts.where(F.expr(when)).select(F.expr(pattern).alias("pattern"), F.expr(action).alias("action"), F.expr(f"date_add(DATE '2024-01-01', {day})").alias("day"))
        every = part if every is None else every.unionByName(part)
    return every


def _digit_sql(i: int) -> str:
    return f"('0x' || substr(md5(host), {4 * i + 1}, 4))::INT"


URL_SQL = f"""
WITH c AS (SELECT page_id AS capture_id, url, DATE '2024-01-01' + (page_id * 37 % 365)::INT AS fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\\.$', '') AS host,
    regexp_extract(coalesce(url, ''), '^(?i:https?)://[^/?#]*(/[^/?#]+)', 1) AS folder FROM pages),
hosts AS (SELECT DISTINCT host FROM c WHERE host <> ''),
entries AS (
  SELECT host AS pattern, 'block' AS action, DATE '2024-01-01' + {_digit_sql(0)} % 180 AS day FROM hosts WHERE {_digit_sql(0)} % 3 = 0
  UNION ALL SELECT host, 'remove', DATE '2024-01-01' + (180 + {_digit_sql(1)} % 90) FROM hosts WHERE {_digit_sql(0)} % 3 = 0
  UNION ALL SELECT host, 'block', DATE '2024-01-01' + (280 + {_digit_sql(1)} % 60) FROM hosts WHERE {_digit_sql(0)} % 3 = 0
  UNION ALL SELECT regexp_replace(host, '^[^.]+[.]', ''), 'block', DATE '2024-01-01' + {_digit_sql(2)} % 365 FROM hosts WHERE {_digit_sql(2)} % 5 = 0
  UNION ALL SELECT host || '/en', 'allow', DATE '2024-01-01' + {_digit_sql(1)} % 200 FROM hosts WHERE {_digit_sql(1)} % 2 = 0
  UNION ALL SELECT host || '/fr', 'block', DATE '2024-01-01' + {_digit_sql(2)} % 300 FROM hosts),
days AS (SELECT pattern, day, max(action) AS action FROM entries GROUP BY 1, 2),
valid AS (SELECT pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to FROM days),
hits AS (
  SELECT capture_id, url, fetched, pattern, action,
         row_number() OVER (PARTITION BY capture_id ORDER BY len(string_split(pattern, '.')) * 2 + contains(pattern, '/')::INT DESC, pattern DESC) AS r,
         count(*) OVER (PARTITION BY capture_id) AS n
  FROM c JOIN valid ON action <> 'remove' AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
    AND (host = split_part(pattern, '/', 1) OR ends_with(host, '.' || split_part(pattern, '/', 1)))
    AND len(string_split(split_part(pattern, '/', 1), '.')) >= 2
    AND (NOT contains(pattern, '/') OR folder = '/' || split_part(pattern, '/', 2)))
SELECT c.capture_id, c.url, c.fetched, coalesce(n, 0) AS n_active, pattern, coalesce(action, 'none') AS verdict
FROM c LEFT JOIN hits ON hits.capture_id = c.capture_id AND r = 1
"""


@query("op6_temporal_url_lists", URL_SQL)
def temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filter_urls(captures(pages), list_entries(pages), least_labels=2)  # the SQL's limit


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM s0),
s2 AS (SELECT *, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top,
         sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s1),
s3 AS (SELECT *, CASE WHEN weight * top <= 200 * source_size * rest THEN top::DOUBLE / (100 * rest)::DOUBLE END AS level FROM s2),
lv AS (SELECT level FROM s3 WHERE level IS NOT NULL ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
s AS (SELECT source, source_size, least(weight * (SELECT level FROM lv), 2.0::DOUBLE * source_size) AS target, greatest(1, ceil(source_size / 128))::BIGINT AS blocks FROM s3),
r0 AS (SELECT source, round(target)::BIGINT AS share FROM s WHERE round(target) > 0),
r AS (SELECT source, sum(share) OVER (ORDER BY source NULLS LAST)::BIGINT AS high, sum(share) OVER (ORDER BY source NULLS LAST)::BIGINT - share AS low, sum(share) OVER ()::BIGINT AS total FROM r0),
slots AS (SELECT i AS slot, floor((i * 2654435769 % 4294967296)::DOUBLE / 4294967296.0::DOUBLE * t::DOUBLE)::BIGINT AS pos
  FROM (SELECT max(total) AS t, unnest(range((max(total) + 127) // 128)) AS i FROM r)),
chosen AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank FROM slots JOIN r ON pos >= low AND pos < high),
takes AS (SELECT c.source, rank % blocks AS block, count(*) AS times FROM chosen c JOIN s ON s.source IS NOT DISTINCT FROM c.source WHERE rank < 2 * blocks GROUP BY 1, 2),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
pieces AS (SELECT doc_id, source, size, start, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS block FROM p WHERE size > 0),
got AS (SELECT q.doc_id, q.source, q.size, start, coalesce(sum((least(start + size, (q.block + 1) * 128) - greatest(start, q.block * 128)) * times), 0)::BIGINT AS taken
  FROM pieces q LEFT JOIN takes t ON t.source IS NOT DISTINCT FROM q.source AND t.block = q.block GROUP BY ALL),
every AS (SELECT doc_id, source, size, taken FROM got UNION ALL SELECT doc_id, source, size, 0 FROM d WHERE size = 0)
SELECT doc_id, size, e.source, source_size, target, taken FROM every e JOIN s ON s.source IS NOT DISTINCT FROM e.source
"""


@query("op8_golden_ratio_mix", MIX_SQL)
def golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


LEAK_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM w WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
SELECT doc_id, item_id, n_item, count(*) AS n_found FROM ds JOIN bs USING (g) JOIN n USING (item_id) GROUP BY ALL HAVING count(*) * 100 >= 75 * n_item
"""


@query("op10_containment_decontamination", LEAK_SQL)
def containment_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_item", "n_found")


@query("op4_license_rules")
def license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))
