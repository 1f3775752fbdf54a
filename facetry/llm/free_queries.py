"""Queries of the operators that run numpy inside tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import language_model, near_vectors, ngram_join, periodic_runs, repeats, token_alignment, toxicity
from facetry.llm.common import table
from facetry.llm.native_queries import CRC_TABLE
from facetry.llm.registry import query

LINK_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query("op3_prefix_tree_join", LINK_SQL)
def prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_documents(table(spark, sf_dir, "documents")).drop("row_key", "root")


@query("op9_prefix_free_repeats")
def prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op1_elias_fano_lm")
def elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


@query("op7_toxicity_chain")
def toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.drop("row_key").withColumns({c: F.round(c, 6) for c in ("p_low_quality", "p_toxic")})


RUN_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT row, doc_id, w, len(w)::BIGINT AS n, coalesce(xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295), 1) AS h FROM d, crc_table),
a AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM h),
x AS (SELECT row, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) ELSE w END AS w FROM a),
g AS (SELECT row, i, array_to_string(w[i:i + 5], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - 4)) AS i FROM x WHERE len(w) >= 6)),
m AS (SELECT a.row, a.i, b.i - a.i AS q FROM g a JOIN g b ON a.row = b.row AND a.g = b.g AND a.i < b.i),
s AS (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM m),
t AS (SELECT row, q, min(i) - 1 AS start, max(i) - min(i) + 6 + q AS length FROM s GROUP BY row, q, k HAVING max(i) - min(i) + 6 + q >= greatest(12, 2 * q)),
runs AS (SELECT row, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period FROM t GROUP BY 1, 2, 3),
r AS (SELECT row, count(*) AS n_runs, list({{'l': -length, 's': start, 'p': period}} ORDER BY -length, start, period)[1] AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
words AS (SELECT row, unnest(range(len(w))) AS i, unnest(w) AS w FROM x SEMI JOIN runs USING (row)),
kept AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s AS start, -best.l AS length, best.p AS period, (1000 * -best.l // best.p)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, array_to_string(w, ' '))) AS collapsed_sha256
FROM x LEFT JOIN r USING (row) LEFT JOIN kept USING (row)
"""


@query("op11_periodic_runs", RUN_SQL)
def periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))))


NEAR_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.row AS a, b.row AS b FROM good a JOIN good b ON a.row <> b.row AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT row, row AS other FROM v UNION SELECT r.row, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT r.row, min(o.vec_id) AS component_id FROM r JOIN v o ON o.row = r.other GROUP BY 1),
n AS (SELECT a AS row, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (row) LEFT JOIN n USING (row)
"""


@query("op12_near_vectors", NEAR_SQL)
def near_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


@query("op13_token_alignment")
def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_links(table(spark, sf_dir, "documents"))
