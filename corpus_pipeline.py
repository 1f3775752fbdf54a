"""A training corpus from raw documents: toxic texts out, near copies out, benchmark leaks out, sources mixed, rows sharded.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``documents``.  Extra columns pass through.  Null texts and
ids, repeated rows and empty tables are handled as the operators of facetry.llm state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from facetry.llm.common import remove, row_key, scratch, table
from facetry.runtime import checkpoint_dir



def _own(docs: DataFrame, *names: str) -> list[str]:
    """Names for a stage's own columns that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier chain does not call toxic; its sample is drawn from the labelled rows of ``docs``."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"))
    [key] = _own(docs, "_row")
    bad = scored.where("is_toxic").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the group's least id, of several with that id the one with the least key.

    Equal rows with words stand once.  Rows without words are copies of nothing and stay.
    Groups are told apart by their sets, so one id on unrelated texts does not merge them.
    Null ids come last: such rows go if linked with a row that has an id; of a group without ids one row stays.
    """
    key, words = _own(docs, "_row", "_words")
    linked = ngram_join.linked_documents(docs)
    least = linked.where("n_shingles > 0 AND doc_id <=> component_id").groupBy("root").agg(F.min("row_key").alias(key)).select(key, F.lit(True).alias(words))
    other = linked.where("n_shingles = 0").select(F.col("row_key").alias(key), F.lit(False).alias(words)).distinct()
    kept = docs.withColumn(key, row_key()).join(least.unionByName(other), key)
    return kept.where(F.col(words)).dropDuplicates([key]).unionByName(kept.where(~F.col(words))).select(docs.columns)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    [key] = _own(docs, "_row")
    found = decontaminate.contained(docs, table(spark, sf_dir, "benchmark")).select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(found, key, "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: taken words over size, to the nearest whole number; half a text counts as one."""
    key, wants, copy = _own(docs, "_row", "_times", "_copy")
    taken = mixing.mix_sources(docs)
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    # equal rows share a key and lie side by side in the stream: their shares are dealt evenly
    wanted = taken.select(F.col("row_key").alias(key), times.alias("n")).groupBy(key).agg(F.max("n").alias(wants)).where(F.col(wants) > 0)
    return docs.withColumn(key, row_key()).join(wanted, key).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(wants)))).select(docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row that is left."""
    return sharding.shard_rows(docs, 8).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [("toxicity", toxic_out), ("ngram_join", near_copies_out), ("decontamination", leaks_out), ("mixing", mixed), ("sharding", sharded)]

#: The classifier cannot be stated in SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written to the shared folder and read again.

    A stage's own tables go when its result is written, and so does its predecessor's result.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{root}/{name}")
        if before:
            remove(spark, f"{root}/{before}")
        docs, before = spark.read.schema(out.schema).parquet(f"{root}/{name}"), name
    return docs
