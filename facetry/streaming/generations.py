"""Compaction of batch stores: many batch partitions become one generation, named by a manifest that is written last.

Below a root, batch N of a store lies in ``<store>/batch_id=N``.  A generation holds the rows
of all batches up to some number in ``_generations/<name>/<store>``; ``_manifests/<n>`` names
it.  Readers take the newest finished manifest, its generation and the batches above its
number, so they see the state before or after a compaction, never one in between: a run that
dies leaves a folder that no manifest names.  ``vacuum`` removes what no reader needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class State:
    """The newest finished manifest: its number, the folder of its generation and the last batch in it."""

    number: int
    folder: str | None
    upto: int


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def state(spark: SparkSession, root: str) -> State:
    done = [n for n in _children(spark, f"{root}/_manifests") if exists(spark, f"{root}/_manifests/{n}/_SUCCESS")]
    if not done:
        return State(-1, None, -1)
    row = spark.read.schema("generation string, upto bigint").json(f"{root}/_manifests/{done[-1]}").first()
    return State(int(done[-1]), f"{root}/_generations/{row['generation']}", row["upto"])


def batches(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of a store's batch folders."""
    store = f"{root}/{name}" if name else root
    return sorted(int(c.split("=")[1]) for c in _children(spark, store) if c.startswith("batch_id="))


def read(spark: SparkSession, root: str, name: str, schema: str | None = None, now: State | None = None) -> DataFrame | None:
    """A store's rows with their ``batch_id``: the generation and the batches since.  None (no schema) or no rows before the first."""
    now = now or state(spark, root)
    store = f"{root}/{name}" if name else root
    newer = [f"{store}/batch_id={n}" for n in batches(spark, root, name) if n > now.upto]
    full = f"{schema}, batch_id bigint" if schema else None
    load = spark.read.schema(full) if full else spark.read
    out = load.parquet(f"{now.folder}/{name or 'rows'}") if now.folder else None
    if newer:
        rows = load.option("basePath", store).parquet(*newer)
        rows = rows.withColumn("batch_id", F.col("batch_id").cast("bigint"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], full) if out is None and full else out


def compact(spark: SparkSession, root: str, stores: Mapping[str, tuple[str | None, Callable[[DataFrame], DataFrame] | None]], upto: int | None = None) -> State:
    """Rewrite all batches up to ``upto`` (by default the last one that every store has finished) as one generation.

    ``stores`` maps a name ('' for a root that is a store itself) to its schema and what
    becomes of its rows, such as keeping the newest of each key.  The manifest comes last.
    """
    now = state(spark, root)
    if upto is None:
        done = [{n for n in batches(spark, root, name) if exists(spark, f"{root}/{name}/batch_id={n}/_SUCCESS")} for name in stores]
        common = set.intersection(*done) if done else set()
        upto = max(common, default=now.upto)
    if upto <= now.upto:
        return now
    generation = f"{now.number + 1:08d}-{uuid.uuid4().hex[:8]}"
    for name, (schema, rewrite) in stores.items():
        rows = read(spark, root, name, schema, now)
        if rows is not None:
            rows = rows.where(F.col("batch_id") <= upto)
            (rewrite(rows) if rewrite else rows).write.parquet(f"{root}/_generations/{generation}/{name or 'rows'}")
    note = spark.range(1).select(F.lit(generation).alias("generation"), F.lit(upto).cast("bigint").alias("upto"))
    note.coalesce(1).write.json(f"{root}/_manifests/{now.number + 1:08d}")
    return state(spark, root)


def vacuum(spark: SparkSession, root: str, names: list[str]) -> int:
    """Remove batches that the newest generation holds, older generations and folders of runs that died; call it when no older reader is left."""
    now = state(spark, root)
    gone = [f"{root}/{name}/batch_id={n}" if name else f"{root}/batch_id={n}" for name in names for n in batches(spark, root, name) if n <= now.upto]
    gone += [f"{root}/_generations/{g}" for g in _children(spark, f"{root}/_generations") if f"{root}/_generations/{g}" != now.folder]
    for path in gone:
        fs, where = _path(spark, path)
        fs.delete(where, True)
    return len(gone)
