"""What the operators of this folder share: row keys, words, shards of a table, stored intermediate tables."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.runtime import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the contracts: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def row_key() -> Column:
    """64-bit name of a row by its id and text: rows that share it are interchangeable copies.

    Ids may be null or repeated, so an id alone cannot carry a result back to its row.
    """
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col("text").isNull(), text_of())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


#: Folders that ``stored`` has written since ``scratch`` was entered, for each open ``scratch``.
_open: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever storage holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that ``stored`` wrote inside; what is to stay must be written elsewhere by then."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage as a checkpoint does, but compressed and columnar; any
    executor may be lost afterwards.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _open:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a bitmap over 64-bit keys: a fixed 4 MB, whatever the data.
BITMAP = 1 << 25


def bitmap(rows: DataFrame, key: str):
    """Broadcast bitmap with the bits of all keys set, built by a partial bit_or.

    It spares rows without partner a shuffle; rows whose bit is set by chance only cost
    that shuffle, so a full bitmap is slower and never wrong.
    """
    bit = F.pmod(key, F.lit(BITMAP))
    words = rows.select(F.shiftright(bit, 5).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({key}, {BITMAP}) % 32 AS INT))").alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(BITMAP >> 5, np.uint32)
    bits[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return rows.sparkSession.sparkContext.broadcast(bits)


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % BITMAP
    return (bits[at >> 5] >> (at % 32).astype(np.uint32) & np.uint32(1)).astype(bool)


def arrays(batches: Iterator, *names: str) -> Iterator[tuple]:
    """Columns of each Arrow batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)) for n in names)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
