"""Exact top-k inner products by the three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.llm.common import arrays, stored

PACKED = "node int, pack long, n int, width int, ids binary, parts binary"
PARTIAL = "query long, object long, node int, score long"
#: Keys that a node's packs are spread over; query packs are copied once a key, so they move in proportion to their number.
GROUPS = 64


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and x = floor(scale * component) of the rows whose vector is whole and finite."""
    wide = F.transform(F.col(vector), lambda v: v.cast("double"))
    whole = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(whole).select(F.col(key).alias("vec_id"), F.transform(wide, lambda v: F.floor(v * scale).cast("bigint")).alias("x"))


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _pack(width: int, nodes: int, rows: int):
    """Each ``rows`` of (id, x) at most as one packed row for every node, which holds one stretch of the components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in arrays(_cut(batches, rows), "id", "x"):
            ids, flat = ids.to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(x.offsets.to_numpy())
            full = np.zeros((len(ids), width), np.int64)
            at = np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            full[at] = flat
            for node, part in enumerate(np.array_split(full, nodes, axis=1)):
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([node], pa.int32()), "pack": pa.array([int(ids[0])], pa.int64()), "n": pa.array([len(ids)], pa.int32()),
                    "width": pa.array([part.shape[1]], pa.int32()), "ids": [ids.tobytes()], "parts": [np.ascontiguousarray(part).tobytes()]})
    return run


def _partial(n, width, ids, parts, qn, qids, qparts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the first query, queries, objects, their partial scores), 512 queries at a time."""
    objects = np.frombuffer(parts, np.int64).reshape(n, width)
    asked = np.frombuffer(qparts, np.int64).reshape(qn, width)
    most = float(np.abs(objects).max(initial=0)) * float(np.abs(asked).max(initial=0)) * max(1, width)
    exact = most < 2 ** 53  # every sum is a whole number that a double holds
    turned = objects.T.astype(float) if exact else objects.T
    for a in range(0, qn, 512):
        part = asked[a:a + 512]
        scores = (part.astype(float) @ turned).astype(np.int64) if exact else part @ turned
        yield a, np.frombuffer(qids, np.int64)[a:a + 512], np.frombuffer(ids, np.int64), scores


def _local_lists(k: int):
    """Phase one at a node: the k best partial scores of every query in every pack."""
    def run(batches):
        for node, n, w, ids, parts, qn, qids, qparts in arrays(batches, "node", "n", "width", "ids", "parts", "qn", "qids", "qparts"):
            for i in range(len(node)):
                for _, q, o, s in _partial(n[i].as_py(), w[i].as_py(), ids[i].as_py(), parts[i].as_py(), qn[i].as_py(), qids[i].as_py(), qparts[i].as_py()):
                    best = np.argpartition(-s, min(k, len(o)) - 1, axis=1)[:, :k]
                    yield pa.RecordBatch.from_pydict({
                        "query": np.repeat(q, best.shape[1]), "object": o[best].ravel(),
                        "node": np.full(best.size, node[i].as_py(), np.int32), "score": np.take_along_axis(s, best, 1).ravel()})
    return run


def _above(nodes: int):
    """Phase two at a node: every entry whose partial score reaches the query's cutoff divided by the nodes."""
    def run(batches):
        for node, n, w, ids, parts, qn, qids, qparts, cut in arrays(batches, "node", "n", "width", "ids", "parts", "qn", "qids", "qparts", "cuts"):
            for i in range(len(node)):
                cuts = np.frombuffer(cut[i].as_py(), np.int64)
                for a, q, o, s in _partial(n[i].as_py(), w[i].as_py(), ids[i].as_py(), parts[i].as_py(), qn[i].as_py(), qids[i].as_py(), qparts[i].as_py()):
                    row, col = np.nonzero(s >= -(-cuts[a:a + 512] // nodes)[:, None])
                    if len(row):
                        yield pa.RecordBatch.from_pydict({"query": q[row], "object": o[col], "node": np.full(len(row), node[i].as_py(), np.int32), "score": s[row, col]})
    return run


def _with_cuts(packs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Query packs with the cutoff of every query in the order of the pack."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = dict(row["found"])
                ids = np.frombuffer(row["ids"], np.int64)
                low = np.iinfo(np.int64).min // 4
                yield pa.RecordBatch.from_pylist([{**{c: row[c] for c in ("node", "pack", "n", "width", "ids", "parts")},
                                                   "cuts": np.array([at.get(int(q), low) for q in ids], np.int64).tobytes()}],
                                                 pa.schema([("node", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()), ("width", pa.int32()),
                                                            ("ids", pa.binary()), ("parts", pa.binary()), ("cuts", pa.binary())]))
    members = packs.where("node = 0").select("pack", F.explode("members").alias("query"))
    # a pack holds a bounded number of queries, and so does each list here
    found = members.join(cuts, "query").groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("query", "cut"))).alias("found"))
    joined = packs.drop("members").join(found, "pack")
    return joined.mapInArrow(run, PACKED + ", cuts binary")


def _meet(packs: DataFrame, asked: DataFrame, groups: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every pack of objects beside every pack of queries of the same node, spread over ``groups`` keys.

    Both sides are shuffled: Spark sizes the query packs by their file, without the copy a key, and would send all copies to the driver.
    """
    left = packs.withColumn("cell", F.pmod(F.xxhash64("pack"), F.lit(groups)))
    right = asked.select("node", F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("parts").alias("qparts"), *extra,
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell"))
    return left.join(right.withColumn("cell", F.col("cell").cast("bigint")).hint("merge"), ["node", "cell"])


def top_k(rows: DataFrame, is_query, k: int = 10, nodes: int = 2, per_pack: int = 4096, salts: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of every query row, ties to the smaller id.

    Rows (vec_id, x) with equal x are one object; it keeps its k + 1 smallest ids, for no
    larger one can be in a list.  The components are dealt to ``nodes``; an object's score
    is the sum of its partial scores.  One: every node gives its best k + 1 entries a
    query; their whole scores give the cutoff, below which no result lies.  Two: every
    node gives the entries that reach cutoff / nodes; an object that reaches the cutoff
    does so at one node at least.  Entries whose seen parts, with the uniform threshold
    for unseen ones, stay below the cutoff are dropped.  Three: the rest are scored whole.

    Objects are told apart by a 64-bit hash of x.  Sums must fit 64 bits.

    Queries meet objects in packs of ``per_pack`` rows, at most all pairs of packs, and only
    entries above the cutoff leave a task.  Vectors that are null or hold null or non-finite
    components take no part; shorter vectors count as ended by zeros; a repeated id with
    another vector is another object, and an identical row is the same one.
    """
    spark = rows.sparkSession
    once = rows.select("vec_id", "x").distinct()
    salted = Window.partitionBy("x", F.pmod(F.xxhash64("vec_id"), F.lit(salts))).orderBy("vec_id")
    kept = once.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k + 1)
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    objects = stored(kept.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.xxhash64("x").alias("id"), "x", "ids"), "topk-objects")
    queries = stored(once.where(is_query).select(F.xxhash64("x").alias("id"), "vec_id", "x"), "topk-queries")
    size = objects.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("w")).first()
    groups, width = max(1, min(GROUPS, size["n"] // per_pack)), max(nodes, size["w"])

    def packed(df: DataFrame, parts: int) -> DataFrame:
        return df.repartition(max(1, parts), "id").mapInArrow(_pack(width, nodes, per_pack), PACKED)

    asked_objects = queries.groupBy("id").agg(F.first("x").alias("x"))
    packs = stored(packed(objects.select("id", "x"), 2 * groups), "topk-packs")
    asked = packed(asked_objects, 1 + queries.count() // per_pack)

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{**row, "members": np.frombuffer(row["ids"], np.int64).tolist()}],
                                                 pa.schema([("node", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()), ("width", pa.int32()),
                                                            ("ids", pa.binary()), ("parts", pa.binary()), ("members", pa.list_(pa.int64()))]))
    asked = stored(asked.mapInArrow(unpack, PACKED + ", members array<long>"), "topk-asked")

    def whole(pairs: DataFrame) -> DataFrame:
        dot = F.aggregate(F.arrays_zip("_qx", "x"), F.lit(0).cast("bigint"), lambda s, p: s + F.coalesce(p["_qx"] * p["x"], F.lit(0)))
        return pairs.join(asked_objects.select(F.col("id").alias("query"), F.col("x").alias("_qx")), "query").join(
            objects.select(F.col("id").alias("object"), "x", "ids"), "object").select("query", "object", "ids", dot.alias("score"))

    lists = _meet(packs, asked, groups).mapInArrow(_local_lists(k + 1), PARTIAL)
    best = Window.partitionBy("query", "node").orderBy(F.desc("score"), "object")
    firsts = lists.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("query", "object").distinct()
    ordered = Window.partitionBy("query").orderBy(F.desc("score"), "object")
    cuts = whole(firsts).withColumn("_r", F.row_number().over(ordered)).where(F.col("_r") <= k + 1).groupBy("query").agg(
        F.min("score").alias("_cut"), F.count(F.lit(1)).alias("_n")).select("query", F.when(F.col("_n") > k, F.col("_cut")).otherwise(F.lit(-(1 << 61))).alias("cut"))
    cuts = stored(cuts, "topk-cuts")
    entries = _meet(packs, _with_cuts(asked, cuts), groups, ("cuts",)).mapInArrow(_above(nodes), PARTIAL)
    share = F.ceil(F.col("cut") / nodes)
    pairs = entries.groupBy("query", "object").agg(F.sum("score").alias("_seen"), F.count(F.lit(1)).alias("_of")).join(cuts, "query").where(
        F.col("_seen") + (nodes - F.col("_of")) * share >= F.col("cut")).select("query", "object")
    scored = whole(pairs)
    # a query's own id may be among the k + 1 entries of its object
    top = scored.withColumn("vec_id", F.explode("ids")).withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(
        F.col("_r") <= k + 1).select("query", "vec_id", "score")
    out = queries.select(F.col("id").alias("query"), F.col("vec_id").alias("query_id")).join(top, "query").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
