"""Prefix-tree join of word n-gram sets: exact Jaccard links and the components they form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import bitmap, has_bit, row_key, stored
from facetry.llm.components import components
from facetry.llm.shingles import set_key, shingle_sets, text_batches

#: Frequent shingles that go last in the global order, most frequent at the end.  Bounds the
#: broadcast to 4 MB; it decides how many candidates there are, never which links are found.
FREQUENT = 1 << 18
#: Whole sets compared in one prefix tree; larger buckets are cut into blocks.
BLOCK = 512
#: Buckets up to this size are first sifted in a tree of prefixes alone; larger ones go to the blocks as they are.
COARSE = 4096
#: Rows of sets that are unpacked at once.
UNPACKED = 512


def prefix_size(n: int | np.ndarray):
    """Sets that link share a shingle among the first n - ceil(3n/4) + 1 of the global order."""
    return n - (3 * n + 3) // 4 + 1


class Order:
    """The global order of shingles: rare ones by hash, then the frequent ones by count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.lexsort((tokens, counts))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        at = np.argsort(tokens)
        self.tokens, self.ranks = tokens[at], rank[at]
        self.by_rank = tokens[by]

    def split(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rare shingles in order, and the ranks of the frequent ones in order."""
        if not len(self.tokens) or not len(own):
            return own, np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        frequent = self.tokens[at] == own
        return own[~frequent], np.sort(self.ranks[at[frequent]])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: id, set and size of each row.  kind 1: shingles that several sets of a piece share, with their number."""
    for piece in text_batches(batches):
        sets = shingle_sets(piece.column("text"))
        keys = np.array([set_key(s) if len(s) else 0 for s in sets], np.int64)
        n = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(sets), np.int32)), "id": piece.column("doc_id"), "sid": pa.array(keys), "n": n, "row": piece.column("row_key")})
        _, first = np.unique(keys, return_index=True)
        tokens, counts = np.unique(np.concatenate([sets[i] for i in first]), return_counts=True) if len(first) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = counts >= 3
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(int(often.sum()), np.int32)), "id": _signed(tokens[often]),
                                          "sid": pa.array(counts[often].astype(np.int64)), "n": pa.array(np.zeros(int(often.sum()), np.int64)), "row": pa.nulls(int(often.sum()), pa.int64())})


def _prefixes(order):
    """The prefix of every set: one row a shingle, with twice the set's size, plus one if the place is late in the prefix."""
    def run(batches):
        known = Order(*order.value)
        for piece in text_batches(batches):
            done, tokens, sizes, sids = set(), [], [], []
            for own in shingle_sets(piece.column("text")):
                if not len(own) or (sid := set_key(own)) in done:
                    continue
                done.add(sid)
                rare, frequent = known.split(own)
                take = int(prefix_size(len(own)))
                head = rare[:take] if take <= len(rare) else np.concatenate((rare, known.by_rank[frequent[:take - len(rare)]]))
                tokens.append(head)
                late = np.arange(len(head)) > len(own) - (6 * len(own) + 6) // 7
                sizes.append(2 * len(own) + late)
                sids.append(np.full(len(head), sid, np.int64))
            if tokens:
                yield pa.RecordBatch.from_pydict({"token": _signed(np.concatenate(tokens)), "size": pa.array(np.concatenate(sizes).astype(np.int64)), "sid": pa.array(np.concatenate(sids))})
    return run


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shingle, size and set: sets of one shingle that can link are put in the bucket of the first of them.

    Of two linked sets the smaller has their first common shingle early in its prefix.  So a
    row that is late in its prefix needs an early row of a smaller set within reach, and a
    gap in the sizes ends a bucket.  One row is kept between batches, however many share a
    shingle.
    """
    carry = None  # shingle, size and hub of the last row that counts, size of the last early row
    for batch in batches:
        if not batch.num_rows:
            continue
        token, size, sid = (batch.column(c).to_numpy() for c in ("token", "size", "sid"))
        n, early = size >> 1, (size & 1) == 0
        reach = np.where(early, n, 0)
        if carry is not None:
            token, n, sid, reach, early = (np.concatenate(([c], x)) for c, x in zip((*carry, True), (token, n, sid, reach, early), strict=True))
        group = np.cumsum(np.concatenate(([False], token[1:] != token[:-1])))
        reach = np.maximum.accumulate(reach + (group << 40)) - (group << 40)
        counts = early | (4 * reach >= 3 * n)
        last_token, last_reach = token[-1], int(reach[-1])
        token, n, sid = token[counts], n[counts], sid[counts]
        carry = None
        if len(token):
            new = np.concatenate(([True], (token[1:] != token[:-1]) | (3 * n[1:] > 4 * n[:-1])))
            hubs = sid[np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))]
            if token[-1] == last_token:
                carry = (token[-1], n[-1], hubs[-1], last_reach)
            other = hubs != sid
            pairs = np.unique(np.stack((hubs[other], sid[other])), axis=1)
            yield pa.RecordBatch.from_pydict({"hub": pa.array(pairs[0]), "sid": pa.array(pairs[1])})


def _sets(order, wanted, whole: bool):
    """Rare shingles and frequent ranks of the sets whose bit is set, whole or of their prefix, once a piece."""
    def run(batches):
        known, bits = Order(*order.value), wanted.value
        for piece in text_batches(batches):
            done, out = set(), {"sid": [], "n": [], "rare": [], "frequent": []}
            for own in shingle_sets(piece.column("text")):
                if not len(own) or (sid := set_key(own)) in done or not has_bit(bits, np.array([sid]))[0]:
                    continue
                done.add(sid)
                rare, frequent = known.split(own)
                if not whole:
                    take = int(prefix_size(len(own)))
                    rare, frequent = rare[:take], frequent[:max(0, take - len(rare))]
                    rare = np.unique((rare >> np.uint64(32)).astype(np.uint32))  # half a hash: a few more candidates
                out["sid"].append(sid)
                out["n"].append(len(own))
                out["rare"].append(rare.tobytes())
                out["frequent"].append(frequent.astype(np.int32).tobytes())
            if done:
                yield pa.RecordBatch.from_pydict({"sid": pa.array(out["sid"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "rare": pa.array(out["rare"], pa.binary()), "frequent": pa.array(out["frequent"], pa.binary())})
    return run


class Tree:
    """Path-compressed prefix tree over sorted sequences: node i spans leaves low..high and depths from..to."""

    def __init__(self, rows: list[np.ndarray]):
        self.low, self.high, self.start, self.end, self.children = [], [], [], [], []
        self.rows = rows
        self.root = self._build(0, len(rows), 0)

    def _build(self, low: int, high: int, depth: int) -> int:
        """Iterative: a chain of copies would be as deep as there are rows."""
        top = self._node(low, high, depth)
        todo = [top]
        while todo:
            node = todo.pop()
            low, high, depth = self.low[node], self.high[node], self.start[node]
            first, last = self.rows[low], self.rows[high - 1]
            shared = min(len(first), len(last))
            differ = np.nonzero(first[depth:shared] != last[depth:shared])[0]
            end = depth + int(differ[0]) if len(differ) else shared
            self.end[node] = end
            at = low
            while at < high and len(self.rows[at]) == end:  # rows that end here are leaves of the node
                at += 1
            while at < high:
                value, stop = self.rows[at][end], at + 1
                # rows are sorted, so the rows with this next shingle are a run
                step = 1
                while stop < high and self.rows[min(high - 1, stop + step - 1)][end] == value:
                    stop = min(high, stop + step)
                    step *= 2
                while stop < high and self.rows[stop][end] == value:
                    stop += 1
                child = self._node(at, stop, end)
                self.children[node].append(child)
                todo.append(child)
                at = stop
        return top

    def _node(self, low: int, high: int, depth: int) -> int:
        for column, value in ((self.low, low), (self.high, high), (self.start, depth), (self.end, depth), (self.children, [])):
            column.append(value)
        return len(self.low) - 1


def tree_links(rows: list[np.ndarray], sizes: np.ndarray, label: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs of rows that can link and join two labels, and the labels after; the labels of a pair become one.

    Rows are sorted ranks, whole sets or the beginnings of sets of the given sizes, in
    lexicographic order.  Each row walks the tree of the rows after it.  Overlaps counted
    along a path serve all rows below it.  A subtree is left when its remaining length, or
    what remains of the row, cannot reach the overlap that any of its rows needs, when its
    sizes are out of reach, or when all its rows have the row's label already.  With whole
    sets nothing remains at a leaf, so its pair is a link.
    """
    label, links = label.copy(), []
    if len(rows) < 2 or (label == label[0]).all():
        return links, label
    tree = Tree(rows)
    lengths = np.array([len(r) for r in rows])
    flat, starts, lasts = np.concatenate(rows), np.cumsum(lengths) - lengths, np.array([r[-1] for r in rows])
    mask = np.zeros(int(lasts.max()) + 1, bool)
    for x, row in enumerate(rows):
        n = int(sizes[x])
        mask[row] = True

        def fits(low: int, high: int, x: int = x, n: int = n) -> np.ndarray:
            return (4 * sizes[low:high] >= 3 * n) & (3 * sizes[low:high] <= 4 * n) & (label[low:high] != label[x])

        def short(met, spans, known, left, n: int = n):
            # a set of size s needs ceil(3 (n + s) / 7) and has s - known shingles to come
            return met + np.minimum(spans - known, left) < -(-3 * (n + spans) // 7)

        def leaves(low: int, high: int, x: int = x, n: int = n, row: np.ndarray = row) -> None:
            """Rows low..high-1 at once, each to its end."""
            low = max(low, x + 1)
            if low >= high:
                return
            part, at = flat[starts[low]:starts[high - 1] + lengths[high - 1]], starts[low:high] - starts[low]
            met = np.add.reduceat(mask[part].astype(np.int64), at)
            known = np.add.reduceat((part <= row[-1]).astype(np.int64), at)
            left = n - np.where(known == lengths[low:high], np.searchsorted(row, lasts[low:high], "right"), len(row))
            for y in low + np.nonzero(fits(low, high) & ~short(met, sizes[low:high], known, left))[0]:
                if label[y] != label[x]:
                    links.append((x, int(y)))
                    label[label == label[y]] = label[x]

        todo = [(tree.root, 0)]
        while todo:
            node, met = todo.pop()
            low, high = max(tree.low[node], x + 1), tree.high[node]
            if low >= high:
                continue
            fit = fits(low, high)
            if not fit.any():
                continue
            start, end, path = tree.start[node], tree.end[node], rows[tree.low[node]]
            # shingles beyond the row's last one are known to be missing only if the row is whole
            known = int(np.searchsorted(path[:end], row[-1], "right"))
            met += int(mask[path[start:known]].sum()) if known > start else 0
            left = n - (int(np.searchsorted(row, path[end - 1], "right")) if known == end and end else len(row) if end else 0)
            if short(met, sizes[low:high][fit], known, left).all():
                continue
            # rows that end here, and runs of children with one row each, are looked at together
            at = tree.low[node]
            run = at
            while at < tree.high[node] and lengths[at] == end:
                at += 1
            for child in tree.children[node]:
                if tree.high[child] - tree.low[child] > 1:
                    leaves(run, tree.low[child])
                    todo.append((child, met))
                    run = tree.high[child]
            leaves(run, tree.high[node])
        mask[row] = False
        if (label == label[0]).all():
            break
    return links, label


def _ranked(rare: list[np.ndarray], frequent: list[np.ndarray]) -> list[np.ndarray]:
    """Sequences of ranks in the global order, local to these sets."""
    known = np.unique(np.concatenate(rare)) if rare else np.zeros(0, np.uint64)
    late = np.unique(np.concatenate(frequent)) if frequent else np.zeros(0, np.int64)
    return [np.concatenate((np.searchsorted(known, r), len(known) + np.searchsorted(late, f))) for r, f in zip(rare, frequent, strict=True)]


def _walk(kind: type, sids: list[int], sizes: list[int], rare: list[bytes], frequent: list[bytes], roots: list[int]):
    rows = _ranked([np.frombuffer(r, kind) for r in rare], [np.frombuffer(f, np.int32).astype(np.int64) for f in frequent])
    order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">i8").tobytes())
    start = np.unique(np.array([roots[i] for i in order]), return_inverse=True)[1]
    links, label = tree_links([rows[i] for i in order], np.array([sizes[i] for i in order]), start)
    return np.array([sids[i] for i in order], np.int64), links, label


def _links_of(*held) -> pa.RecordBatch:
    sids, links, _ = _walk(np.uint64, *held)
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"v": pa.array(sids[at[:, 0]]), "u": pa.array(sids[at[:, 1]])})


def _groups_of(*held) -> pa.RecordBatch:
    """Sets that candidates connect, each group named by its members."""
    sids, _, label = _walk(np.uint32, *held)
    groups, members = [], []
    for one in np.unique(label):
        own = np.sort(sids[label == one])
        if len(own) > 1:
            groups.extend([set_key(own)] * len(own))
            members.append(own)
    return pa.RecordBatch.from_pydict({"v": pa.array(groups, pa.int64()), "u": pa.array(np.concatenate(members) if members else np.zeros(0, np.int64))})


def _buckets(result):
    """Rows come sorted by bucket; one bucket is held at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {"sid": [], "n": [], "rare": [], "frequent": [], "root": []}
        for rows in (batch.slice(at, UNPACKED).to_pydict() for batch in batches for at in range(0, batch.num_rows, UNPACKED)):
            for i, at in enumerate(zip(rows["hub"], rows["block"], rows["other"], strict=True)):
                if at != key:
                    if len(held["sid"]) > 1:
                        yield result(*held.values())
                    key, held = at, {c: [] for c in held}
                for c in held:
                    held[c].append(rows[c][i])
        if len(held["sid"]) > 1:
            yield result(*held.values())
    return run


def _walked(members: DataFrame, sets: DataFrame, result) -> DataFrame:
    """``result`` (v, u) of every (hub, block, other) of ``members``."""
    full = members.join(sets, "sid")
    return full.repartition("hub", "block", "other").sortWithinPartitions("hub", "block", "other", "sid").mapInArrow(_buckets(result), "v long, u long")


def linked_documents(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, n_shingles, component_id, root of every row; ``root``, the least set, tells components apart.

    Equal sets are one.  Shingles shared by several sets of a piece of input are counted;
    the most frequent go last in the global order, so common passages are in few prefixes.
    Sets of like sizes that share a shingle of their prefixes meet in the bucket of the
    first of them.  A tree of the prefixes alone splits the bucket into groups that candidates
    connect, so sets that share little are never moved whole.  Each group is a prefix tree
    of whole sets, cut into blocks of 512 when larger, the least set in each.  Blocks of one
    group that are not connected by then are compared with each other: what is outside the
    group's largest component with all of the group.
    So every linked pair is compared or already connected.

    Null or wordless texts have size 0 and are their own component.  Equal rows, ties and
    repeated ids get the component of their set; a null id names no component: such rows get
    the least id they are linked with, or null.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(row_key().alias("row_key"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    profile = stored(texts.mapInArrow(_profile, "kind int, id long, sid long, n long, row long"), "ngram-profile")
    rows = profile.where("kind = 0").select(F.col("row").alias("row_key"), F.col("id").alias("doc_id"), "sid", F.col("n").alias("n_shingles"))
    often = profile.where("kind = 1").groupBy("id").agg(F.sum("sid").alias("n")).orderBy(F.desc("n"), "id").limit(FREQUENT).toArrow()
    # plain arrays: a broadcast is read before a worker can import this package
    order = spark.sparkContext.broadcast((often.column("id").to_numpy().view(np.uint64), often.column("n").to_numpy()))
    only = texts.select("text")
    prefixes = only.mapInArrow(_prefixes(order), "token long, size long, sid long")
    pairs = prefixes.repartition("token").sortWithinPartitions("token", "size", "sid").mapInArrow(_hubs, "hub long, sid long").distinct()
    pairs = stored(pairs, "ngram-pairs")
    kinds = "sid long, n long, rare binary, frequent binary"
    every = pairs.unionByName(pairs.select("hub", F.col("hub").alias("sid"))).distinct()
    size = every.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).select("hub", (F.col("n") > COARSE).alias("large"))
    sized = stored(every.join(size, "hub"), "ngram-members")
    small = sized.where("NOT large")
    heads = only.mapInArrow(_sets(order, bitmap(small, "sid"), False), kinds).dropDuplicates(["sid"])
    one = F.lit(0)
    groups = _walked(small.select("hub", one.alias("block"), one.alias("other"), "sid", F.col("sid").alias("root")), heads, _groups_of)
    buckets = stored(groups.select(F.col("v").alias("hub"), F.col("u").alias("sid")).unionByName(sized.where("large").select("hub", "sid")).distinct(), "ngram-buckets")
    sets = stored(only.mapInArrow(_sets(order, bitmap(buckets, "sid"), True), kinds).dropDuplicates(["sid"]), "ngram-sets")
    hubs = buckets.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.min("sid").alias("least")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    block = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    # the bucket's least set is in each of its blocks
    members = buckets.join(hubs, "hub").where("sid <> least").select("hub", "sid", "blocks", block.alias("block")).unionByName(
        hubs.select("hub", F.col("least").alias("sid"), "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    members = stored(members, "ngram-members")
    first = stored(_walked(members.select("hub", "block", one.alias("other"), "sid", F.col("sid").alias("root")), sets, _links_of), "ngram-links")
    roots = components(first, "ngram-roots")

    large = members.where("blocks > 1")
    if not large.isEmpty():
        second = stored(_walked(stored(_open_buckets(large, roots), "ngram-members"), sets, _links_of), "ngram-links")
        if not second.isEmpty():
            roots = components(first.unionByName(second), "ngram-roots")

    named = rows.join(roots.select(F.col("v").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select(
        "row_key", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def _open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """hub, block, other, sid, root: for buckets of several components, every block beside every block of what is outside the largest."""
    at = members.dropDuplicates(["hub", "sid"]).join(roots.select(F.col("v").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    sizes = at.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("hub").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).select(
        "hub", F.col("top.root").alias("main"), (F.col("all") - F.col("top.n")).alias("outside")).where("outside > 0")
    both = stored(at.join(largest, "hub").withColumn("others", F.ceil(F.col("outside") / BLOCK).cast("int")), "ngram-open")
    left = both.select("hub", "block", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "sid", "root")
    right = both.where("root <> main").select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("sid", F.lit(1)), F.col("others")).cast("int").alias("other"), "sid", "root")
    return left.unionByName(right).dropDuplicates(["hub", "block", "other", "sid"])
