"""Language-model scores from a sharded Elias-Fano n-gram trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import mix, stored
from facetry.llm.eliasfano import Trie
from facetry.llm.shingles import text_batches, word_hashes

#: Hashes of the sign that ends a text and of the one that stands before its first word.  Words have 63-bit hashes.
END, BEGIN = 0x1D4F7A3B62C98E05, 0x2B7E151628AED2A6
_63 = np.uint64((1 << 63) - 1)
#: Preceding words are told apart by 40 bits under each word.
_40 = np.int64((1 << 40) - 1)
#: Words that may be split over shards; bounds the broadcast to 1 MB.
SPLIT_WORDS = 1 << 16
#: Words of a piece of texts; a longer text is cut, the word before the cut goes along.
PIECE = 1 << 19
EVENTS = "shard long, piece long, words binary, parents binary, befores binary, pairs binary, docs binary, times binary, info binary"
PARTIAL = "piece long, kind int, data binary"


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that the model does not learn from; a null id is learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 1, F.lit(False))


def _token_rows(batches: Iterator[pa.RecordBatch]):
    """For each piece of texts: batch, hashes of all tokens with ends, row of each token, whether it begins a text."""
    for piece in text_batches(batches):
        flat, sizes = word_hashes(piece.column("text"))
        sizes = sizes + 1
        tokens = np.full(int(sizes.sum()), END, np.int64)
        inner = np.ones(len(tokens), bool)
        ends = np.cumsum(sizes)
        inner[ends - 1] = False
        tokens[inner] = (flat & _63).astype(np.int64)
        yield piece, tokens, np.repeat(np.arange(len(sizes)), sizes), ends


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training count of every token of a piece."""
    for piece, tokens, row, _ in _token_rows(batches):
        learn = ~piece.column("held_out").to_numpy(zero_copy_only=False)
        words, counts = np.unique(tokens[learn[row]], return_counts=True)
        yield pa.RecordBatch.from_pydict({"word": pa.array(words), "n": pa.array(counts.astype(np.int64))})


def _bytes5(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from5(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.int64).ravel()


def _dealt(shards: int, split):
    """Every (word, word before, row) of a piece to the shard of the word; frequent words are dealt by the word before as well."""
    def run(batches):
        split_words, split_ways = split.value
        number = 0
        for batch, tokens, row, ends in _token_rows(batches):
            before = np.concatenate(([BEGIN], tokens[:-1]))
            before[ends[:-1]] = BEGIN
            learn = (~batch.column("held_out").to_numpy(zero_copy_only=False)).astype(np.uint8)
            sizes = np.diff(np.concatenate(([0], ends)))
            for a in range(0, len(tokens), PIECE):
                piece = (TaskContext.get().partitionId() << 32) | number
                number += 1
                w, h, r = tokens[a:a + PIECE], before[a:a + PIECE] & _40, row[a:a + PIECE]
                r = r - r[0]
                first = row[a]
                last = row[min(len(tokens), a + PIECE) - 1]
                ways = np.ones(len(w), np.int64)
                if len(split_words):
                    at = np.minimum(np.searchsorted(split_words, w), len(split_words) - 1)
                    ways = np.where(split_words[at] == w, split_ways[at], 1)
                salt = (mix(h.astype(np.uint64)) % ways.astype(np.uint64)).astype(np.int64)
                root = w ^ (salt << 20)  # a word's parts are roots of their own
                roots, root_at, root = np.unique(root, return_index=True, return_inverse=True)
                shard = (mix(roots.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
                order = np.lexsort((roots, shard))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                hs, hl = np.unique(h, return_inverse=True)
                keys, times = np.unique((place[root] << 31) << 12 | hl << 12 | r, return_counts=True)
                pair, doc = keys >> 12, keys & 4095
                doc = (doc | learn[first:last + 1][doc].astype(np.int64) << 15).astype(np.uint16)  # the row, and whether it is learned from
                new = np.nonzero(np.concatenate(([True], pair[1:] != pair[:-1])))[0]
                per_pair = np.diff(np.concatenate((new, [len(pair)])))
                pair = pair[new]
                parent = pair >> 31
                befores = hs[pair & ((1 << 31) - 1)]
                parents, per_word = np.unique(parent, return_counts=True)
                word = w[root_at][order][parents]
                cuts = np.nonzero(np.concatenate(([True], shard[order][parents][1:] != shard[order][parents][:-1], [True])))[0]
                pair_at = np.concatenate(([0], np.cumsum(per_word)))
                doc_at = np.concatenate(([0], np.cumsum(per_pair)))
                out = {c: [] for c in ("shard", "words", "parents", "befores", "pairs", "docs", "times")}
                for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                    p0, p1 = pair_at[s], pair_at[e]
                    d0, d1 = doc_at[p0], doc_at[p1]
                    out["shard"].append(int(shard[order][parents[s]]))
                    out["words"].append(word[s:e].tobytes())
                    out["parents"].append(per_word[s:e].astype(np.int32).tobytes())
                    out["befores"].append(_bytes5(befores[p0:p1]))
                    out["pairs"].append(per_pair[p0:p1].astype(np.uint16).tobytes())
                    out["docs"].append(doc[d0:d1].tobytes())
                    out["times"].append(np.minimum(times[d0:d1], 1 << 31).astype(np.int32).tobytes())
                kinds = dict.fromkeys(("words", "parents", "befores", "pairs", "docs", "times"), pa.binary()) | {"shard": pa.int64()}
                rows = {c: pa.array(v, kinds[c]) for c, v in out.items()} | {"piece": pa.array([piece] * len(out["shard"]), pa.int64()), "info": pa.array([b""] * len(out["shard"]), pa.binary())}
                yield pa.RecordBatch.from_pydict({c: rows[c] for c in ("shard", "piece", "words", "parents", "befores", "pairs", "docs", "times", "info")})
                # the rows themselves: id, key and share of the tokens go on without a shard of their own
                ids = batch.column("doc_id").slice(int(first), int(last - first + 1))
                own = np.bincount(r, minlength=int(last - first + 1))
                begins = np.array([a <= ends[i] - sizes[i] < a + PIECE for i in range(int(first), int(last) + 1)], np.uint8)
                table = pa.table({c: batch.column(c).slice(int(first), len(ids)) for c in ("uid", "doc_id", "held_out")} | {"n": own.astype(np.int64), "begins": begins})
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                blank = pa.array([b""], pa.binary())
                yield pa.RecordBatch.from_pydict({"shard": pa.array([-1 - piece], pa.int64()), "piece": pa.array([piece], pa.int64())}
                                                 | {c: blank for c in ("words", "parents", "befores", "pairs", "docs", "times")}
                                                 | {"info": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    return run


def _shard_scores(held: list[dict], known: tuple[np.ndarray, np.ndarray], total: float, mass: float) -> Iterator[tuple[int, bytes]]:
    """Trie of one shard from its training events, and the sums of all its events per piece and row; rows without an event there are left out."""
    words, befores, of_pair, times, learned, where = [], [], [], [], [], []
    pieces = [row["piece"] for row in held]
    at = 0
    for k, row in enumerate(held):
        per_word, per_pair = np.frombuffer(row["parents"], np.int32), np.frombuffer(row["pairs"], np.uint16)
        words.append(np.repeat(np.frombuffer(row["words"], np.int64), per_word))
        befores.append(_from5(row["befores"]))
        of_pair.append((at + np.repeat(np.arange(len(per_pair)), per_pair)).astype(np.int32))
        at += len(per_pair)
        times.append(np.frombuffer(row["times"], np.int32))
        doc = np.frombuffer(row["docs"], np.uint16).astype(np.int64)
        learned.append(doc >= 1 << 15)
        where.append(k * 4096 + (doc & 4095))
        row.clear()
        row["piece"] = pieces[k]
    w, h, pair, times, learned, where = (np.concatenate(x) for x in (words, befores, of_pair, times, learned, where))
    order = np.lexsort((h, w))
    new = np.ones(len(order), bool)
    new[1:] = (w[order][1:] != w[order][:-1]) | (h[order][1:] != h[order][:-1])
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new) - 1
    order = order[new]
    w, h = w[order], h[order]
    pair = number[pair]
    del order, new, number
    count = np.bincount(pair[learned], times[learned], len(w))
    starts = np.nonzero(np.concatenate(([True], w[1:] != w[:-1])))[0]
    word, per_word = w[starts], np.diff(np.concatenate((starts, [len(w)])))
    of_word = np.repeat(np.arange(len(word)), per_word)
    whole = np.bincount(of_word, count, len(word))
    if len(known[0]):  # words that are split over shards have their counts from the first pass
        k = np.minimum(np.searchsorted(known[0], word), len(known[0]) - 1)
        whole = np.where(known[0][k] == word, known[1][k], whole)
    base = np.log10((whole + 0.5) / total)
    # the trie holds what was learned
    seen_word, seen = whole > 0, count > 0
    smooth = np.log10(count[seen] + mass * ((whole + 0.5) / total)[of_word[seen]])
    first = np.concatenate(([0], np.cumsum(np.bincount(of_word[seen], minlength=len(word))[seen_word])))
    trie = Trie(word[seen_word], base[seen_word], first, h[seen], smooth)
    contexts, which = np.unique(h, return_inverse=True)
    node = trie.word(word)
    child = trie.pair(node[of_word], trie.context(contexts)[which])
    unknown = np.log10(0.5 / total)
    backed = np.where(node >= 0, trie.log(0, np.maximum(node, 0)) if len(trie.codes[0]) else 0.0, unknown) + np.log10(mass)
    log = np.where(child >= 0, trie.log(1, np.maximum(child, 0)) if len(trie.codes[1]) else 0.0, backed[of_word])
    # each word also is the one before the next, which divides by its count; the end is not
    log = log - np.where(word == END, 0.0, np.log10(whole + mass))[of_word]
    row, where = np.unique(where, return_inverse=True)
    sums = [np.bincount(where, times * x[pair], len(row)) for x in (base[of_word], log, seen_word[of_word].astype(float))]
    cuts = np.searchsorted(row, np.arange(len(pieces) + 1) * 4096)
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        base_sum, score_sum, n_known = (x[a:b] for x in sums)
        yield pieces[k], base_sum.tobytes() + score_sum.tobytes() + np.round(n_known).astype(np.int32).tobytes() + (row[a:b] & 4095).astype(np.uint16).tobytes()


def _scored(known, total: float, mass: float):
    """Rows come sorted by shard; one shard is held at a time."""
    names = ("piece", "words", "parents", "befores", "pairs", "docs", "times", "info")

    def out(held):
        for piece, sums in _shard_scores(held, known.value, total, mass):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([0], pa.int32()), pa.array([sums], pa.binary())], ["piece", "kind", "data"])

    def run(batches):
        shard, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column("shard")[i].as_py()
                row = {c: batch.column(c)[i].as_py() for c in names}
                if now < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([row["piece"]], pa.int64()), pa.array([1], pa.int32()), pa.array([row["info"]], pa.binary())], ["piece", "kind", "data"])
                    continue
                if now != shard:
                    if held:
                        yield from out(held)
                    shard, held = now, []
                held.append(row)
        if held:
            yield from out(held)
    return run


def _gathered(begin: float):
    """Rows come sorted by piece: the sums of its shards are added to its rows."""
    def out(info, sums):
        table = pa.ipc.open_stream(info).read_all()
        n = table.num_rows
        sums = sums[:, :n] if sums is not None else np.zeros((3, n))
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("uid", "doc_id", "held_out", "n")), pa.array(sums[0]),
                                           pa.array(sums[1] - begin * table.column("begins").to_numpy()), pa.array(np.round(sums[2]).astype(np.int64))],
                                          ["uid", "doc_id", "held_out", "n_tokens", "base_score", "score", "n_known"])

    def run(batches):
        piece, info, sums = None, None, None
        for batch in batches:
            for p, kind, data in zip(batch.column("piece").to_pylist(), batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                if p != piece:
                    if info is not None:
                        yield out(info, sums)
                    piece, info, sums = p, None, None
                if kind:
                    info = data.as_buffer()
                else:
                    raw = data.as_buffer().to_pybytes()
                    n = len(raw) // 22
                    sums = np.zeros((3, 4096)) if sums is None else sums
                    sums[:, np.frombuffer(raw, np.uint16, n, 20 * n)] += np.stack((np.frombuffer(raw, float, n), np.frombuffer(raw, float, n, 8 * n), np.frombuffer(raw, np.int32, n, 16 * n)))
        if info is not None:
            yield out(info, sums)
    return run


def score_texts(docs: DataFrame, mass: float = 1000.0, per_shard: int = 1_000_000) -> DataFrame:
    """Base and model scores of every row, learned from all rows that are not held out.

    Bigrams with Dirichlet smoothing: P(w | h) = (c(hw) + mass * P(w)) / (c(h) + mass), where
    P(w) is the base.  Numerators depend on counts of w and hw only, denominators on the
    count of h, so both are found where the word lives: tokens go to the shard of their
    word once, with the word before and the row, and shards send sums per row back.  A
    shard builds a trie of its words with the words before them in Elias-Fano levels and
    16-bit codes, maps it into memory and looks every pair up by successor search in the
    word's range.  The number of shards grows with the corpus; the most frequent words
    are split over several by the word before.

    Words are told apart by 63-bit hashes.  A null or empty text is the end alone; equal
    rows and repeated ids are scored each; a null id is learned from.  A text of any
    length is cut into pieces.  With no training rows every word is unknown.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = stored(rows.select("text", "held_out").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0)).alias("d")).first()
    tokens, words, texts = size["n"], size["v"], size["d"]
    total = tokens + 0.5 * (words + 1)
    shards = max(1, -(-tokens // per_shard))
    often = counts.where(F.col("n") * (2 * shards) >= tokens).orderBy(F.desc("n"), "word").limit(SPLIT_WORDS).toArrow() if tokens else None
    word = often.column("word").to_numpy() if often is not None else np.zeros(0, np.int64)
    n = often.column("n").to_numpy() if often is not None else np.zeros(0, np.int64)
    at = np.argsort(word)
    word, n = word[at], n[at]
    split = spark.sparkContext.broadcast((word, np.maximum(1, -(-4 * shards * n // max(1, tokens)))))
    known = spark.sparkContext.broadcast((word, n))
    events = rows.mapInArrow(_dealt(shards, split), EVENTS)
    partial = events.repartition("shard").sortWithinPartitions("shard", "piece").mapInArrow(_scored(known, total, mass), PARTIAL)
    begin = float(np.log10(texts + mass))
    sums = partial.repartition("piece").sortWithinPartitions("piece").mapInArrow(_gathered(begin), "uid long, doc_id long, held_out boolean, n_tokens long, base_score double, score double, n_known long")
    # a text that was cut has several rows here; ids travel with them, for a second scan could number rows otherwise
    per_row = sums.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return per_row.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))
