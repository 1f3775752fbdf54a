"""Alignment of the tokens that two tokenizers make of the same text."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import stored
from facetry.llm.shingles import text_batches

#: Folder with the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Texts of these characters, and of no more than so many, may take the faster reading of the byte vocabulary.
PLAIN, PLAIN_SIZE = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*"), 200_000
#: How the byte vocabulary parts a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text aligned together, and pairs of ids held at once.
PIECE_BYTES, PAIRS = 1_000_000, 2_000_000
#: At most so many of the most frequent id pairs are broadcast with their counts; the others are joined by shuffle.
HOT = 1 << 17
#: Bits of a token id in a pair.
ID_BITS = 20

_loaded: dict[int, tuple] = {}


def _byte_of() -> dict[str, int]:
    """Byte for each character of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the others for the next code points from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """The byte-level vocabulary: ids of texts and the bytes of ids."""

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_buffer(data)
        self.slow.encode_special_tokens = True
        parsed = json.loads(data)
        special = {t["content"] for t in parsed["added_tokens"]}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in token): i for token, i in parsed["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values(), default=0) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [self.fast.encode_ordinary(t) if len(t) <= PLAIN_SIZE and PLAIN.fullmatch(t) else None for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, self.slow.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out


class PieceTokens:
    """The vocabulary of pieces with byte fallback; it puts a space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(self.model.id_to_piece(list(range(self.model.get_piece_size()))))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def _vocabularies(shared) -> tuple[ByteTokens, PieceTokens]:
    """Built once a worker."""
    data = shared.value
    name = hash(data)
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = ByteTokens(data[0]), PieceTokens(data[1])
    return _loaded[name]


@dataclass
class Side:
    """Tokens of one tokenizer over a batch: id, number of the text, first byte and end counted over the whole batch."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, tokens: list[list[int]], lengths: np.ndarray) -> Side:
        sizes = np.array([len(t) for t in tokens], np.int64)
        ids = np.fromiter((i for t in tokens for i in t), np.int64, int(sizes.sum()))
        end = np.cumsum(lengths[ids])
        return cls(ids, np.repeat(np.arange(len(tokens)), sizes), end - lengths[ids], end)


def tokens_of(texts: list[str | None], byte: ByteTokens, piece: PieceTokens) -> tuple[Side, Side]:
    """Tokens of both sides; none on either where a side's bytes are not those of a space and the text."""
    held = [i for i, t in enumerate(texts) if t]
    whole = [" " + texts[i] for i in held]
    a: list[list[int]] = [[] for _ in texts]
    b: list[list[int]] = [[] for _ in texts]
    for i, text, x, y in zip(held, whole, byte.encode(whole), piece.encode([t[1:] for t in whole]), strict=True):
        data = text.encode()
        if b"".join(map(byte.bytes.__getitem__, x)) == data and b"".join(map(piece.bytes.__getitem__, y)) == data:
            a[i], b[i] = x, y
    sizes = [np.array([len(t) for t in side.bytes], np.int64) for side in (byte, piece)]
    return Side.of(a, sizes[0]), Side.of(b, sizes[1])


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all pairs of tokens that share a byte.

    Each start of a token finds the token of the other side that covers it, by an as-of
    join keyed by the text; two tokens overlap when one of them covers the other's start.
    """
    one = pd.DataFrame({"start": a.start, "doc": a.doc, "a": np.arange(len(a.ids))})
    two = pd.DataFrame({"start": b.start, "doc": b.doc, "b": np.arange(len(b.ids))})
    from_a = pd.merge_asof(one, two, on="start", by="doc")
    from_b = pd.merge_asof(two, one, on="start", by="doc")
    i, j = from_b["a"].to_numpy(np.int64), from_b["b"].to_numpy(np.int64)
    later = a.start[i] != b.start[j]  # equal starts were met from a
    return np.concatenate((from_a["a"].to_numpy(np.int64), i[later])), np.concatenate((from_a["b"].to_numpy(np.int64), j[later]))


@dataclass
class Groups:
    """Groups between common ends: their text, and the group of each token."""

    doc: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def groups_of(a: Side, b: Side) -> Groups:
    i, j = overlaps(a, b)
    common = i[a.end[i] == b.end[j]]
    common.sort()
    ends = a.end[common]
    of_a, of_b = np.searchsorted(ends, a.end), np.searchsorted(ends, b.end)
    return Groups(a.doc[common], of_a, of_b, np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends)))


def _texts_of(a: Side, b: Side, groups: Groups, names: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The written tokens of all groups in order, and the text of each."""
    out = np.empty(len(a.ids) + len(b.ids), object)
    doc = np.empty(len(out), np.int64)
    before_a, before_b = np.cumsum(groups.n_a), np.cumsum(groups.n_b) - groups.n_b
    for side, of, place, last in ((a, groups.of_a, np.arange(len(a.ids)) + before_b[groups.of_a], 1), (b, groups.of_b, np.arange(len(b.ids)) + before_a[groups.of_b], 2)):
        ends = np.ones(len(of), bool)
        ends[:-1] = of[1:] != of[:-1]
        stops = np.ones(len(of), bool)
        stops[:-1] = side.doc[1:] != side.doc[:-1]
        written = names[0][side.ids]
        written[ends] = names[last][side.ids[ends]]
        if last == 2:
            written[stops] = names[3][side.ids[stops]]
        out[place], doc[place] = written, side.doc
    return out, doc


def _names(size: int) -> tuple:
    """Ids as text, followed by what parts them: next id, the other side, next group, nothing."""
    return tuple(np.array([f"{i}{end}" for i in range(size)], object) for end in (",", "|", ";", ""))


def _counted(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each group and how often they stand in it."""
    key, times = np.unique(group << ID_BITS | ids, return_counts=True)
    return key >> ID_BITS, key & ((1 << ID_BITS) - 1), times


def _merged(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


def linked_pairs(a: Side, b: Side, groups: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id pair, times) of the linked tokens, each pair once a text, in order.

    A group's tokens are counted by id before they are paired, so a long group of few
    ids is no square.
    """
    group_a, id_a, times_a = _counted(groups.of_a, a.ids)
    group_b, id_b, times_b = _counted(groups.of_b, b.ids)
    first, last = np.searchsorted(group_b, group_a), np.searchsorted(group_b, group_a, side="right")
    each = last - first
    key, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    reach = np.cumsum(each)
    at = 0
    while at < len(each):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS, side="right")))
        n = each[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n)
        new = groups.doc[group_a[i]] << 2 * ID_BITS | id_a[i] << ID_BITS | id_b[j]
        key, times = _merged(np.concatenate((key, new)), np.concatenate((times, times_a[i] * times_b[j])))
        at = stop
    return key >> 2 * ID_BITS, key & ((1 << 2 * ID_BITS) - 1), times


def _lists(at: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """Values as one list a row; ``at`` holds the row of each and ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(rows + 1)).astype(np.int32)), values)


def _linked(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte, piece = _vocabularies(shared)
        names = _names(max(len(byte.bytes), len(piece.bytes)))
        for batch in text_batches(batches, chars=PIECE_BYTES):
            n = batch.num_rows
            a, b = tokens_of(batch.column("text").to_pylist(), byte, piece)
            groups = groups_of(a, b)
            written, doc = _texts_of(a, b, groups, names)
            stops = np.searchsorted(doc, np.arange(n + 1))
            digest = [hashlib.sha256("".join(written[x:y].tolist()).encode()).hexdigest() if y > x else "" for x, y in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]
            at, pair, times = linked_pairs(a, b, groups)
            total = np.zeros(n, np.int64)
            np.add.at(total, groups.doc, groups.n_a * groups.n_b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *(pa.array(np.bincount(x, minlength=n).astype(np.int64)) for x in (a.doc, b.doc, groups.doc)), pa.array(total),
                 pa.array(digest, pa.string()), _lists(at, n, pa.array(pair)), _lists(at, n, pa.array(times))],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
    return run


def _aligned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte, piece = _vocabularies(shared)
        for batch in text_batches(batches, chars=PIECE_BYTES):
            n = batch.num_rows
            a, b = tokens_of(batch.column("text").to_pylist(), byte, piece)
            i, j = overlaps(a, b)
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            groups = groups_of(a, b)
            first_a, first_b = (np.searchsorted(s.doc, np.arange(n)) for s in (a, b))
            own = np.arange(len(groups.doc))
            edge_a, edge_b = (np.searchsorted(of, own, side="right") for of in (groups.of_a, groups.of_b))
            pairs = pa.StructArray.from_arrays([pa.array((i - first_a[a.doc[i]]).astype(np.int32)), pa.array((j - first_b[a.doc[i]]).astype(np.int32))], ["a", "b"])
            ends = pa.StructArray.from_arrays([pa.array((edge_a - first_a[groups.doc]).astype(np.int32)), pa.array((edge_b - first_b[groups.doc]).astype(np.int32))], ["a_end", "b_end"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), _lists(a.doc, n, pa.array(a.ids.astype(np.int32))), _lists(b.doc, n, pa.array(b.ids.astype(np.int32))),
                 _lists(a.doc[i], n, pairs), _lists(groups.doc, n, ends)], ["row", "doc_id", "a_ids", "b_ids", "overlaps", "groups"])
    return run


def _weighed(shared):
    """Sums over the pairs whose counts are broadcast, and the pairs that are not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("pairs")
            at = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            own, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            place = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            hot = pair[place] == own if len(pair) else np.zeros(len(own), bool)
            total, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, at[hot], times[hot] * count[place[hot]])
            np.add.at(n_best, at[hot], times[hot] * best[place[hot]])
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(n_best), pa.array(total), _lists(at[~hot], n, pa.array(own[~hot])), _lists(at[~hot], n, pa.array(times[~hot]))],
                [*names, "n_best", "count_sum", "pairs", "times"])
    return run


def _broadcast(docs: DataFrame, folder: str):
    """The two vocabulary files, read by the driver; a few MB whatever the data."""
    data = []
    for name in (BYTE_BPE, PIECE_BPE):
        with open(os.path.join(folder, name), "rb") as f:
            data.append(f.read())
    return docs.sparkSession.sparkContext.broadcast(tuple(data))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def align_tokens(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, a_ids, b_ids, overlaps (places of tokens that share a byte), groups (tokens up to each common end) of every row.

    Side a is the byte-level vocabulary over a space and the text, side b the pieces of the
    text.  Null, empty and unfaithful texts, whose bytes a side does not give back, have
    empty lists; special tokens' strings are plain text; an empty table gives no rows.
    """
    return _rows(docs).mapInArrow(_aligned(_broadcast(docs, folder)), "row long, doc_id long, a_ids array<int>, b_ids array<int>, "
                                  "overlaps array<struct<a:int,b:int>>, groups array<struct<a_end:int,b_end:int>>").drop("row")


def _hot(counts: DataFrame):
    """(arrays of the most frequent pairs, whether there are others): all pairs from the least count on whose number is within ``HOT``."""
    bucket = F.floor(F.log2(F.col("n")) * 8).cast("int")
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()  # a few hundred rows at most
    held, least = 0, None
    for row in sizes:
        if held + row["n"] > HOT:
            break
        held, least = held + row["n"], row["least"]
    got = counts.where(F.col("n") >= least if least is not None else F.lit(False)).orderBy("pair").toArrow()
    return tuple(got.column(c).to_numpy().astype(np.int64) for c in ("pair", "n", "best")), held < sum(r["n"] for r in sizes)


def alignment_links(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    Tokens of both sides that share a group are linked.  The count of an id pair is the
    number of rows that link it; ``n_best`` are the links whose count no other pair with
    the same id of a exceeds, ``count_sum`` adds the counts of all links.  Counts cover
    the whole corpus: each row's distinct pairs are written once, counted by a partial
    aggregate, and read again.  The most frequent pairs (131,072 at most) meet the rows as
    a broadcast, so none of them gathers in one task; all others by a join.

    Null, empty and unfaithful texts have zeros and the digest ''; equal rows and repeated
    or null ids are rows of their own; other columns are not read; an empty table gives no rows.
    """
    numbers = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    rows = stored(_rows(docs).mapInArrow(_linked(_broadcast(docs, folder)), f"{numbers}, pairs array<long>, times array<long>"), "token-links")
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", ID_BITS)), "token-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row an id of a
    counts = stored(counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")), "token-best")
    hot, others = _hot(counts)
    weighed = rows.mapInArrow(_weighed(rows.sparkSession.sparkContext.broadcast(hot)), f"{numbers}, n_best long, count_sum long, pairs array<long>, times array<long>")
    if others:
        weighed = stored(weighed, "token-weighed")
        rest = weighed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        more = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("best")).alias("more_best"))
        weighed = weighed.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn(
            "count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return weighed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
