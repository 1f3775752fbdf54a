"""Periodic runs of words inside a text, by seeds on diagonals that are extended once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import WORD, text_of
from facetry.llm.shingles import text_batches
from facetry.runtime import let

#: Least number of words of a run.
LEAST = 12
#: Words and bytes of text looked at together; a longer text is a piece of its own.
PIECE_WORDS, PIECE_BYTES = 400_000, 4_000_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Grams:
    """Names of the grams of 1, 2, 4, ... words: equal numbers for equal grams, -1 for one that stands nowhere else.

    A gram of 2k words is named by its halves, and only where both halves stand somewhere
    else too, so a level costs as much as there is repetition left.
    """

    def __init__(self, words: np.ndarray):
        self.levels: list[np.ndarray] = []
        name = self._named(np.arange(len(words)), words.astype(np.int64), len(words))
        while (name >= 0).any():
            self.levels.append(name)
            k = 1 << (len(self.levels) - 1)
            n = len(words) - 2 * k + 1
            at = np.nonzero((name[:n] >= 0) & (name[k:k + n] >= 0))[0] if n > 0 else np.zeros(0, np.int64)
            name = self._named(at, name[at].astype(np.int64) * len(words) + name[at + k], len(words))

    @staticmethod
    def _named(at: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, -1, np.int32)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[:len(ranked)]
        group = np.cumsum(new) - 1
        often = np.bincount(group)[group] > 1 if len(group) else group.astype(bool)
        out[at[order[often]]] = group[often]
        return out

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from places a and b on (a < b)."""
        run, n = np.zeros(len(a), np.int64), len(self.levels[0])
        for j in reversed(range(len(self.levels))):
            x, y = a + run, b + run
            inside = y + (1 << j) <= n
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            run += (inside & (self.levels[j][x] == self.levels[j][y]) & (self.levels[j][x] >= 0)).astype(np.int64) << j
        return run

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before places a and b (a < b)."""
        run = np.zeros(len(a), np.int64)
        for j in reversed(range(len(self.levels))):
            x, y = a - run - (1 << j), b - run - (1 << j)
            inside = x >= 0
            x, y = np.where(inside, x, 0), np.where(inside, y, 0)
            run += (inside & (self.levels[j][x] == self.levels[j][y]) & (self.levels[j][x] >= 0)).astype(np.int64) << j
        return run


def _seeds(name: np.ndarray, low: int, high: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of equal grams whose first one stands at a multiple of ``step`` and whose second one low..high-1 words later."""
    at = np.nonzero(name >= 0)[0]
    key = name[at].astype(np.int64) * (len(name) + 1) + at
    key.sort()
    anchor = at[at % step == 0]
    base = name[anchor].astype(np.int64) * (len(name) + 1)
    first = np.searchsorted(key, base + np.minimum(anchor + low, len(name)))
    count = np.searchsorted(key, base + np.minimum(anchor + high, len(name))) - first
    place = np.repeat(anchor, count)
    other = key[np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)] % (len(name) + 1)
    return place, other - place


def runs_of(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length, period of every run of the word numbers, in the order of start and period.

    A run of period q holds max(least - q, q) words or more that equal the word q later: its
    guaranteed overlap on the diagonal q.  Lags of 2k to 4k words are found by grams of k
    words at multiples of k: one lies in any such overlap.  A gram that occurs often within
    4k words is itself periodic, so the pairs of a level are in proportion to the words.
    On each diagonal the seeds in reach of the one before lie in the stretch it covers and
    are not extended again.  Of stretches with the same ends the least period stays.
    """
    none = np.zeros(0, np.int64)
    grams = Grams(words) if len(words) >= least else None
    found = []
    # (words of a gram as a power of two, lags, places of the first gram)
    short = max(1, (least + 1) // 2)  # least guaranteed overlap of all lags
    small = short.bit_length() - 1
    k = 1 << small
    classes = [(small, 1, 2 * k, short - k + 1)]
    while 2 * (1 << small) <= len(words):
        k = 1 << small
        classes.append((small, 2 * k, 4 * k, k))
        small += 1
    for level, low, high, step in classes:
        if grams is None or level >= len(grams.levels):
            break
        place, lag = _seeds(grams.levels[level], low, high, step)
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        # the furthest word covered on this diagonal: seeds side by side cover one stretch
        fresh = np.ones(len(place), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] - place[:-1] > (1 << level))
        place, lag = place[fresh], lag[fresh]
        back = grams.behind(place, place + lag)
        length = back + grams.ahead(place, place + lag) + lag
        keep = length >= np.maximum(least, 2 * lag)
        found.append((place[keep] - back[keep], length[keep], lag[keep]))
    if not found:
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) == 0


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in text_batches(batches, chars=PIECE_BYTES):
        # bytes.split() parts at just the six ASCII blanks
        words = [t.encode().split() if t else [] for t in batch.column("text").to_pylist()]
        at = total = 0
        for i, w in enumerate(words):
            if total and total + len(w) > PIECE_WORDS:
                yield batch.slice(at, i - at), words[at:i]
                at, total = i, 0
            total += len(w)
        yield batch.slice(at), words[at:]


def _found(least: int, keep: list[str]):
    def run(batches):
        for batch, texts in _pieces(batches):
            numbers, ends = [], []
            count = 0
            for words in texts:
                known: dict[bytes, int] = {}  # words of different texts get different numbers, so nothing crosses texts
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + count)
                count += len(known)
                ends.append(len(words))
            stop = np.cumsum(ends)
            start, length, period = runs_of(np.concatenate(numbers) if numbers else np.zeros(0, np.int64), least)
            owner = np.searchsorted(stop, start, side="right")
            first = stop - ends
            low, high = np.searchsorted(owner, np.arange(len(texts))), np.searchsorted(owner, np.arange(len(texts)), side="right")
            runs = pa.ListArray.from_arrays(pa.array(np.append(low, len(owner)).astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(start - first[owner]), pa.array(length), pa.array(period)], fields=list(RUN)))
            collapsed = []
            for i, words in enumerate(texts):
                if low[i] < high[i]:
                    own = slice(low[i], high[i])
                    words = [w for w, k in zip(words, _kept(len(words), start[own] - first[i], length[own], period[own]).tolist(), strict=True) if k]
                collapsed.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(ends, pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())],
                                             [*keep, "n_words", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, words from 0), collapsed of every row.

    A run is a stretch of ``least`` words or more, twice its smallest period or more, that
    no neighbouring word extends.  ``collapsed`` holds the words that no run contains after
    its first period, joined by one space.  Texts are read whole, each in one task; a
    text's memory is some 100 bytes a word.

    Null, empty and blank texts have no words, no runs and the empty text; equal rows get
    equal results, rows with a null id too; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_found(least, ["doc_id"]), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text by the checksum h of its id is made periodic from some word on.

    With n words, g = h / 10 and a = g % n, word i >= a becomes word a + (i - a) % p,
    p = 1 + (n - a) / (3 + g % 8).  Null ids and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string"))
    g = F.floor(h / 10).cast("long")

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
        return let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(v["w"], lambda w, i: F.when(
            i < v["a"], w).otherwise(F.get(v["w"], (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))), " "))

    changed = let(F.regexp_extract_all(text_of(), F.lit(f"({WORD})")), lambda w: F.when(F.size(w) > 0, periodic(w)).otherwise(F.lit("")))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.pmod(h, F.lit(10)) == 0, changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Numbers and digests of the runs: how many, the longest one (ties: least start, then period), all of them, and of the text that is left."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.back")).alias("start"), F.col("_longest.length").alias("length"),
        (-F.col("_longest.short")).alias("period"), F.floor(1000 * F.col("_longest.length") / -F.col("_longest.short")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
