"""Removal of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import bitmap, has_bit, row_key, stored
from facetry.llm.phrases import GRAM, Rolling, parse

#: What a row of phrases or events is.
MARK, ASK, COMPARE, PHRASE = 0, 1, 2, 3
PHRASE_ROWS = "key long, full long, row long, low int, high int, kind int, many boolean"
EVENTS = "row long, low int, high int, kind int"
PIECE = 3_000_000


def _buffers(rows: Iterator[tuple[int, bytes]], span: int, size: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, row of each text, offset of each text in its row): texts side by side, about ``size`` bytes at a time.

    A longer text is cut into stretches that overlap by span - 1 bytes, so each of its
    windows lies in exactly one of them.
    """
    held, total = [], 0
    for row, data in rows:
        at = 0
        while True:
            part = data[at:at + size + span - 1]
            held.append((row, at, part))
            total += len(part)
            if total >= size:
                yield _packed(held)
                held, total = [], 0
            at += size
            if at + span > len(data):
                break
    if held:
        yield _packed(held)


def _packed(held):
    return (np.frombuffer(b"".join(h[2] for h in held), np.uint8), np.cumsum([len(h[2]) for h in held]),
            np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.nonzero(new)[0]


def _merged(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching stretches of each row."""
    if not len(row):
        return row, low, high
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order].astype(np.int64), high[order].astype(np.int64)
    group = np.cumsum(np.concatenate(([False], row[1:] != row[:-1])))
    reach = np.maximum.accumulate(high + group * (1 << 33)) - group * (1 << 33)
    first = np.concatenate(([0], np.nonzero((row[1:] != row[:-1]) | (low[1:] > reach[:-1]))[0] + 1))
    return row[first], low[first], np.maximum.reduceat(high, first)


def _phrase_batch(key, full, row, low, high, kind, many):
    as_long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    return pa.RecordBatch.from_arrays([as_long(key), as_long(full), pa.array(row), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                                       pa.array(np.full(len(row), kind, np.int32)), pa.array(many)], ["key", "full", "row", "low", "high", "kind", "many"])


def _parsed(span: int, window: int):
    """Phrases of the texts.  Phrases met twice in one piece are marked at once, and one of them stands for the others."""
    def texts(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode()
                if len(data) >= span:
                    yield row, data

    def run(batches):
        for data, ends, rows, offsets in _buffers(texts(batches), span):
            found = parse(data, ends, span, window)
            if found is None:
                continue
            start = np.concatenate(([0], ends[:-1]))[found.text] - offsets[found.text]
            row, low, high = rows[found.text], found.low - start, found.high - start
            order = np.lexsort((found.full, found.key))
            key, full, row, low, high = (x[order] for x in (found.key, found.full, row, low, high))
            first = _runs(key, full)
            count = np.diff(np.concatenate((first, [len(key)])))
            again = np.repeat(count > 1, count)
            mark = _merged(row[again], low[again], high[again] + span)
            spread = mark[0].view(np.uint64)
            yield _phrase_batch(spread, spread, *mark, MARK, np.zeros(len(mark[0]), bool))
            yield _phrase_batch(key[first], full[first], row[first], low[first], high[first], PHRASE, count > 1)
    return run


def _events(row, low, high, kind):
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                                       pa.array(np.broadcast_to(kind, row.shape).astype(np.int32))], ["row", "low", "high", "kind"])


def _classified(span: int):
    """Phrases in the order of (key, full): equal phrases are marked; keys with several phrases have their windows compared.

    A run of equal phrases is carried over the end of a batch as one row, so no group is
    ever held, whatever its size.
    """
    def run(batches):
        carry, before = None, False  # the last phrase, and whether another one of its key came before it
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "full", "row", "low", "high", "kind", "many")}
            marks = cols["kind"] == MARK
            if marks.any():
                yield _events(cols["row"][marks], cols["low"][marks], cols["high"][marks], MARK)
            cols = {c: v[~marks] for c, v in cols.items()}
            if carry is not None:
                cols = {c: np.concatenate((carry[c], v)) for c, v in cols.items()}
            if not len(cols["row"]):
                continue
            key, row, low, high, many = (cols[c] for c in ("key", "row", "low", "high", "many"))
            first = _runs(key, cols["full"])
            count = np.add.reduceat(1 + many.astype(np.int64), first)
            each = np.diff(np.concatenate((first, [len(row)])))
            twice = np.repeat(count > 1, each) & ~many
            yield _events(row[twice], low[twice], high[twice] + span, MARK)
            same = key[first][1:] == key[first][:-1]
            other = np.concatenate(([before], same)) | np.concatenate((same, [False]))
            other[-1] = False  # it may go on in the next batch
            rep = first[other]
            yield _events(row[rep], low[rep], high[rep], np.where(count[other] > 1, COMPARE, ASK))
            carry = {c: v[first[-1]:first[-1] + 1].copy() for c, v in cols.items()}
            carry["many"][0] = count[-1] > 1
            before = bool(same[-1]) if len(same) else before
        if carry is not None and before:
            yield _events(carry["row"], carry["low"], carry["high"], np.where(carry["many"], COMPARE, ASK))
    return run


def _windows(span: int):
    """Fingerprints of the windows that are to be compared: the rolling hash of all their bytes and another one of their ends."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for row, text, asked in zip(*(batch.column(c).slice(i, 256).to_pylist() for c in ("row", "text", "asked")), strict=True):
                    data = np.frombuffer(text.encode(), np.uint8)
                    for low, high, kind in ((a["low"], a["high"], a["kind"]) for a in asked):
                        rolling = Rolling(data[low:high + span])
                        p = np.arange(high - low + 1)
                        ends = rolling.of(p, p + GRAM) ^ rolling.of(p + span - GRAM, p + span)
                        out.append((rolling.of(p, p + span), ends >> np.uint64(33), np.full(len(p), row, np.int64), low + p, np.full(len(p), kind)))
                if not out:
                    continue
                code, tag, row, at, kind = (np.concatenate(x) for x in zip(*out, strict=True))
                order = np.lexsort((kind, tag, code))
                code, tag, row, at, kind = (x[order] for x in (code, tag, row, at, kind))
                first = _runs(code, tag)
                count = np.diff(np.concatenate((first, [len(row)])))
                again = np.repeat(count > 1, count) & (kind == ASK)
                mark = _merged(row[again], at[again], at[again] + span)
                spread = mark[0].view(np.uint64)
                yield _phrase_batch(spread, spread, *mark, MARK, np.zeros(len(mark[0]), bool))
                # what was marked here, and what needs no mark, only stands for its window
                yield _phrase_batch(code[first], tag[first], row[first], at[first], at[first], PHRASE, (count > 1) | (kind[first] == COMPARE))
    return run


def _met(span: int):
    """Windows in the order of their fingerprints: equal ones are marked, stretches of a row as one."""
    def run(batches):
        carry = None
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "full", "row", "low", "high", "kind", "many")}
            marks = cols["kind"] == MARK
            if marks.any():
                yield _events(cols["row"][marks], cols["low"][marks], cols["high"][marks], MARK)
            cols = {c: v[~marks] for c, v in cols.items()}
            if carry is not None:
                cols = {c: np.concatenate((carry[c], v)) for c, v in cols.items()}
            if not len(cols["row"]):
                continue
            first = _runs(cols["key"], cols["full"])
            each = np.diff(np.concatenate((first, [len(cols["row"])])))
            # rows of ``seen`` were counted before this batch
            twice = np.repeat(each > 1, each) & ~cols["many"]
            yield _events(*_merged(cols["row"][twice], cols["low"][twice], cols["low"][twice] + span), MARK)
            carry = {c: v[first[-1]:first[-1] + 1].copy() for c, v in cols.items()}
            carry["many"][0] |= each[-1] > 1
    return run


def _sifted(wanted):
    """Texts whose bit is set stay; the others are finished here."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            hit = has_bit(wanted.value, batch.column("row").to_numpy())
            texts = batch.column("text").to_pylist()
            raw = [b"" if h else (t or "").encode() for h, t in zip(hit, texts, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"), "text": pa.array([t if h else None for h, t in zip(hit, texts, strict=True)], pa.string()),
                "n_bytes": pa.array([len(b) for b in raw], pa.int64()),
                "kept_sha256": pa.array([None if h else hashlib.sha256(b).hexdigest() for h, b in zip(hit, raw, strict=True)], pa.string())})
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows: the marked stretches of each text are merged and taken out."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))]
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            if row["text"] is None:
                out.append((row["doc_id"], row["n_bytes"], 0, 0, row["kept_sha256"], []))
                continue
            data, marks = row["text"].encode(), row["marks"] or []
            low, high = np.array([m["low"] for m in marks], np.int64), np.array([m["high"] for m in marks], np.int64)
            _, low, high = _merged(np.zeros(len(low), np.int64), low, high)
            cuts = list(zip(low.tolist(), high.tolist(), strict=True))
            digest, at = hashlib.sha256(), 0
            for a, b in cuts:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((row["doc_id"], len(data), int((high - low).sum()), len(cuts), digest.hexdigest(), [{"low": a, "high": b} for a, b in cuts]))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(len(names))], names)


def remove_repeats(docs: DataFrame, span: int = 400, window: int = 128) -> DataFrame:
    """Spans of every text that are covered by ``span``-byte strings which start somewhere else as well.

    Texts are parsed into phrases at rolling-hash triggers; every ``span``-byte window
    belongs to one phrase, chosen by its own bytes alone.  The dictionary of phrases is
    put in order by key and content: equal phrases repeat all their windows.  Phrases that
    share only the key part with others (where a repeated passage begins or ends) have
    their windows fingerprinted and compared.  The order is needed only as far as ``span``
    bytes, so fingerprints of stretches stand for ranks in the suffix arrays of dictionary
    and parse.

    Windows never cross texts.  Null and empty texts have 0 bytes; texts shorter than
    ``span`` lose nothing; equal rows lose all their windows; an empty table gives no rows.
    A text of any length is parsed in stretches of 3 MB.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.
    """
    if window - 1 + GRAM > span:
        raise ValueError("a trigger must lie inside its window")
    texts = docs.select(row_key().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    whole = texts.select("row", "text")
    phrases = whole.mapInArrow(_parsed(span, window), PHRASE_ROWS)
    events = stored(phrases.repartition("key").sortWithinPartitions("key", "full").mapInArrow(_classified(span), EVENTS), "repeat-events")
    # the phrases of one text, so a list is bounded by the text
    asked = events.where(f"kind <> {MARK}").groupBy("row").agg(F.collect_list(F.struct("low", "high", "kind")).alias("asked"))
    wanted = bitmap(events.where(f"kind <> {MARK}"), "row")
    some = whole.mapInArrow(_only(wanted), "row long, text string")
    windows = some.join(asked, "row").mapInArrow(_windows(span), PHRASE_ROWS)
    more = windows.repartition("key").sortWithinPartitions("key", "full", "row", "low").mapInArrow(_met(span), EVENTS)
    marks = stored(events.where(f"kind = {MARK}").unionByName(more).select("row", "low", "high"), "repeat-marks")
    stretches = marks.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("marks"))
    sifted = texts.mapInArrow(_sifted(bitmap(marks, "row")), "row long, doc_id long, text string, n_bytes long, kept_sha256 string")
    return sifted.join(stretches, "row", "left").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<low:int,high:int>>")


def _only(wanted):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(has_bit(wanted.value, batch.column("row").to_numpy())))
    return run
