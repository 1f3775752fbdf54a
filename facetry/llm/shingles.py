"""Words of whole texts as 64-bit hashes, and their shingles as sorted arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from facetry.llm.common import mix
from facetry.llm.phrases import Rolling

#: Odd multipliers, one a place, and one for each number of words.
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
LENGTH = np.array([n * 0xE7037ED1A0B428DB % (1 << 64) for n in range(6)], np.uint64)
#: A-Z to a-z; the six blanks of the contract.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Bytes of text that are hashed at once: hashing takes about 40 bytes a byte.
HASHED = 1 << 20


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after the other, and the number of words of each text; null texts have none.

    Works on the bytes of the Arrow column at once: a word is a run of other bytes than
    the six blanks, inside one text, and its hash a stretch of a rolling hash.
    """
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = _LOWER[np.frombuffer(data, np.uint8)[ends[0]:ends[-1]]]
    ends -= ends[0]
    solid = np.empty(len(raw) + 1, bool)
    np.logical_not(_BLANK[raw], out=solid[:-1])
    solid[-1] = False
    first = solid[:-1].copy()
    first[1:] &= ~solid[:-2]
    begin = ends[:-1][ends[:-1] < len(raw)]
    first[begin] = solid[begin]  # a text begins a word whatever stands before it
    last = solid[:-1] & ~solid[1:]
    stop = ends[1:][ends[1:] > 0] - 1
    last[stop] = solid[stop]
    start, end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    return Rolling(raw).of(start, end), np.diff(np.searchsorted(start, ends))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 5-word shingle hashes of each text; shorter texts are one shingle, texts without words none."""
    return [own for part in _parts(texts) for own in _shingles(part)]


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of the texts of about ``HASHED`` bytes; a longer text is one."""
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + HASHED, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def _shingles(texts: pa.Array) -> list[np.ndarray]:
    flat, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    full = np.zeros(max(0, len(flat) - 4), np.uint64)
    for i in range(5):
        full += flat[i:i + len(full)] * PLACE[i]
    full = mix(full + LENGTH[5])
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        if size >= 5:
            own = np.sort(full[end - size:end - 4])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif size:
            out.append(mix(np.array([(flat[end - size:end] * PLACE[:size]).sum(dtype=np.uint64)], np.uint64) + LENGTH[size]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    value = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return value - (1 << 64) if value >> 63 else value


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 2048, chars: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that no piece has more than ``rows`` rows, or much more than ``chars`` bytes unless one text does."""
    for batch in batches:
        at = 0
        column = batch.column(batch.schema.get_field_index("text"))
        while at < batch.num_rows:
            take = min(rows, batch.num_rows - at)
            while take > 1 and column.slice(at, take).nbytes > chars:
                take = (take + 1) // 2
            yield batch.slice(at, take)
            at += take
