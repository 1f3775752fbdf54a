"""Prefix-free parsing of byte texts: rolling-hash triggers, phrases and their fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from facetry.llm.common import mix

#: Bytes whose rolling hash makes a trigger.
GRAM = 16
_LOW = np.uint64((1 << 24) - 1)
_B = 0x9E3779B97F4A7C15
_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the next piece."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _B), ("down", pow(_B, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hash of any stretch of a buffer in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


@dataclass
class Phrases:
    """One row a phrase: the windows low..high of its text share the trigger; start is where its text begins in the buffer."""

    text: np.ndarray
    low: np.ndarray
    high: np.ndarray
    trigger: np.ndarray
    key: np.ndarray
    full: np.ndarray
    rolling: Rolling


def least_in_window(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each run of ``window`` values, from running minima of blocks."""
    n = len(values) - window + 1
    padded = np.full(-(-len(values) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[window - 1:window - 1 + n])


def parse(data: np.ndarray, ends: np.ndarray, span: int, window: int) -> Phrases | None:
    """Phrases of the texts that lie one after the other in ``data`` and end at ``ends``.

    The trigger of the window that starts at p is the least rolling hash among the
    ``window`` grams from p on, the last one of equals: equal windows have equal triggers,
    and every window has one.  A phrase is the run of windows with one trigger.  Its key is
    what all its windows hold from the trigger on; ``full`` covers every byte of them.
    """
    n = len(data)
    if n < span:
        return None
    rolling = Rolling(data)
    at = np.arange(n - GRAM + 1)
    grams = rolling.of(at, at + GRAM)
    marked = (grams & ~_LOW) | (_LOW - at.astype(np.uint64))
    trigger = (_LOW - (least_in_window(marked, window) & _LOW)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    usable = np.maximum(0, ends - starts - span + 1)
    total = int(usable.sum())
    if not total:
        return None
    text = np.repeat(np.arange(len(ends)), usable)
    p = np.arange(total) - np.repeat(np.cumsum(usable) - usable, usable) + np.repeat(starts, usable)
    trigger = trigger[p]
    first = np.nonzero(np.concatenate(([True], (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1]))))[0]
    last = np.concatenate((first[1:], [total])) - 1
    low, high, trigger, text = p[first], p[last], trigger[first], text[first]
    key = rolling.of(trigger, trigger + (span - window + 1))
    shape = ((trigger - low).astype(np.uint64) << np.uint64(32)) | (trigger - high).astype(np.uint64)
    return Phrases(text, low, high, trigger, key, mix(rolling.of(low, high + span) ^ mix(shape)), rolling)
