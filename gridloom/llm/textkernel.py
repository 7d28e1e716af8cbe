"""Vectorised word work over Arrow text columns.

A batch of texts is one buffer of UTF-8 bytes. Word bounds come from a table
lookup. The hash of a span takes its bytes in blocks of eight, each through a
finaliser that spreads all bits (a chain, no polynomial, so that no regular
family of strings collides); spans over ``LONGEST`` bytes end in a cryptographic
digest. No Python object is made for a shorter one. Equal spans have equal
hashes; two different ones collide with a chance of about 2**-64.

Memory is about 15 bytes for each byte of a slice, or of a text that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SPAN = 1 << 19
#: Bytes of a span that are hashed block by block.
LONGEST = 512
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer, with zeros behind the end; a view of a copy."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def span_hashes(data: np.ndarray, eight: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of each data[low:high]; ``eight`` is eights(data)."""
    size = high - low
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x5851F42D4C957F2D))
    h = mix(h ^ (eight[low] & _MASKS[np.minimum(size, 8)]))
    at, done = np.flatnonzero(size > 8), 8
    while len(at) and done < LONGEST:
        h[at] = mix(h[at] ^ (eight[low[at] + done] & _MASKS[np.minimum(size[at] - done, 8)]))
        done += 8
        at = at[size[at] > done]
    if len(at):
        rest = [int.from_bytes(blake2b(data[a + done : b], digest_size=8).digest(), "little") for a, b in zip(low[at].tolist(), high[at].tolist(), strict=True)]
        h[at] = mix(h[at] ^ np.array(rest, np.uint64))
    return h


def text_slices(batch: pa.RecordBatch, column: int = 1, span: int = SPAN) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) of parts of the batch with about ``span`` bytes; null is empty."""
    texts = batch.column(column)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    if texts.null_count:
        # a null row may own bytes; these are not part of any text
        sizes = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        if sizes.sum() != offsets[-1] - offsets[0]:
            data = np.frombuffer("".join(t or "" for t in texts.to_pylist()).encode(), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    low = 0
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + span, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Words:
    """Word bounds and hashes of one slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool, hashed: bool = True):
        self.data, self.offsets = data, offsets
        n = len(data)
        space = _SPACE[data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = space[:-1]
        edge[offsets] = True
        inside = ~space
        self.starts = np.flatnonzero(inside & edge[:n])
        edge = np.ones(n + 1, bool)
        edge[: n - 1] = space[1:] if n else False
        last = offsets[offsets > 0] - 1
        edge[last] = True
        self.ends = np.flatnonzero(inside & edge[:n]) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of the texts' words
        self.counts = np.diff(self.first)
        self.read = _FOLDED[data] if fold else data
        self.eight = eights(self.read)
        if hashed:
            self.hashes = self.span_hash(self.starts, self.ends)

    def span_hash(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of bytes[low:high]."""
        return span_hashes(self.read, self.eight, low, high)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` words that starts at a word, and whether the run lies within its text."""
        h = self.hashes
        n = len(h)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                if n > k:
                    out[: n - k] = out[: n - k] * np.uint64(0xD1342543DE82EF95) + h[k:]
        last = np.repeat(self.first[1:], self.counts)
        return mix(out), np.arange(n) + size <= last

    def places_by_text(self, places: np.ndarray) -> np.ndarray:
        """How many of the ascending places fall into each text."""
        return np.diff(np.searchsorted(places, self.offsets))


class Sent:
    """Keys that a task has sent twice already.

    A bucket that gathers keys has to learn that a key occurs twice, not how
    often. What a task sent twice is known to be shared: its later owners need
    no answer. A table of fixed size holds keys by their low bits; a key that
    was sent twice keeps its slot. So a key that all texts have reaches its
    bucket about twice for each task.
    """

    def __init__(self, slots: int = 1 << 18):
        self.key, self.times = np.zeros(slots, np.uint64), np.zeros(slots, np.uint8)

    def split(self, keys: np.ndarray) -> np.ndarray:
        """Of ascending keys, whether each is to be sent; the others are shared for certain."""
        if not len(keys):
            return np.zeros(0, bool)
        new = np.append(True, keys[1:] != keys[:-1])
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        nth = np.arange(len(keys)) - head[group]
        own = keys[head]
        slot = (own & np.uint64(len(self.key) - 1)).astype(np.int64)
        held = self.key[slot] == own
        times = np.where(held, self.times[slot], 0)
        send = nth < np.maximum(2 - times.astype(np.int64), 0)[group]
        after = np.minimum(times + np.bincount(group[send], minlength=len(own)), 2).astype(np.uint8)
        put = np.flatnonzero(held | (self.times[slot] < 2))
        _, first = np.unique(slot[put], return_index=True)
        put = put[first]
        self.key[slot[put]], self.times[slot[put]] = own[put], after[put]
        return send
