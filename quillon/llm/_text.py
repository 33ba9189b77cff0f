"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D);
this equals the code point rule ``[^\\x20\\x09-\\x0D]+`` because UTF-8 continuation
bytes are never white space.  Hashes are 64-bit: a polynomial over random byte
values with an odd random base modulo 2**64, finished by a bit mixer.  Two given
different words share a hash with a chance near 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MASK = (1 << 64) - 1
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
SLICE_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser (Steele, Lea and Flood 2014), element-wise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


BYTE_VALUE = stream(101, 256)
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[ord("A") : ord("Z") + 1] = BYTE_VALUE[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
BASE = int(stream(7, 1)[0]) | 1
INVERSE = pow(BASE, -1, 1 << 64)


#: Values that are hashed at a time, so that the powers and prefix sums stay small; a longer span is hashed in pieces.
HASHED = 1 << 17


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, enough for two runs of HASHED values."""
    up, down = np.ones(1, dtype=U64), np.ones(1, dtype=U64)
    while len(up) <= 2 * HASHED:
        k = len(up)
        up = np.concatenate([up, up * U64(pow(BASE, k, 1 << 64))])
        down = np.concatenate([down, down * U64(pow(INVERSE, k, 1 << 64))])
    return up, down


def _long_hash(values: np.ndarray, start: int, end: int, table: np.ndarray | None) -> int:
    up, total = _powers()[0], 0
    for at in range(start, end, HASHED):
        part = values[at : min(end, at + HASHED)]
        part = table[part] if table is not None else part
        total += int(np.add.reduce(part * up[: len(part)], dtype=U64)) * pow(BASE, at - start, 1 << 64)
    return total & MASK


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hash of values[start:end] for each span, independent of where it lies; starts must not fall.

    With a table, table[value] is hashed in place of the value.
    """
    up, down = _powers()
    out = np.empty(len(starts), dtype=U64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = int(np.searchsorted(starts, base + HASHED))
        first, last = starts[lo:hi], ends[lo:hi]
        long = last - first > HASHED
        for k in np.flatnonzero(long).tolist():
            out[lo + k] = _long_hash(values, int(first[k]), int(last[k]), table)
        if not long.all():
            if long.any():
                first, last = first[~long], last[~long]
            part = values[base : int(last.max())]
            part = table[part] if table is not None else part
            total = np.empty(len(part) + 1, dtype=U64)
            total[0] = 0
            np.cumsum(part * up[: len(part)], out=total[1:])
            out[lo:hi][~long] = (total[last - base] - total[first - base]) * down[first - base]
        lo = hi
    return mix64(out)


def release() -> None:
    """Give freed memory back to the system: workers are reused, and what one stage took would count in the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """fn over a task's batches, memory released at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            release()

    return run


@dataclass
class Words:
    """Words of some documents: byte spans, hashes, and each document's range of words."""

    buf: np.ndarray  # bytes of all documents
    off: np.ndarray  # document d is buf[off[d]:off[d + 1]]
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # document d has the words first[d] to first[d + 1] - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word index of every k-word window inside one document, and its hash."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=U64)
        own = self.owner()
        at = np.flatnonzero(own[: len(own) - k + 1] == own[k - 1 :])
        return at, spans_hash(self.hashes, at, at + k)

    def text(self, d: int) -> bytes:
        return self.buf[self.off[d] : self.off[d + 1]].tobytes()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.empty(0, dtype=np.uint8)
    return buf, off - off[0] if len(texts) else np.zeros(1, dtype=np.int64)


def split(texts: pa.Array, fold: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words of every text, between bytes of space; fold lower-cases A-Z for the hashes."""
    buf, off = raw(texts)
    word = ~space[buf]
    start, end = word.copy(), word.copy()
    if len(buf):
        start[1:] &= ~word[:-1]
        end[:-1] &= ~word[1:]
        full = off[:-1] < off[1:]
        at = off[:-1][full]
        start[at] |= word[at]
        at = off[1:][full] - 1
        end[at] |= word[at]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    hashes = spans_hash(buf, starts, ends, FOLDED_VALUE if fold else BYTE_VALUE)
    return Words(buf, off, starts, ends, hashes, np.searchsorted(starts, off))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes of text; a longer text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def mapper(fn: Callable[..., Iterator[dict]], schema: pa.Schema, text: str = "text", fold: bool | None = False, space: np.ndarray = SPACE):
    """A function for mapInArrow: fn(rows, words) gives column dicts for each slice of rows.

    words is None if fold is None.  Columns must come in the schema's order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for lo, hi in slices(batch.column(at)):
                rows = batch.slice(lo, hi - lo)
                for out in fn(rows, None if fold is None else split(rows.column(at), fold, space)):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in schema], schema=schema)

    return tidy(run)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all the ranges [start, start + length) one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift
